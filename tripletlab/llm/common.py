"""Helpers shared by the training-data operators.

* ``stash``       cuts lineage with a table in the shared checkpoint folder;
* ``Words``       vectorised word splitting and hashing over an Arrow buffer;
* ``components``  distributed connected components;
* ``slots``       gapless numbering without one big sort task.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of our own
    only where the session names none and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tripletlab-"))
    return _OWN_DIR[0]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tripletlab/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps restart
    from the files instead of recomputing, also after an executor is lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the written tables of all operators in the shared folder, once
    nothing that reads them is left to be computed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tripletlab")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_mark(text: Column) -> Column:
    """With an identifier, tells rows apart that repeat it with another text."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole, F.octet_length(whole))


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------
# 64-bit arithmetic on numpy arrays (wraps modulo 2**64)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (public domain constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _PowerTable:
    """base**i and base**-i for i up to the longest run asked for so far."""

    def __init__(self) -> None:
        self.up = _powers(_BASE, 1 << 12)
        self.down = _powers(_INV, 1 << 12)

    def need(self, n: int) -> None:
        if len(self.up) <= n:
            m = 1 << int(n).bit_length()
            self.up, self.down = _powers(_BASE, m), _powers(_INV, m)


_POW = _PowerTable()
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """All words of a run of texts, split at space and U+0009..U+000D.

    ``doc[i]`` is the row of word i, ``start[i]``/``end[i]`` its byte range in
    ``data``, ``hash[i]`` a 64-bit hash of its bytes; ``first[d]``/``first[d+1]``
    bound the words of row d.  Nulls count as empty.  Memory: about 40 bytes
    for each text byte, so callers feed it in pieces (see ``pieces``)."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64, count=n + 1, offset=texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        lo, hi = int(off[0]), int(off[-1])
        data = np.frombuffer(raw, np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
        off = off - lo
        self.data, self.offsets = data, off
        inside = ~_SPACE[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        cuts = off[1:-1]
        cuts = cuts[cuts < len(data)]
        begin[cuts] = inside[cuts]
        self.start = np.flatnonzero(begin)
        stop = np.zeros(len(data) + 1, bool)
        stop[1:][inside] = True
        stop[:-1] &= ~inside  # a word ends where the next byte is outside
        ends = np.zeros(len(data) + 1, bool)
        ends[:-1] = stop[:-1]
        ends[cuts[(cuts > 0)]] |= inside[cuts[(cuts > 0)] - 1]
        if len(data) and inside[-1]:
            ends[-1] = True
        self.end = np.flatnonzero(ends)
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, off, side="left")
        _POW.need(len(data) + 1)
        acc = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _POW.up[: len(data)], out=acc[1:])
        self.hash = mix((acc[self.end] - acc[self.start]) * _POW.down[self.start] + np.uint64(1))

    def spans(self, table: np.ndarray):
        """A function (start, end) -> hashes of byte ranges, each byte standing
        for ``table[byte]`` (to fold case, for instance)."""
        acc = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[table][self.data] * _POW.up[: len(self.data)], out=acc[1:])
        return lambda a, b: mix((acc[b] - acc[a]) * _POW.down[a] + np.uint64(1))

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, 64-bit hash) of every run of k words that
        stays inside one row."""
        h = self.hash if hashes is None else hashes
        n = len(h)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        _POW.need(n + 1)
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _POW.up[:n], out=acc[1:])
        return at, mix((acc[at + k] - acc[at]) * _POW.down[at])

    def text(self, a: int, b: int) -> bytes:
        """Bytes from word a up to the end of word b - 1."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes()


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of a batch that hold about ``limit`` text bytes (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    group = (np.cumsum(size) - size) // limit
    cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [n]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield batch.slice(a, b - a)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --------------------------------------------------------------------------


def _forest(batches):
    """Spanning forest of an edge list by union-find: (node, component)."""
    us, vs = [], []
    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
    if not us:
        return
    u, v = np.concatenate(us), np.concatenate(vs)
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    root = np.arange(len(nodes))
    while len(a):  # hook the larger root on the smaller one, then compress
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = root[a], root[b]
        differ = a != b
        a, b = a[differ], b[differ]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = 1_000_000, rounds: int = 60) -> DataFrame:
    """Connected components of an edge list of longs: rows (node, component),
    component being the smallest node that can be reached.

    Up to ``one_task`` edges (16 MB) one executor task joins them by union-find.
    Beyond, large-star and small-star steps alternate, which shrinks paths fast
    and keeps each node's neighbours spread over both ends; each round is two
    grouped minima with joins on the node, written to the shared folder.  Both
    ways give the same rows; only one row of counts comes to the driver."""
    e = stash(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(),
        "edges",
    )
    if e.count() <= one_task:
        return e.repartition(1).mapInArrow(_forest, "node long, component long")
    before = None
    for _ in range(rounds):
        # large star: every neighbour larger than u is linked with u's smallest
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every neighbour not larger than u is linked with the smallest
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low2, "u")
        e2 = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stash(e2, "edges")
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1000003), F.lit(0)).alias("h")).first()
        if now == before or now["n"] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def slots(df: DataFrame, group: list[str], order: list, out: str, chunk: int = 100_000, spread: str = "_spread") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without gaps.

    A group is cut into chunks by a hash of the ``order`` columns, chunk sizes
    are summed first (a small table), and rows are numbered inside their chunk,
    so no task has to sort a whole group.  The number of chunks follows the
    row count, which is one aggregate over a narrow table."""
    rows = df.agg(F.count("*")).first()[0]
    m = max(1, -(-rows // chunk))
    keyed = df.withColumn(spread, F.pmod(F.xxhash64(*order), F.lit(m)))
    sizes = keyed.groupBy(*group, spread).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(spread).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*group, spread).orderBy(*order)
    numbered = keyed.withColumn("_r", F.row_number().over(inner))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*group, spread)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return numbered.alias("n").join(starts.alias("s"), cond).select(
        *[F.col(f"n.{c}") for c in df.columns], (F.col("_r") - 1 + F.col("_base")).cast("long").alias(out)
    )
