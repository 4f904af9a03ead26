"""Op 6 [native]: sharding by a k-d tree of distributed weighted medians.

Every row has a few bounded integer coordinates made from its metadata.  A node
that stands for k shards is split at the weight fraction floor(k/2)/k along the
dimension in which its rows are widest, widths being shares of the dimension's
range over all rows, and its halves are split again until a node stands for one
shard; with the default shard count, leaves so hold ``total / shards`` bytes each,
whose target may be given instead.

Cut values are found exactly enough without sorting: all nodes of a level are
refined together by histograms over the key range that still holds the median,
up to 1024 cells for each pass, until the cell weighs less than ``tolerance`` of
a leaf.  A key is the coordinate, then the text's CRC-32, then a hash of the
identifier.  Equal texts share their coordinates (those of the group's smallest
metadata) and stay together: cuts fall between texts, unless one text weighs more
than ``whole`` of a leaf and must be cut for shards to be near equal, as a group
of copies that fills a third of the table must.  The passes run over a narrow
table (no text); the driver gets about a million numbers a pass at most, and the
tables of a level are joined by broadcast, one row for each open node.

Slots are numbered by chunks (``common.slots``), so no task sorts a whole shard.

Defined cases: null text has no bytes (size 16) and CRC 0; null metadata is a
coordinate of its own; a null identifier is hashed like any other; rows that
repeat are separate rows, and may all lie in one shard since nothing tells them
apart; ties in a coordinate go by CRC and identifier; an empty table gives no
rows; texts may have any length; extra columns are not used.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletlab.llm.common import column, slots, small, stash

COORDINATE_BITS, CRC_BITS, ID_BITS = 16, 28, 18
_LOW = CRC_BITS + ID_BITS


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from driver values, by SQL functions alone."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _key(dims: list[str], dim: str) -> str:
    return f"(shiftleft(array({', '.join(f'cast({d} as bigint)' for d in dims)})[{dim}], {_LOW}) + _low)"


def kd_assign(rows: DataFrame, dims: list[str], weight: str, shards: int, tolerance: float = 0.002, whole: float = 0.01) -> DataFrame:
    """``rows`` with a column ``shard``.  ``rows`` holds the dims (integers of
    COORDINATE_BITS), ``_low`` (CRC_BITS + ID_BITS) and the weight."""
    if shards == 1:
        return rows.withColumn("shard", F.lit(0))
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    slack, group = max(1.0, tolerance * float(total) / shards), whole * float(total) / shards
    rows = rows.withColumn("_node", F.lit(0).cast("long"))
    open_nodes, named, full, depth = {0: (0, shards)}, 1, None, 0
    while open_nodes:
        ends = [f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
        spans = {r["_node"]: r for r in rows.where("_node >= 0").groupBy("_node").agg(F.sum(weight).alias("w"), *ends).collect()}
        if full is None:
            full = [max(1, spans[0][f"hi{i}"] - spans[0][f"lo{i}"]) if spans else 1 for i in range(len(dims))]
        search = {}  # node -> [dim, lo, hi, weight below lo, wanted weight]
        for k, (_, n) in open_nodes.items():
            if (r := spans.get(k)) is None:
                search[k] = [0, 0, 0, 0, 0]
                continue
            d = max(range(len(dims)), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"]) / full[i])
            search[k] = [d, r[f"lo{d}"] << _LOW, (r[f"hi{d}"] + 1) << _LOW, 0, r["w"] * (n // 2) / n]
        active = set(spans)
        while active:
            cells = max(16, min(1024, (1 << 20) // len(active)))
            step = {}
            for k in active:
                step[k] = -(-(search[k][2] - search[k][1]) // cells)
                if search[k][2] - search[k][1] > 1 << ID_BITS:  # cuts between texts
                    step[k] = -(-step[k] >> ID_BITS) << ID_BITS
            state = _local(spark, [{"n": k, "d": search[k][0], "a": search[k][1], "b": search[k][2], "s": step[k]} for k in sorted(active)], "n: bigint, d: int, a: bigint, b: bigint, s: bigint")
            here = rows.join(F.broadcast(state), F.col("_node") == F.col("n")).select("n", "a", "b", "s", weight, F.expr(_key(dims, "d")).alias("k")).where("k >= a AND k < b")
            by: dict[int, dict[int, int]] = {}
            for r in here.groupBy("n", F.expr("(k - a) div s").alias("cell")).agg(F.sum(weight).alias("w")).collect():
                by.setdefault(r["n"], {})[r["cell"]] = r["w"]
            for k in sorted(active):
                s, w = search[k], by.get(k, {})
                below, lo, x, cell = s[3], s[1], 0, 0
                for cell in sorted(w):
                    x = w[cell]
                    if below + x >= s[4]:
                        break
                    below += x
                s[1], s[2], s[3] = lo + cell * step[k], min(lo + (cell + 1) * step[k], s[2]), below
                one_text = s[2] - s[1] <= 1 << ID_BITS
                if x <= slack or s[2] - s[1] <= 1 or (one_text and x <= group):
                    s[1] = s[1] if s[4] - below < below + x - s[4] else s[2]
                    active.discard(k)
        later, table = {}, []
        for k, (first, n) in open_nodes.items():
            sides = []
            for f, m in ((first, n // 2), (first + n // 2, n - n // 2)):
                if m > 1:
                    later[named] = (f, m)
                    sides.append(named)
                    named += 1
                else:
                    sides.append(-1 - f)
            table.append({"n": k, "d": search[k][0], "c": search[k][1], "l": sides[0], "r": sides[1]})
        names = [c for c in rows.columns if c != "_node"]
        level = _local(spark, table, "n: bigint, d: int, c: bigint, l: bigint, r: bigint")
        step_down = F.expr(f"CASE WHEN n IS NULL THEN _node WHEN {_key(dims, 'd')} < c THEN l ELSE r END").alias("_node")
        rows = rows.join(F.broadcast(level), F.col("_node") == F.col("n"), "left").select(*names, step_down)
        open_nodes, depth = later, depth + 1
        if depth % 4 == 0 and open_nodes:
            rows = stash(rows, "shard-level")
    return rows.withColumn("shard", (-1 - F.col("_node")).cast("int")).drop("_node")


def _coordinate(c: Column) -> Column:
    """Equal values to equal places; order has no meaning."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << COORDINATE_BITS))).cast("int")


def coordinates(docs: DataFrame, id_col: str, text_col: str, labels: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """The narrow table: _id, size, text_crc32, the dims and ``_low``; equal texts
    have equal dims."""
    text = column(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    dims = [*[f"_d{i}" for i in range(len(labels))], "_size"]
    raw = docs.select(
        column(id_col).alias("_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"),
        *[_coordinate(column(c)).alias(f"_d{i}") for i, c in enumerate(labels)],
        F.least(F.lit((1 << COORDINATE_BITS) - 1), F.floor(F.log2(size.cast("double")) * 2_000)).cast("int").alias("_size"),
        (F.shiftleft(F.shiftright(crc, 32 - CRC_BITS), ID_BITS) + F.pmod(F.xxhash64(column(id_col)), F.lit(1 << ID_BITS))).alias("_low"),
    )
    raw = stash(raw, "shard-rows")
    # texts whose copies have different metadata; most texts need no partner
    differ = F.lit(False)
    for d in dims[:-1]:
        differ = differ | (F.col(f"{d}_lo") < F.col(f"{d}_hi"))
    groups = raw.groupBy(F.col("size").alias("g_size"), F.col("text_crc32").alias("g_crc"), F.col("_h").alias("g_h")).agg(*[f(d).alias(f"{d}_{n}") for d in dims[:-1] for n, f in (("lo", F.min), ("hi", F.max))]).where(differ)
    groups = stash(groups, "shard-groups")
    if groups.isEmpty():
        return raw, dims
    same = (F.col("size") == F.col("g_size")) & (F.col("text_crc32") == F.col("g_crc")) & (F.col("_h") == F.col("g_h"))
    joined = raw.join(small(groups), same, "left").select("_id", "size", "text_crc32", *[F.coalesce(f"{d}_lo", d).alias(d) for d in dims[:-1]], "_size", "_low")
    return stash(joined, "shard-rows"), dims


def shard_documents(docs: DataFrame, shards: int = 40, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", labels: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row.
    ``target_bytes`` sets the number of shards from the total instead."""
    rows, dims = coordinates(docs, id_col, text_col, labels)
    if target_bytes:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shards = max(1, -(-total // target_bytes))
    placed = kd_assign(rows, dims, "size", shards)
    numbered = slots(placed.select("_id", "size", "text_crc32", "shard", "_low"), ["shard"], ["_low", "_id"], "slot")
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)
