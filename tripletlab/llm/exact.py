"""Op 5: exact deduplication with Patricia-trie owners.

Two rows are copies when their texts are identical after lower-casing A-Z.
Candidate partitions are formed by (length, content hash).  Inside one, full
byte strings go into a compressed radix trie whose terminal nodes hold the owner
(smallest or, for the query, largest identifier) and the number of copies, so
the decision rests on the bytes and never on a hash.

Copies meet in two steps.  Each task first builds tries over the rows it reads,
so a text that fills a third of the table leaves a task once; when a trie holds
more bytes than its budget, its heaviest subtree is spilled, that is, its
terminals are sent on as partial owners and its nodes are dropped.  The partial
owners are then exchanged by (length, hash), sorted there by Spark, and merged
by one trie per (length, hash) run.  Rows get their owner by a join on the
SHA-256 of the text, in which only texts with copies appear on the right side
and which adaptive execution may split.

Defined cases: null text counts as empty; a null identifier loses against any
other and an owner is null only if all copies lack one; a row whose identifier
is the owner's is kept, so rows that repeat both text and identifier are all
kept; identifiers may have any type that has an order; texts may have any length;
empty tables give empty results; extra columns are not used, or carried along
whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from tripletlab.llm.common import column, n_parts

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Node:
    __slots__ = ("label", "kids", "owner", "count", "terminal", "weight")

    def __init__(self, label: bytes) -> None:
        self.label, self.kids = label, {}
        self.owner, self.count, self.terminal, self.weight = None, 0, False, len(label)


class PatriciaTrie:
    """Compressed radix trie over byte strings; terminals hold (owner, count)."""

    def __init__(self, largest: bool = False) -> None:
        self.root, self.better = _Node(b""), max if largest else min

    def insert(self, text: bytes, owner: int | None, count: int = 1) -> None:
        node, at = self.root, 0
        path = [node]
        while True:
            if at == len(text):
                break
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = _Node(text[at:])
                node = kid
                path.append(kid)
                at = len(text)
                for p in path[:-1]:
                    p.weight += kid.weight
                break
            label = kid.label
            if text.startswith(label, at):
                node, at = kid, at + len(label)
                path.append(kid)
                continue
            cut = len(os.path.commonprefix((label, text[at : at + len(label)])))
            upper = _Node(label[:cut])
            kid.label = label[cut:]
            upper.weight = kid.weight
            kid.weight -= cut
            upper.kids[kid.label[0]] = kid
            node.kids[text[at]] = upper
            node, at = upper, at + cut
            path.append(upper)
        if owner is not None:
            node.owner = owner if node.owner is None else self.better(node.owner, owner)
        node.count += count
        node.terminal = True

    @property
    def weight(self) -> int:
        return self.root.weight

    def terminals(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        todo = [(node or self.root, prefix)]
        while todo:
            node, prefix = todo.pop()
            text = prefix + node.label
            if node.terminal:
                yield text, node.owner, node.count
            todo += [(k, text) for k in node.kids.values()]

    def spill(self, keep: int) -> Iterator[tuple[bytes, int | None, int]]:
        """Take out the heaviest subtrees under the root until at most ``keep``
        bytes stay."""
        for kid in sorted(self.root.kids.values(), key=lambda k: -k.weight):
            if self.weight <= keep:
                break
            yield from self.terminals(kid)
            del self.root.kids[kid.label[0]]
            self.root.weight -= kid.weight


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = 24 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """One row per distinct normalised text: (text_sha256, keep_id, group_size)."""
    largest = keep == "largest"
    kind = docs.schema[id_col].dataType
    ident = to_arrow_type(kind)
    names, kinds = ["size", "hash", "body", "owner", "copies"], [pa.int64(), pa.int64(), pa.binary(), ident, pa.int64()]

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    def send(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for text, owner, count in rows:
            h = xxhash.xxh64_intdigest(text)
            found.append((len(text), h - (1 << 64) if h >> 63 else h, text, owner, count))
            held += len(text) + 64
            if held > shard_bytes:
                yield rows_of(found)
                found, held = [], 0
        if found:
            yield rows_of(found)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest)
        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                trie.insert((text.as_py() or "").encode().translate(_LOWER), owner)
                if trie.weight > budget:
                    yield from send(trie.spill(budget // 2))
        yield from send(trie.terminals())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, trie, shas, keeps, sizes = None, PatriciaTrie(largest), [], [], []

        def close() -> None:
            for text, owner, count in trie.terminals():
                shas.append(hashlib.sha256(text).hexdigest())
                keeps.append(owner)
                sizes.append(count)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(shas, pa.string()), pa.array(keeps, ident), pa.array(sizes, pa.int64())], ["text_sha256", "keep_id", "group_size"])

        for batch in batches:
            size, hashes, owner, count = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, body in enumerate(batch.column(2)):
                if (size[i], hashes[i]) != run:
                    close()
                    run, trie = (size[i], hashes[i]), PatriciaTrie(largest)
                trie.insert(body.as_py(), owner[i], count[i])
            if len(shas) > 10_000:
                yield out()
                shas, keeps, sizes = [], [], []
        close()
        if shas:
            yield out()

    part = docs.select(column(id_col), column(text_col)).mapInArrow(local, f"size long, hash long, body binary, owner {kind.simpleString()}, copies long")
    n = n_parts(docs.sparkSession)
    return part.repartition(n, "size", "hash").sortWithinPartitions("size", "hash").mapInArrow(merge, f"text_sha256 string, keep_id {kind.simpleString()}, group_size long")


def digests(rows: DataFrame) -> DataFrame:
    """``rows`` (the last column a text) and the SHA-256 of each normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256((t.as_py() or "").encode().translate(_LOWER)).hexdigest() for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sha, pa.string())], schema=pa.schema([*list(batch.schema)[:-1], pa.field("text_sha256", pa.string())]))

    return rows.mapInArrow(run, ", ".join([f"{c} {t}" for c, t in rows.dtypes[:-1]] + ["text_sha256 string"]))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: list[str] | None = None) -> DataFrame:
    """One row per document with the owner of its text: ``id``, keep_id,
    group_size, kept, text_sha256 and the carried columns."""
    groups = owners(docs, id_col, text_col, keep).where("group_size > 1")
    wanted = list(dict.fromkeys([id_col, *(carry or [])]))
    rows = digests(docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(wanted)], column(text_col).alias("t")))
    size = F.coalesce(F.col("g.group_size"), F.lit(1)).cast("long")
    keep_id = F.when(F.col("g.group_size").isNull(), F.col("r.c0")).otherwise(F.col("g.keep_id"))
    joined = rows.alias("r").join(groups.alias("g"), F.col("r.text_sha256") == F.col("g.text_sha256"), "left")
    return joined.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(wanted)], keep_id.alias("keep_id"), size.alias("group_size"), keep_id.eqNullSafe(F.col("r.c0")).alias("kept"), F.col("r.text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs, keep="largest")


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
