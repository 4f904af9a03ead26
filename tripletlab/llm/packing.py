"""Op 10: packing documents into token-budget batches by optimal length buckets.

Lengths are counted in one pass (the query counts words; any length column can
be given).  The global histogram has one cell for each length up to 4096 and
1024 cells for each doubling beyond, so it is bounded at any corpus size; a cell
knows its largest length.  A dynamic program over the cells chooses the bucket
boundaries with the least padding among their largest lengths (up to 4096 these
are all lengths there are), each document being padded to its bucket's boundary,
and the last boundary is the longest document.  Inside a bucket,
documents are numbered without gaps (chunk by chunk, no global sort) and every
``budget // boundary`` of them form one batch (one at least).

Defined cases: null and empty texts have length 0 and go to the first bucket; a
document longer than the budget is a batch of its own; ties are ordered by
identifier; texts may have any length; rows that repeat are separate rows; empty tables give no rows; extra
columns are carried only where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletlab.llm.common import pieces, slots, stash

FINE_BITS = 12


def cell_top(length: Column) -> Column:
    """The largest length of the histogram cell that holds ``length``."""
    shift = F.greatest(F.lit(0), F.length(F.bin(length)) - FINE_BITS).cast("int")
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return F.when(length <= 1 << FINE_BITS, length).otherwise(F.ceil(length / step).cast("long") * step)


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (a subset of the sorted ``lengths``, the largest included)
    that minimise sum(count * (boundary - length)) with at most ``buckets``
    buckets.  Divide and conquer over monotone split points: O(k n log n)."""
    n = len(lengths)
    if not n:
        return []
    x = lengths.astype(np.float64)
    docs = np.concatenate([[0.0], np.cumsum(counts.astype(np.float64))])
    cost = np.concatenate([[0.0], x * docs[1:]])  # all in one bucket, less a constant
    cuts = []
    for _ in range(1, min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            mid = (a + b) // 2
            i = np.arange(lo, min(hi, mid - 1) + 1)
            c = cost[i] + x[mid - 1] * (docs[mid] - docs[i])
            k = int(c.argmin())
            new[mid], cut[mid] = c[k], i[k]
            todo += [(a, mid - 1, lo, int(i[k])), (mid + 1, b, int(i[k]), hi)]
        cuts.append(cut)
        cost = new
    out, at = [], n
    for cut in reversed(cuts):
        out.append(int(lengths[at - 1]))
        at = int(cut[at])
        if at == 0:
            break
    if at:
        out.append(int(lengths[at - 1]))
    return sorted(out)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens): words between white space, null as none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col, 1 << 20):
                n = [len((t.as_py() or "").encode().split()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """(id, n_tokens, bucket, padded_to, batch, place) of every row."""
    rows = stash(lengths.select(F.col(id_col).alias("_id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens")).withColumn("_cell", cell_top(F.col("n_tokens"))), "lengths")
    cells = rows.groupBy("_cell").agg(F.max("n_tokens").alias("top"), F.count("*").alias("n")).orderBy("_cell").collect()  # a bounded histogram
    tops = best_boundaries(np.array([r["top"] for r in cells], np.int64), np.array([r["n"] for r in cells], np.int64), buckets)
    edges = F.array(*[F.lit(t).cast("long") for t in tops]) if tops else F.array().cast("array<long>")
    bucket = F.size(F.filter(edges, lambda t: t < F.col("n_tokens")))
    placed = rows.select("_id", "n_tokens", bucket.alias("bucket"), F.get(edges, bucket).alias("padded_to"))
    numbered = slots(placed, ["bucket", "padded_to"], ["n_tokens", "_id"], "_slot")
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded_to", F.lit(1)))).cast("long")
    return numbered.select(F.col("_id").alias(id_col), "n_tokens", "bucket", "padded_to", F.floor(F.col("_slot") / per).cast("long").alias("batch"), (F.col("_slot") % per).alias("place"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
