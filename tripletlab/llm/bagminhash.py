"""Op 1: near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles; similarity is the weighted
Jaccard index of the counts, and a link needs 0.8 or more.

Signature.  The weight axis of each shingle is cut into the discrete levels
1, 2, 3-4, 5-8, ...; each cut carries a Poisson process whose rate is its length
and whose points have a time, a signature slot and a place on the axis.  A
document sees the points whose place is not above its count; slot i keeps the
earliest time.  Points depend on shingle, cut and number only, so two documents
share the winner of a slot with probability equal to their weighted Jaccard
index.  Points come in rounds of doubled time horizon until every slot is
settled, so the cost is near max(distinct shingles, slots * ln(slots)).

Candidates.  Documents with the same multiset form a class first (grouped on a
128-bit commutative digest, which collapses large groups of copies before
anything else).  Class representatives meet in ``bands`` buckets of ``rows``
slots each (32 x 5: a pair at 0.8 is missed with probability 3e-6).  In each turn
every bucket that spans several components names a hub, first the member that
shares most buckets (the text that its copies resemble), then others; members
outside the hub's component are compared with it, and verified links are joined
into components.  After ``turns`` turns, all pairs of one bucket that are still in
different components are compared, except those that a bound rules out: shingles
that no other open document holds cannot be shared, and similarity t needs an
overlap of t / (1 + t) times both sizes.  Pairs inside a component need no
comparison, so the components are those of all candidate links, without listing
the pairs inside a group.

Verification joins the texts and computes the multiset overlap exactly.

Defined cases: documents with fewer than five words are one shingle of all their
words (none: the empty multiset, a class of its own); null text counts as empty;
rows without identifier are their own group and get a null component; rows that
repeat an identifier are documents of their own (classes are numbered, and texts
are found by identifier and a hash of the text), of which, inside one group, only
those with the smallest (identifier, hash) are kept; rows that repeat identifier
and text are kept or dropped together; empty tables give no rows; a
text is one piece of work at least, at about 40 bytes of memory for each byte of
it; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletlab.llm.common import Words, components, mix, pieces, signed, stash, text_mark

K, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def multisets(words: Words, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) sorted by row and shingle."""
    at, h = words.shingles(k)
    row = words.doc[at]
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        h_short = np.array([int(np.bitwise_xor.reduce(mix(words.hash[a:b] + _GOLD * np.arange(1, b - a + 1, dtype=np.uint64)))) for a, b in zip(words.first[short], words.first[short + 1])], np.uint64)
        row, h = np.concatenate([row, short]), np.concatenate([h, h_short])
    if len(short):
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1
    a = 0
    for b in ends.tolist():  # one short sort per document
        h[a:b].sort()
        a = b
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """Earliest times, shape (n_rows, slots); inf where a row has no shingle."""
    out = np.full((n_rows, slots), np.inf)
    if not len(row):
        return out
    # cuts of the weight axis: (2**(j-1), 2**j], the first one (0, 1]
    cuts = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    rep = np.repeat(np.arange(len(row)), cuts)
    level = np.arange(len(rep)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.where(level > 0, low, 1.0)
    doc, limit = row[rep], count[rep].astype(np.float64)
    seed = mix(shingle[rep] + _GOLD * (level + 1).astype(np.uint64))
    total = np.bincount(row, weights=count, minlength=n_rows)
    horizon = slots * (np.log(slots) + 1.0) / np.maximum(total, 1.0)
    flat = out.reshape(-1)
    live = np.arange(len(rep))  # processes whose document is not settled
    number = np.ones(len(rep), np.int64)  # of each process's next point
    draw = mix(seed + _GOLD)
    time = -np.log(_uniform(draw)) / rate
    while len(live):
        due = live[time[live] <= horizon[doc[live]]]
        while len(due):
            side = mix(draw[due] + _GOLD)
            seen = low[due] + _uniform(side) * rate[due] <= limit[due]
            slot = (mix(side) % np.uint64(slots)).astype(np.int64)[seen]
            np.minimum.at(flat, doc[due][seen] * slots + slot, time[due][seen])
            number[due] += 1
            draw[due] = mix(seed[due] + number[due].astype(np.uint64) * _GOLD)
            time[due] -= np.log(_uniform(draw[due])) / rate[due]
            due = due[time[due] <= horizon[doc[due]]]
        # points later than the horizon cannot matter once every slot is below it
        open_docs = np.unique(doc[live])
        more = out[open_docs].max(axis=1) > horizon[open_docs]
        horizon[open_docs] = np.where(more, horizon[open_docs] * 2, -1.0)
        live = live[horizon[doc[live]] > 0]
    return out


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) bucket keys; equal winners give equal times bit by bit."""
    h = mix(times.view(np.uint64).reshape(len(times), bands, rows) * _GOLD)
    acc = np.zeros(h.shape[:2], np.uint64) + (np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)[None, :]
    for i in range(rows):
        acc = mix(acc * np.uint64(3) + h[:, :, i])
    return acc


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, mark, d1, d2, total, bands array) per document; bands null for the empty multiset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                words, n = Words(part.column(1)), part.num_rows
                row, sh, count = multisets(words, k)
                times = signatures(row, sh, count, n, bands * rows)
                keys = band_keys(times, bands, rows)
                c = count.astype(np.uint64)
                d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(d1, row, mix(sh + c * _GOLD))
                np.add.at(d2, row, mix((sh ^ _GOLD) * np.uint64(3) + c))
                total = np.bincount(row, weights=count, minlength=n).astype(np.int64)
                off = np.arange(0, n * bands + 1, bands, dtype=np.int32)
                arr = pa.ListArray.from_arrays(pa.array(off), pa.array(signed(keys.reshape(-1))), mask=pa.array(total == 0))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(signed(d1)), pa.array(signed(d2)), pa.array(total), arr], ["id", "mark", "d1", "d2", "total", "bands"])

    marked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_mark(F.col(text_col)).alias("mark"))
    return marked.mapInArrow(run, "id long, mark long, d1 long, d2 long, total long, bands array<long>")


def overlaps(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, similarity): exact weighted Jaccard of the shingle counts."""
    joined = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "tb", 1 << 20):
                n = part.num_rows
                both = pa.chunked_array([part.column(2), part.column(3)]).combine_chunks()
                row, sh, count = multisets(Words(both), k)
                total = np.bincount(row, weights=count, minlength=2 * n)
                pair = row % n
                order = np.lexsort((sh, pair))
                p, s, c = pair[order], sh[order], count[order]
                same = np.flatnonzero((p[1:] == p[:-1]) & (s[1:] == s[:-1]))
                common = np.bincount(p[same], weights=np.minimum(c[same], c[same + 1]), minlength=n)
                union = total[:n] + total[n:] - common
                sim = np.where(union > 0, common / np.maximum(union, 1), 1.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], ["a", "b", "similarity"])

    return joined.mapInArrow(run, "a long, b long, similarity double")


SKETCH = 2048  # bits of the finer signature of documents that are still open


def sharable(texts: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(id, total, shared, sketch): size of each multiset, how much of it consists
    of shingles that another one of these texts holds too, and one bit for each
    of 2048 slots of a finer signature."""

    def each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                row, sh, count = multisets(Words(part.column(1)), k)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(signed(sh)), pa.array(count, pa.int64())], ["id", "shingle", "n"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                row, sh, count = multisets(Words(part.column(1)), k)
                times = signatures(row, sh, count, part.num_rows, SKETCH)
                one = (mix(times.view(np.uint64)) & np.uint64(1)).astype(bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in np.packbits(one, axis=1)], pa.binary())], ["id", "sketch"])

    each = texts.select("id", "text").mapInArrow(each_shingle, "id long, shingle long, n long")
    one = each.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other"), F.sum("n").alias("n")).where("id = other")
    own = one.groupBy("id").agg(F.sum("n").alias("own"))
    sketch = texts.select("id", "text").mapInArrow(bits, "id long, sketch binary")
    return totals.join(sketch, "id").join(own, "id", "left").select("id", "total", (F.col("total") - F.coalesce("own", F.lit(0))).alias("shared"), "sketch")


def close_pairs(rest: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that can be links.

    A bucket is cut into blocks and every pair of blocks is a cell of at most
    2 * block rows, so a hot bucket is spread over many tasks.  In a cell a pair
    passes if the sharing bound and the sketch (5 standard deviations below the
    threshold, so a link is lost with probability 3e-7) allow it; it is given in
    the first of its shared buckets only."""
    spark = rest.sparkSession
    sizes = rest.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "parts")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))).alias("c")
    dealt = rest.join(sizes, "bucket").select("bucket", cell, own.alias("part"), "rep", "comp", "total", "shared", "sketch", "bands")
    dealt = dealt.select("bucket", "c.i", "c.j", "part", "rep", "comp", "total", "shared", "sketch", "bands")
    need = threshold / (1 + threshold)
    p = (1 + threshold) / 2
    agree = SKETCH * (p - 5 * (p * (1 - p) / SKETCH) ** 0.5)

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        n = t.num_rows
        part, rep, comp, total, shared = (t.column(c).to_numpy() for c in ("part", "rep", "comp", "total", "shared"))
        bucket, i, j = t.column("bucket")[0].as_py(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(n, -1)
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        at = int(np.flatnonzero(bands[0] == bucket)[0])
        x, y = np.flatnonzero(part == i), np.flatnonzero(part == j)
        out = []
        for a in x.tolist():
            o = y[y > a] if i == j else y
            o = o[(comp[o] != comp[a]) & (np.minimum(shared[o], shared[a]) >= need * (total[o] + total[a]) - 1e-6)]
            if not len(o):
                continue
            same = SKETCH - np.bitwise_count(sketch[o] ^ sketch[a]).sum(axis=1, dtype=np.int64)
            o = o[same >= agree]
            o = o[~(bands[o, :at] == bands[a, :at]).any(axis=1)]
            out += [(min(rep[a], r), max(rep[a], r)) for r in rep[o]]
        if not out:
            return None
        u, v = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            b, i, j = (batch.column(c).to_numpy() for c in range(3))
            cut = np.flatnonzero((np.diff(b) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if s == e:
                    continue
                now = (b[s], i[s], j[s])
                if now != key and held:
                    if (out := solve(held)) is not None:
                        yield out
                    held = []
                key = now
                held.append(batch.slice(s, e - s))
        if held and (out := solve(held)) is not None:
            yield out

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, turns: int = 1) -> DataFrame:
    """One row per document: id, class_id (smallest identifier with the same
    shingle multiset), class_size, component_id (smallest identifier reachable
    by links), kept, text_mark.  Inside, a class goes by its number ``rep``."""
    marks = stash(fingerprints(docs, id_col, text_col, k, bands, rows), "marks")
    alike = marks.where("id IS NOT NULL").groupBy("d1", "d2", "total").agg(F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("class_size"), F.any_value("bands").alias("bands"))
    classes = stash(alike.select("d1", "d2", "total", F.monotonically_increasing_id().alias("rep"), "first", "class_size", "bands"), "classes")
    buckets = classes.where("bands IS NOT NULL").select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stash(buckets.join(shared, "bucket").select("bucket", "rep", "n"), "members")
    weight = members.groupBy("rep").agg(F.sum("n").alias("w"))  # large for the text that its copies resemble most
    members = stash(members.join(weight, "rep").select("bucket", "rep", "w"), "weighed")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_mark(F.col(text_col)).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = members.select("rep").distinct().join(classes.select("rep", F.col("first.id").alias("doc"), "first.mark"), "rep")
    # one plan at every size: a list of identifiers that grows is never broadcast
    texts = texts.hint("merge").join(wanted, ["doc", "mark"])
    texts = stash(texts.groupBy("doc", "mark").agg(F.any_value("rep").alias("id"), F.any_value("text").alias("text")).select("id", "text"), "texts")
    comp = checked = links = None
    turn = 0
    while True:
        placed = members.withColumn("comp", F.col("rep")) if comp is None else members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "w", F.coalesce("component", "rep").alias("comp"))
        # one hub for each bucket, another one each turn; buckets of one component are done
        rank = F.col("w") if turn == 0 else F.xxhash64("rep", "bucket", F.lit(turn))
        hubs = placed.groupBy("bucket").agg(F.max(F.struct(rank.alias("h"), "rep", "comp")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "hub.rep", "hub.comp")
        hubs = hubs.toDF("bucket", "hub", "hub_comp")
        left = stash(placed.join(hubs, "bucket"), "open")
        if left.isEmpty():
            break
        last = turn >= turns
        if last:  # every pair of one bucket in different components that the bound allows
            able = sharable(texts.join(left.select(F.col("rep").alias("id")).distinct(), "id"), classes.select(F.col("rep").alias("id"), "total"), k)
            able = able.join(classes.select(F.col("rep").alias("id"), "bands"), "id").withColumnRenamed("id", "rep")
            pairs = close_pairs(left.select("bucket", "rep", "comp").join(able, "rep"), threshold)
        else:
            pairs = left.where("comp <> hub_comp").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
        todo = pairs.distinct()
        seen = stash(overlaps(todo if checked is None else todo.join(checked.select("a", "b"), ["a", "b"], "left_anti"), texts, k), "verified")
        checked = seen if checked is None else checked.union(seen)
        good = seen.where(F.col("similarity") >= threshold).select("a", "b")
        links = good if links is None else links.union(good)
        comp = stash(components(links), "components")
        turn += 1
        if last:
            break
    if comp is None:
        comp = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    tied = classes.select("rep", "first").join(comp.withColumnRenamed("node", "rep"), "rep")
    heads = tied.groupBy("component").agg(F.min("first").alias("head"))
    tied = tied.join(heads, "component").select("rep", "head")
    found = classes.join(tied, "rep", "left").select("d1", "d2", "total", "first", "class_size", F.coalesce("head", "first").alias("head"))
    out = marks.join(found, ["d1", "d2", "total"], "left")
    named = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(named, F.col("first.id")).alias("class_id"),
        F.when(named, F.col("class_size")).otherwise(1).alias("class_size"),
        F.when(named, F.col("head.id")).alias("component_id"),
        (~named | ((F.col("id") == F.col("head.id")) & (F.col("mark") == F.col("head.mark")))).alias("kept"),
        F.col("mark").alias("text_mark"),
    )


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_mark")
