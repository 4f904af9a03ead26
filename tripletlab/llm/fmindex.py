"""Op 9: repeated passages by compressed FM-indexes, one per shard.

A window is ``span`` (20) consecutive words of a document; a word goes if some
window over it has the same words as a window that starts earlier.

Routing.  A window's key is the smallest 64-bit hash among its six-word runs,
so equal windows have equal keys and neighbouring windows mostly share one; a
document is cut into runs of windows with one key.  A run can only hold a
repeat if its key occurs in another run or twice in its own words.  Keys that
repeat inside one task's block are settled there, so a passage that half of the
documents share crosses the exchange once per block; single ones are exchanged
as (key, document, place).

Shards.  The words of the runs that remain are sent to the shard of their key;
runs with the same words in one block are sent once and the later ones settled
at once.  Runs of a key that has more than ``hot_runs`` runs or ``hot_windows``
windows are sent window by window, dealt by the window's own words; such windows
arrive in document order and are settled as they come, so a route holds a bounded
number of words however often one passage occurs.  A shard sorts by key and
builds an FM-index over a few megabytes at a time: symbols are five-word groups
(four per window, in five interleaved sequences), the Burrows-Wheeler transform
is kept as a wavelet matrix of packed bits with block counts.  Every window of
the shard's documents is then streamed through backward search; windows whose
interval holds an earlier occurrence are reported as (document, start, count).

Words are compared through 64-bit hashes of their bytes inside a shard.

Defined cases: null text has no words; rows without identifier lose nothing and
prove nothing; rows that repeat an identifier with another text are documents of
their own at the same place in the order (``twin`` tells them apart), so equal
windows of theirs do not remove each other; rows that repeat identifier and text
lose the same words; extra columns are not used; empty tables give empty results;
documents may have any length, at about 40 bytes of memory for each byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletlab.llm.common import Words, mix, n_parts, pieces, signed, small, stash, text_mark

SPAN, GRAM, GROUP = 20, 6, 5
_LEN_BITS = 20
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


# -- FM-index ---------------------------------------------------------------


class WaveletMatrix:
    """Rank queries over a sequence of integers, one packed bit row per level."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        self.zeros: list[int] = []
        seq = np.asarray(seq, np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            raw = np.packbits(bit, bitorder="little")
            raw = np.concatenate([raw, np.zeros(8 + (-len(raw)) % 8, np.uint8)])
            words = raw.view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.blocks.append((np.cumsum(counts) - counts).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        start = self._follow(np.arange(sigma), np.zeros(sigma, np.int64))
        self.start = start

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            w = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.blocks[i][w] + np.bitwise_count(self.words[i][w] & mask)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones).astype(np.int64)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        return self._follow(symbol, at) - self.start[symbol]


class FMIndex:
    """Backward search for patterns of up to four symbols (suffixes are sorted
    by their first four symbols, which is all that such patterns can see)."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        n = len(text)
        pair = text.astype(np.int64) * sigma
        pair[:-1] += text[1:]
        _, two = np.unique(pair, return_inverse=True)
        four = two.astype(np.int64) * (int(two.max(initial=0)) + 2)
        four[:-2] += two[2:] + 1
        self.suffix = np.argsort(four, kind="stable")
        bwt = text[self.suffix - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.ranks = WaveletMatrix(bwt, sigma)

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [lo, hi) of the rows of ``patterns``."""
        last = patterns[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, k]
            base = self.first[c]
            lo, hi = base + self.ranks.rank(c, lo), base + self.ranks.rank(c, hi)
        return lo, hi


def later_windows(words: Words, place: np.ndarray, doc: np.ndarray, span: int = SPAN, twin: np.ndarray | None = None) -> np.ndarray:
    """For runs given as texts (rows of ``words``) with their document and first
    window number: indices of first words of windows that have the same words as
    an earlier window.  Rows must be sorted by (document, twin, place)."""
    twin = np.zeros(len(doc), np.int64) if twin is None else twin
    group = span // 4
    at, h = words.shingles(group)
    if not len(at):
        return np.zeros(0, np.int64)
    row = words.doc[at]
    offset = at - words.first[row]
    kinds, symbol = np.unique(h, return_inverse=True)
    symbol = symbol.astype(np.int64) + 1  # 0 separates
    order = np.lexsort((offset, row, offset % group))
    lane = (offset % group)[order]
    r = row[order]
    new = np.ones(len(order), bool)
    new[1:] = (lane[1:] != lane[:-1]) | (r[1:] != r[:-1])
    to = np.arange(len(order)) + np.cumsum(new)  # a separator before each lane of a row
    text = np.zeros(len(order) + int(new.sum()) + 1, np.int64)
    text[to] = symbol[order]
    source = np.full(len(text), np.iinfo(np.int64).max)
    source[to] = at[order]
    index = FMIndex(text, len(kinds) + 1)
    by_word = np.full(len(words) + span, 0, np.int64)
    by_word[at] = symbol
    first = np.flatnonzero(words.doc[: len(words) - span + 1] == words.doc[span - 1 :]) if len(words) >= span else np.zeros(0, np.int64)
    if not len(first):
        return first
    out, shared = [], []
    number = lambda w, x: place[x] + w - words.first[x]
    low_source = np.append(source[index.suffix], np.iinfo(np.int64).max)
    for a in range(0, len(first), 1 << 18):
        some = first[a : a + (1 << 18)]
        lo, hi = index.find(np.stack([by_word[some + k * group] for k in range(4)], axis=1))
        kind, back = np.unique(lo, return_inverse=True)
        end = np.zeros(len(kind), np.int64)
        end[back] = hi
        earliest = np.minimum.reduceat(low_source, np.stack([kind, end], axis=1).reshape(-1))[::2][back]
        d, e = words.doc[some], words.doc[earliest]
        out.append(some[(doc[e] < doc[d]) | ((doc[e] == doc[d]) & (twin[e] == twin[d]) & (number(earliest, e) < number(some, d)))])
        if twin.any():  # the earliest one may be of another row with the same identifier
            mine = np.flatnonzero(twin[d] != 0)
            shared.append((lo[mine], some[mine]))
    if shared:
        lo, w = (np.concatenate(x) for x in zip(*shared))
        d = words.doc[w]
        n = number(w, d)
        order = np.lexsort((n, twin[d], doc[d], lo))
        lo, w, d, n = lo[order], w[order], d[order], n[order]
        new = np.ones(len(w), bool)
        new[1:] = (lo[1:] != lo[:-1]) | (doc[d[1:]] != doc[d[:-1]]) | (twin[d[1:]] != twin[d[:-1]])
        at = np.flatnonzero(new)
        out.append(w[n > np.repeat(n[at], np.diff(np.append(at, len(w))))])
        return np.unique(np.concatenate(out))
    return np.concatenate(out)


# -- stages -----------------------------------------------------------------


def window_keys(words: Words, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: (row, first window number, windows, key,
    whether the key occurs twice in the run's own words)."""
    n = len(words)
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool)
    at, h = words.shingles(gram)
    g = np.full(n + span, _TOP)
    g[at] = h
    width = span - gram + 1
    low, have = g, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    first = np.flatnonzero(words.doc[: n - span + 1] == words.doc[span - 1 :])
    key, row = low[first], words.doc[first]
    twin = np.zeros(n + span, bool)
    for d in range(1, width + 1):  # windows of one run hold their key at most ``width`` grams apart
        twin[:-d] |= g[:-d] == g[d:]
    twin &= g != _TOP
    twins = np.append(0, np.cumsum(twin))
    number = first - words.first[row]
    new = np.ones(len(first), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (number[1:] // (1 << 18) != number[:-1] // (1 << 18))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(first)))
    a = first[start]
    own = (twins[a + size + width - 1] - twins[a]) > 0
    return row[start], number[start], size, key[start], own


def anchors(docs: DataFrame, span: int, gram: int, block: int = 16 << 20) -> DataFrame:
    """Runs as (key, doc, twin, packed): packed = first window << 20 | windows, as
    its complement where the run is already known to need a look; doc null where
    the row only says that the key occurs."""

    def close(found: list[tuple]) -> pa.RecordBatch:
        doc, twin, packed, key, own = (np.concatenate(x) for x in zip(*found))
        kinds, back, count = np.unique(key, return_inverse=True, return_counts=True)
        known = own | (count[back] > 1)
        say = np.union1d(kinds[count > 1], key[own])
        packed = np.where(known, ~packed, packed)
        keys = pa.array(signed(np.concatenate([key, say])))
        none = np.zeros(len(say), np.int64)
        docs_ = pa.array(np.concatenate([doc, none]), mask=np.concatenate([np.zeros(len(doc), bool), np.ones(len(say), bool)]))
        return pa.RecordBatch.from_arrays([keys, docs_, pa.array(np.concatenate([twin, none])), pa.array(np.concatenate([packed, none]))], ["key", "doc", "twin", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            ids, twins = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            done = 0
            for part in pieces(batch, "text", 1 << 20):
                words = Words(part.column(2))
                row, number, size, key, own = window_keys(words, span, gram)
                if len(row):
                    found.append((ids[done + row], twins[done + row], (number << _LEN_BITS) | size, key, own))
                done += part.num_rows
                held += len(words.data)
                if held > block and found:
                    yield close(found)
                    found, held = [], 0
        if found:
            yield close(found)

    return docs.mapInArrow(run, "key long, doc long, twin long, packed long")


def repeated_runs(found: DataFrame) -> DataFrame:
    """Runs whose key occurs elsewhere: (key, doc, twin, first, windows)."""
    spark = found.sparkSession
    dealt = F.when(F.col("packed") < 0, F.xxhash64("doc", "packed")).otherwise(F.col("key"))
    sorted_ = found.repartition(n_parts(spark), dealt).sortWithinPartitions("key")

    def emit(key, doc, twin, packed, null):
        keep = ~null
        key, doc, twin, packed = key[keep], doc[keep], twin[keep], packed[keep]
        packed = np.where(packed < 0, ~packed, packed)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(twin), pa.array(packed >> _LEN_BITS), pa.array(packed & ((1 << _LEN_BITS) - 1))], ["key", "doc", "twin", "first", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last single row of the batch before, and whether it repeats
        for batch in batches:
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            key, twin, packed = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            doc = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            known = packed < 0
            if known.any():
                yield emit(key[known], doc[known], twin[known], packed[known], null[known])
            one = ~known
            key, doc, twin, packed, null = key[one], doc[one], twin[one], packed[one], null[one]
            if not len(key):
                continue
            again = np.zeros(len(key) + 1, bool)
            if held is not None:
                key, doc, twin, packed, null = (np.append(a, b) for a, b in zip(held, (key, doc, twin, packed, null)))
                again = np.zeros(len(key) + 1, bool)
                again[0] = held[5]
            same = key[1:] == key[:-1]
            again[1:-1] |= same
            again[:-2] |= same
            again = again[:-1]
            held = (key[-1], doc[-1], twin[-1], packed[-1], null[-1], again[-1])
            take = again.copy()
            take[-1] = False
            if take.any():
                yield emit(key[take], doc[take], twin[take], packed[take], null[take])
        if held is not None and held[5]:
            yield emit(*(np.array([x]) for x in held[:5]))

    return sorted_.mapInArrow(run, "key long, doc long, twin long, first long, windows long")


def segments(joined: DataFrame, span: int, block: int = 8 << 20) -> DataFrame:
    """(route, doc, twin, first, windows, alone, body): runs to compare; body null
    where the windows are known to repeat an earlier run.  Runs marked as hot go
    window by window (``alone``), as words joined by one space."""
    names = ["route", "doc", "twin", "first", "windows", "alone", "body"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[int, int, int, bool]] = {}
        settled: list[tuple[int, int, int, int]] = []
        held = 0

        def close() -> pa.RecordBatch:
            rows = [(key[0], d, key[2], f, n, alone, key[1]) for key, (d, f, n, alone) in best.items()]
            rows += [(d, d, t, f, n, False, None) for d, t, f, n in settled]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                words = Words(part.column(2))
                ids, twins, runs = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3)
                for i, (d, t) in enumerate(zip(ids, twins)):
                    base = int(words.first[i])
                    mine = runs[i].values
                    key, first, size = (mine.field(j).to_numpy() for j in range(3))
                    wide = mine.field(3).to_numpy(zero_copy_only=False)
                    if wide.any():
                        rep = np.where(wide, size, 1)
                        off = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
                        key, first, size = np.repeat(key, rep), np.repeat(first, rep) + off, np.where(np.repeat(wide, rep), 1, np.repeat(size, rep))
                        wide = np.repeat(wide, rep)
                    for k, f, n, alone in zip(key.tolist(), first.tolist(), size.tolist(), wide.tolist()):
                        body = words.text(base + f, base + f + n + span - 1)
                        if alone:
                            body = b" ".join(body.split())
                            k = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
                        at = (k, body, t, d if t else 0)  # rows that share an identifier settle nothing but their own
                        old = best.get(at)
                        if old is None:
                            best[at] = (d, f, n, alone)
                            held += len(body) + 250
                        elif (d, f) < old[:2]:
                            settled.append((old[0], t, old[1], old[2]))
                            best[at] = (d, f, n, alone)
                        elif (d, f) > old[:2]:
                            settled.append((d, t, f, n))
                    if held + 64 * len(settled) > block:
                        yield close()
                        best, settled, held = {}, [], 0
        if best or settled:
            yield close()

    return joined.mapInArrow(run, "route long, doc long, twin long, first long, windows long, alone boolean, body binary")


class _Alone:
    """Settles windows that come one by one, in the order of their documents."""

    def __init__(self) -> None:
        self.low: dict[bytes, tuple[int, dict[int, int]]] = {}  # words -> smallest document, first place by twin

    def repeats(self, doc: int, twin: int, first: int, body: bytes) -> bool:
        d, places = self.low.setdefault(body, (doc, {}))
        return d < doc or first > places.setdefault(twin, first)


def search_shards(parts: DataFrame, span: int, load: int = 3 << 20) -> DataFrame:
    """Windows that repeat an earlier one, as runs (doc, twin, first, windows)."""
    spark = parts.sparkSession
    sorted_ = parts.repartition(n_parts(spark), "route").sortWithinPartitions("route", "doc", "first")
    names = ["doc", "twin", "first", "windows"]

    def settle(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch | None:
        rows.sort(key=lambda r: r[:3])
        doc, twin, place = (np.array(c, np.int64) for c in list(zip(*rows))[:3])
        words = Words(pa.array([r[3] for r in rows], pa.binary()).view(pa.utf8()))
        hit = later_windows(words, place, doc, span, twin)
        if not len(hit):
            return None
        row = words.doc[hit]
        number = place[row] + hit - words.first[row]
        new = np.ones(len(hit), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)
        a = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(doc[row[a]]), pa.array(twin[row[a]]), pa.array(number[a]), pa.array(np.diff(np.append(a, len(hit))))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last, single = [], 0, None, _Alone()
        for batch in batches:
            known = batch.filter(batch.column(6).is_null())
            if known.num_rows:
                yield known.select(names)
            batch = batch.filter(batch.column(6).is_valid())
            hits = []
            for route, doc, twin, first, alone, body in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6))):
                if route != last:
                    single = _Alone()
                    if held > load:
                        if (out := settle(rows)) is not None:
                            yield out
                        rows, held = [], 0
                last = route
                if alone:
                    if single.repeats(doc, twin, first, body):
                        hits.append((doc, twin, first, 1))
                else:
                    rows.append((doc, twin, first, body))
                    held += len(body)
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits)], names)
        if rows and (out := settle(rows)) is not None:
            yield out

    return sorted_.mapInArrow(run, "doc long, twin long, first long, windows long")


def marked_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """(doc, twin, text), twin being 0 or telling apart the texts of one
    identifier, and the columns that name a row: doc alone where no identifier
    has two texts, so that groups by row and joins with rows share an exchange."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    mark = F.when(text_mark(F.col("text")) == 0, 1).otherwise(text_mark(F.col("text")))
    ids = rows.where("doc IS NOT NULL").select("doc", mark.alias("m")).groupBy("doc").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo <> hi")
    ids = stash(ids.select(F.col("doc").alias("again")), "repeated-ids")
    if ids.isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("twin"), "text"), ["doc"]
    rows = rows.join(small(ids), F.col("doc") == F.col("again"), "left").select("doc", F.when(F.col("again").isNull(), 0).otherwise(mark).cast("long").alias("twin"), "text")
    return rows, ["doc", "twin"]


def repeated_windows(rows: DataFrame, names: list[str], span: int = SPAN, hot_runs: int = 2_000, hot_windows: int = 200_000) -> DataFrame:
    """Runs of windows that occur earlier in the corpus: (doc, twin, first, windows).
    ``rows`` and ``names`` as from marked_rows()."""
    if span % 4 or span < 8:
        raise ValueError("span must be a multiple of 4, 8 or more")
    gram = min(GRAM, span // 2)
    rows = rows.where("doc IS NOT NULL")
    runs = stash(repeated_runs(anchors(rows, span, gram)), "runs")
    # routing only, so a sixteenth of the runs tells which keys are hot; results do not depend on it
    seen = runs.where(F.pmod(F.xxhash64("doc", "first"), F.lit(16)) == 0).groupBy("key").agg((16 * F.count("*")).alias("n"), (16 * F.sum("windows")).alias("w"))
    hot = seen.where((F.col("n") > hot_runs) | (F.col("w") > hot_windows))
    hot = stash(hot.select(F.col("key").alias("hot_key")), "hot-keys")
    wide = F.lit(False).alias("hot")
    if not hot.isEmpty():
        runs, wide = runs.join(small(hot), F.col("key") == F.col("hot_key"), "left"), F.col("hot_key").isNotNull().alias("hot")
    lists = runs.groupBy(*names).agg(F.collect_list(F.struct("key", "first", "windows", wide)).alias("runs"))
    joined = rows.join(lists, names).select("doc", "twin", "text", "runs")
    return search_shards(segments(joined, span), span)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, texts: bool = True, **limits) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, if asked
    for, the text of the kept words."""
    rows, names = marked_rows(docs, id_col, text_col)
    hits = repeated_windows(rows, names, span, **limits)
    lists = hits.groupBy(*names).agg(F.collect_list(F.struct("first", "windows")).alias("hits"))
    rows = rows.join(lists, names, "left").select("doc", "text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                total, gone, sha, kept = [], [], [], []
                for text, found in zip(part.column(1), part.column(2)):
                    words = (text.as_py() or "").encode().split()
                    n = len(words)
                    if found.is_valid:
                        step = np.zeros(n + 1, np.int64)
                        first = found.values.field(0).to_numpy()
                        end = np.minimum(first + found.values.field(1).to_numpy() + span - 1, n)
                        np.add.at(step, first, 1)
                        np.add.at(step, end, -1)
                        words = list(compress(words, (np.cumsum(step[:-1]) == 0).tolist()))
                    body = b" ".join(words)
                    total.append(n)
                    gone.append(n - len(words))
                    sha.append(hashlib.sha256(body).hexdigest())
                    if texts:
                        kept.append(body.decode())
                cols = [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())] + [pa.array(kept, pa.string())] * texts
                yield pa.RecordBatch.from_arrays(cols, ["doc", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts)

    return rows.mapInArrow(run, "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts).withColumnRenamed("doc", id_col)


def op9_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM w WHERE len(w) >= 20),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
m AS (SELECT x.doc_id, x.p, x.word, max(r.p) OVER (PARTITION BY x.doc_id ORDER BY x.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.p = r.p),
c AS (SELECT doc_id, count(*) AS n_words, sum(gone::int) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id
"""
