"""Op 7: quality classifier with hierarchical empirical Bayes.

Document evidence.  Two logistic models (low quality, toxicity) are fitted on a
bounded sample of labelled rows (``max_labels``, 20,000 by default, taken by a
hash of the identifier).  Features are the shape of a text (shares of symbols,
capitals, digits, word repetition, length) and the counts of the ``max_words``
words and word beginnings that the labels separate best.  Words are counted and
features made on the executors; the driver gets the chosen words and, for each
sampled row, its shape and the counts of chosen words, never a text.  Scoring is
one pass over the whole texts with hashed words.

Site evidence.  Labelled rows are counted by host and by path with one grouped
aggregate; the posterior of a path is its own counts plus ``kappa`` pseudo-counts
at the host's posterior, which has the same form against the global rate, so
sparse sites shrink to what is above them, a path without labels to its host and
a host without labels to the global rate.  Each level has its kappa from the data
by the method of moments (variance of the rates between hosts, and of paths
within hosts).  Counts use every label but those of the row's own fold (20 folds
by a hash of the identifier), so that no label speaks for its own row.  Evidence
and prior meet on the log-odds scale: posterior = document log-odds - log-odds of
the sample's rate + log-odds of the path's posterior.

A document is rejected if its posterior of being low in quality or of being
toxic exceeds ``cut`` (0.5).

Defined cases: null and empty texts have no evidence against their site's rate
beyond their shape, which the models see as length 0; null host or path is a
site of its own; labels that are null are not used, labels of documents that are
not in the table neither; with no labels of one class the rate is used alone;
of labelled rows that repeat an identifier the models see one (by the hash of its
text), while sites count all; extra columns of any name are carried along, except
those named like the three results; repeated rows are scored alike; empty tables
give no rows; a text is one piece of work at least, at about 40 bytes of memory
for each byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletlab.llm.common import Words, pieces, signed, stash, text_mark

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT)
_SYMBOL[[0x2C, 0x2E]] = False
_FOLD = np.arange(256)
_FOLD[65:91] += 32
SHAPES = 9
PREFIXES = (5, 7)
FOLDS = 20
LABELS = ("low", "toxic")


def marks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, stripped of symbols around it and with A-Z
    folded, and of its first 5 and 7 bytes where it is longer."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, b = words.start.copy(), words.end.copy()
    edge = _SYMBOL.copy()
    edge[[0x2C, 0x2E]] = True
    for _ in range(4):
        a += (a < b) & edge[words.data[np.minimum(a, len(words.data) - 1)]]
        b -= (b > a) & edge[words.data[b - 1]]
    hashed = words.spans(_FOLD)
    rows, out = [words.doc], [hashed(a, b)]
    for n in PREFIXES:
        long = np.flatnonzero(b - a > n)
        rows.append(words.doc[long])
        out.append(hashed(a[long], a[long] + n) ^ np.uint64(n))
    return np.concatenate(rows), np.concatenate(out)


def shapes(words: Words, n: int) -> np.ndarray:
    """(n, SHAPES) features of whole texts."""
    data, off = words.data, words.offsets
    size = np.diff(off).astype(np.float64)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(size, 1)

    count = np.diff(words.first).astype(np.float64)
    distinct = np.zeros(n)
    if len(words):
        order = np.lexsort((words.hash, words.doc))
        h, d = words.hash[order], words.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d[new], minlength=n).astype(np.float64)
    at, g = words.shingles(3)
    fresh = np.zeros(n)
    if len(at):
        d = words.doc[at]
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        fresh = np.bincount(d[new], minlength=n).astype(np.float64)
    runs = np.maximum(count - 2, 1)
    letters, caps = share(_LETTER), share(_UPPER)
    return np.stack(
        [share(_SYMBOL), caps / np.maximum(letters, 1e-9), share(_DIGIT), letters, np.log1p(count), distinct / np.maximum(count, 1), fresh / runs, size / np.maximum(count, 1) / 10, (count == 0).astype(float)],
        axis=1,
    )


def _fit(rows, n: int, y: np.ndarray, ridge: float = 1.0, steps: int = 30, chunk: int = 2048) -> np.ndarray:
    """Ridge logistic regression by Newton's method.  ``rows(a, b)`` gives the
    features of some rows; their last column is one, and its weight the intercept."""
    width = rows(0, 1).shape[1]
    w = np.zeros(width)
    pen = np.full(width, ridge)
    pen[-1] = 1e-3
    for _ in range(steps):
        g, h = pen * w, np.diag(pen)
        for a in range(0, n, chunk):
            x = rows(a, min(a + chunk, n))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = g + x.T @ (p - y[a : a + chunk])
            h = h + (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Word hashes (sorted), scaling of shapes and weights of one label."""

    def __init__(self, rate: float, words: np.ndarray | None = None) -> None:
        self.rate, self.weights = rate, None
        self.words = np.zeros(0, np.uint64) if words is None else np.sort(words)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.words >> np.uint64(48)).astype(np.int64)] = True

    def fit(self, shape: np.ndarray, doc: np.ndarray, mark: np.ndarray, times: np.ndarray, label: np.ndarray) -> Model:
        """``doc``, ``mark``, ``times``: occurrences of words in the rows of
        ``shape``, sorted by row; rows whose label is NaN are not used."""
        known = np.flatnonzero(~np.isnan(label))
        if not len(known) or label[known].min() == label[known].max():
            return self
        place = np.full(len(label), -1)
        place[known] = np.arange(len(known))
        at = np.searchsorted(self.words, mark)
        some = np.flatnonzero((place[doc] >= 0) & np.isin(mark, self.words))
        doc, at, value = place[doc[some]], at[some], np.log1p(times[some])
        self.mean, self.scale = shape[known].mean(axis=0), shape[known].std(axis=0) + 1e-6
        scaled = (shape[known] - self.mean) / self.scale

        def rows(a: int, b: int) -> np.ndarray:
            x = np.zeros((b - a, SHAPES + len(self.words) + 1))
            x[:, :SHAPES], x[:, -1] = scaled[a:b], 1
            i, j = np.searchsorted(doc, [a, b])
            x[doc[i:j] - a, SHAPES + at[i:j]] = value[i:j]
            return x

        self.weights = _fit(rows, len(known), label[known])
        return self

    def counts(self, doc: np.ndarray, mark: np.ndarray, n: int) -> np.ndarray:
        """log(1 + occurrences) of the chosen words in each of n rows."""
        out = np.zeros((n, len(self.words)))
        if len(self.words) and len(mark):
            some = np.flatnonzero(self.maybe[(mark >> np.uint64(48)).astype(np.int64)])
            doc, mark = doc[some], mark[some]
            at = np.minimum(np.searchsorted(self.words, mark), len(self.words) - 1)
            hit = self.words[at] == mark
            np.add.at(out, (doc[hit], at[hit]), 1)
        return np.log1p(out)

    def logit(self, found: tuple[np.ndarray, np.ndarray], shape: np.ndarray) -> np.ndarray:
        """Evidence: log-odds of the label less the log-odds of its rate."""
        n = len(shape)
        if self.weights is None:
            return np.zeros(n)
        w = self.weights
        return ((shape - self.mean) / self.scale) @ w[:SHAPES] + self.counts(*found, n) @ w[SHAPES:-1] + w[-1] - np.log(self.rate / (1 - self.rate))


def _unique(row: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, mark), sorted, with how often each occurs."""
    order = np.lexsort((mark, row))
    row, mark = row[order], mark[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])
    at = np.flatnonzero(new)
    return row[at], mark[at], np.diff(np.append(at, len(row)))


def _tallies(sample: DataFrame) -> DataFrame:
    """(mark, and for each label the rows with the mark that have the label, and
    that have it as 1) over the sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                row, mark, _ = _unique(*marks(Words(part.column(0))))
                kinds, back = np.unique(mark, return_inverse=True)
                cols = [pa.array(signed(kinds))]
                for i in (1, 2):
                    y = part.column(i).to_numpy(zero_copy_only=False).astype(np.float64)[row]
                    known = ~np.isnan(y)
                    cols += [pa.array(np.bincount(back, weights=w, minlength=len(kinds)).astype(np.int64)) for w in (known, np.where(known, y, 0))]
                yield pa.RecordBatch.from_arrays(cols, ["mark", "n_low", "k_low", "n_toxic", "k_toxic"])

    found = sample.select("text", *LABELS).mapInArrow(run, "mark long, n_low long, k_low long, n_toxic long, k_toxic long")
    return found.groupBy("mark").agg(*[F.sum(f"{p}_{c}").alias(f"{p}_{c}") for c in LABELS for p in "nk"])


def _features(sample: DataFrame, words: np.ndarray) -> DataFrame:
    """(labels, shape, marks, times) of each sampled row, for the listed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                w, n = Words(part.column(0)), part.num_rows
                row, mark = marks(w)
                some = np.isin(mark, words)
                row, mark, times = _unique(row[some], mark[some])
                off = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                shape = pa.ListArray.from_arrays(pa.array(np.arange(0, n * SHAPES + 1, SHAPES, dtype=np.int32)), pa.array(shapes(w, n).reshape(-1)))
                lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int64) if x is times else signed(x))) for x in (mark, times)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), shape, *lists], [*LABELS, "shape", "marks", "times"])

    return sample.select("text", *LABELS).mapInArrow(run, "low double, toxic double, shape array<double>, marks array<long>, times array<long>")


def fit_models(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labels: int, max_words: int) -> dict[str, Model]:
    """Models of low quality and toxicity from a bounded sample of labelled rows."""
    known = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_lid"))
    chosen = known.agg((1 - F.max("quality")).cast("double").alias("low"), F.max("toxic").cast("double").alias("toxic")).orderBy(F.xxhash64("_lid"), "_lid").limit(max_labels)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_lid"))
    one = rows.groupBy("_id", *LABELS).agg(F.min_by("text", text_mark(F.col("text"))).alias("text"))
    sample = stash(one, "labelled")
    total = sample.agg(*[f(c).alias(f"{p}_{c}") for c in LABELS for p, f in (("n", F.count), ("k", F.sum))]).first()
    tallies = stash(_tallies(sample), "word-tallies")
    models = {}
    for c in LABELS:
        n, k = total[f"n_{c}"], total[f"k_{c}"] or 0.0
        words = None
        if n and 0 < k < n:
            ratio = F.log((F.col(f"k_{c}") + 0.5) / (k + 1)) - F.log((F.col(f"n_{c}") - F.col(f"k_{c}") + 0.5) / (n - k + 1))
            best = tallies.where(F.col(f"n_{c}") >= max(3, n // 2000)).select("mark", (F.abs(ratio) * F.sqrt(f"n_{c}")).alias("gain"))
            words = np.array([r[0] for r in best.where("gain > 0").orderBy(F.desc("gain"), "mark").limit(max_words).collect()], np.int64).view(np.uint64)
        models[c] = Model((k + 0.5) / (n + 1), words)
    found = _features(sample, np.union1d(*[m.words for m in models.values()])).toArrow()  # bounded rows of chosen words
    if found.num_rows:
        column = lambda c: found.column(c).combine_chunks()
        shape = column("shape").flatten().to_numpy().reshape(-1, SHAPES)
        mark, times = column("marks"), column("times").flatten().to_numpy()
        doc = np.repeat(np.arange(found.num_rows), mark.value_lengths().to_numpy())
        for c, m in models.items():
            m.fit(shape, doc, mark.flatten().to_numpy().view(np.uint64), times, column(c).to_numpy(zero_copy_only=False).astype(np.float64))
    return models


def _fold(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(FOLDS)).cast("int")


class Sites:
    """Label counts of hosts and paths outside each fold, and what shrinks them."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, host: str, path: str) -> None:
        """``host`` and ``path`` are SQL expressions."""
        known = labels.groupBy(F.col("doc_id").alias("_lid")).agg(F.max(1 - F.col("quality")).alias("low"), F.max("toxic").alias("toxic"))
        rows = docs.select(F.col(id_col).alias("_id"), F.expr(host).alias("_host"), F.expr(path).alias("_path"), _fold(F.col(id_col)).alias("_fold")).join(known, F.col("_id") == F.col("_lid"))
        counts = [f(c).cast("double").alias(f"{p}_{c}") for c in LABELS for p, f in (("n", F.count), ("k", F.sum))]
        by = stash(rows.groupBy("_host", "_path", "_fold").agg(*counts).fillna(0.0, [f"k_{c}" for c in LABELS]), "site-counts")
        sums = [F.sum(f"{p}_{c}").alias(f"{p}_{c}") for c in LABELS for p in "nk"]
        paths, hosts = by.groupBy("_host", "_path").agg(*sums), by.groupBy("_host").agg(*sums)
        self.paths = self._outside(paths, by.groupBy("_host", "_path", "_fold").agg(*sums), ["_host", "_path"])
        self.hosts = self._outside(hosts, by.groupBy("_host", "_fold").agg(*sums), ["_host"])
        square = lambda k, n: F.coalesce(F.sum(F.try_divide(F.col(k) * F.col(k), F.col(n))), F.lit(0.0))
        top = hosts.agg(*[x for c in LABELS for x in (F.count_if(F.col(f"n_{c}") > 0).alias(f"m_{c}"), F.sum(f"n_{c}").alias(f"n_{c}"), F.sum(f"k_{c}").alias(f"k_{c}"), square(f"k_{c}", f"n_{c}").alias(f"s_{c}"), F.sum(F.col(f"n_{c}") * F.col(f"n_{c}")).alias(f"q_{c}"))]).first()
        inner = paths.groupBy("_host").agg(*[x for c in LABELS for x in (F.count_if(F.col(f"n_{c}") > 0).alias(f"m_{c}"), square(f"k_{c}", f"n_{c}").alias(f"s_{c}"), F.sum(F.col(f"n_{c}") * F.col(f"n_{c}")).alias(f"q_{c}"), F.sum(f"n_{c}").alias(f"n_{c}"))])
        low = inner.agg(*[x for c in LABELS for x in (F.sum(f"m_{c}").alias(f"m_{c}"), F.sum(f"s_{c}").alias(f"s_{c}"), F.coalesce(F.sum(F.try_divide(F.col(f"q_{c}"), F.col(f"n_{c}"))), F.lit(0.0)).alias(f"q_{c}"))]).first()
        per_fold = {r["_fold"]: r for r in by.groupBy("_fold").agg(*sums).collect()}  # 20 rows at most
        self.kappa, self.rates = {}, {}
        for c in LABELS:
            n, k = top[f"n_{c}"] or 0.0, top[f"k_{c}"] or 0.0
            r = (k + 0.5) / (n + 1)
            self.rates[c] = [(k - (per_fold[f][f"k_{c}"] if f in per_fold else 0) + 0.5) / (n - (per_fold[f][f"n_{c}"] if f in per_fold else 0) + 1) for f in range(FOLDS)]
            over_hosts = self._kappa(r, (top[f"s_{c}"] or 0) - (k * k / n if n else 0), (top[f"m_{c}"] or 0) - 1, n - ((top[f"q_{c}"] or 0) / n if n else 0))
            in_hosts = self._kappa(r, (low[f"s_{c}"] or 0) - (top[f"s_{c}"] or 0), (low[f"m_{c}"] or 0) - (top[f"m_{c}"] or 0), n - (low[f"q_{c}"] or 0))
            self.kappa[c] = (over_hosts, in_hosts)

    @staticmethod
    def _kappa(rate: float, between: float, free: float, spread: float) -> float:
        """Pseudo-counts by the method of moments, from 2 to 10,000."""
        tau = (between - free * rate * (1 - rate)) / spread if spread > 1e-9 else 0.0
        return min(1e4, max(2.0, rate * (1 - rate) / tau - 1)) if tau > 0 else 1e4

    @staticmethod
    def _outside(total: DataFrame, by: DataFrame, keys: list[str]) -> DataFrame:
        """The counts of each site without those of each fold: FOLDS rows a site,
        which also spread a hot site over as many join keys."""
        every = total.select("*", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("_fold")).alias("t")
        same = F.col("t._fold") == F.col("f._fold")
        for k in keys:
            same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"f.{k}"))
        left = [(F.col(f"t.{p}_{c}") - F.coalesce(F.col(f"f.{p}_{c}"), F.lit(0.0))).alias(f"{p}_{c}") for c in LABELS for p in "nk"]
        return every.join(by.alias("f"), same, "left").select(*[f"t.{k}" for k in keys], "t._fold", *left)

    def prior(self, c: str, fold: Column, host: tuple[Column, Column], path: tuple[Column, Column]) -> Column:
        """Posterior rate of a path from (labels, labels that are 1) of its host
        and its own, nulls where there are none."""
        zero = F.lit(0.0)
        (a, b), (n, k) = [[F.coalesce(x, zero) for x in pair] for pair in (host, path)]
        over, within = (F.lit(x) for x in self.kappa[c])
        rate = F.get(F.array(*[F.lit(float(x)) for x in self.rates[c]]), fold)
        return (k + within * (b + over * rate) / (a + over)) / (n + within)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", cut: float = 0.5, max_labels: int = 20_000, max_words: int = 400, max_sites: int = 20_000) -> DataFrame:
    """All columns of ``docs`` plus low_posterior, toxic_posterior, kept.

    Site counts are joined by broadcast while there are at most ``max_sites``
    sites, and else by a shuffle on site and fold."""
    models = fit_models(docs, labels, id_col, text_col, max_labels, max_words)
    sites = Sites(docs, labels, id_col, host, path)
    names = docs.columns
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in names]
    plain = docs.select(*[q.alias(f"c{i}") for i, q in enumerate(quoted)], F.expr(host).alias("_dh"), F.expr(path).alias("_dp"), _fold(F.col(id_col)).alias("_df"))
    place = names.index(text_col)
    columns = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, f"c{place}", 1 << 20):
                words = Words(part.column(place))
                shape = shapes(words, part.num_rows)
                found = marks(words)
                extra = [pa.array(models[c].logit(found, shape)) for c in LABELS]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*columns, *[f"_e_{c}" for c in LABELS]])

    scored = plain.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in plain.dtypes) + "".join(f", _e_{c} double" for c in LABELS)).alias("d")
    for table, keys, name in ((sites.hosts, ["_host"], "h"), (sites.paths, ["_host", "_path"], "p")):
        right = F.broadcast(table) if table.limit(max_sites * FOLDS + 1).count() <= max_sites * FOLDS else table
        same = F.col("d._df") == F.col(f"{name}._fold")
        for k, d in zip(keys, ("_dh", "_dp")):
            same = same & F.col(f"d.{d}").eqNullSafe(F.col(f"{name}.{k}"))
        scored = scored.join(right.alias(name), same, "left")

    def posterior(c: str) -> Column:
        prior = sites.prior(c, F.col("d._df"), *[(F.col(f"{t}.n_{c}"), F.col(f"{t}.k_{c}")) for t in "hp"])
        return 1 / (1 + F.exp(-(F.col(f"d._e_{c}") + F.log(prior / (1 - prior)))))

    found = scored.select(*[F.col(f"d.c{i}").alias(c) for i, c in enumerate(names) if c not in ("low_posterior", "toxic_posterior", "kept")], posterior("low").alias("low_posterior"), posterior("toxic").alias("toxic_posterior"))
    return found.withColumn("kept", (F.col("low_posterior") <= cut) & (F.col("toxic_posterior") <= cut))


def op7_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, labels).select("doc_id", "low_posterior", "toxic_posterior", "kept")
