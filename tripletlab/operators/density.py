"""Density tables: ingest, filters, normalisation and shape.

The engine form is long: name, pos (ordered codon index or first nucleotide),
from_tis, from_tts, region, codon, sample, f0, f1, f2.  Every window names its
order column; nothing depends on row order in a file.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIXED = ["name", "now_nt", "from_tis", "from_tts", "region", "codon"]
SHIFT = {"E": -1, "P": 0, "A": 1}


def sample_names(columns: list[str]) -> list[str]:
    """Samples of a wide table, found by the suffix ``_f0``."""
    return [c[:-3] for c in columns if c.endswith("_f0")]


def wide_to_long(wide: DataFrame) -> DataFrame:
    """One row per codon and sample; a map-only explode."""
    items = [F.struct(F.lit(s).alias("sample"), *[F.coalesce(F.col(f"`{s}_f{k}`"), F.lit(0)).cast("long").alias(f"f{k}") for k in range(3)]) for s in sample_names(wide.columns)]
    return wide.select(*FIXED, F.explode(F.array(*items)).alias("x")).select(*FIXED, "x.*")


def long_to_wide(long: DataFrame, samples: list[str]) -> DataFrame:
    aggs = [F.sum(F.when(F.col("sample") == s, F.col(f"f{k}")).otherwise(0)).alias(f"{s}_f{k}") for s in samples for k in range(3)]
    return long.groupBy(*FIXED).agg(*aggs)


def frame(df: DataFrame, which: str = "all", out: str = "x") -> DataFrame:
    """Counts of one frame, or of all three together."""
    return df.withColumn(out, F.col("f0") + F.col("f1") + F.col("f2") if which == "all" else F.col(f"f{which}"))


def clean_codons(df: DataFrame) -> DataFrame:
    return df.withColumn("codon", F.upper("codon")).where(~F.col("codon").contains("N"))


def keep_codons(df: DataFrame, codons: list[str] | DataFrame) -> DataFrame:
    """Rows of listed codons (a list, or a table as read_codons gives)."""
    if isinstance(codons, DataFrame):
        return df.join(codons.select("codon").distinct(), "codon", "left_semi").select(*df.columns)
    return df.where(F.col("codon").isin([c.upper().replace("U", "T") for c in codons]))


def first_genes(df: DataFrame, n: int, name: str = "name") -> DataFrame:
    """The first ``n`` gene names in order, for views of a few genes."""
    return df.select(name).distinct().orderBy(name).limit(n)


def trim(df: DataFrame, tis: int | None = None, tts: int | None = None) -> DataFrame:
    """Keep codons at least ``tis`` after the start and ``tts`` before the stop."""
    if tis is not None:
        df = df.where(F.col("from_tis") >= tis)
    return df if tts is None else df.where(F.col("from_tts") <= -tts)


def totals(df: DataFrame, value: str = "x", by: str = "sample") -> DataFrame:
    return df.groupBy(by).agg(F.sum(value).alias("total"))


def expressed(df: DataFrame, minimum: float, value: str = "x", name: str = "name", sample: str = "sample", n_samples: int | None = None) -> DataFrame:
    """Rows of genes whose sum, averaged over samples, reaches ``minimum``.  Where
    the number of samples is known, the sum comes by a window beside the rows, which
    are then not computed twice."""
    if n_samples is not None:
        d = df.where(F.col(name).isNotNull()).withColumn("_s", F.sum(value).over(Window.partitionBy(name)))
        return d.where(F.col("_s") / n_samples >= minimum).drop("_s")
    per = df.groupBy(name).agg(F.sum(value).alias("s"), F.count_distinct(sample).alias("k"))
    return df.join(per.where(F.col("s") / F.col("k") >= minimum).select(name), name, "left_semi")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: no rows are left")
    return df


def per_million(df: DataFrame, value: str = "x", by: str = "sample", scale: float = 1e6, out: str = "rpm") -> DataFrame:
    """Counts per ``scale`` of the sample's total; totals are one row per sample."""
    t = totals(df, value, by)
    return df.join(F.broadcast(t), by).withColumn(out, F.try_divide(F.col(value) * F.lit(scale), F.col("total"))).drop("total")


def shift_site(df: DataFrame, site: str, value: str = "x", name: list[str] | None = None, pos: str = "pos", out: str = "shifted") -> DataFrame:
    """Counts moved to the E, P or A site within a gene, 0 where none comes in."""
    w = Window.partitionBy(*(name or ["name"])).orderBy(pos)
    k = SHIFT.get(site, 0)
    moved = F.col(value) if k == 0 else F.lag(value, 1, 0).over(w) if k > 0 else F.lead(value, 1, 0).over(w)
    return df.withColumn(out, moved)


def rezero(df: DataFrame, pos: str = "pos", name: str = "name", out: str = "pos0") -> DataFrame:
    return df.withColumn(out, F.col(pos) - F.min(pos).over(Window.partitionBy(name)) + 1)


@dataclass(frozen=True)
class Ingest:
    rows: DataFrame
    totals: DataFrame
    samples: list[str]


def ingest(wide: DataFrame, genes: DataFrame | None = None, site: str = "P", which: str = "all", minimum: float = 0, tis: int | None = None, tts: int | None = None) -> Ingest:
    """The chain that most analyses start from: clean, count totals, keep listed
    genes, trim, merge frames, shift the site, keep expressed genes."""
    rows = frame(wide_to_long(clean_codons(wide)), which)
    total = totals(frame(wide_to_long(wide), "all"))
    if genes is not None:
        rows = rows.join(genes.select(F.col(genes.columns[0]).alias("name")).distinct(), "name", "left_semi")
    rows = shift_site(trim(rows, tis, tts), site, name=["name", "sample"], pos="now_nt", out="x")
    names = sample_names(wide.columns)
    return Ingest(expressed(rows, minimum, n_samples=len(names)) if minimum else rows, total, names)


@dataclass(frozen=True)
class IngestPair:
    ribo: Ingest
    rna: Ingest
    pairs: list[tuple[str, str]]


def ingest_pair(ribo: DataFrame, rna: DataFrame, pairs: list[tuple[str, str]] | None = None, genes: DataFrame | None = None, site: str = "P", minimum: float = 0, tis: int | None = None, tts: int | None = None) -> IngestPair:
    """ingest() of both assays; only genes that both keep remain in either.
    Samples are paired as listed, or else by their order, which needs equally
    many; the site shift is for ribosomes only."""
    a = ingest(ribo, genes, site, "all", minimum, tis, tts)
    b = ingest(rna, genes, "P", "all", minimum, tis, tts)
    if pairs is None and len(a.samples) != len(b.samples):
        raise ValueError(f"{len(a.samples)} ribo and {len(b.samples)} rna samples: name the pairs")
    both = a.rows.select("name").intersect(b.rows.select("name")).repartition("name")  # one exchange, which both results read
    keep = lambda x: Ingest(x.rows.join(both, "name", "left_semi"), x.totals, x.samples)
    return IngestPair(keep(a), keep(b), pairs or list(zip(a.samples, b.samples)))


def codon_grid(annotation: DataFrame) -> DataFrame:
    """Codon rows of each transcript from its three lengths: name, now_nt,
    from_tis, from_tts, region (a trailing part of a codon moves to the 3' UTR)."""
    a = annotation.select("name", F.col("utr5_length").alias("u"), F.col("cds_length").alias("c"), F.col("utr3_length").alias("t"))
    a = a.select("name", "u", (F.col("c") - F.col("c") % 3).alias("c"), (F.col("t") + F.col("c") % 3).alias("t"))
    a = a.withColumns({"s5": F.col("u") % 3, "u2": F.col("u") - F.col("u") % 3, "t2": F.col("t") - F.col("t") % 3})
    a = a.withColumn("n", F.expr("(u2 + c + t2) div 3")).where("n > 0")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")
    g = a.select("*", k)
    tis, tts = F.col("k") - F.expr("u2 div 3"), F.expr("t2 div 3") - F.col("n") + 1 + F.col("k")
    region = F.when(tis < 0, "5utr").when(tts > 0, "3utr").otherwise("cds")
    return g.select("name", (1 + F.col("s5") + 3 * F.col("k")).alias("now_nt"), tis.alias("from_tis"), tts.alias("from_tts"), region.alias("region"))


def format_density(annotation: DataFrame, sequences: DataFrame, hits: DataFrame) -> DataFrame:
    """Density table from (name, nt, n) hits: grid, codon letters, three frames."""
    grid = codon_grid(annotation).join(sequences.select("name", "seq"), "name").withColumn("codon", F.expr("substring(seq, cast(now_nt as int), 3)")).drop("seq")
    start = annotation.select("name", (F.col("utr5_length") % 3).alias("s5"))
    h = hits.join(start, "name").select("name", (F.col("nt") - F.pmod(F.col("nt") - 1 - F.col("s5"), F.lit(3))).alias("now_nt"), F.pmod(F.col("nt") - 1 - F.col("s5"), F.lit(3)).alias("f"), "n")
    three = h.groupBy("name", "now_nt").agg(*[F.sum(F.when(F.col("f") == k, F.col("n")).otherwise(0)).alias(f"f{k}") for k in range(3)])
    return grid.join(three, ["name", "now_nt"], "left").fillna(0, ["f0", "f1", "f2"])


def melt_nucleotides(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Three rows per codon: its nucleotides with their places and counts."""
    items = F.array(*[F.struct(F.lit(k).alias("frame"), F.substring("codon", k + 1, 1).alias("base"), F.col(f"f{k}").alias("n")) for k in range(3)])
    return df.select("*", F.explode(items).alias("m")).select(*df.columns, "m.*", (F.col(pos) + F.col("m.frame")).alias("nt"))


def merge_samples(tables: dict[str, DataFrame], keys: list[str], values: list[str], how: str = "inner") -> DataFrame:
    """Join per-sample tables on their keys; values get the sample's name."""
    named = [t.select(*keys, *[F.col(v).alias(f"{s}_{v}") for v in values]) for s, t in tables.items()]
    return reduce(lambda a, b: a.join(b, keys, how), named)


def union_long(tables: dict[str, DataFrame], label: str = "sample") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(label, F.lit(s)) for s, t in tables.items()])


def sample_of_file(path: Column) -> Column:
    """Sample name from a file path: base name up to the first underscore or dot."""
    return F.regexp_extract(path, r"([^/]+?)(?:[_.][^/]*)?$", 1)


def pivot_samples(df: DataFrame, keys: list[str], sample: str, value: str, samples: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(sample, samples).agg(F.first(value))


def expand_intervals(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per base of half-open intervals."""
    ok = df.where(F.col(end) > F.col(start))
    return ok.withColumn("pos", F.explode(F.sequence(F.col(start), F.col(end) - 1)))


def gene_profile(df: DataFrame, genes: DataFrame | None = None, sample: str = "sample") -> DataFrame:
    """Nucleotide profile of genes: counts of each frame per ten million of the
    sample, and relative to an even spread over all nucleotides of the table."""
    total = df.groupBy(sample).agg(F.sum(F.col("f0") + F.col("f1") + F.col("f2")).alias("_total"), (F.count("*") * 3).alias("_cells"))
    some = df if genes is None else df.join(genes, "name", "left_semi")
    d = some.join(F.broadcast(total), sample).select("name", "from_tis", "from_tts", sample, "_total", "_cells", F.posexplode(F.array("f0", "f1", "f2")).alias("frame", "_n"))
    share = F.try_divide(F.col("_n").cast("double"), F.col("_total"))
    return d.select("name", "from_tis", "from_tts", sample, "frame", (share * 1e7).alias("rpm"), (share * F.col("_cells")).alias("density"))
