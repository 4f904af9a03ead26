"""Delimited tables with declared schemas; none is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANNOTATION = "chromosome string, gene_id string, transcript_id string, start int, end int, utr5_length int, cds_length int, utr3_length int, strand string, rep_transcript boolean, modified boolean"
ANNOTATION_NAMED = ANNOTATION.replace("gene_id string, ", "gene_id string, gene_name string, ")
OFFSETS = "length int, frame0 int, rpfs0 bigint, frame1 int, rpfs1 bigint, frame2 int, rpfs2 bigint, p_site int, rpfs bigint, periodicity double, ribo string"
DENSITY_FIXED = "name string, now_nt int, from_tis int, from_tts int, region string, codon string"


def _tsv(spark: SparkSession, path, schema, header: bool = True, comment: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("sep", "\t").option("header", header).option("enforceSchema", True)
    return (r.option("comment", comment) if comment else r).csv(path)


def header_of(spark: SparkSession, path: str, comment: str | None = None) -> list[str]:
    """Column names of a tab-separated file: its first line that is no comment."""
    lines = spark.read.text(path)
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    first = lines.first()
    return first[0].rstrip("\r").split("\t") if first else []


def read_density(spark: SparkSession, path: str) -> DataFrame:
    """Wide density table; sample columns are found in the header."""
    names = header_of(spark, path)
    fixed = [f.name for f in T._parse_datatype_string(DENSITY_FIXED).fields]
    if names[:2] != fixed[:2] or set(fixed) - set(names):
        raise ValueError(f"not a density table: {names[:6]}")
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(DENSITY_FIXED).fields}
    schema = T.StructType([T.StructField(n, kinds.get(n, T.LongType())) for n in names])
    return _tsv(spark, path, schema)


def read_annotation(spark: SparkSession, path: str, representative: bool = False, coding: bool = False) -> DataFrame:
    named = "gene_name" in header_of(spark, path)
    df = _tsv(spark, path, ANNOTATION_NAMED if named else ANNOTATION).withColumn("length", F.col("utr5_length") + F.col("cds_length") + F.col("utr3_length"))
    if representative:
        df = df.where("rep_transcript")
    return df.where("cds_length <> 0") if coding else df


def fitting_genes(annotation: DataFrame, utr5: int, cds: int, utr3: int) -> tuple[DataFrame, tuple[int, int, int]]:
    """Genes long enough for a window; a part that no gene can fill falls back
    to the median (half of it for the CDS)."""
    s = annotation.agg(*[f(c).alias(f"{n}{c}") for c in ("utr5_length", "cds_length", "utr3_length") for n, f in (("x", F.max), ("m", F.median))]).first()
    want = []
    for c, w in (("utr5_length", utr5), ("cds_length", cds), ("utr3_length", utr3)):
        half = 2 if c == "cds_length" else 1
        want.append(int(s[f"m{c}"] // half) if w > (s[f"x{c}"] or 0) else w)
    u, c, t = want
    return annotation.where(f"utr5_length >= {u} AND cds_length >= {c} AND utr3_length >= {t}"), (u, c, t)


def read_offsets(spark: SparkSession, path: str, periodicity: float = 0.0, lengths: tuple[int, int] | None = None) -> DataFrame:
    """Offsets per read length as arrays, counted from 0, and the monomer class."""
    df = _tsv(spark, path, OFFSETS).dropna().where(F.col("periodicity") >= periodicity)
    if lengths:
        df = df.where(F.col("length").between(*lengths))
    return df.groupBy("length").agg(F.sort_array(F.collect_list(F.col("p_site") - 1)).alias("p_site"), F.count_distinct("ribo").alias("ribosomes"))


def read_list(spark: SparkSession, path: str, column: str = "transcript_id") -> DataFrame:
    """Ids from the named column or else the first one; the header is consumed."""
    names = header_of(spark, path)
    df = _tsv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return df.select(F.trim(F.col(f"`{column if column in names else names[0]}`")).alias("name")).where("name <> ''").distinct()


def read_codons(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path).select(F.translate(F.upper(F.trim("value")), "U", "T").alias("codon"))
    return text.where("codon <> '' AND length(codon) % 3 = 0")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "name string, group string")


def read_design(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "name string, group string, file string")


def read_counts(spark: SparkSession, path: str, lead: int = 6, suffix: str = r"(\.genes\.results|\.isoforms\.results|_quant|\.bam)$") -> DataFrame:
    """Count matrix with ``lead`` leading columns; sample names lose their suffix."""
    names = header_of(spark, path, "#")
    schema = T.StructType([T.StructField(n, T.StringType() if i < lead else T.DoubleType()) for i, n in enumerate(names)])
    df = _tsv(spark, path, schema, comment="#")
    import re

    clean = [n if i < lead else re.sub(suffix, "", n.rsplit("/", 1)[-1]) for i, n in enumerate(names)]
    df = df.toDF(*clean)
    return df.select(*clean[:lead], *[F.col(f"`{c}`").cast("long").alias(c) for c in clean[lead:]])


def min_mean(df: DataFrame, suffix: str, minimum: float) -> DataFrame:
    """Rows whose mean over the columns with a suffix reaches ``minimum``."""
    cols = [F.col(f"`{c}`") for c in df.columns if c.endswith(suffix)]
    return df.where(sum(cols[1:], cols[0]) / len(cols) >= minimum)


def read_results(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Quantification results: id and one of expected_count, TPM, FPKM."""
    names = header_of(spark, path)
    df = _tsv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return df.select(F.col(f"`{names[0]}`").alias("name"), F.expr(f"try_cast(`{value}` AS double)").alias(value))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    df = _tsv(spark, path, "chr string, start int, end int, rpm double", header=False)
    return df.where(~F.isnan("rpm") & (F.abs("rpm") < float("inf")))


def read_peaks(spark: SparkSession, path: str, alpha: float | None = None) -> DataFrame:
    """Peak table; ``-`` is null."""
    names = header_of(spark, path)
    df = _tsv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    df = df.select(*[F.nullif(F.col(f"`{n}`"), F.lit("-")).alias(n) for n in names])
    return df if alpha is None else df.where(F.expr("try_cast(BHFDR AS double)") < alpha)


def read_aligner_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log: file, reads processed, alignments reported."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.select("file", F.regexp_extract("value", r"# reads processed: (\d+)", 1).try_cast("long").alias("processed"), F.regexp_extract("value", r"Reported (\d+)", 1).try_cast("long").alias("reported"))


def read_orf_bed(spark: SparkSession, path: str) -> DataFrame:
    """ORFs from BED rows named ``orf;gene;rna;type``: exons in order per ORF."""
    df = _tsv(spark, path, "chrom string, start int, end int, label string, score string, strand string", header=False)
    part = F.split("label", ";")
    df = df.select("chrom", "start", "end", "strand", *[part[i].alias(n) for i, n in enumerate(("orf", "gene", "rna", "kind"))])
    return df.groupBy("orf", "gene", "rna", "kind", "chrom", "strand").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"), F.sum(F.col("end") - F.col("start")).alias("length"))


def read_orf_table(spark: SparkSession, path: str, max_p: float = 0.05, min_aa: int = 0, kind: str = "uORF|dORF|Novel") -> DataFrame:
    names = header_of(spark, path)
    df = _tsv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    df = df.where((F.expr("try_cast(RiboPvalue AS double)") < max_p) & (F.expr("try_cast(AALen AS int)") >= min_aa) & F.col("TisType").rlike(kind))
    place = F.split("GenomePos", ":")
    blocks = F.transform(F.split("Blocks", ","), lambda b: F.struct(F.split(b, "-")[0].cast("int").alias("start"), F.split(b, "-")[1].cast("int").alias("end")))
    return df.select("*", place[0].alias("chrom"), place[2].alias("strand"), blocks.alias("blocks"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample list: name and file."""
    names = header_of(spark, path)
    df = _tsv(spark, path, T.StructType([T.StructField(n.lower(), T.StringType()) for n in names]))
    return df.select(F.trim(df.columns[0]).alias("name"), F.trim(df.columns[1]).alias("file")).where("name <> ''")


def filter_orfs(orfs: DataFrame, kinds: list[str], low: int, high: int) -> DataFrame:
    """ORFs of the listed classes with a length within bounds, by chromosome and place."""
    some = orfs.where(F.col("kind").isin(kinds) & F.col("length").between(low, high))
    return some.orderBy("chrom", F.col("exons")[0]["start"], "orf")


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chr string, start int, value double", header=False)


def read_offset_detail(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Offset matrices ``<sample>_<tis|tts>_<5end|3end>`` (one row a read length,
    one column an offset) as one long table."""
    parts = []
    for path in paths:
        stem = path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
        sample, site, end = stem.rsplit("_", 2)
        if site not in ("tis", "tts") or end not in ("5end", "3end"):
            raise ValueError(f"not an offset matrix: {stem}")
        names = header_of(spark, path)
        wide = _tsv(spark, path, T.StructType([T.StructField(f"c{i}", T.LongType()) for i in range(len(names))]))
        cells = F.explode(F.array(*[F.struct(F.lit(int(n)).alias("offset"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names) if i])).alias("x")
        parts.append(wide.select(F.lit(sample).alias("sample"), F.lit(site).alias("site"), F.lit(f"{end[0]}p-end").alias("end"), F.col("c0").cast("int").alias("length"), cells).select("sample", "site", "end", "length", "x.*"))
    from functools import reduce

    return reduce(DataFrame.unionByName, parts)


def offset_ends(detail: DataFrame, offsets: list[int]) -> DataFrame:
    """One row per sample, site and length, with both ends' offsets side by side."""
    cell = lambda e, o: F.sum(F.when((F.col("end") == f"{e}p-end") & (F.col("offset") == o), F.col("n"))).alias(f"{e}p_{o}")
    return detail.groupBy("sample", "site", "length").agg(*[cell(e, o) for e in "53" for o in offsets])


def with_stop(orfs: DataFrame) -> DataFrame:
    """ORFs of read_orf_bed with the stop codon: three nucleotides more at the
    last block on the plus strand, before the first one on the minus strand; and
    the frame of each block, counted in reading direction."""
    last = F.size("exons") - 1
    wider = F.transform("exons", lambda x, i: F.struct(F.when((F.col("strand") == "-") & (i == 0), x["start"] - 3).otherwise(x["start"]).alias("start"), F.when((F.col("strand") != "-") & (i == last), x["end"] + 3).otherwise(x["end"]).alias("end")))
    d = orfs.withColumns({"exons": wider, "length": F.col("length") + 3})
    ahead = lambda i: F.when(F.col("strand") == "-", F.slice("exons", i + 2, F.size("exons"))).otherwise(F.slice("exons", F.lit(1), i))
    return d.withColumn("frames", F.transform("exons", lambda x, i: F.aggregate(ahead(i), F.lit(0), lambda t, e: t + e["end"] - e["start"]) % 3))
