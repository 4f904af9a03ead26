"""Sinks: tab-separated text at the edge, Parquet inside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, by: list[str] | None = None, places: int | None = None) -> None:
    """Tab-separated with header; doubles rounded to ``places``, one folder per
    value of ``by``."""
    if places is not None:
        df = df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t in ("double", "float") and c not in (by or [])})
    w = df.write.option("sep", "\t").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def write_bedgraph(track: DataFrame, path: str, value: str = "rpm", by_strand: bool = False) -> None:
    """Sorted chr, start, end, value without header."""
    cols = ["chr", "start", "end", value]
    if by_strand:
        track.select(*cols, "strand").repartitionByRange("strand", "chr", "start").sortWithinPartitions("chr", "start").write.partitionBy("strand").option("sep", "\t").csv(path)
    else:
        track.select(*cols).orderBy("chr", "start").write.option("sep", "\t").csv(path)


def write_annotation(models: DataFrame, path: str) -> None:
    """The 11-column annotation; prefixes of identifiers go."""
    bare = lambda c: F.regexp_replace(c, "^(cds-|rna-|gene-)", "")
    cols = [F.col("chrom").alias("chromosome"), bare("name2").alias("gene_id"), bare("name").alias("transcript_id"), F.col("txStart").alias("start"), F.col("txEnd").alias("end"), "utr5_length", "cds_length", "utr3_length", "strand", "rep_transcript", "modified"]
    write_tsv(models.select(*cols), path)


def write_wig(track: DataFrame, path: str, value: str = "rpm", by_strand: bool = False) -> None:
    """Sorted chr, start, value without header; values that are no number go."""
    ok = track.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(value) < float("inf")))
    cols = ["chr", "start", value]
    if by_strand:
        ok.select(*cols, "strand").repartitionByRange("strand", "chr", "start").sortWithinPartitions("chr", "start").write.partitionBy("strand").option("sep", "\t").csv(path)
    else:
        ok.select(*cols).orderBy("chr", "start").write.option("sep", "\t").csv(path)
