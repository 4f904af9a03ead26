"""Tracks and tables around them: smoothing, retrieval, matrices, splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletlab.functions.sequence import translate_nt


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    h = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-h, h + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def polynomial_weights(width: int, order: int) -> list[float]:
    """Weights of the centre value of a least-squares polynomial over ``width``
    (odd) points."""
    h = width // 2
    a = np.vander(np.arange(-h, h + 1), order + 1, increasing=True).astype(float)
    return np.linalg.pinv(a)[0].tolist()


def smooth(df: DataFrame, weights: list[float], by: list[str], pos: str, value: str, places: int = 4, keep_zero: bool = True) -> DataFrame:
    """Symmetric smoothing of a sparse track whose absent positions are 0.

    Every value is spread over its neighbours and summed by position, so no
    dense grid is made and a long chromosome is no single task.  Rounded, and
    not below 0; positions out of reach of any value are 0 and not listed."""
    h = len(weights) // 2
    w = F.array(*[F.lit(float(x)) for x in weights])
    parts = F.posexplode(F.transform(w, lambda x: x * F.col(value))).alias("k", "part")
    out = df.select(*by, F.col(pos).alias("_p"), parts).groupBy(*by, (F.col("_p") + F.col("k") - h).alias(pos)).agg(F.greatest(F.lit(0.0), F.round(F.sum("part"), places)).alias(value))
    return out if keep_zero else out.where(F.col(value) != 0)


def lookup(sequences: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Sequences of the listed ids, and the ids without one."""
    wanted = ids.select(F.regexp_replace(F.trim(F.col(ids.columns[0])), "^>", "").alias(key)).distinct()
    return sequences.join(wanted, key, "left_semi"), wanted.join(sequences, key, "left_anti")


def peak_sequences(peaks: DataFrame, density: DataFrame, flank: int, name: str = "name", pos: str = "pos") -> DataFrame:
    """Codons of each peak with its flanks, in order, and their translation."""
    near = density.select(F.col(name), F.col(pos).alias("_p"), "codon").join(peaks, name).where(F.col("_p").between(F.col("start") - flank, F.col("end") + flank))
    g = near.groupBy(*peaks.columns).agg(F.sort_array(F.collect_list(F.struct("_p", "codon"))).alias("c"))
    seq = F.array_join(F.transform("c", lambda x: x["codon"]), "")
    return g.select(*peaks.columns, seq.alias("seq"), translate_nt(seq).alias("protein"))


def region_rows(density: DataFrame, ranges: DataFrame, up: int, down: int, name: str = "name", pos: str = "pos") -> DataFrame:
    """Density rows within the named ranges, widened on both sides."""
    r = ranges.select(F.col(name), (F.col("start") - up).alias("_a"), (F.col("end") + down).alias("_b"), F.struct("start", "end").alias("range"))
    return density.join(r, name).where(F.col(pos).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def sequence_matrix(df: DataFrame, seq: str, sample: str, samples: list[str]) -> DataFrame:
    """Counts of each distinct sequence per sample, and in all."""
    cols = [F.count_if(F.col(sample) == s).alias(s) for s in samples]
    return df.groupBy(seq).agg(*cols, F.count("*").alias("total"))


def mapping_ratios(logs: DataFrame, order: list[str], sample: str = "sample", database: str = "database", count: str = "reported", total: str = "processed") -> DataFrame:
    """Counts and shares (%) per sample and database, in the order given."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(database))
    return logs.select(sample, database, rank.cast("int").alias("rank"), F.col(count).alias("count"), F.try_divide(F.col(count) * 100.0, F.col(total)).alias("ratio"))


def quartiles(df: DataFrame, value: str, out: str = "quartile") -> DataFrame:
    """Quartile (1 to 4) of each row; the three cuts are one broadcast row."""
    cuts = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return df.join(F.broadcast(cuts)).withColumn(out, 1 + F.size(F.filter("_q", lambda q: F.col(value) > q))).drop("_q")


def bin_matrix(df: DataFrame, bins: int, name: str = "name", bin_col: str = "bin", value: str = "m") -> DataFrame:
    """One row per gene and one column per bin."""
    return df.groupBy(name).pivot(bin_col, list(range(bins))).agg(F.first(value))


def heatmap_order(matrix: DataFrame, name: str = "name") -> DataFrame:
    """Genes of a matrix by the mean over its columns, largest first."""
    cols = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in matrix.columns if c != name]
    return matrix.withColumn("row_mean", sum(cols[1:], cols[0]) / len(cols)).orderBy(F.desc("row_mean"), name)
