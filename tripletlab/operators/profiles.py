"""Per-gene and per-codon profiles: quantities, pausing, occupancy, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletlab.functions.tables import written


def _per(names: list[str]) -> Window:
    return Window.partitionBy(*names)


def region_quant(df: DataFrame, value: str = "x", name: str = "name", sample: str = "sample", tis: int | None = None, tts: int | None = None) -> DataFrame:
    """Counts per gene, region and sample with RPM, RPKM and TPM.  Lengths are
    the whole gene's rows times three; one grouped pass gives counts, lengths and
    totals.  With ``tis`` and ``tts``, coding rows near the start and the stop
    count neither as reads of their region nor as its rows, but in the totals."""
    inside = F.lit(True)
    if tis is not None:
        inside = inside & (F.col("from_tis") >= tis)
    if tts is not None:
        inside = inside & (F.col("from_tts") <= -tts)
    kept = (F.col("region") != "cds") | inside
    gene = df.groupBy(name, "region", sample).agg(F.coalesce(F.sum(F.when(kept, F.col(value))), F.lit(0)).alias("count"), F.sum(value).alias("all"), F.count_if(kept).alias("rows"))
    total = gene.groupBy(sample).agg(F.sum("all").alias("total"))
    q = gene.withColumn("length", F.sum("rows").over(_per([name, sample])) * 3).where("rows > 0").join(F.broadcast(total), sample)
    q = q.withColumn("rpk", F.try_divide(F.col("count") * 1e3, F.col("length")))
    all_rpk = q.groupBy("region", sample).agg(F.sum("rpk").alias("sum_rpk"))
    q = q.join(F.broadcast(all_rpk), ["region", sample])
    return q.select(
        name, "region", sample, "count",
        F.try_divide(F.col("count") * 1e6, F.col("total")).alias("rpm"),
        F.try_divide(F.col("count") * 1e9, F.col("length") * F.col("total")).alias("rpkm"),
        F.try_divide(F.col("rpk") * 1e6, F.col("sum_rpk")).alias("tpm"),
    )


def shares(df: DataFrame, keys: list[str], within: list[str], value: str, out: str = "share") -> DataFrame:
    """Sum by keys, and its share (%) of the sum within ``within``."""
    s = df.groupBy(*dict.fromkeys([*within, *keys])).agg(F.sum(value).alias("count"))
    return s.withColumn(out, F.try_divide(F.col("count") * 100.0, F.sum("count").over(_per(within))))


def periodicity(df: DataFrame, sample: str = "sample") -> DataFrame:
    """Counts and percentage of the three frames of each sample."""
    long = df.select(sample, F.explode(F.array(*[F.struct(F.lit(k).alias("frame"), F.col(f"f{k}").alias("n")) for k in range(3)])).alias("v")).select(sample, "v.*")
    return shares(long, ["frame"], [sample], "n", "ratio")


def metagene(df: DataFrame, value: str = "x", name: str = "name", at: str = "from_tis", lo: int = -10, hi: int = 20) -> DataFrame:
    """Mean density per gene at each offset from the start (or stop)."""
    genes = df.agg(F.count_distinct(name).alias("genes"))
    some = df.where(F.col(at).between(lo, hi)).groupBy(at).agg(F.sum(value).alias("s"))
    return some.join(F.broadcast(genes)).select(F.col(at).alias("offset"), F.try_divide("s", "genes").alias("density"))


def equal_bins(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Right-closed equal-width bins of lo..hi, the lowest value in bin 0."""
    return F.greatest(F.lit(0), F.ceil(F.try_divide((i - lo) * float(bins), (hi - lo).cast("double"))) - 1).cast("int")


def coverage(df: DataFrame, bins: int, value: str = "x", name: str = "name", pos: str = "pos") -> DataFrame:
    """Mean of genes' mean densities in equal-width bins of the gene."""
    ends = df.groupBy(name).agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"))
    genes = ends.agg(F.count("*").alias("genes"))
    binned = df.join(ends, name).withColumn("bin", F.coalesce(equal_bins(F.col(pos), F.col("lo"), F.col("hi"), bins), F.lit(0)))
    per = binned.groupBy(name, "bin").agg(F.avg(value).alias("m"))
    return per.groupBy("bin").agg(F.sum("m").alias("s")).join(F.broadcast(genes)).select("bin", F.try_divide("s", "genes").alias("density"))


def fill_outliers(df: DataFrame, value: str = "x", name: str = "name", width: float = 2.0, how: str = "iqr") -> DataFrame:
    """Values beyond ``width`` interquartile ranges, or with a z-score beyond
    ``width`` (``how`` = zscore), become the gene's mean."""
    if how == "zscore":
        w = _per([name])
        z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
        return df.withColumn("filled", F.when(F.abs(z) > width, F.avg(value).over(w)).otherwise(F.col(value).cast("double")))
    q = df.groupBy(name).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"), F.avg(value).alias("mean"))
    iqr = F.col("q3") - F.col("q1")
    out = (F.col(value) < F.col("q1") - width * iqr) | (F.col(value) > F.col("q3") + width * iqr)
    return df.join(q, name).withColumn("filled", F.when(out, F.col("mean")).otherwise(F.col(value).cast("double"))).drop("q1", "q3", "mean")


def pausing_gene_mean(df: DataFrame, value: str = "x", names: list[str] | None = None, inside: Column | None = None, out: str = "pause") -> DataFrame:
    """x over the gene's mean (of the rows ``inside``), 0 where the mean is 0."""
    x = F.col(value) if inside is None else F.when(inside, F.col(value))
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(value), F.avg(x).over(_per(names or ["name"]))), F.lit(0.0)))


def pausing_background(df: DataFrame, b: int, value: str = "x", names: list[str] | None = None, pos: str = "pos", centered: bool = False, out: str = "pause") -> DataFrame:
    """x over the mean of 2b+1 positions from x on (or around x); positions past
    the end of the gene count as 0."""
    lo, hi = (-b, b) if centered else (0, 2 * b)
    mean = F.sum(value).over(_per(names or ["name"]).orderBy(pos).rowsBetween(lo, hi)) / (2 * b + 1)
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(value), mean), F.lit(0.0)))


def pausing_by_gene_codon(df: DataFrame, score: str = "pause", name: str = "name") -> DataFrame:
    return df.groupBy(name, "codon").agg(F.sum(score).alias("pause_sum"), F.avg(score).alias("pause_mean"))


def pausing_by_gene(df: DataFrame, score: str = "pause", name: str = "name", pos: str = "pos", last: str = "from_tis") -> DataFrame:
    return df.groupBy(name).agg(F.sum(score).alias("pause_sum"), F.max_by(last, pos).alias("last"))


def pausing_by_codon(df: DataFrame, score: str = "pause", value: str = "x") -> DataFrame:
    """Codons, those with counts, counts, mean score over all and over covered
    rows, and the mean relative to the largest."""
    s = df.groupBy("codon").agg(
        F.count("*").alias("total_codon"), F.count_if(F.col(value) > 0).alias("valid_codon"), F.sum(value).alias("counts"),
        F.avg(score).alias("mean_all"), F.avg(F.when(F.col(value) > 0, F.col(score))).alias("mean_valid"),
    )
    top = s.agg(F.max("mean_all").alias("top"))
    return s.join(F.broadcast(top)).withColumn("relative", F.try_divide("mean_all", "top")).drop("top")


def occupancy(df: DataFrame, value: str = "x", name: str = "name") -> DataFrame:
    """Gene-mean-normalised density per codon, over non-zero sites."""
    d = df.withColumn("d", F.try_divide(F.col(value), F.avg(value).over(_per([name]))))
    s = d.groupBy("codon").agg(F.sum("d").alias("occ_sum"), F.avg(F.nullif(F.col("d"), F.lit(0.0))).alias("occ_mean"))
    top = s.agg(F.max("occ_mean").alias("top"))
    return s.join(F.broadcast(top)).withColumn("relative", F.try_divide("occ_mean", "top")).drop("top")


def codon_usage(counts: DataFrame, codon: str = "codon", aa: str = "aa", n: str = "n") -> DataFrame:
    """Frequency per thousand, RSCU, relative adaptiveness and the optimal codon."""
    w = _per([aa])
    total = counts.agg(F.sum(n).alias("total"))
    best = F.row_number().over(w.orderBy(F.desc(n), codon)) == 1
    return counts.join(F.broadcast(total)).select(
        codon, aa, n, F.try_divide(F.col(n) * 1000.0, F.col("total")).alias("freq"), F.try_divide(F.col(n), F.avg(n).over(w)).alias("rscu"),
        F.try_divide(F.col(n).cast("double"), F.max(n).over(w)).alias("weight"), best.alias("optimal"),
    )


def adaptation_index(codons: DataFrame, weights: DataFrame, name: str = "name") -> DataFrame:
    """Geometric mean of the codons' weights in each gene."""
    w = weights.where("weight > 0").select("codon", "weight")
    return codons.join(F.broadcast(w), "codon").groupBy(name).agg(F.exp(F.avg(F.log("weight"))).alias("cai"))


def expected_residues(base_freq: DataFrame, dimension: DataFrame, stop_factor: float = 1.057) -> DataFrame:
    """Residue shares that the base composition would give."""
    base = {b: base_freq.select(F.col("base").alias(f"b{b}"), F.col("freq").alias(f"p{b}")) for b in range(3)}
    d = dimension
    for b in range(3):
        d = d.join(F.broadcast(base[b]), F.substring("codon", b + 1, 1) == F.col(f"b{b}"))
    return d.where("aa <> '*'").groupBy("aa").agg((F.sum(F.col("p0") * F.col("p1") * F.col("p2")) * stop_factor).alias("expected"))


def gene_cov(df: DataFrame, value: str = "x", name: str = "name") -> DataFrame:
    g = df.groupBy(name).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return g.withColumn("cov", F.try_divide("sd", "mean")).drop("sd").dropna("any")


def cumulative_cov(df: DataFrame, value: str = "x", name: str = "name", pos: str = "pos") -> DataFrame:
    """Sample deviation over mean of all positions up to each one."""
    w = _per([name]).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cov", F.try_divide(F.stddev_samp(value).over(w), F.avg(value).over(w)))


def meta_cumulative_cov(covs: DataFrame, longer_than: int, name: str = "name", pos: str = "pos") -> DataFrame:
    """Mean cumulative CoV at each place over genes longer than the trim."""
    w = _per([name])
    keep = covs.withColumn("_n", F.max(pos).over(w)).where((F.col("_n") > longer_than) & (F.col(pos) <= longer_than))
    return keep.groupBy(pos).agg(F.avg("cov").alias("cov"))


def decoding_time(ribo: DataFrame, rna_rpkm: DataFrame, value: str = "x", name: str = "name") -> DataFrame:
    """Per codon: counts and counts over the gene's RNA level, per covered site."""
    per = ribo.groupBy(name, "codon").agg(F.sum(value).alias("s"), F.count_if(F.col(value) > 0).alias("sites"))
    j = per.join(rna_rpkm.where("rpkm > 0"), name).withColumn("norm", F.try_divide("s", "rpkm"))
    c = j.groupBy("codon").agg(F.sum("s").alias("counts"), F.sum("sites").alias("sites"), F.sum("norm").alias("norm"))
    return c.select("codon", "counts", "sites", F.try_divide("counts", "sites").alias("cdt"), F.try_divide("norm", "sites").alias("norm_cdt"))


def selection_time(gene_codons: DataFrame, genes: DataFrame, times: int) -> DataFrame:
    """Codon selection times after ``times`` rounds.

    gene_codons: (name, codon, n, ribo, rna); genes: (name, codons, density).
    Each round weights a gene's RNA counts by its initiation rate, which comes
    from the codon times before.  The table is written once with one row per gene,
    so a round is one map and one partial aggregate over it; the codon times (64
    numbers) stay on the driver between rounds, and plans do not grow."""
    spark = gene_codons.sparkSession
    items = gene_codons.groupBy("name").agg(F.collect_list(F.struct("codon", "n", "ribo", "rna")).alias("items"))
    table = written(genes.join(items, "name").select("codons", "density", "items"), "gene-codons")
    flat = table.select(F.explode("items").alias("i"))
    ribo = {r[0]: r[1] for r in flat.groupBy("i.codon").agg(F.sum("i.ribo")).collect()}
    all_ribo = float(sum(v or 0 for v in ribo.values()))
    cst: dict[str, float] | None = None
    for _ in range(times):
        weight = F.lit(1.0)
        if cst is not None:
            known = F.create_map(*[x for c, v in cst.items() for x in (F.lit(c), F.lit(v))])
            time = F.aggregate("items", F.lit(0.0), lambda t, i: t + i["n"] * F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == i["codon"])), F.lit(0)), F.lit(0.0)))
            weight = F.coalesce(F.try_divide(F.col("codons") * F.col("density"), time), F.lit(0.0))
        rna = {r[0]: r[1] or 0.0 for r in table.select(weight.alias("w"), F.explode("items").alias("i")).groupBy("i.codon").agg(F.sum(F.col("i.rna") * F.col("w"))).collect()}
        all_rna = sum(rna.values())
        share = {c: (ribo[c] or 0) / all_ribo if all_ribo else None for c in ribo}
        cst = {c: share[c] / (rna[c] / all_rna) if all_rna and rna[c] and share[c] is not None else 0.0 for c in ribo}
    return spark.createDataFrame(sorted((cst or {}).items()), "codon string, cst double")


def windows_around(df: DataFrame, match: Column, around: int, value: str = "x", name: str = "name", pos: str = "pos", unique: bool = False) -> DataFrame:
    """Rows (name, site, offset, value) within ``around`` codons of matches whose
    whole window lies inside the gene.  One window pass per gene: each match
    collects its neighbours by lag and lead, no self join.  ``unique`` drops
    matches closer than twice ``around`` to another one."""
    w = _per([name]).orderBy(pos)
    near = F.collect_list(value).over(w.rowsBetween(-around, around))
    d = df.withColumns({"_near": near, "_m": match})
    d = d.where("_m").where(F.size("_near") == 2 * around + 1)
    if unique:
        gap = 2 * around
        d = d.withColumns({"_a": F.col(pos) - F.lag(pos).over(w), "_b": F.lead(pos).over(w) - F.col(pos)})
        d = d.where(((F.col("_a") >= gap) | F.col("_a").isNull()) & ((F.col("_b") >= gap) | F.col("_b").isNull()))
    return d.select(F.col(name), F.col(pos).alias("site"), F.posexplode("_near").alias("k", "value")).select(name, "site", (F.col("k") - around).alias("offset"), "value")


def motif_match(codons: list[str], name: str = "name", pos: str = "pos") -> Column:
    """Whether a run of codons starts here."""
    w = _per([name]).orderBy(pos)
    found = F.col("codon") == codons[0]
    for k, c in enumerate(codons[1:], 1):
        found = found & (F.lead("codon", k).over(w) == c)
    return F.coalesce(found, F.lit(False))


def meta_window(windows: DataFrame, scale: bool = False) -> DataFrame:
    m = windows.groupBy("offset").agg(F.avg("value").alias("density"))
    if scale:
        mean = m.agg(F.avg("density").alias("mean"))
        m = m.join(F.broadcast(mean)).select("offset", F.try_divide("density", "mean").alias("density"))
    return m


def moving_mean(df: DataFrame, half: int, value: str = "x", name: str = "name", pos: str = "pos", out: str = "smooth") -> DataFrame:
    """Centred mean whose window repeats the edge values past both ends."""
    w = _per([name])
    o = w.orderBy(pos)
    body = F.sum(value).over(o.rowsBetween(-half, half))
    before = F.greatest(F.lit(0), half + 1 - F.row_number().over(o))
    after = F.greatest(F.lit(0), half - (F.count("*").over(w) - F.row_number().over(o)))
    first, last = F.first(value).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(out, (body + before * first + after * last) / (2 * half + 1))


def occupancy_nonzero(df: DataFrame, minimum: float, site: str = "P", value: str = "x", name: str = "name", pos: str = "pos", sample: str = "sample") -> DataFrame:
    """Occupancy in its older form: genes whose largest sample total reaches
    ``minimum``, the shifted value over the gene's mean of non-zero values,
    averaged over non-zero ratios by codon and sample (no stop codons), with its
    z-score over the codons of the sample."""
    per = _per([name, sample])
    total = F.sum(value).over(per)
    d = df.withColumns({"_m": F.avg(F.nullif(F.col(value).cast("double"), F.lit(0.0))).over(per), "_t": total})
    moved = {"E": F.lead(value, 1, 0), "P": F.col(value), "A": F.lag(value, 1, 0)}[site]
    d = d.withColumn("_v", moved if site == "P" else moved.over(per.orderBy(pos)))
    d = d.withColumn("_top", F.max("_t").over(_per([name]))).where(F.col("_top") >= minimum)
    d = d.withColumn("_r", F.nullif(F.try_divide(F.col("_v"), F.col("_m")), F.lit(0.0)))
    occ = d.where(~F.col("codon").isin("TAA", "TAG", "TGA")).groupBy("codon", sample).agg(F.avg("_r").alias("occupancy"))
    over = _per([sample])  # 61 codons at most
    return occ.withColumn("relative", F.try_divide(F.col("occupancy") - F.avg("occupancy").over(over), F.stddev_samp("occupancy").over(over)))
