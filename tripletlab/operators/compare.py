"""Comparisons between samples, groups and positions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletlab.functions import stats


def correlations(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson matrix in long form from a single aggregate row."""
    pairs = list(combinations(columns, 2))
    row = wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def replicate_gate(df: DataFrame, columns: list[str], minimum: float, name: str = "name") -> DataFrame:
    """Genes all of whose sample pairs correlate at ``minimum`` or more."""
    pairs = list(combinations(columns, 2))
    cors = [F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    g = df.groupBy(name).agg(*cors)
    passed = sum((F.coalesce(F.col(f"c{i}") >= minimum, F.lit(False)).cast("int") for i in range(len(pairs))), F.lit(0))
    return g.select(name, passed.alias("pairs_passed"), (passed == len(pairs)).alias("ok"))


def odds_sites(df: DataFrame, control: str, treated: str, keys: list[str], name: str = "name") -> DataFrame:
    """Odds ratio of each site against the rest of its gene."""
    w = Window.partitionBy(name)
    d = df.groupBy(name, *keys).agg(F.sum(control).alias("c"), F.sum(treated).alias("t"))
    d = d.withColumns({"cs": F.sum("c").over(w), "ts": F.sum("t").over(w)})
    odds = F.try_divide(F.try_divide(F.col("t"), F.col("ts") - F.col("t")), F.try_divide(F.col("c"), F.col("cs") - F.col("c")))
    return d.withColumn("odds", odds)


def fill_zero_sites(df: DataFrame, columns: list[str], share: float = 0.01, drop: bool = False) -> DataFrame:
    """Drop sites without any count; then require all counts, or add ``share``
    of the smallest positive count to every one."""
    some = df.where(F.greatest(*columns) > 0)
    if drop:
        return some.where(F.least(*columns) > 0)
    low = some.agg(*[F.min(F.when(F.col(c) > 0, F.col(c))).alias(f"_m_{c}") for c in columns])
    return some.join(F.broadcast(low)).withColumns({c: F.col(c) + share * F.least(*[F.col(f"_m_{x}") for x in columns]) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def odds_z(d: DataFrame) -> DataFrame:
    """z of the log odds ratio of the 2 x 2 table of each site."""
    a, b, c, e = F.col("t"), F.col("ts") - F.col("t"), F.col("c"), F.col("cs") - F.col("c")
    ok = d.where((a > 0) & (b > 0) & (c > 0) & (e > 0))
    return ok.withColumn("z", F.log(F.col("odds")) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / e))


def odds_pvalues(d: DataFrame, order: list[str], groups: list[str] | None = None) -> DataFrame:
    z = odds_z(d).withColumn("p", stats.z_tail(F.col("z")))
    return stats.bh_adjust(z, "p", order, groups=groups)


def odds_summary(d: DataFrame, significant: Column | None = None) -> DataFrame:
    """Sites below and above 1 per codon and their mean counts; with a condition
    of significance also those that meet it, and their share (%)."""
    extra = []
    if significant is not None:
        for n, side in (("lower", F.col("odds") < 1), ("higher", F.col("odds") > 1)):
            extra += [F.count_if(side & significant).alias(f"sig_{n}"), F.try_divide(F.count_if(side & significant) * 100.0, F.count("*")).alias(f"share_{n}")]
    return d.groupBy("codon").agg(
        *extra,
        F.count_if(F.col("odds") < 1).alias("lower"), F.count_if(F.col("odds") > 1).alias("higher"),
        F.avg(F.when(F.col("odds") < 1, F.col("c"))).alias("mean_lower"), F.avg(F.when(F.col("odds") > 1, F.col("t"))).alias("mean_higher"),
    )


def quadrants(df: DataFrame, x: str, y: str, cut: float = 1.0) -> DataFrame:
    """Nine classes of two log ratios."""
    side = lambda c: F.when(F.col(c) >= cut, "up").when(F.col(c) <= -cut, "down").otherwise("flat")
    return df.withColumn("quadrant", F.concat_ws("_", side(x), side(y)))


def regulation(df: DataFrame, log_fc: str, p: str, fold: float = 1.0, alpha: float = 0.05) -> DataFrame:
    sig = F.col(p) < alpha
    return df.withColumn("flag", F.when(sig & (F.col(log_fc) >= fold), "up").when(sig & (F.col(log_fc) <= -fold), "down").otherwise("ns"))


def translation_efficiency(ribo: DataFrame, rna: DataFrame, value: str = "x", name: str = "name") -> DataFrame:
    """Ribo over RNA level of each gene; genes of either assay are kept."""
    return ribo.select(name, F.col(value).alias("ribo")).join(rna.select(name, F.col(value).alias("rna")), name, "full_outer").withColumn("te", F.try_divide("ribo", "rna"))


def efficiency_change(te: DataFrame, control: list[str], treated: list[str], name: str = "name") -> DataFrame:
    """Mean efficiency per group, control over treated, its log2, and a t-test
    with Bonferroni correction.  ``te`` is wide (one column per sample)."""
    both = [F.struct(F.lit("ck").alias("side"), F.col(c).alias("v")) for c in control] + [F.struct(F.lit("treat").alias("side"), F.col(c).alias("v")) for c in treated]
    long = te.select(name, F.explode(F.array(*both)).alias("q")).select(name, "q.*")
    t = stats.t_test(long, [name], "side", "v", ("ck", "treat"))
    n = t.agg(F.count("p").alias("_n"))
    t = t.join(F.broadcast(n)).withColumn("fold", F.try_divide("m0", "m1"))
    return t.select(name, F.col("m0").alias("te_ck"), F.col("m1").alias("te_treat"), "fold", F.log2("fold").alias("log2_fold"), "p", stats.bonferroni(F.col("p"), F.col("_n")).alias("bonferroni"))


def size_factors(counts: DataFrame, name: str = "name", sample: str = "sample", value: str = "x") -> DataFrame:
    """Median of ratios to each gene's geometric mean, over genes that every
    sample has."""
    n = counts.agg(F.count_distinct(sample).alias("k"))
    g = counts.groupBy(name).agg(F.avg(F.log(F.when(F.col(value) > 0, F.col(value)))).alias("lg"), F.count_if(F.col(value) > 0).alias("have"))
    ok = g.join(F.broadcast(n)).where("have = k").select(name, "lg")
    return counts.join(ok, name).groupBy(sample).agg(F.exp(F.percentile(F.log(F.col(value)) - F.col("lg"), F.lit(0.5))).alias("size_factor"))


def count_test(counts: DataFrame, factors: DataFrame, groups: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """Approximate negative-binomial Wald test per gene: moment dispersion shrunk
    to the overall one, log2 fold change, p and BH."""
    d = counts.join(F.broadcast(factors), "sample").join(F.broadcast(groups), "sample").withColumn("v", F.col("x") / F.col("size_factor"))
    side = {k: F.when(F.col("group") == s, F.col("v")) for k, s in zip("ab", pair)}
    g = d.where(F.col("group").isin(*pair)).groupBy("name").agg(*[f(side[k]).alias(f"{n}_{k}") for k in "ab" for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))], F.avg("v").alias("base"))
    pooled = (F.coalesce("s_a", F.lit(0.0)) * (F.col("n_a") - 1) + F.coalesce("s_b", F.lit(0.0)) * (F.col("n_b") - 1)) / F.greatest(F.lit(1), F.col("n_a") + F.col("n_b") - 2)
    g = g.withColumn("raw", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(pooled - F.col("base"), F.col("base") * F.col("base")), F.lit(0.0))))
    prior = g.agg(F.percentile_approx("raw", 0.5).alias("prior"))
    g = g.join(F.broadcast(prior)).withColumn("dispersion", (F.col("raw") + F.col("prior")) / 2)
    var = lambda k: F.try_divide(1 / F.greatest(F.col(f"m_{k}"), F.lit(0.5)) + F.col("dispersion"), F.col(f"n_{k}"))
    lfc = F.log((F.col("m_b") + 0.5) / (F.col("m_a") + 0.5))
    out = g.select("name", F.col("base").alias("base_mean"), (lfc / np.log(2)).alias("log2_fold"), (lfc / F.sqrt(var("a") + var("b"))).alias("stat"))
    return stats.bh_adjust(out.withColumn("p", stats.z_tail(F.col("stat"))), "p", ["name"], out="padj")


def log_cdf(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """log2(x + 1) and its cumulative share; counted per value first, so that the
    window runs over distinct values."""
    v = df.withColumn("log2_value", F.log2(F.col(value) + 1.0)).groupBy(*groups, "log2_value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*groups)
    run = w.orderBy("log2_value").rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumn("cdf", F.sum("n").over(run) / F.sum("n").over(w))


def principal_components(wide: DataFrame, columns: list[str], k: int = 2) -> list[tuple]:
    """Sample coordinates from the Gram matrix of log2(x + 1); the products are
    one aggregate row (samples squared), the decomposition is small."""
    logs = wide.select(*[F.log2(F.col(c) + 1.0).alias(c) for c in columns])
    mean = F.aggregate(F.array(*columns), F.lit(0.0), lambda a, x: a + x) / len(columns)
    centred = logs.withColumn("_m", mean)
    cells = [F.sum((F.col(a) - F.col("_m")) * (F.col(b) - F.col("_m"))) for a in columns for b in columns]
    gram = np.array(centred.agg(*[c.alias(f"g{i}") for i, c in enumerate(cells)]).first(), float).reshape(len(columns), -1)
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(-values)[:k]
    return [(c, *(vectors[i, top] * np.sqrt(np.maximum(values[top], 0))).tolist()) for i, c in enumerate(columns)]


def pair_distances(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Euclidean distance of each pair of a stated small set (each pair once)."""
    a, b = df.alias("a"), df.alias("b")
    sq = F.aggregate(F.zip_with(F.col(f"a.{vec_col}"), F.col(f"b.{vec_col}"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, F.col(f"a.{id_col}") < F.col(f"b.{id_col}")).select(F.col(f"a.{id_col}").alias("a"), F.col(f"b.{id_col}").alias("b"), F.sqrt(sq).alias("distance"))


def ward_order(labels: list, points: np.ndarray) -> list:
    """Leaf order of Ward's linkage for a few hundred rows at most."""
    groups = [(1, p.astype(float), [label]) for label, p in zip(labels, points)]
    if len(groups) > 500:
        raise ValueError("Ward's linkage is for small tables")
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                (n, c, _), (m, d, _) = groups[i], groups[j]
                cost = n * m / (n + m) * float(((c - d) ** 2).sum())
                if best is None or cost < best[0]:
                    best = (cost, i, j)
        _, i, j = best
        (n, c, x), (m, d, y) = groups[i], groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [(n + m, (n * c + m * d) / (n + m), x + y)]
    return groups[0][2] if groups else []


def frame_correlations(counts: DataFrame, keys: list[str], sample: str = "sample") -> DataFrame:
    """Pearson matrices of samples for each frame and for all frames together:
    (mode, a, b, r).  Counts are summed over ``keys`` first."""
    samples = sorted(r[0] for r in counts.select(sample).distinct().collect())  # one per sample
    modes = {"0": F.col("f0"), "1": F.col("f1"), "2": F.col("f2"), "all": F.col("f0") + F.col("f1") + F.col("f2")}
    wide = counts.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(sample) == s, x)), F.lit(0)).alias(f"{m}|{s}") for m, x in modes.items() for s in samples])
    out = None
    for m in modes:
        one = correlations(wide, [f"{m}|{s}" for s in samples]).select(F.lit(m).alias("mode"), *[F.substring_index(c, "|", -1).alias(c) for c in ("a", "b")], "r")
        out = one if out is None else out.union(one)
    return out


def expressed_in_all(ribo: DataFrame, rna: DataFrame, ribo_min: float, rna_min: float, value: str = "x", name: str = "name", sample: str = "sample") -> DataFrame:
    """Names whose sum reaches the assay's threshold in every sample of both assays."""
    sides = []
    for df, least in ((ribo, ribo_min), (rna, rna_min)):
        k = df.select(sample).distinct().agg(F.count("*").alias("_k"))
        per = df.groupBy(name, sample).agg(F.sum(value).alias("s")).where(F.col("s") >= least).groupBy(name).agg(F.count("*").alias("n"))
        sides.append(per.join(F.broadcast(k)).where("n = _k").select(name))
    return sides[0].intersect(sides[1])


def pair_test(counts: DataFrame, design: DataFrame, pair: str, minimum: float) -> DataFrame:
    """count_test() of a pair of groups, ``A+B_vs_C``, over the genes whose total
    in either side is above ``minimum``, with the counts and normalised counts of
    each sample as maps."""
    first, second = ([g.strip() for g in side.split("+")] for side in pair.split("_vs_"))
    side = F.when(F.col("group").isin(first), "a").when(F.col("group").isin(second), "b")
    groups = design.select("sample", side.alias("group")).where("group IS NOT NULL")
    d = counts.join(F.broadcast(groups), "sample")
    keep = d.groupBy("name").agg(*[F.sum(F.when(F.col("group") == s, F.col("x"))).alias(s) for s in "ab"]).where(f"a > {minimum} OR b > {minimum}")
    d = d.join(keep.select("name"), "name", "left_semi").drop("group")
    factors = size_factors(d)
    each = d.join(F.broadcast(factors), "sample").groupBy("name").agg(*[F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample", v)))).alias(n) for n, v in (("counts", F.col("x")), ("normalised", (F.col("x") / F.col("size_factor")).alias("v")))])
    return count_test(d, factors, groups, ("a", "b")).join(each, "name")
