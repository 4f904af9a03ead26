"""All registered queries of the profiling operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletlab.functions import sequence as S
from tripletlab.functions import stats
from tripletlab.functions.codons import CODE
from tripletlab.functions.tables import workspace
from tripletlab.operators import compare as C
from tripletlab.operators import density as D
from tripletlab.operators import peaks as K
from tripletlab.operators import profiles as P
from tripletlab.operators import reads as R
from tripletlab.operators import tracks as T
from tripletlab.plans.analogs import EV, LN, LN0, events_density, line_counts, line_density, table
from tripletlab.sources import alignments, sequences, sinks, tables
from tripletlab.streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def r6(*cols: str):
    """Round doubles to six places, as the oracles do."""
    return [F.round(c, 6).alias(c) for c in cols]


def ev(spark, sf):
    return events_density(spark, sf)


def ln(spark, sf):
    return D.frame(line_density(spark, sf))


def ln0(spark, sf):
    return D.frame(line_counts(spark, sf))


# -- projections, filters, totals -------------------------------------------


@query(f"WITH {LN0} SELECT sample, CAST(sum(f0 + f1 + f2) AS BIGINT) AS total FROM ln0 GROUP BY sample")
def total_counts(spark, sf):
    return D.totals(ln0(spark, sf))


@query(f"WITH {LN0} SELECT name, sample, codon, f0 + f1 + f2 AS all_frames, f1 AS frame1 FROM ln0")
def frame_projection(spark, sf):
    d = D.frame(line_counts(spark, sf), "all", "all_frames")
    return D.frame(d, "1", "frame1").select("name", "sample", "codon", "all_frames", "frame1")


@query(f"WITH {EV} SELECT name, pos, codon, from_tis, from_tts, round(x, 6) AS x FROM ev WHERE from_tis >= 2 AND from_tts <= -1")
def tis_tts_trim(spark, sf):
    return D.trim(ev(spark, sf), 2, 1).select("name", "pos", "codon", "from_tis", "from_tts", *r6("x"))


@query(f"WITH {LN0}, g AS (SELECT name FROM ln0 GROUP BY name HAVING sum(f0 + f1 + f2) / 2.0 >= 500) SELECT sample, codon, count(*) AS n, CAST(sum(f0) AS BIGINT) AS f0 FROM ln0 WHERE name IN (SELECT name FROM g) GROUP BY sample, codon")
def expressed_genes(spark, sf):
    return D.expressed(ln0(spark, sf), 500, n_samples=2).groupBy("sample", "codon").agg(F.count("*").alias("n"), F.sum("f0").alias("f0"))


@query(f"WITH {LN0} SELECT name, count(*) AS n, CAST(sum(f0) AS BIGINT) AS f0 FROM ln0 WHERE name IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY name")
def gene_list_semi(spark, sf):
    genes = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("name"))
    return line_counts(spark, sf).join(genes, "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"), F.sum("f0").alias("f0"))


_WANTED = "SELECT DISTINCT '>' || CAST(p_partkey * 3 AS VARCHAR) || ' ' AS id FROM part WHERE p_size < 20"


@query(f"WITH w AS ({_WANTED}) SELECT regexp_replace(trim(id), '^>', '') AS id FROM w WHERE regexp_replace(trim(id), '^>', '') NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)")
def unmatched_ids_anti(spark, sf):
    part = table(spark, sf, "part")
    wanted = part.where("p_size < 20").select(F.concat(F.lit(">"), (F.col("p_partkey") * 3).cast("string"), F.lit(" ")).alias("id"))
    return T.lookup(part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("seq")), wanted)[1]


@query(f"WITH w AS ({_WANTED}) SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS seq FROM part WHERE CAST(p_partkey AS VARCHAR) IN (SELECT regexp_replace(trim(id), '^>', '') FROM w)")
def sequence_lookup(spark, sf):
    part = table(spark, sf, "part")
    wanted = part.where("p_size < 20").select(F.concat(F.lit(">"), (F.col("p_partkey") * 3).cast("string"), F.lit(" ")).alias("id"))
    return T.lookup(part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("seq")), wanted)[0]


@query("SELECT l_partkey AS name FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def gene_set_intersect(spark, sf):
    li = table(spark, sf, "lineitem")
    a, b = (li.where(F.col("l_linestatus") == s).select(F.col("l_partkey").alias("name")) for s in "FO")
    return a.intersect(b)


@query(f"WITH {LN0} SELECT name FROM ln0 WHERE sample = 'F' GROUP BY name HAVING sum(f0) > 400 UNION SELECT name FROM ln0 WHERE sample = 'O' GROUP BY name HAVING sum(f0) > 400")
def eligible_union(spark, sf):
    per = [line_counts(spark, sf).where(F.col("sample") == s).groupBy("name").agg(F.sum("f0").alias("s")).where("s > 400").select("name") for s in "FO"]
    return per[0].union(per[1]).distinct()


@query(f"WITH {LN0}, g AS (SELECT name, sample, CAST(sum(f0) AS BIGINT) AS f0 FROM ln0 GROUP BY name, sample) SELECT a.name, a.f0 AS \"F_f0\", b.f0 AS \"O_f0\" FROM g a JOIN g b ON a.name = b.name AND a.sample = 'F' AND b.sample = 'O'")
def merge_samples_inner(spark, sf):
    g = line_counts(spark, sf).groupBy("name", "sample").agg(F.sum("f0").alias("f0"))
    return D.merge_samples({s: g.where(F.col("sample") == s) for s in "FO"}, ["name"], ["f0"])


@query("WITH a AS (SELECT l_suppkey AS name, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1), b AS (SELECT l_suppkey AS name, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 3 GROUP BY 1) SELECT name, a.n AS \"R_n\", b.n AS \"A_n\" FROM a FULL JOIN b USING (name)")
def merge_tables_outer(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.where("l_returnflag = 'R' AND l_quantity > 45").groupBy(F.col("l_suppkey").alias("name")).agg(F.count("*").alias("n"))
    b = li.where("l_returnflag = 'A' AND l_quantity < 3").groupBy(F.col("l_suppkey").alias("name")).agg(F.count("*").alias("n"))
    return D.merge_samples({"R": a, "A": b}, ["name"], ["n"], "full_outer")


@query("SELECT event_type AS sample, user_id AS name, count(*) AS n FROM events GROUP BY 1, 2")
def union_long_tables(spark, sf):
    e = table(spark, sf, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # a handful of types
    return D.union_long({k: e.where(F.col("event_type") == k).groupBy(F.col("user_id").alias("name")).agg(F.count("*").alias("n")) for k in kinds})


# -- windows ----------------------------------------------------------------


@query(f"WITH {EV} SELECT name, pos, round(coalesce(lag(x) OVER (PARTITION BY name ORDER BY pos), 0), 6) AS shifted FROM ev")
def shift_site_a(spark, sf):
    return D.shift_site(ev(spark, sf), "A").select("name", "pos", *r6("shifted"))


@query(f"WITH {EV} SELECT name, pos, round(coalesce(lead(x) OVER (PARTITION BY name ORDER BY pos), 0), 6) AS shifted FROM ev")
def shift_site_e(spark, sf):
    return D.shift_site(ev(spark, sf), "E").select("name", "pos", *r6("shifted"))


@query(f"WITH {LN0}, t AS (SELECT sample, sum(f0 + f1 + f2) AS total FROM ln0 GROUP BY sample), g AS (SELECT name, sample, sum(f0 + f1 + f2) AS x FROM ln0 GROUP BY name, sample) SELECT name, g.sample, round(x * 1e6 / total, 6) AS rpm FROM g JOIN t ON g.sample = t.sample")
def rpm_normalise(spark, sf):
    g = ln0(spark, sf).groupBy("name", "sample").agg(F.sum("x").alias("x"))
    return D.per_million(g).select("name", "sample", *r6("rpm"))


@query(f"""WITH {LN}, g AS (SELECT name, region, sample, sum(f0 + f1 + f2) AS c FROM ln GROUP BY ALL), l AS (SELECT name, sample, count(*) * 3 AS len FROM ln GROUP BY ALL),
t AS (SELECT sample, sum(f0 + f1 + f2) AS total FROM ln GROUP BY ALL), q AS (SELECT g.*, len, total, c * 1e3 / len AS rpk FROM g JOIN l USING (name, sample) JOIN t USING (sample))
SELECT name, region, sample, CAST(c AS BIGINT) AS "count", round(c * 1e6 / total, 6) AS rpm, round(c * 1e9 / (len * total), 6) AS rpkm, round(rpk * 1e6 / sum(rpk) OVER (PARTITION BY region, sample), 6) AS tpm FROM q""")
def region_quant_tpm(spark, sf):
    return P.region_quant(ln(spark, sf)).select("name", "region", "sample", "count", *r6("rpm", "rpkm", "tpm"))


@query(f"WITH {LN}, g AS (SELECT sample, region, sum(f0 + f1 + f2) AS c FROM ln GROUP BY ALL) SELECT sample, region, CAST(c AS BIGINT) AS \"count\", round(c * 100.0 / sum(c) OVER (PARTITION BY sample), 6) AS share FROM g")
def region_share(spark, sf):
    return P.shares(ln(spark, sf), ["region"], ["sample"], "x").select("sample", "region", "count", *r6("share"))


@query(f"WITH {LN0}, u AS (SELECT sample, unnest([0, 1, 2]) AS frame, unnest([f0, f1, f2]) AS n FROM ln0), g AS (SELECT sample, frame, sum(n) AS c FROM u GROUP BY ALL) SELECT sample, frame, CAST(c AS BIGINT) AS \"count\", round(c * 100.0 / sum(c) OVER (PARTITION BY sample), 6) AS ratio FROM g")
def periodicity(spark, sf):
    return P.periodicity(line_counts(spark, sf)).select("sample", "frame", "count", *r6("ratio"))


@query(f"WITH {EV}, g AS (SELECT count(DISTINCT name) AS k FROM ev) SELECT 'TIS' AS meta, from_tis AS \"offset\", round(sum(x) / any_value(k), 6) AS density FROM ev, g WHERE from_tis BETWEEN -10 AND 20 GROUP BY from_tis UNION ALL SELECT 'TTS', from_tts, round(sum(x) / any_value(k), 6) FROM ev, g WHERE from_tts BETWEEN -20 AND 10 GROUP BY from_tts")
def metagene_tis_tts(spark, sf):
    e = ev(spark, sf)
    a, b = P.metagene(e, at="from_tis", lo=-10, hi=20), P.metagene(e, at="from_tts", lo=-20, hi=10)
    return D.union_long({"TIS": a, "TTS": b}, "meta").select("meta", "offset", *r6("density"))


@query(f"""WITH {EV}, e AS (SELECT name, min(pos) AS lo, max(pos) AS hi FROM ev GROUP BY name),
b AS (SELECT ev.name, greatest(0, CAST(ceil((pos - lo) * 10.0 / nullif(hi - lo, 0)) AS INT) - 1) AS bin, x FROM ev JOIN e ON ev.name = e.name),
m AS (SELECT name, coalesce(bin, 0) AS bin, avg(x) AS m FROM b GROUP BY ALL) SELECT bin, round(sum(m) / (SELECT count(*) FROM e), 6) AS density FROM m GROUP BY bin""")
def coverage_bins(spark, sf):
    return P.coverage(ev(spark, sf), 10).select("bin", *r6("density"))


@query(f"WITH {EV}, q AS (SELECT name, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS m FROM ev GROUP BY name) SELECT ev.name, pos, round(CASE WHEN x < q1 - 2 * (q3 - q1) OR x > q3 + 2 * (q3 - q1) THEN m ELSE x END, 6) AS filled FROM ev JOIN q ON ev.name = q.name")
def outlier_iqr_fill(spark, sf):
    return P.fill_outliers(ev(spark, sf)).select("name", "pos", *r6("filled"))


@query(f"WITH {EV} SELECT name, pos, round(coalesce(x / nullif(avg(CASE WHEN region = 'cds' THEN x END) OVER (PARTITION BY name), 0), 0), 6) AS pause FROM ev")
def pausing_gene_mean(spark, sf):
    return P.pausing_gene_mean(ev(spark, sf), inside=F.col("region") == "cds").select("name", "pos", *r6("pause"))


_SHIFTED = f"{EV}, sh AS (SELECT name, pos, codon, from_tis, coalesce(lag(x) OVER (PARTITION BY name ORDER BY pos), 0) AS x FROM ev)"
_PAUSE = f"{_SHIFTED}, pz AS (SELECT *, coalesce(x / nullif(sum(x) OVER (PARTITION BY name ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) / 5, 0), 0) AS pause FROM sh)"


def _pauses(spark, sf):
    e = D.shift_site(ev(spark, sf), "A")
    return P.pausing_background(e.drop("x").withColumnRenamed("shifted", "x"), 2)


@query(f"WITH {_PAUSE} SELECT codon, round(avg(pause), 6) AS pause FROM pz GROUP BY codon")
def pausing_forward_background(spark, sf):
    return _pauses(spark, sf).groupBy("codon").agg(F.round(F.avg("pause"), 6).alias("pause"))


@query(f"WITH {_PAUSE} SELECT name, codon, round(sum(pause), 6) AS pause_sum, round(avg(pause), 6) AS pause_mean FROM pz GROUP BY ALL")
def pausing_gene_codon(spark, sf):
    return P.pausing_by_gene_codon(_pauses(spark, sf)).select("name", "codon", *r6("pause_sum", "pause_mean"))


@query(f"WITH {_PAUSE}, s AS (SELECT codon, count(*) AS total_codon, count(*) FILTER (WHERE x > 0) AS valid_codon, sum(x) AS counts, avg(pause) AS mean_all, avg(pause) FILTER (WHERE x > 0) AS mean_valid FROM pz GROUP BY codon) SELECT codon, total_codon, valid_codon, round(counts, 4) AS counts, round(mean_all, 6) AS mean_all, round(mean_valid, 6) AS mean_valid, round(mean_all / max(mean_all) OVER (), 6) AS relative FROM s")
def pausing_codon_summary(spark, sf):
    s = P.pausing_by_codon(_pauses(spark, sf))
    return s.select("codon", "total_codon", "valid_codon", F.round("counts", 4).alias("counts"), *r6("mean_all", "mean_valid", "relative"))


@query(f"WITH {_PAUSE} SELECT name, round(sum(pause), 6) AS pause_sum, arg_max(from_tis, pos) AS last FROM pz GROUP BY name")
def argmax_last_row(spark, sf):
    return P.pausing_by_gene(_pauses(spark, sf)).select("name", *r6("pause_sum"), "last")


@query(f"WITH {EV}, d AS (SELECT codon, x / nullif(avg(x) OVER (PARTITION BY name), 0) AS d FROM ev), s AS (SELECT codon, sum(d) AS s, avg(nullif(d, 0)) AS m FROM d GROUP BY codon) SELECT codon, round(s, 6) AS occ_sum, round(m, 6) AS occ_mean, round(m / max(m) OVER (), 6) AS relative FROM s")
def codon_occupancy(spark, sf):
    return P.occupancy(ev(spark, sf)).select("codon", *r6("occ_sum", "occ_mean", "relative"))


@query(f"WITH {LN0}, c AS (SELECT codon, codon[1] AS aa, count(*) AS n FROM ln0 GROUP BY ALL) SELECT codon, aa, n, round(n * 1000.0 / sum(n) OVER (), 6) AS freq, round(n / avg(n) OVER (PARTITION BY aa), 6) AS rscu, round(n / max(n) OVER (PARTITION BY aa), 6) AS weight, row_number() OVER (PARTITION BY aa ORDER BY n DESC, codon) = 1 AS optimal FROM c")
def codon_usage_rscu(spark, sf):
    c = line_counts(spark, sf).groupBy("codon").agg(F.count("*").alias("n")).withColumn("aa", F.substring("codon", 1, 1))
    return P.codon_usage(c).select("codon", "aa", "n", *r6("freq", "rscu", "weight"), "optimal")


@query(f"WITH {EV}, g AS (SELECT name, sum(x) AS s, avg(x) AS m, stddev_samp(x) AS d FROM ev GROUP BY name) SELECT name, round(s, 4) AS \"sum\", round(m, 6) AS mean, round(d / m, 6) AS cov FROM g WHERE d IS NOT NULL AND m <> 0")
def gene_cov(spark, sf):
    return P.gene_cov(ev(spark, sf)).select("name", F.round("sum", 4).alias("sum"), *r6("mean", "cov"))


_CC = "c AS (SELECT name, pos, stddev_samp(x) OVER w / nullif(avg(x) OVER w, 0) AS cov FROM ev WINDOW w AS (PARTITION BY name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query(f"WITH {EV}, {_CC} SELECT name, pos, round(cov, 6) AS cov FROM c")
def cumulative_cov(spark, sf):
    return P.cumulative_cov(ev(spark, sf)).select("name", "pos", *r6("cov"))


@query(f"WITH {EV}, {_CC}, k AS (SELECT *, max(pos) OVER (PARTITION BY name) AS n FROM c) SELECT pos, round(avg(cov), 6) AS cov FROM k WHERE n > 30 AND pos <= 30 GROUP BY pos")
def meta_cumulative_cov(spark, sf):
    return P.meta_cumulative_cov(P.cumulative_cov(ev(spark, sf)), 30).select("pos", *r6("cov"))


@query(f"WITH {LN} SELECT name, pos, pos - min(pos) OVER (PARTITION BY name) + 1 AS pos0 FROM ln WHERE region = 'cds'")
def rezero_positions(spark, sf):
    return D.rezero(line_density(spark, sf).where("region = 'cds'")).select("name", "pos", "pos0")


# -- decoding and selection times -------------------------------------------

_RPKM = "rk AS (SELECT name, sum(f0) * 1e9 / (count(*) * 3 * (SELECT sum(f0) FROM ln0 WHERE sample = 'O')) AS rpkm FROM ln0 WHERE sample = 'O' GROUP BY name)"


def _rna_level(spark, sf):
    o = line_counts(spark, sf).where("sample = 'O'")
    total = o.agg(F.sum("f0").alias("t"))
    return o.groupBy("name").agg(F.sum("f0").alias("s"), F.count("*").alias("n")).join(F.broadcast(total)).select("name", (F.col("s") * 1e9 / (F.col("n") * 3 * F.col("t"))).alias("rpkm"))


@query(f"WITH {LN0}, {_RPKM}, p AS (SELECT name, codon, sum(f1) AS s, count(*) FILTER (WHERE f1 > 0) AS k FROM ln0 WHERE sample = 'F' GROUP BY ALL), c AS (SELECT codon, sum(s) AS s, sum(k) AS k, sum(s / rpkm) AS nm FROM p JOIN rk USING (name) WHERE rpkm > 0 GROUP BY codon) SELECT codon, CAST(s AS BIGINT) AS counts, CAST(k AS BIGINT) AS sites, round(s / k, 6) AS cdt, round(nm / k, 6) AS norm_cdt FROM c")
def codon_decoding_time(spark, sf):
    ribo = line_counts(spark, sf).where("sample = 'F'")
    return P.decoding_time(ribo, _rna_level(spark, sf), "f1").select("codon", "counts", "sites", *r6("cdt", "norm_cdt"))


def _cst_sql(times: int) -> str:
    parts = [LN0.replace("ln0 AS (", "ln0 AS MATERIALIZED ("), "gc AS MATERIALIZED (SELECT name, codon[1] AS codon, count(*) AS n, sum(f0) AS ribo, sum(f1) AS rna FROM ln0 GROUP BY ALL)",
             "gs AS MATERIALIZED (SELECT name, sum(n) AS codons, sum(ribo) / nullif(sum(rna), 0) AS density FROM gc GROUP BY name)", "rb AS (SELECT codon, sum(ribo) / (SELECT sum(ribo) FROM gc) AS rs FROM gc GROUP BY codon)"]
    for i in range(times):
        w = "1.0" if i == 0 else "w"
        j = "gc" if i == 0 else f"gc JOIN w{i} USING (name)"
        parts.append(f"a{i} AS MATERIALIZED (SELECT codon, sum(rna * {w}) AS a FROM {j} GROUP BY codon)")
        parts.append(f"c{i} AS MATERIALIZED (SELECT codon, coalesce(rs / nullif(a / (SELECT sum(a) FROM a{i}), 0), 0) AS cst FROM rb JOIN a{i} USING (codon))")
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT name, coalesce(codons * density / nullif(t, 0), 0) AS w FROM gs JOIN (SELECT name, sum(n * cst) AS t FROM gc JOIN c{i} USING (codon) GROUP BY name) USING (name))")
    return f"WITH {', '.join(parts)} SELECT codon, round(cst, 6) AS cst FROM c{times - 1}"


def _selection(spark, sf, times):
    gc = line_counts(spark, sf).groupBy("name", F.substring("codon", 1, 1).alias("codon")).agg(F.count("*").alias("n"), F.sum("f0").alias("ribo"), F.sum("f1").alias("rna"))
    genes = gc.groupBy("name").agg(F.sum("n").alias("codons"), F.try_divide(F.sum("ribo"), F.sum("rna")).alias("density"))
    return P.selection_time(gc, genes, times).select("codon", *r6("cst"))


@query(_cst_sql(3))
def codon_selection_time_k(spark, sf):
    return _selection(spark, sf, 3)


@query(_cst_sql(10))
def codon_selection_time_10(spark, sf):
    return _selection(spark, sf, 10)


# -- meta-codon windows -----------------------------------------------------


@query(f"WITH {EV}, m AS (SELECT name, pos FROM ev WHERE codon = 'click'), n AS (SELECT name, max(pos) AS n FROM ev GROUP BY name) SELECT ev.pos - m.pos AS \"offset\", round(avg(x), 6) AS density FROM m JOIN n ON m.name = n.name AND m.pos > 3 AND m.pos + 3 <= n JOIN ev ON ev.name = m.name AND ev.pos BETWEEN m.pos - 3 AND m.pos + 3 GROUP BY 1")
def meta_codon_window(spark, sf):
    w = P.windows_around(ev(spark, sf), F.col("codon") == "click", 3)
    return P.meta_window(w).select("offset", *r6("density"))


@query(f"WITH {EV}, l AS (SELECT name, pos, codon, lead(codon) OVER (PARTITION BY name ORDER BY pos) AS nx, count(*) OVER (PARTITION BY name) AS n FROM ev), m AS (SELECT name, pos FROM l WHERE codon = 'click' AND nx = 'view' AND pos > 2 AND pos + 2 <= n), d AS (SELECT ev.pos - m.pos AS o, avg(x) AS d FROM m JOIN ev ON ev.name = m.name AND ev.pos BETWEEN m.pos - 2 AND m.pos + 2 GROUP BY 1) SELECT o AS \"offset\", round(d / avg(d) OVER (), 6) AS density FROM d")
def motif_window(spark, sf):
    e = ev(spark, sf).withColumn("m", P.motif_match(["click", "view"]))
    return P.meta_window(P.windows_around(e, F.col("m"), 2), scale=True).select("offset", *r6("density"))


# -- top rows, sets, joins --------------------------------------------------


@query("SELECT l_partkey AS name, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def representative_top1(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey")
    return table(spark, sf, "lineitem").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("l_partkey").alias("name"), "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_keep_first(spark, sf):
    return table(spark, sf, "documents").groupBy("text").agg(F.min_by(F.struct("doc_id", "lang"), "doc_id").alias("r")).select("r.doc_id", "r.lang")


_IV = "SELECT o_custkey AS name, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, o_orderpriority AS p FROM orders"


@query(f"WITH i AS ({_IV}), a AS (SELECT DISTINCT name, s - 10 AS start, s + 10 AS \"end\" FROM i WHERE p LIKE '1%'), b AS (SELECT DISTINCT name, s - 10 AS start, s + 10 AS \"end\" FROM i WHERE p LIKE '2%') SELECT a.name, a.start, a.\"end\", EXISTS (SELECT 1 FROM b WHERE b.name = a.name AND a.start <= b.\"end\" AND b.start <= a.\"end\") AS overlap FROM a")
def interval_overlap_label(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long").alias("s"), F.col("o_orderpriority").alias("p"))
    a, b = (o.where(F.col("p").startswith(k)).select("name", (F.col("s") - 10).alias("start"), (F.col("s") + 10).alias("end")).distinct() for k in "12")
    return K.overlap_label(a, b, ["name"])


@query("WITH n AS (SELECT n_name AS id FROM nation UNION SELECT r_name FROM region), p AS (SELECT a.id AS a, b.id AS b, unnest(range(2, length(a.id) + 1)) AS k FROM n a, n b WHERE a.id <> b.id) SELECT a, b, min(k) AS overlap FROM p WHERE k <= length(b) AND right(a, CAST(k AS INT)) = left(b, CAST(k AS INT)) GROUP BY a, b")
def suffix_prefix_overlap(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("id")).union(table(spark, sf, "region").select("r_name")).distinct()
    # every suffix meets every prefix of its length by an equality join
    cut = F.explode(F.sequence(F.lit(2), F.length("id"))).alias("k")
    a = n.where("length(id) >= 2").select(F.col("id").alias("a"), cut).withColumn("part", F.expr("right(a, k)"))
    b = n.where("length(id) >= 2").select(F.col("id").alias("b"), cut).withColumn("part", F.expr("left(b, k)")).drop("k")
    return a.join(b, "part").where("a <> b").groupBy("a", "b").agg(F.min("k").cast("long").alias("overlap"))


# -- reshaping --------------------------------------------------------------


@query(f"WITH {LN}, u AS (SELECT name, pos, codon, unnest([0, 1, 2]) AS frame, unnest([f0, f1, f2]) AS n FROM ln) SELECT name, pos + frame AS nt, frame, substring(codon, frame + 1, 1) AS base, n FROM u")
def melt_nt(spark, sf):
    return D.melt_nucleotides(line_density(spark, sf)).select("name", "nt", "frame", "base", "n")


@query(f"WITH {LN0} SELECT codon, CAST(sum(f0) FILTER (WHERE sample = 'F') AS BIGINT) AS \"F\", CAST(sum(f0) FILTER (WHERE sample = 'O') AS BIGINT) AS \"O\" FROM ln0 GROUP BY codon")
def pivot_wide(spark, sf):
    g = line_counts(spark, sf).groupBy("codon", "sample").agg(F.sum("f0").alias("v"))
    return D.pivot_samples(g, ["codon"], "sample", "v", ["F", "O"])


@query("SELECT p_partkey AS name, CAST(p_size + i AS BIGINT) AS pos FROM (SELECT p_partkey, p_size, unnest(range(0, CAST(p_partkey % 7 AS BIGINT))) AS i FROM part)")
def interval_to_base(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").cast("long").alias("start"), (F.col("p_size") + F.col("p_partkey") % 7).cast("long").alias("end"))
    return D.expand_intervals(p).select("name", "pos")


@query("""WITH a AS (SELECT p_partkey AS name, CAST(p_size % 11 AS BIGINT) AS u, CAST(p_size AS BIGINT) AS c0, CAST(p_size % 13 AS BIGINT) AS t0 FROM part), b AS (SELECT name, u, c0 - c0 % 3 AS c, t0 + c0 % 3 AS t FROM a),
g AS (SELECT name, u % 3 AS s5, (u - u % 3) // 3 AS u3, (t - t % 3) // 3 AS t3, (u - u % 3 + c + t - t % 3) // 3 AS n FROM b), k AS (SELECT *, unnest(range(0, n)) AS k FROM g)
SELECT name, 1 + s5 + 3 * k AS now_nt, k - u3 AS from_tis, t3 - n + 1 + k AS from_tts, CASE WHEN k - u3 < 0 THEN '5utr' WHEN t3 - n + 1 + k > 0 THEN '3utr' ELSE 'cds' END AS region FROM k""")
def codon_grid(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") % 11).cast("long").alias("utr5_length"), F.col("p_size").cast("long").alias("cds_length"), (F.col("p_size") % 13).cast("long").alias("utr3_length"))
    return D.codon_grid(a)


# -- sequences --------------------------------------------------------------


@query("SELECT k AS kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(1, length(text) - 3) + 1), lambda i: substring(text, i, 4))) AS k FROM benchmark WHERE text IS NOT NULL) GROUP BY k")
def kmers(spark, sf):
    return table(spark, sf, "benchmark").where("text IS NOT NULL").select(F.explode(S.kmers(F.col("text"), 4)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query("SELECT item_id, translate(reverse(text), 'ACGTUacgtu', 'TGCAAtgcaa') AS rc FROM benchmark")
def revcomp(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", S.revcomp(F.col("text")).alias("rc"))


@query("WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, length(text) AS l, length(text) - length(replace(text, 'a', '')) AS a, length(text) - length(replace(text, 'e', '')) AS e FROM t) SELECT doc_id, CAST(sum(l) AS BIGINT) AS length, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(e) AS BIGINT) AS n_e FROM c GROUP BY ROLLUP (doc_id)")
def composition(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return S.composition(d, "doc_id", "text", "ae")


@query("WITH s AS (SELECT item_id, upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS q FROM benchmark), c AS (SELECT item_id, q, list_transform(range(0, length(q) // 3), lambda i: substring(q, 3 * i + 1, 3)) AS c FROM s), m AS (SELECT " + "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in sorted(CODE.items())) + "} AS m) SELECT item_id, array_to_string(list_transform(c, lambda x: m[x]), '') AS protein FROM c, m")
def translate(spark, sf):
    q = F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", ""))
    d = table(spark, sf, "benchmark").select("item_id", q.alias("q"))
    whole = F.expr("substring(q, 1, length(q) - length(q) % 3)")
    return d.withColumn("q", whole).select("item_id", S.translate_nt(F.col("q")).alias("protein"))


@query("SELECT n_chars AS length, count(*) AS n FROM documents GROUP BY ROLLUP (n_chars)")
def length_histogram(spark, sf):
    return table(spark, sf, "documents").rollup(F.col("n_chars").alias("length")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT unnest(range(0, least(16, length(text)))) AS site, text FROM documents WHERE length(text) > 0), c AS (SELECT site, lower(substring(text, site + 1, 1)) AS c FROM p), g AS (SELECT * FROM c WHERE c IN ('a', 'e', 'n', 't')) SELECT CAST(site AS INT) AS site, round(count(*) FILTER (WHERE c = 'a') / count(*), 6) AS a, round(count(*) FILTER (WHERE c = 'e') / count(*), 6) AS e, round(count(*) FILTER (WHERE c = 'n') / count(*), 6) AS n, round(count(*) FILTER (WHERE c = 't') / count(*), 6) AS t FROM g GROUP BY site")
def pwm_by_position(spark, sf):
    d = table(spark, sf, "documents").where("length(text) > 0").select(F.lower("text").alias("seq"))
    return R.position_weights(d, "seq", 16, "aent").select("site", *r6("a", "e", "n", "t"))


# -- enrichment and peaks ---------------------------------------------------

@query(f"WITH {LN0}, g AS (SELECT name, sum(f0) AS a, sum(f1) AS b, sum(f2) AS c FROM ln0 GROUP BY name) SELECT name, round((coalesce(a / nullif(b, 0), 0) + coalesce(a / nullif(c, 0), 0)) / 2, 6) AS ratio FROM g")
def enrichment_ratio(spark, sf):
    g = line_counts(spark, sf).groupBy("name").agg(F.sum("f0").alias("a"), F.sum("f1").alias("b"), F.sum("f2").alias("c"))
    return K.enrichment(g, ["b", "c"], ["a"]).select("name", *r6("ratio"))


@query(f"WITH {LN} SELECT name, pos, round(CASE WHEN f1 = 0 THEN avg(f1) OVER (PARTITION BY name) ELSE f1 END, 6) AS f1 FROM ln")
def fill_empty(spark, sf):
    return K.fill_empty(line_density(spark, sf), "f1").select("name", "pos", *r6("f1"))


_MM = f"""{EV}, o AS (SELECT name, pos, x, count(*) OVER (PARTITION BY name) AS n, first(x) OVER w AS fx, last(x) OVER w AS lx,
sum(x) OVER (PARTITION BY name ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM ev WINDOW w AS (PARTITION BY name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
sm AS (SELECT name, pos, (s + greatest(0, 3 - pos) * fx + greatest(0, 2 - (n - pos)) * lx) / 5 AS smooth FROM o)"""


@query(f"WITH {_MM} SELECT name, pos, round(smooth, 6) AS smooth FROM sm")
def moving_mean_smooth(spark, sf):
    return P.moving_mean(ev(spark, sf), 2).select("name", "pos", *r6("smooth"))


_IS = f"{EV}, e AS (SELECT name, pos, x, CASE WHEN pos - lag(pos) OVER (PARTITION BY name ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS nw FROM ev WHERE x > 60), i AS (SELECT name, pos, x, CAST(sum(nw) OVER (PARTITION BY name ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM e)"


@query(f"WITH {_IS} SELECT name, pos, island FROM i")
def gap_islands(spark, sf):
    return K.islands(ev(spark, sf).where("x > 60"), 2).select("name", "pos", "island")


@query(f"WITH {_IS} SELECT name, island, min(pos) AS start, max(pos) AS \"end\", count(*) AS covered, round(max(x), 6) AS max_value, arg_max(pos, (x, -pos)) AS max_pos, round(avg(x), 6) AS mean_value FROM i GROUP BY ALL")
def peak_summary(spark, sf):
    i = K.islands(ev(spark, sf).where("x > 60"), 2)
    return K.summarise(i, "x").select("name", "island", "start", "end", "covered", *r6("max_value"), "max_pos", *r6("mean_value"))


# The caller in SQL: filled control, ratio, mean over five positions, islands, the
# best chain of islands (recursion over islands, then back from the last one), and
# the t-test of each stretch; the tail of Student's t for whole degrees of freedom
# is a finite sum.
_CALL = f"""{LN}, d AS (SELECT name, pos, f0 AS ip, CASE WHEN f1 = 0 THEN avg(f1) OVER (PARTITION BY name) ELSE f1 END AS ck FROM ln),
ra AS (SELECT name, pos, ip - ck AS diff, coalesce(ip / nullif(ck, 0), 0) AS x, count(*) OVER (PARTITION BY name) AS n FROM d),
sm AS (SELECT name, pos, diff, (sum(x) OVER (PARTITION BY name ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 3 - pos) * first_value(x) OVER w + greatest(0, 2 - (n - pos)) * last_value(x) OVER w) / 5 AS smooth FROM ra
  WINDOW w AS (PARTITION BY name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
st AS (SELECT name, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY name ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS fresh FROM sm WHERE smooth >= 8),
isl AS (SELECT name, k, min(pos) AS s, max(pos) AS e, count(*) AS c FROM (SELECT name, pos, sum(fresh) OVER (PARTITION BY name ORDER BY pos) AS k FROM st) GROUP BY name, k),
isr AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY name ORDER BY k) <= 2 * 3 THEN 0 ELSE 1 END AS fresh, sum(c) OVER (PARTITION BY name ORDER BY k) AS p FROM isl),
g AS (SELECT name, count(*) AS m, list(s ORDER BY k) AS s, list(e ORDER BY k) AS e, list(c ORDER BY k) AS c, list(p ORDER BY k) AS p, list(r ORDER BY k) AS r FROM (SELECT *, sum(fresh) OVER (PARTITION BY name ORDER BY k) AS r FROM isr) GROUP BY name),
dp AS (SELECT name, 0 AS j, [0::BIGINT] AS best, []::BIGINT[] AS fr FROM g UNION ALL
  SELECT name, j + 1, list_append(best, CASE WHEN top // 1000000 > best[j + 1] THEN top // 1000000 ELSE best[j + 1] END), list_append(fr, CASE WHEN top // 1000000 > best[j + 1] THEN top % 1000000 ELSE 0 END)
  FROM (SELECT dp.*, list_max([CAST((best[i] + p[j + 1] - p[i] + c[i]) * 1000000 + i AS BIGINT) FOR i IN range(1, j + 2) IF r[i] = r[j + 1] AND e[j + 1] - s[i] + 1 >= 3 AND p[j + 1] - p[i] + c[i] >= 0.5 * (e[j + 1] - s[i] + 1)]) AS top FROM dp JOIN g USING (name) WHERE j < m)),
bt AS (SELECT name, m AS j FROM g UNION ALL SELECT bt.name, CASE WHEN fr[bt.j] > 0 THEN fr[bt.j] - 1 ELSE bt.j - 1 END FROM bt JOIN dp ON dp.name = bt.name JOIN g ON g.name = bt.name AND dp.j = m WHERE bt.j > 0),
pk AS (SELECT g.name, s[fr[bt.j]] AS start, e[bt.j] AS "end", p[bt.j] - p[fr[bt.j]] + c[fr[bt.j]] AS covered FROM bt JOIN g ON g.name = bt.name JOIN dp ON dp.name = bt.name AND dp.j = m WHERE bt.j > 0 AND fr[bt.j] > 0)"""
_T_TAIL = """CASE WHEN t IS NULL THEN NULL WHEN v % 2 = 0 THEN 1 - abs(t) / sqrt(v + t * t) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(v / (v + t * t), k) FOR k IN range(0, v // 2)])
ELSE 1 - 2 / pi() * (atan(abs(t) / sqrt(v)) + abs(t) * sqrt(v) / (v + t * t) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(v / (v + t * t), k) FOR k IN range(0, (v - 1) // 2)]), 0)) END"""


@query(f"""WITH RECURSIVE {_CALL}, q AS (SELECT pk.name, start, "end", count(*) AS n, avg(diff) AS md, stddev_samp(diff) AS sd, max(smooth) AS max_value, arg_max(pos, (smooth, -pos)) AS max_pos, avg(smooth) AS mean_value FROM pk JOIN sm ON sm.name = pk.name AND pos BETWEEN start AND "end" GROUP BY ALL),
t AS (SELECT *, n - 1 AS v, md / nullif(sd / sqrt(n), 0) AS t FROM q), p AS (SELECT *, {_T_TAIL} AS p FROM t), r AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, name, start) AS k, count(p) OVER () AS m FROM p)
SELECT name, start, "end", n, round(max_value, 6) AS max_value, round(mean_value, 6) AS mean_value, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END, 6) AS bhfdr, max_pos FROM r""")
def peak_detection(spark, sf):
    d = line_density(spark, sf).select("name", "pos", "region", F.col("f1").alias("ck"), F.col("f0").alias("ip"))
    p = K.detect(d, ["ck"], ["ip"], floor=8.0, width=3, share=0.5)
    return p.select("name", "start", "end", "n", *r6("max_value", "mean_value", "p", "bhfdr"), "max_pos")


# -- statistics -------------------------------------------------------------


@query(f"WITH {LN0} SELECT 'f0' AS a, 'f1' AS b, round(corr(f0, f1), 6) AS r FROM ln0 UNION ALL SELECT 'f0', 'f2', round(corr(f0, f2), 6) FROM ln0 UNION ALL SELECT 'f1', 'f2', round(corr(f1, f2), 6) FROM ln0")
def replicate_corr_matrix(spark, sf):
    return C.correlations(line_counts(spark, sf), ["f0", "f1", "f2"]).select("a", "b", *r6("r"))


_OD = "g AS (SELECT name, codon[1] AS codon, sum(f1) AS c, sum(f0) AS t FROM ln0 GROUP BY ALL), w AS (SELECT *, sum(c) OVER (PARTITION BY name) AS cs, sum(t) OVER (PARTITION BY name) AS ts FROM g), od AS (SELECT *, (t / nullif(ts - t, 0)) / nullif(c / nullif(cs - c, 0), 0) AS odds FROM w)"


def _odds(spark, sf):
    d = line_counts(spark, sf).withColumn("codon", F.substring("codon", 1, 1))
    return C.odds_sites(d, "f1", "f0", ["codon"])


@query(f"WITH {LN0}, {_OD} SELECT name, codon, CAST(c AS BIGINT) AS c, CAST(t AS BIGINT) AS t, round(odds, 6) AS odds FROM od")
def odds_ratio_sites(spark, sf):
    return _odds(spark, sf).select("name", "codon", "c", "t", *r6("odds"))


@query(f"WITH {LN0}, {_OD} SELECT codon, count(*) FILTER (WHERE odds < 1) AS lower, count(*) FILTER (WHERE odds > 1) AS higher, round(avg(c) FILTER (WHERE odds < 1), 6) AS mean_lower, round(avg(t) FILTER (WHERE odds > 1), 6) AS mean_higher FROM od GROUP BY codon")
def odds_ratio_summary(spark, sf):
    return C.odds_summary(_odds(spark, sf)).select("codon", "lower", "higher", *r6("mean_lower", "mean_higher"))


@query(f"WITH {LN0}, {_OD} SELECT name, codon, round(ln(odds) / sqrt(1 / t + 1 / (ts - t) + 1 / c + 1 / (cs - c)), 6) AS z FROM od WHERE t > 0 AND ts - t > 0 AND c > 0 AND cs - c > 0")
def odds_ratio_z(spark, sf):
    return C.odds_z(_odds(spark, sf)).select("name", "codon", *r6("z"))


# Two-sided normal tail of z as 1 - erf(u), u = |z| / sqrt(2): erf as the series of
# positive terms 2^n u^(2n+1) / (2n+1)!! times 2 exp(-u^2) / sqrt(pi).
_Z_TAIL = "CASE WHEN u = 0 THEN 1 WHEN u > 6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-u * u) * list_sum([exp(n * ln(2) + (2 * n + 1) * ln(u) - lgamma(2 * n + 3) + (n + 1) * ln(2) + lgamma(n + 2)) FOR n IN range(0, 150)]) END"


@query(f"""WITH {LN0}, {_OD}, z AS (SELECT name, codon, ln(odds) / sqrt(1 / t + 1 / (ts - t) + 1 / c + 1 / (cs - c)) AS z FROM od WHERE t > 0 AND ts - t > 0 AND c > 0 AND cs - c > 0),
u AS (SELECT *, abs(z) / sqrt(2) AS u FROM z), p AS (SELECT name, codon, z, {_Z_TAIL} AS p FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY codon ORDER BY p, name) AS k, count(*) OVER (PARTITION BY codon) AS n FROM p)
SELECT name, codon, round(z, 6) AS z, round(p, 6) AS p, round(min(p * n / k) OVER (PARTITION BY codon ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bh FROM r""")
def odds_ratio_pvalue(spark, sf):
    return C.odds_pvalues(_odds(spark, sf), ["name"], ["codon"]).select("name", "codon", *r6("z", "p", "bh"))


_PV = "pv AS (SELECT p_partkey AS name, p_partkey * 7919 % 1009 / 1009.0 AS p FROM part)"


def _pvalues(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") * 7919 % 1009 / 1009.0).alias("p"))


@query(f"WITH {_PV}, r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS n FROM pv) SELECT name, round(min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bh FROM r")
def bh_adjust(spark, sf):
    return stats.bh_adjust(_pvalues(spark, sf), "p", ["name"]).select("name", *r6("bh"))


@query(f"WITH {_PV} SELECT name, round(least(1, p * (SELECT count(*) FROM pv)), 6) AS bonferroni FROM pv")
def bonferroni(spark, sf):
    p = _pvalues(spark, sf)
    n = p.agg(F.count("*").alias("n"))
    return p.join(F.broadcast(n)).select("name", F.round(stats.bonferroni(F.col("p"), F.col("n")), 6).alias("bonferroni"))


_LR = "lr AS (SELECT name, log2((sum(f0) FILTER (WHERE sample = 'F') + 1) / (sum(f0) FILTER (WHERE sample = 'O') + 1)) AS x, log2((sum(f1) FILTER (WHERE sample = 'F') + 1) / (sum(f1) FILTER (WHERE sample = 'O') + 1)) AS y FROM ln0 GROUP BY name)"


@query(f"WITH {LN0}, {_LR} SELECT name, CASE WHEN x >= 0.5 THEN 'up' WHEN x <= -0.5 THEN 'down' ELSE 'flat' END || '_' || CASE WHEN y >= 0.5 THEN 'up' WHEN y <= -0.5 THEN 'down' ELSE 'flat' END AS quadrant FROM lr WHERE x IS NOT NULL AND y IS NOT NULL")
def quadrant_class(spark, sf):
    one = lambda c, s: F.sum(F.when(F.col("sample") == s, F.col(c)))
    g = line_counts(spark, sf).groupBy("name").agg(*[F.log2((one(c, "F") + 1) / (one(c, "O") + 1)).alias(n) for c, n in (("f0", "x"), ("f1", "y"))]).dropna()
    return C.quadrants(g, "x", "y", 0.5).select("name", "quadrant")


@query(f"WITH {LN0}, a AS (SELECT name, sum(f0) AS r FROM ln0 WHERE sample = 'F' GROUP BY name), b AS (SELECT name, sum(f1) AS m FROM ln0 WHERE sample = 'O' GROUP BY name) SELECT name, CAST(r AS BIGINT) AS ribo, CAST(m AS BIGINT) AS rna, round(r / nullif(m, 0), 6) AS te FROM a FULL JOIN b USING (name)")
def te_fold_change(spark, sf):
    d = line_counts(spark, sf)
    a = d.where("sample = 'F'").groupBy("name").agg(F.sum("f0").alias("x"))
    b = d.where("sample = 'O'").groupBy("name").agg(F.sum("f1").alias("x"))
    return C.translation_efficiency(a, b).select("name", "ribo", "rna", *r6("te"))


@query(f"WITH {LN0}, c AS (SELECT name, sample, sum(f0) AS x FROM ln0 GROUP BY ALL), g AS (SELECT name, avg(ln(x)) AS lg FROM c WHERE x > 0 GROUP BY name HAVING count(*) = (SELECT count(DISTINCT sample) FROM c)) SELECT sample, round(exp(quantile_cont(ln(x) - lg, 0.5)), 6) AS size_factor FROM c JOIN g USING (name) GROUP BY sample")
def size_factors(spark, sf):
    c = line_counts(spark, sf).groupBy("name", "sample").agg(F.sum("f0").alias("x"))
    return C.size_factors(c).select("sample", *r6("size_factor"))


@query(f"WITH {LN0}, c AS (SELECT name, sample, sum(f0) AS x FROM ln0 GROUP BY ALL), v AS (SELECT sample, log2(x + 1) AS v FROM c) SELECT DISTINCT sample, round(v, 6) AS log2_value, round(cume_dist() OVER (PARTITION BY sample ORDER BY v), 6) AS cdf FROM v")
def log2_cdf(spark, sf):
    c = line_counts(spark, sf).groupBy("name", "sample").agg(F.sum("f0").alias("x"))
    return C.log_cdf(c, "x", ["sample"]).select("sample", *r6("log2_value", "cdf"))


@query("WITH p AS (SELECT user_id, CAST(floor(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 6) AS BIGINT) / (0.05 * 16777216)) AS INT) + 1 AS part FROM events), f AS (SELECT user_id, min(part) AS part FROM p GROUP BY user_id) SELECT CAST(s AS INT) AS step, (SELECT count(*) FROM f WHERE part <= s) AS genes FROM range(1, 10) t(s)")
def saturation_hash(spark, sf):
    return R.saturation(table(spark, sf, "events"), "event_id", "user_id")


@query(f"WITH {EV}, a AS (SELECT name, pos, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM ev), b AS (SELECT name, x, row_number() OVER (PARTITION BY name ORDER BY md5('0|' || name || '|' || pos), pos) AS k FROM ev) SELECT a.name, a.pos, round(b.x, 6) AS shuffled FROM a JOIN b ON a.name = b.name AND a.k = b.k")
def shuffle_within_gene(spark, sf):
    return R.shuffle_counts(ev(spark, sf), "x").select("name", "pos", *r6("shuffled"))


@query("WITH v AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL), e AS (SELECT label, list(x ORDER BY i) AS e FROM c GROUP BY label) SELECT a.label AS a, b.label AS b, round(list_distance(a.e, b.e), 6) AS distance FROM e a JOIN e b ON a.label < b.label")
def pairwise_distance(spark, sf):
    """Distances between the groups' mean profiles: one row per pair of groups."""
    v = table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    mean = v.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e"))
    return C.pair_distances(mean.select("label", F.col("e.x").alias("e")), "label", "e").select("a", "b", *r6("distance"))


@query(f"WITH {EV}, s AS (SELECT name, sum(x) AS s FROM ev GROUP BY name) SELECT name, round((s - avg(s) OVER ()) / stddev_samp(s) OVER (), 6) AS z FROM s")
def zscore_scale(spark, sf):
    g = ev(spark, sf).groupBy("name").agg(F.sum("x").alias("s"))
    return stats.scaled(g, "s", "zscore", [], "z").select("name", *r6("z"))


@query(f"WITH {EV}, s AS (SELECT name, codon, sum(x) AS s FROM ev GROUP BY ALL) SELECT name, codon, round(s / nullif(max(s) OVER (PARTITION BY name), 0), 6) AS share, round((s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0), 6) AS z FROM s WINDOW w AS (PARTITION BY name)")
def scale_in_groups(spark, sf):
    g = ev(spark, sf).groupBy("name", "codon").agg(F.sum("x").alias("s"))
    return stats.scaled(stats.scaled(g, "s", "minmax", ["name"], "share"), "s", "zscore", ["name"], "z").select("name", "codon", *r6("share", "z"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    return W.tumbling(table(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf):
    return W.sessions(table(spark, sf, "events")).select("user_id", "start", "end", "n")


_GAUSS = T.gaussian_weights(1.0, 2.0)


@query(f"WITH {EV}, w AS (SELECT unnest({_GAUSS}) AS w, unnest(range(-2, 3)) AS k) SELECT name, CAST(pos + k AS BIGINT) AS pos, greatest(0, round(sum(x * w), 4)) AS x FROM ev, w GROUP BY ALL")
def smooth_gaussian(spark, sf):
    return T.smooth(ev(spark, sf).select("name", "pos", "x"), _GAUSS, ["name"], "pos", "x")


_POLY = T.polynomial_weights(5, 2)


@query(f"WITH {EV}, w AS (SELECT unnest({_POLY}) AS w, unnest(range(-2, 3)) AS k) SELECT name, CAST(pos + k AS BIGINT) AS pos, greatest(0, round(sum(x * w), 4)) AS x FROM ev, w GROUP BY ALL")
def smooth_polynomial(spark, sf):
    return T.smooth(ev(spark, sf).select("name", "pos", "x"), _POLY, ["name"], "pos", "x")


@query("SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) AS total FROM documents GROUP BY source")
def sequence_matrix(spark, sf):
    return T.sequence_matrix(table(spark, sf, "documents"), "source", "lang", ["de", "en"])


@query(f"WITH {LN0}, g AS (SELECT name, sum(f0) AS s FROM ln0 GROUP BY name), q AS (SELECT quantile_cont(s, [0.25, 0.5, 0.75]) AS q FROM g) SELECT name, CAST(s AS BIGINT) AS s, CAST(1 + (s > q[1])::INT + (s > q[2])::INT + (s > q[3])::INT AS INT) AS quartile FROM g, q")
def quartile_split(spark, sf):
    return T.quartiles(line_counts(spark, sf).groupBy("name").agg(F.sum("f0").alias("s")), "s")


@query(f"WITH {EV}, p AS (SELECT name, 5 AS a, 8 AS b FROM (SELECT DISTINCT name FROM ev)) SELECT ev.name, ev.pos, round(x, 6) AS x FROM ev JOIN p ON ev.name = p.name AND pos BETWEEN a - 2 AND b + 3")
def region_rows(spark, sf):
    e = ev(spark, sf)
    ranges = e.select("name").distinct().withColumns({"start": F.lit(5), "end": F.lit(8)})
    return T.region_rows(e, ranges, 2, 3).select("name", "pos", *r6("x"))


@query("WITH c AS (SELECT l_linestatus AS sample, l_returnflag AS database, count(*) AS n FROM lineitem GROUP BY ALL) SELECT sample, database, CAST(CASE database WHEN 'R' THEN 1 WHEN 'N' THEN 2 WHEN 'A' THEN 3 ELSE 0 END AS INT) AS rank, n AS \"count\", round(n * 100.0 / sum(n) OVER (PARTITION BY sample), 6) AS ratio FROM c")
def mapping_ratio(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("sample"), F.col("l_returnflag").alias("database")).agg(F.count("*").alias("reported"))
    t = c.groupBy("sample").agg(F.sum("reported").alias("processed"))
    return T.mapping_ratios(c.join(F.broadcast(t), "sample"), ["R", "N", "A"]).select("sample", "database", "rank", "count", *r6("ratio"))


# -- gates, classes and variants ---------------------------------------------


@query(f"WITH {LN}, k AS (SELECT *, region <> 'cds' OR (from_tis >= 2 AND from_tts <= -1) AS ok FROM ln), g AS (SELECT name, region, sample, sum(CASE WHEN ok THEN f0 + f1 + f2 ELSE 0 END) AS c, count(*) FILTER (WHERE ok) AS n FROM k GROUP BY ALL), l AS (SELECT *, sum(n) OVER (PARTITION BY name, sample) * 3 AS len FROM g), t AS (SELECT sample, sum(f0 + f1 + f2) AS total FROM ln GROUP BY ALL) SELECT name, region, l.sample, CAST(c AS BIGINT) AS \"count\", round(c * 1e6 / total, 6) AS rpm, round(c * 1e9 / (len * total), 6) AS rpkm FROM l JOIN t ON l.sample = t.sample WHERE n > 0")
def region_quant_trimmed(spark, sf):
    return P.region_quant(ln(spark, sf), tis=2, tts=1).select("name", "region", "sample", "count", *r6("rpm", "rpkm"))


@query(f"WITH {EV}, w AS (SELECT *, avg(x) OVER (PARTITION BY name) AS m, stddev_samp(x) OVER (PARTITION BY name) AS d FROM ev) SELECT name, pos, round(CASE WHEN abs((x - m) / nullif(d, 0)) > 1.5 THEN m ELSE x END, 6) AS filled FROM w")
def outlier_z_fill(spark, sf):
    return P.fill_outliers(ev(spark, sf), width=1.5, how="zscore").select("name", "pos", *r6("filled"))


@query(f"WITH {LN} SELECT name, pos, round(CASE WHEN f1 = 0 THEN (SELECT avg(f1) FROM ln) ELSE f1 END, 6) AS f1 FROM ln")
def fill_empty_global(spark, sf):
    return K.fill_empty(line_density(spark, sf), "f1", 0).select("name", "pos", *r6("f1"))


@query(f"WITH {LN} SELECT name, pos, round(CASE WHEN f1 = 0 THEN avg(f1) FILTER (WHERE pos <= 10) OVER (PARTITION BY name) ELSE f1 END, 6) AS f1 FROM ln")
def fill_empty_first(spark, sf):
    return K.fill_empty(line_density(spark, sf), "f1", 10).select("name", "pos", *r6("f1"))


@query(f"WITH {LN0} SELECT name, sample, codon, f0 FROM ln0 WHERE codon IN ('AF', 'NO')")
def codon_whitelist(spark, sf):
    return D.keep_codons(line_counts(spark, sf), ["af", "NO"]).select("name", "sample", "codon", "f0")


@query(f"WITH {LN0} SELECT DISTINCT name FROM ln0 ORDER BY name LIMIT 20")
def first_genes(spark, sf):
    return D.first_genes(line_counts(spark, sf), 20)


@query(f"WITH {LN0}, a AS (SELECT name, sample, sum(f0) AS s FROM ln0 GROUP BY ALL), b AS (SELECT name, sample, sum(f1) AS s FROM ln0 GROUP BY ALL) SELECT name FROM a WHERE s >= 200 GROUP BY name HAVING count(*) = 2 INTERSECT SELECT name FROM b WHERE s >= 40 GROUP BY name HAVING count(*) = 2")
def expressed_in_all(spark, sf):
    d = line_counts(spark, sf)
    return C.expressed_in_all(d.withColumn("x", F.col("f0")), d.withColumn("x", F.col("f1")), 200, 40)


@query(f"WITH {LN0}, g AS (SELECT name, codon[1] AS codon, sample, sum(f0) AS a, sum(f1) AS b, sum(f2) AS c FROM ln0 GROUP BY ALL), w AS (SELECT name, codon, coalesce(sum(a) FILTER (WHERE sample = 'F'), 0) AS fa, coalesce(sum(a) FILTER (WHERE sample = 'O'), 0) AS oa, coalesce(sum(b) FILTER (WHERE sample = 'F'), 0) AS fb, coalesce(sum(b) FILTER (WHERE sample = 'O'), 0) AS ob, coalesce(sum(c) FILTER (WHERE sample = 'F'), 0) AS fc, coalesce(sum(c) FILTER (WHERE sample = 'O'), 0) AS oc FROM g GROUP BY ALL) SELECT '0' AS mode, 'F' AS a, 'O' AS b, round(corr(fa, oa), 6) AS r FROM w UNION ALL SELECT '1', 'F', 'O', round(corr(fb, ob), 6) FROM w UNION ALL SELECT '2', 'F', 'O', round(corr(fc, oc), 6) FROM w UNION ALL SELECT 'all', 'F', 'O', round(corr(fa + fb + fc, oa + ob + oc), 6) FROM w")
def frame_mode_correlations(spark, sf):
    d = line_counts(spark, sf).withColumn("codon", F.substring("codon", 1, 1))
    return C.frame_correlations(d, ["name", "codon"]).select("mode", "a", "b", *r6("r"))


@query(f"WITH {LN0}, {_OD}, z AS (SELECT *, ln(odds) / sqrt(1 / t + 1 / (ts - t) + 1 / c + 1 / (cs - c)) AS z FROM od WHERE t > 0 AND ts - t > 0 AND c > 0 AND cs - c > 0) SELECT codon, count(*) FILTER (WHERE odds < 1 AND abs(z) >= 1.96) AS sig_lower, round(count(*) FILTER (WHERE odds < 1 AND abs(z) >= 1.96) * 100.0 / count(*), 6) AS share_lower, count(*) FILTER (WHERE odds > 1 AND abs(z) >= 1.96) AS sig_higher, round(count(*) FILTER (WHERE odds > 1 AND abs(z) >= 1.96) * 100.0 / count(*), 6) AS share_higher FROM z GROUP BY codon")
def odds_ratio_significance(spark, sf):
    return C.odds_summary(C.odds_z(_odds(spark, sf)), F.abs("z") >= 1.96).select("codon", "sig_lower", "sig_higher", *r6("share_lower", "share_higher"))


@query(f"WITH i AS ({_IV}), a AS (SELECT DISTINCT name, s - 10 AS start, s + 10 AS \"end\" FROM i WHERE p LIKE '1%'), b AS (SELECT DISTINCT name, s - 10 AS start, s + 10 AS \"end\" FROM i WHERE p LIKE '2%') SELECT name, start, \"end\", 'control' AS side, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.name = a.name AND a.start <= b.\"end\" AND b.start <= a.\"end\") THEN 'overlap' ELSE 'control' END AS kind FROM a UNION ALL SELECT name, start, \"end\", 'treated', CASE WHEN EXISTS (SELECT 1 FROM a WHERE b.name = a.name AND a.start <= b.\"end\" AND b.start <= a.\"end\") THEN 'overlap' ELSE 'treated' END FROM b")
def overlap_classes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long").alias("s"), F.col("o_orderpriority").alias("p"))
    a, b = (o.where(F.col("p").startswith(k)).select("name", (F.col("s") - 10).alias("start"), (F.col("s") + 10).alias("end")).distinct() for k in "12")
    return K.overlap_classes(a, b, ["name"])


@query(f"WITH {LN}, g AS (SELECT name, max(f0) FILTER (WHERE pos >= 10) AS h, max(f0) FILTER (WHERE pos < 10) AS l FROM ln GROUP BY name) SELECT name, coalesce(h > l * 0.9, false) AS ok FROM g")
def background_gate(spark, sf):
    return K.background_gate(line_density(spark, sf), ["f0"], 0.9, 10, pos="pos")


@query(f"WITH {LN}, c AS (SELECT name, corr(f0, f1) AS r FROM ln GROUP BY name) SELECT name, CAST(coalesce(r >= 0.1, false) AS INT) AS pairs_passed, coalesce(r >= 0.1, false) AS ok FROM c")
def replicate_gate(spark, sf):
    return C.replicate_gate(line_density(spark, sf), ["f0", "f1"], 0.1)


@query(f"WITH {LN0}, g AS (SELECT codon[1] AS codon, sample, f0 FROM ln0) SELECT codon, round((avg(f0) FILTER (WHERE sample = 'F') - avg(f0) FILTER (WHERE sample = 'O')) / sqrt(((count(*) FILTER (WHERE sample = 'F') - 1) * var_samp(f0) FILTER (WHERE sample = 'F') + (count(*) FILTER (WHERE sample = 'O') - 1) * var_samp(f0) FILTER (WHERE sample = 'O')) / (count(*) - 2) * (1.0 / count(*) FILTER (WHERE sample = 'F') + 1.0 / count(*) FILTER (WHERE sample = 'O'))), 6) AS t FROM g GROUP BY codon HAVING count(DISTINCT sample) = 2")
def two_sample_t(spark, sf):
    d = line_counts(spark, sf).withColumn("codon", F.substring("codon", 1, 1))
    return stats.t_test(d, ["codon"], "sample", "f0", ("F", "O")).where("t IS NOT NULL").select("codon", *r6("t"))


@query(f"WITH {LN0}, v AS (SELECT f0, count(*) FILTER (WHERE sample = 'F') AS a, count(*) FILTER (WHERE sample = 'O') AS b FROM ln0 GROUP BY f0), c AS (SELECT sum(a) OVER (ORDER BY f0) / sum(a) OVER () - sum(b) OVER (ORDER BY f0) / sum(b) OVER () AS g FROM v) SELECT round(max(abs(g)), 6) AS d FROM c")
def ks_distance(spark, sf):
    d = line_counts(spark, sf).withColumn("g", F.lit(1))
    return stats.ks_test(d, ["g"], "sample", "f0", ("F", "O")).select(*r6("d"))


@query(f"WITH {_PV}, g AS (SELECT name, name % 3 AS g, p FROM pv), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, name) AS k, count(*) OVER (PARTITION BY g) AS n FROM g) SELECT name, g, round(min(p * n / k) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bh FROM r")
def bh_adjust_in_groups(spark, sf):
    p = _pvalues(spark, sf).withColumn("g", F.col("name") % 3)
    return stats.bh_adjust(p, "p", ["name"], groups=["g"]).select("name", "g", *r6("bh"))


# -- reads -------------------------------------------------------------------

_RD = """rd AS (SELECT l_partkey AS rname, CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 256 ELSE 0 END AS flag, CAST(l_quantity AS INT) AS mapq,
CAST(l_linenumber * 7 + l_suppkey % 5 AS INT) AS block_start, CAST(l_linenumber * 7 + l_suppkey % 5 + 25 + l_orderkey % 8 AS INT) AS block_end, CAST(25 + l_orderkey % 8 AS INT) AS length FROM lineitem)"""
_AN = "an AS (SELECT p_partkey AS name, CAST(10 + p_size % 11 AS INT) AS u, CAST(30 + p_size AS INT) AS c FROM part)"
_OF = "ofs AS (SELECT CAST(l AS INT) AS length, CAST(11 + l % 3 AS INT) AS o FROM range(25, 31) t(l))"


def _reads(spark, sf):
    """Alignments made from order lines."""
    start = (F.col("l_linenumber") * 7 + F.col("l_suppkey") % 5).cast("int")
    length = (25 + F.col("l_orderkey") % 8).cast("int")
    flag = F.when(F.col("l_linestatus") == "O", 16).otherwise(0) + F.when(F.col("l_returnflag") == "R", 256).otherwise(0)
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("rname"), flag.alias("flag"), F.col("l_quantity").cast("int").alias("mapq"), start.alias("block_start"), (start + length).alias("block_end"), length.alias("length"))


def _read_annotation(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("name"), (10 + F.col("p_size") % 11).cast("int").alias("utr5_length"), (30 + F.col("p_size")).cast("int").alias("cds_length"))


def _read_offsets(spark, sf):
    return spark.range(25, 31).select(F.col("id").cast("int").alias("length"), F.array((11 + F.col("id") % 3).cast("int")).alias("p_site"))


@query(f"WITH {_RD} SELECT rname, flag, mapq, length FROM rd WHERE mapq >= 20 AND flag & 256 = 0 AND length IN (28, 29)")
def read_filter(spark, sf):
    return R.filter_reads(_reads(spark, sf), 20, [28, 29]).select("rname", "flag", "mapq", "length")


@query(f"WITH {_RD} SELECT length, count(*) FILTER (WHERE flag & 16 = 0) AS plus, count(*) FILTER (WHERE flag & 16 <> 0) AS minus FROM rd GROUP BY length")
def read_lengths_by_strand(spark, sf):
    return R.length_by_strand(_reads(spark, sf))


@query(f"WITH {_RD}, c AS (SELECT length, count(*) FILTER (WHERE flag & 16 = 0) AS plus, count(*) FILTER (WHERE flag & 16 <> 0) AS minus FROM rd GROUP BY length), t AS (SELECT length AS peak FROM c ORDER BY plus DESC, minus DESC, length DESC LIMIT 1) SELECT peak, CASE WHEN peak BETWEEN 24 AND 34 THEN 'monosome' WHEN peak BETWEEN 54 AND 64 THEN 'disome' WHEN peak BETWEEN 84 AND 94 THEN 'trisome' ELSE 'unknown' END AS kind FROM t")
def ribosome_class(spark, sf):
    return R.ribosome_class(R.length_by_strand(_reads(spark, sf)))


@query(f"""WITH {_RD}, {_AN}, j AS (SELECT *, CASE WHEN block_start <= u AND block_end > u THEN 'tis' WHEN block_start <= u + c - 6 AND block_end > u + c - 6 THEN 'tts' END AS site FROM rd JOIN an ON rname = name WHERE flag & 16 = 0),
p AS (SELECT *, CASE site WHEN 'tis' THEN u ELSE u + c - 6 END AS p FROM j WHERE site IS NOT NULL), e AS (SELECT site, '5end' AS "end", length, p - block_start AS "offset" FROM p UNION ALL SELECT site, '3end', length, block_end - 1 - p FROM p)
SELECT site, "end", length, "offset", count(*) AS n FROM e WHERE abs("offset") <= 50 GROUP BY ALL""")
def end_offsets(spark, sf):
    return R.end_offsets(_reads(spark, sf), _read_annotation(spark, sf))


@query(f"""WITH {_RD}, {_AN}, j AS (SELECT length, CAST(11 + floor((length - 30) / 2.0) AS INT) AS base, (block_start + CAST(11 + floor((length - 30) / 2.0) AS INT) - u) AS x FROM rd JOIN an ON rname = name WHERE flag & 16 = 0),
c AS (SELECT length, base, count(*) FILTER (WHERE ((x % 3) + 3) % 3 = 0) AS c0, count(*) FILTER (WHERE ((x % 3) + 3) % 3 = 1) AS c1, count(*) FILTER (WHERE ((x % 3) + 3) % 3 = 2) AS c2 FROM j GROUP BY ALL)
SELECT length, c0 AS rpfs0, c1 AS rpfs1, c2 AS rpfs2, CAST(base + 1 + CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN -1 ELSE 1 END AS INT) AS p_site, c0 + c1 + c2 AS rpfs, round(greatest(c0, c1, c2) * 100.0 / (c0 + c1 + c2), 6) AS periodicity FROM c""")
def frame_offsets(spark, sf):
    return R.frame_offsets(_reads(spark, sf), _read_annotation(spark, sf)).select("length", "rpfs0", "rpfs1", "rpfs2", "p_site", "rpfs", *r6("periodicity"))


@query(f"WITH {_RD}, {_OF} SELECT rname AS name, CAST(block_start + o + 1 AS BIGINT) AS nt, count(*) AS n FROM rd JOIN ofs USING (length) GROUP BY ALL")
def psite_hits(spark, sf):
    return R.psite_hits(_reads(spark, sf), _read_offsets(spark, sf))


@query(f"WITH {_RD} SELECT rname AS name, CAST(block_start + 1 + k AS BIGINT) AS nt, count(*) AS n FROM rd, (SELECT unnest([0, 10, 20, 30]) AS k) WHERE block_start + 1 + k <= block_end GROUP BY ALL")
def rolling_hits(spark, sf):
    return R.rolling_hits(_reads(spark, sf), 10)


@query(f"WITH {_RD}, {_OF}, t AS (SELECT rname AS chr, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, CASE WHEN flag & 16 <> 0 THEN block_end - 1 - o ELSE block_start + o END AS start, count(*) AS n FROM rd JOIN ofs USING (length) GROUP BY ALL) SELECT chr, start, start + 1 AS \"end\", strand, CASE strand WHEN '-' THEN -n ELSE n END AS density, round(CASE strand WHEN '-' THEN -n ELSE n END * 1e6 / sum(n) OVER (), 3) AS rpm FROM t")
def genome_track(spark, sf):
    return R.genome_track(_reads(spark, sf), _read_offsets(spark, sf))


@query(f"WITH {_RD}, {_AN}, j AS (SELECT length, (((block_start - u) % 3) + 3) % 3 AS a, (((block_end - u) % 3) + 3) % 3 AS b FROM rd JOIN an ON rname = name WHERE flag & 16 = 0) SELECT length, " + ", ".join(f"count(*) FILTER (WHERE {c} = {k}) AS \"{n}_{k}\"" for n, c in (("5end", "a"), ("3end", "b")) for k in range(3)) + " FROM j GROUP BY length")
def digestion_frames(spark, sf):
    return R.digestion_frames(_reads(spark, sf), _read_annotation(spark, sf))


# -- files: written as text to the shared folder and read back -----------------


@query(f"WITH {LN0}, w AS (SELECT name, sample, sum(f0) AS f0, sum(f1) AS f1, sum(f2) AS f2 FROM ln0 GROUP BY ALL) SELECT CAST(name AS VARCHAR) AS name, sample, CAST(f0 AS BIGINT) AS f0, CAST(f1 AS BIGINT) AS f1, CAST(f2 AS BIGINT) AS f2 FROM w")
def density_files(spark, sf):
    """Wide density table: sink, scan with samples from the header, long form."""
    g = line_counts(spark, sf).groupBy("name", "sample").agg(*[F.sum(f"f{k}").alias(f"f{k}") for k in range(3)])
    fixed = {"now_nt": F.lit(1), "from_tis": F.lit(0), "from_tts": F.lit(-1), "region": F.lit("cds"), "codon": F.lit("ATG")}
    wide = D.long_to_wide(g.withColumns(fixed), ["F", "O"])
    path = workspace(spark, "density")
    sinks.write_tsv(wide, path)
    back = D.wide_to_long(tables.read_density(spark, path))
    have = g.select(F.col("name").cast("string").alias("name"), "sample")
    return back.select("name", "sample", "f0", "f1", "f2").join(have, ["name", "sample"], "left_semi")


@query("SELECT CAST(item_id AS VARCHAR) AS id, regexp_replace(text, '\\s+', '', 'g') AS seq FROM benchmark WHERE length(trim(text)) > 0")
def fasta_files(spark, sf):
    path = workspace(spark, "fasta")
    sequences.write_fasta(table(spark, sf, "benchmark").where("length(trim(text)) > 0").select(F.col("item_id").cast("string").alias("id"), F.regexp_replace("text", r"\s+", "").alias("seq")), path)
    return sequences.read_fasta(spark, path).select("id", "seq")


@query(f"WITH {_RD} SELECT CAST(rname AS VARCHAR) AS rname, flag, mapq, block_start, block_end, length, count(*) AS n FROM rd GROUP BY ALL")
def sam_files(spark, sf):
    """Alignment lines written as text, and read with blocks, lengths and tags."""
    path = workspace(spark, "sam")
    line = F.concat_ws("\t", F.lit("r"), "flag", "rname", F.col("block_start") + 1, "mapq", F.concat(F.col("length"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("NH:i:1"))
    _reads(spark, sf).select(line.alias("value")).write.text(path)
    d = alignments.read_sam(spark, path)
    return R.unique_reads(d).groupBy("rname", "flag", "mapq", "block_start", "block_end", "length").agg(F.count("*").alias("n"))


@query(f"WITH {_RD}, {_OF}, t AS (SELECT CAST(rname AS VARCHAR) AS chr, CAST(block_start + o AS INT) AS start, count(*) AS n FROM rd JOIN ofs USING (length) WHERE flag & 16 = 0 GROUP BY ALL) SELECT chr, start, CAST(start + 1 AS INT) AS \"end\", CAST(n AS DOUBLE) AS rpm FROM t")
def bedgraph_files(spark, sf):
    path = workspace(spark, "bedgraph")
    t = R.genome_track(_reads(spark, sf), _read_offsets(spark, sf)).where("strand = '+'").withColumn("rpm", F.col("density").cast("double"))
    sinks.write_bedgraph(t, path)
    return tables.read_bedgraph(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS name FROM part WHERE p_size > 25")
def gene_list_files(spark, sf):
    path = workspace(spark, "list")
    sinks.write_tsv(table(spark, sf, "part").where("p_size > 25").select(F.lit("x").alias("note"), F.col("p_partkey").alias("transcript_id")), path)
    return tables.read_list(spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS name, 'f' || c_nationkey AS file FROM customer")
def sample_list_files(spark, sf):
    path = workspace(spark, "samples")
    sinks.write_tsv(table(spark, sf, "customer").select(F.col("c_custkey").alias("Name"), F.concat(F.lit("f"), "c_nationkey").alias("File")), path)
    return tables.read_samples(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS transcript_id, 10 + p_size % 11 AS utr5_length, 30 + p_size AS cds_length, 40 + p_size + p_size % 11 AS length FROM part WHERE p_partkey % 2 = 0")
def annotation_files(spark, sf):
    """The annotation sink and its scan of representative, coding transcripts."""
    path = workspace(spark, "annotation")
    m = _read_annotation(spark, sf).select(F.lit("c").alias("chrom"), F.concat(F.lit("gene-"), "name").alias("name2"), F.concat(F.lit("rna-"), "name").alias("name"), F.lit(1).alias("txStart"), F.lit(9).alias("txEnd"), "utr5_length", "cds_length", F.lit(0).alias("utr3_length"), F.lit("+").alias("strand"), (F.col("name") % 2 == 0).alias("rep_transcript"), F.lit(False).alias("modified"))
    sinks.write_annotation(m, path)
    return tables.read_annotation(spark, path, True, True).select("transcript_id", "utr5_length", "cds_length", "length")


@query("SELECT 'o' || p_partkey AS orf, CASE WHEN p_size % 2 = 0 THEN 'uORF' ELSE 'dORF' END AS kind, CAST(p_size + 30 AS BIGINT) AS length FROM part WHERE p_size BETWEEN 10 AND 30 AND p_size % 3 <> 0")
def orf_files(spark, sf):
    """ORF caller rows: two exons each, grouped, filtered by class and length."""
    path = workspace(spark, "orf")
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 3 == 0, "internal").when(F.col("p_size") % 2 == 0, "uORF").otherwise("dORF").alias("kind"))
    label = F.concat_ws(";", F.concat(F.lit("o"), "p_partkey"), F.lit("g"), F.lit("r"), "kind")
    exon = F.explode(F.array(F.struct(F.lit(100).alias("a"), F.lit(130).alias("b")), F.struct(F.lit(500).alias("a"), (500 + F.col("p_size")).alias("b")))).alias("x")
    p.select("p_partkey", label.alias("l"), exon).select(F.lit("chr1"), "x.a", "x.b", "l", F.lit("."), F.lit("+")).write.option("sep", "\t").csv(path)
    return tables.filter_orfs(tables.read_orf_bed(spark, path), ["uORF", "dORF"], 40, 60).select("orf", "kind", "length")


# -- further variants ------------------------------------------------------------


@query(f"""WITH {_RD}, {_AN}, j AS (SELECT *, CASE WHEN block_start <= u AND block_end > u THEN u WHEN block_start <= u + c - 6 AND block_end > u + c - 6 THEN u + c - 6 END AS p FROM rd JOIN an ON rname = name WHERE flag & 16 = 0),
h AS (SELECT length, CAST(p - block_start AS INT) AS o, count(*) AS n FROM j WHERE p IS NOT NULL AND p - block_start <= 50 GROUP BY ALL),
c AS (SELECT length, CAST(o AS INT) AS o FROM (SELECT length, unnest(range(8 + CAST(floor((length - 30) / 2.0) AS INT), 17 + CAST(floor((length - 30) / 2.0) AS INT))) AS o FROM (SELECT DISTINCT length FROM h))),
b AS (SELECT c.length, c.o AS site FROM c LEFT JOIN h USING (length, o) QUALIFY row_number() OVER (PARTITION BY c.length ORDER BY coalesce(n, 0) DESC, c.o) = 1),
f AS (SELECT b.length, site, CAST(coalesce(sum(n) FILTER (WHERE o IN (site - 3, site, site + 3)), 0) AS BIGINT) AS rpfs0, CAST(coalesce(sum(n) FILTER (WHERE o IN (site - 2, site + 1, site + 4)), 0) AS BIGINT) AS rpfs1, CAST(coalesce(sum(n) FILTER (WHERE o IN (site - 1, site + 2, site + 5)), 0) AS BIGINT) AS rpfs2 FROM b LEFT JOIN h ON h.length = b.length GROUP BY ALL)
SELECT length, site, rpfs0, rpfs1, rpfs2, site + 1 AS p_site, rpfs0 + rpfs1 + rpfs2 AS rpfs, round(greatest(rpfs0, rpfs1, rpfs2) * 1.0 / nullif(rpfs0 + rpfs1 + rpfs2, 0), 6) AS periodicity FROM f""")
def candidate_offsets(spark, sf):
    h = R.end_offsets(_reads(spark, sf), _read_annotation(spark, sf))
    return R.candidate_offsets(h, 30).select("length", "site", "rpfs0", "rpfs1", "rpfs2", "p_site", "rpfs", *r6("periodicity"))


@query(f"WITH {EV}, g AS (SELECT *, sum(x) OVER (PARTITION BY name) AS t, avg(nullif(x, 0)) OVER (PARTITION BY name) AS m, coalesce(lag(x) OVER (PARTITION BY name ORDER BY pos), 0) AS v FROM ev), o AS (SELECT codon, avg(nullif(v / nullif(m, 0), 0)) AS occ FROM g WHERE t >= 20 GROUP BY codon) SELECT codon, 'all' AS sample, round(occ, 6) AS occupancy, round((occ - avg(occ) OVER ()) / stddev_samp(occ) OVER (), 6) AS relative FROM o")
def codon_occupancy_nonzero(spark, sf):
    return P.occupancy_nonzero(ev(spark, sf).withColumn("sample", F.lit("all")), 20, "A").select("codon", "sample", *r6("occupancy", "relative"))


@query(f"WITH {LN}, t AS (SELECT sample, sum(f0 + f1 + f2) AS total, count(*) * 3 AS cells FROM ln GROUP BY sample), m AS (SELECT name, from_tis, from_tts, ln.sample, unnest([0, 1, 2]) AS frame, unnest([f0, f1, f2]) AS f, total, cells FROM ln JOIN t ON t.sample = ln.sample) SELECT name, from_tis, from_tts, sample, CAST(frame AS INT) AS frame, round(f * 1e7 / total, 6) AS rpm, round(f * cells / total, 6) AS density FROM m")
def gene_profile(spark, sf):
    return D.gene_profile(line_density(spark, sf)).select("name", "from_tis", "from_tts", "sample", "frame", *r6("rpm", "density"))


@query("SELECT CAST(c_custkey AS BIGINT) AS name, coalesce(n_name, '-') AS gene FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1")
def gene_notes(spark, sf):
    nations = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("gene"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_nationkey").alias("name"))
    return K.with_notes(c, nations).select(F.col("key").alias("name"), "gene")


@query(f"WITH {LN}, d AS (SELECT name, count(*) AS n, avg(f0 - f1) AS m, stddev_samp(f0 - f1) AS s FROM ln GROUP BY name) SELECT name, n, round(m, 6) AS mean, round(m / nullif(s / sqrt(n), 0), 6) AS t FROM d")
def paired_t(spark, sf):
    return stats.paired_t(line_density(spark, sf), ["name"], "f0", "f1").select("name", "n", *r6("mean", "t"))


_PN = "pn AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS seq FROM part)"


def _letters(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("seq"))


@query(f"WITH {_PN} SELECT 'r' || p_partkey AS id, substr(seq, 1, 8) AS seq, 8 AS n_quality FROM pn WHERE length(seq) >= 8")
def fastq_files(spark, sf):
    """FASTQ written as text, read, cut to eight letters."""
    path = workspace(spark, "fastq")
    _letters(spark, sf).select(F.concat_ws("\n", F.concat(F.lit("@r"), "key"), "seq", F.lit("+"), F.expr("repeat('I', length(seq))")).alias("value")).write.text(path)
    return sequences.trim_reads(sequences.read_fastq(spark, path), 8).select("id", "seq", F.length("quality").alias("n_quality"))


_RES = lambda t, c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " ELSE 0 END"


@query(f"""WITH {_PN}, r AS (SELECT p_partkey, seq, unnest(string_split(seq, '')) AS c, unnest(range(1, length(seq) + 1)) AS i FROM pn WHERE seq <> ''),
g AS (SELECT p_partkey, avg(CAST({_RES(S.HYDROPATHY, 'c')} AS DOUBLE)) AS gravy, avg(CASE WHEN c IN ('V', 'I', 'Y', 'F', 'W', 'L') THEN 1.0 ELSE 0 END) AS helix, avg(CASE WHEN c IN ('N', 'P', 'G', 'S') THEN 1.0 ELSE 0 END) AS turn, avg(CASE WHEN c IN ('E', 'M', 'A', 'L') THEN 1.0 ELSE 0 END) AS sheet,
CASE WHEN count(*) >= 9 THEN sum(CAST({_RES(S.FLEXIBILITY, 'c')} AS DOUBLE) * (1.25 - abs(i - 5) * 0.1875 - 0.25)) FILTER (WHERE i <= 9) / 5.25 END AS flexibility FROM r GROUP BY p_partkey)
SELECT p_partkey AS key, round(gravy, 6) AS gravy, round(helix, 6) AS helix, round(turn, 6) AS turn, round(sheet, 6) AS sheet, round(flexibility, 6) AS flexibility FROM g""")
def protein_properties(spark, sf):
    d = _letters(spark, sf)
    x = S.fractions(F.col("seq"))
    return d.where("seq <> ''").select("key", F.round(S.gravy(F.col("seq")), 6).alias("gravy"), *[F.round(v, 6).alias(k) for k, v in x.items()], F.round(F.try_element_at(S.flexibility(F.col("seq")), F.lit(1)), 6).alias("flexibility"))


@query(f"WITH {_RD}, {_OF}, t AS (SELECT CAST(rname AS VARCHAR) AS chr, CAST(block_start + o AS INT) AS start, count(*) AS n FROM rd JOIN ofs USING (length) WHERE flag & 16 = 0 GROUP BY ALL) SELECT chr, start, CAST(n AS DOUBLE) AS value FROM t")
def wig_files(spark, sf):
    path = workspace(spark, "wig")
    sinks.write_wig(R.genome_track(_reads(spark, sf), _read_offsets(spark, sf)).where("strand = '+'").withColumn("rpm", F.col("density").cast("double")), path)
    return tables.read_wig(spark, path)


_MODELS = "m AS (SELECT 't' || p_partkey AS name, 'g' || p_partkey % 50 AS name2, p_partkey % 2 = 0 AS plus, CAST(p_size AS INT) AS s FROM part)"


@query(f"WITH {_MODELS}, l AS (SELECT *, CASE WHEN plus THEN 50 ELSE 30 END AS u5, 50 + s AS c, CASE WHEN plus THEN 30 ELSE 50 END AS u3 FROM m) SELECT name, name2, u5 AS utr5_length, c AS cds_length, u3 AS utr3_length, row_number() OVER (PARTITION BY name2 ORDER BY c DESC, s DESC, u5 DESC, u3 DESC, name) = 1 AS rep_transcript FROM l")
def genepred_files(spark, sf):
    """Gene predictions of two exons: region lengths and the representative."""
    path = workspace(spark, "genepred")
    k, s = F.col("p_partkey"), F.col("p_size").cast("int")
    text = F.concat_ws("\t", F.concat(F.lit("t"), k), F.lit("chr1"), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("100"), 330 + s, F.lit("150"), 300 + s, F.lit("2"), F.lit("100,300,"), F.concat(F.lit("200,"), 330 + s, F.lit(",")), F.lit("0"), F.concat(F.lit("g"), k % 50), F.lit("cmpl"), F.lit("cmpl"), F.lit("0,0,"))
    table(spark, sf, "part").select(text.alias("value")).write.text(path)
    d = sequences.representative(sequences.region_lengths(sequences.read_genepred(spark, path)))
    return d.select("name", "name2", "utr5_length", "cds_length", "utr3_length", "rep_transcript")


@query(f"WITH {_MODELS} SELECT name, name2, 99 AS \"txStart\", 500 + s AS \"txEnd\", 150 AS \"cdsStart\", 303 + s AS \"cdsEnd\", 2 AS exons FROM m")
def gff_files(spark, sf):
    """Parents and identifiers of GFF3; the stop codon joins the CDS."""
    path = workspace(spark, "gff")
    k, s = F.col("p_partkey"), F.col("p_size").cast("int")
    lines = [("mRNA", F.lit(100), 500 + s), ("exon", F.lit(100), F.lit(200)), ("exon", F.lit(301), 500 + s), ("CDS", F.lit(151), F.lit(200)), ("CDS", F.lit(301), 300 + s), ("stop_codon", 301 + s, 303 + s)]
    parent = F.concat(F.lit("Parent=t"), k)
    text = [F.concat_ws("\t", F.lit("chr1"), F.lit("x"), F.lit(f), a, b, F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=t"), k, F.lit(";Parent=g"), k % 50) if f == "mRNA" else parent) for f, a, b in lines]
    table(spark, sf, "part").select(F.explode(F.array(*text)).alias("value")).write.text(path)
    return sequences.transcripts(sequences.read_gtf(spark, path)).select("name", "name2", "txStart", "txEnd", "cdsStart", "cdsEnd", F.size("exonStarts").alias("exons"))


@query(f"WITH {_MODELS} SELECT name, name2, CASE WHEN plus THEN '+' ELSE '-' END AS strand, 100 AS \"txStart\", 330 + s AS \"txEnd\", CASE WHEN s > 10 THEN 150 ELSE 330 + s END AS \"cdsStart\", CASE WHEN s > 10 THEN 300 + s ELSE 330 + s END AS \"cdsEnd\", 2 AS exons FROM m")
def gtf_files(spark, sf):
    """Gene models written as GTF with transcripts and CDS, and read back; models
    without CDS have it empty at their end."""
    path = workspace(spark, "gtf")
    k, s = F.col("p_partkey"), F.col("p_size").cast("int")
    a, b = F.when(s > 10, F.lit(150)).otherwise(330 + s), F.when(s > 10, 300 + s).otherwise(330 + s)
    m = table(spark, sf, "part").select(F.concat(F.lit("t"), k).alias("name"), F.concat(F.lit("g"), k % 50).alias("name2"), F.lit("chr1").alias("chrom"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(100).alias("txStart"), (330 + s).alias("txEnd"), a.alias("cdsStart"), b.alias("cdsEnd"), F.array(F.lit(100), F.lit(300)).alias("exonStarts"), F.array(F.lit(200), 330 + s).alias("exonEnds"))
    sequences.gene_models_to_gtf(m, full=True).write.text(path)
    return sequences.transcripts(sequences.read_gtf(spark, path)).select("name", "name2", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd", F.size("exonStarts").alias("exons"))


@query("SELECT 'o' || p_partkey AS orf, CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 97 END AS first_start, CASE WHEN p_partkey % 2 = 0 THEN 503 + p_size ELSE 500 + p_size END AS last_end, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_size % 3 END AS frame0, CASE WHEN p_partkey % 2 = 0 THEN 31 % 3 ELSE 0 END AS frame1 FROM part")
def orf_places(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("o"), "p_partkey").alias("orf"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.array(F.struct(F.lit(100).alias("start"), F.lit(131).alias("end")), F.struct(F.lit(500).alias("start"), (500 + F.col("p_size").cast("int")).alias("end"))).alias("exons"), (31 + F.col("p_size")).alias("length"))
    d = tables.with_stop(p)
    return d.select("orf", F.col("exons")[0]["start"].alias("first_start"), F.col("exons")[1]["end"].alias("last_end"), F.col("frames")[0].alias("frame0"), F.col("frames")[1].alias("frame1"))


@query("SELECT CAST(l_linenumber AS INT) AS length, l_linestatus AS site, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS five, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS three FROM lineitem GROUP BY ALL")
def offset_detail_files(spark, sf):
    """Offset matrices per site and end, written, read and laid side by side."""
    root, paths = workspace(spark, "offsets"), []
    d = table(spark, sf, "lineitem")
    for site, status in (("tis", "F"), ("tts", "O")):
        for end, flag in (("5end", "R"), ("3end", "A")):
            paths.append(f"{root}/s_{site}_{end}")
            g = d.where(F.col("l_linestatus") == status).groupBy(F.col("l_linenumber").alias("length")).agg(F.count_if(F.col("l_returnflag") == flag).alias("-12"))
            sinks.write_tsv(g, paths[-1])
    e = tables.offset_ends(tables.read_offset_detail(spark, paths), [-12])
    return e.select("length", F.when(F.col("site") == "tis", "F").otherwise("O").alias("site"), F.col("5p_-12").alias("five"), F.col("3p_-12").alias("three"))


# -- ingest -----------------------------------------------------------------------


def _wide(spark, sf):
    """A wide density table of both samples; every position holds counts of one."""
    return D.long_to_wide(line_density(spark, sf).withColumn("now_nt", F.col("pos")), ["F", "O"])


_LONG = f"{LN}, lg AS (SELECT name, pos AS now_nt, from_tis, from_tts, region, codon, s AS sample, CASE WHEN sample = s THEN f0 + f1 + f2 ELSE 0 END AS v FROM ln, (SELECT unnest(['F', 'O']) AS s) WHERE NOT contains(codon, 'N'))"
_KEPT = "kp AS (SELECT name, now_nt, sample, coalesce(lag(v) OVER (PARTITION BY name, sample ORDER BY now_nt), 0) AS x FROM lg WHERE from_tis >= 1 AND from_tts <= -1)"


@query(f"WITH {_LONG}, {_KEPT}, e AS (SELECT name FROM kp GROUP BY name HAVING sum(x) / 2 >= 40) SELECT name, now_nt, sample, CAST(x AS BIGINT) AS x FROM kp WHERE name IN (SELECT name FROM e)")
def ingest_rows(spark, sf):
    d = D.ingest(_wide(spark, sf), site="A", minimum=40, tis=1, tts=1)
    return d.rows.select("name", "now_nt", "sample", "x")


@query(f"WITH {_LONG.split(', lg AS')[0]} SELECT sample, CAST(sum(f0 + f1 + f2) AS BIGINT) AS total FROM ln GROUP BY sample")
def ingest_totals(spark, sf):
    return D.ingest(_wide(spark, sf), site="A", minimum=40, tis=1, tts=1).totals


@query(f"""WITH {_LONG}, {_KEPT}, listed AS (SELECT p_partkey AS name FROM part WHERE p_size % 2 = 0), a AS (SELECT * FROM kp WHERE name IN (SELECT name FROM listed)),
b0 AS (SELECT name, now_nt, CASE sample WHEN 'F' THEN 'x' ELSE 'y' END AS sample, v AS x FROM lg WHERE from_tis >= 1 AND from_tts <= -1 AND now_nt % 2 = 0 AND name IN (SELECT name FROM listed)),
ok AS (SELECT name FROM a GROUP BY name HAVING sum(x) / 2 >= 20 INTERSECT SELECT name FROM b0 GROUP BY name HAVING sum(x) / 2 >= 20),
u AS (SELECT 'ribo' AS assay, sample, name, x FROM a UNION ALL SELECT 'rna', sample, name, x FROM b0) SELECT assay, sample, name, CAST(sum(x) AS BIGINT) AS x FROM u WHERE name IN (SELECT name FROM ok) GROUP BY ALL""")
def ingest_both_assays(spark, sf):
    """Ribosome and RNA tables with a gene list; genes that both assays keep."""
    wide = _wide(spark, sf)
    rna = wide.where("now_nt % 2 = 0").withColumnsRenamed({f"{s}_f{k}": f"{t}_f{k}" for s, t in ("Fx", "Oy") for k in range(3)})
    listed = table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("transcript_id"))
    p = D.ingest_pair(wide, rna, genes=listed, site="A", minimum=20, tis=1, tts=1)
    each = [x.rows.groupBy("sample", "name").agg(F.sum("x").alias("x")).select(F.lit(n).alias("assay"), "sample", "name", "x") for n, x in (("ribo", p.ribo), ("rna", p.rna))]
    return each[0].union(each[1])


@query(f"WITH {LN}, t AS (SELECT sample, sum(f0 + f1 + f2) AS total, sum(f0 + f1 + f2) FILTER (WHERE region = 'cds') AS cds, (SELECT count(DISTINCT name) FROM ln) AS genes FROM ln GROUP BY sample) SELECT sample, CASE sample WHEN 'F' THEN 'control' ELSE 'pulldown' END AS side, CAST(total AS BIGINT) AS total, round(cds * 1e6 / (total * genes * 30.0), 6) AS mean_rpm FROM t")
def pulldown_background(spark, sf):
    return K.pulldown_table(_wide(spark, sf), ["F"], ["O"], background=30.0)[1].select("sample", "side", "total", *r6("mean_rpm"))


@query(f"WITH {LN} SELECT name, pos, from_tis, region, CAST(CASE sample WHEN 'F' THEN f0 + f1 + f2 ELSE 0 END AS BIGINT) AS \"F\", CAST(CASE sample WHEN 'O' THEN f0 + f1 + f2 ELSE 0 END AS BIGINT) AS \"O\" FROM ln")
def pulldown_rows(spark, sf):
    return K.pulldown_table(_wide(spark, sf), ["F"], ["O"])[0]


@query(f"WITH {EV}, i AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY name ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS fresh FROM ev WHERE x > 60), k AS (SELECT *, sum(fresh) OVER (PARTITION BY name ORDER BY pos) AS island FROM i) SELECT CAST(name AS VARCHAR) AS chrom, CAST(min(pos) - 1 AS INT) AS start, CAST(max(pos) AS INT) AS \"end\", name || '_' || min(pos) AS label, round(max(x), 4) AS score FROM k GROUP BY name, island")
def peak_bed_files(spark, sf):
    """Peaks as BED text, read back."""
    path = workspace(spark, "bed")
    K.write_bed(K.summarise(K.islands(ev(spark, sf).where("x > 60"), 2), "x"), path)
    return spark.read.csv(path, sep="\t", schema="chrom string, start int, end int, label string, score double")
