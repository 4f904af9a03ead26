"""Operators on small frames whose results are worked by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tripletlab.operators import compare, density, peaks, profiles, reads, tracks


def gene(spark, xs, name="g"):
    return spark.createDataFrame([(name, i + 1, float(x)) for i, x in enumerate(xs)], "name string, pos long, x double")


def col(df, c, order="pos"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_site_shift(spark):
    d = gene(spark, [7, 5, 4, 2])
    assert col(density.shift_site(d, "A"), "shifted") == [0, 7, 5, 4]
    assert col(density.shift_site(d, "E"), "shifted") == [5, 4, 2, 0]
    assert col(density.shift_site(d, "P"), "shifted") == [7, 5, 4, 2]


def test_cumulative_cov(spark):
    got = col(profiles.cumulative_cov(gene(spark, [4, 5, 10])), "cov")
    assert got[0] is None and got[1:] == pytest.approx([0.157135, 0.507561], abs=1e-6)


def test_background(spark):
    assert col(profiles.pausing_background(gene(spark, [3, 0, 6]), 1), "pause") == [1, 0, 3]
    assert col(profiles.pausing_background(gene(spark, [3, 0, 6]), 1, centered=True), "pause") == [3, 0, 3]


def test_bins(spark):
    d = spark.range(10).select("id", profiles.equal_bins(F.col("id"), F.lit(0), F.lit(9), 5).alias("b"))
    assert col(d, "b", "id") == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_position_arithmetic(spark):
    a = spark.createDataFrame([("t", 4, 6, 4)], "name string, utr5_length int, cds_length int, utr3_length int")
    g = density.codon_grid(a).orderBy("now_nt").collect()
    assert [(r.now_nt, r.from_tis, r.from_tts, r.region) for r in g] == [(2, -1, -2, "5utr"), (5, 0, -1, "cds"), (8, 1, 0, "cds"), (11, 2, 1, "3utr")]
    seq = spark.createDataFrame([("t", "AATGCCCTAAGGGT")], "name string, seq string")
    hits = spark.createDataFrame([("t", 5, 3), ("t", 7, 2)], "name string, nt long, n long")
    d = density.format_density(a, seq, hits).where("now_nt = 5").first()
    assert (d.codon, d.f0, d.f1, d.f2) == ("CCC", 3, 0, 2)


def test_melt(spark):
    d = spark.createDataFrame([("g", 1, "ATG", 10, 3, 2)], "name string, pos long, codon string, f0 long, f1 long, f2 long")
    got = density.melt_nucleotides(d).orderBy("nt").collect()
    assert [(r.nt, r.base, r.n) for r in got] == [(1, "A", 10), (2, "T", 3), (3, "G", 2)]


def test_ingest_chain(spark):
    rows = [("a", 1, 0, -1, "cds", "atg", 1, 0, 0, 5, 5, 5), ("a", 4, 1, 0, "cds", "CCC", 2, 1, 0, 0, 0, 1), ("b", 1, 0, 0, "cds", "NNA", 9, 9, 9, 9, 9, 9), ("c", 1, 0, 0, "cds", "CCC", 0, 0, 0, 0, 0, 1)]
    wide = spark.createDataFrame(rows, "name string, now_nt int, from_tis int, from_tts int, region string, codon string, s1_f0 long, s1_f1 long, s1_f2 long, s2_f0 long, s2_f1 long, s2_f2 long")
    got = density.ingest(wide, minimum=5)
    assert got.samples == ["s1", "s2"]
    assert {r.sample: r.total for r in got.totals.collect()} == {"s1": 31, "s2": 44}
    assert {(r.name, r.now_nt, r.sample, r.x) for r in got.rows.collect()} == {("a", 1, "s1", 1), ("a", 4, "s1", 3), ("a", 1, "s2", 15), ("a", 4, "s2", 1)}
    listed = density.ingest(wide, genes=spark.createDataFrame([("c",)], "transcript_id string"))
    assert {r.name for r in listed.rows.collect()} == {"c"}
    back = density.long_to_wide(density.wide_to_long(wide), ["s1", "s2"])
    assert sorted(map(tuple, back.select(*wide.columns).collect())) == sorted(rows)
    with pytest.raises(ValueError):
        density.require_rows(wide.where("false"), "density")


def test_invariants(spark):
    d = spark.createDataFrame([(f"g{i % 5}", i, "cds" if i % 3 else "5utr", "s", i % 7, i % 4, i % 3, "ACG"[i % 3]) for i in range(60)], "name string, pos long, region string, sample string, f0 long, f1 long, f2 long, codon string")
    q = profiles.region_quant(density.frame(d))
    for r in q.groupBy("region").agg(F.sum("tpm").alias("t")).collect():
        assert r.t == pytest.approx(1e6)
    assert profiles.periodicity(d).agg(F.sum("ratio")).first()[0] == pytest.approx(100)
    s = reads.shuffle_counts(d, "f0")
    for c in ("f0", "shuffled"):
        assert sorted((r.name, r[c]) for r in s.collect()) == sorted((r.name, r.f0) for r in d.collect())


def test_windows_and_motifs(spark):
    d = spark.createDataFrame([("g", i + 1, c, float(i)) for i, c in enumerate("ABABBAB")], "name string, pos long, codon string, x double")
    w = profiles.windows_around(d, F.col("codon") == "A", 1)
    assert {(r.site, r.offset, r.value) for r in w.collect()} == {(3, -1, 1.0), (3, 0, 2.0), (3, 1, 3.0), (6, -1, 4.0), (6, 0, 5.0), (6, 1, 6.0)}
    assert {r.site for r in profiles.windows_around(d, F.col("codon") == "B", 1, unique=True).collect()} == {2}
    assert [r.m for r in d.withColumn("m", profiles.motif_match(["A", "B", "B"])).orderBy("pos").collect()] == [False, False, True, False, False, False, False]


def test_moving_mean_edges(spark):
    got = col(profiles.moving_mean(gene(spark, [5, 0, 0, 0, 10]), 1), "smooth")
    assert got == pytest.approx([10 / 3, 5 / 3, 0, 10 / 3, 20 / 3])


def test_islands_and_chain(spark):
    d = gene(spark, range(20)).where("pos in (1, 2, 3, 6, 7, 12)")
    i = peaks.islands(d, 2)
    assert col(i, "island") == [1, 1, 1, 2, 2, 3]
    s = peaks.summarise(i, "x")
    top = s.where("island = 1").first()
    assert (top.start, top.end, top.covered, top.max_pos) == (1, 3, 3, 3)
    chain = peaks.best_chain(s, width=5, share=0.7, gap=1).collect()
    assert [(r.start, r.end, r.covered) for r in chain] == [(1, 7, 5)]


def plain_chains(rows, width, share, gap):
    """All chains of allowed stretches, the most covered positions of any."""
    fits = {}
    for i in range(len(rows)):
        for j in range(i, len(rows)):
            if j > i and rows[j][0] - rows[j - 1][1] > gap * width:
                break
            long, covered = rows[j][1] - rows[i][0] + 1, sum(r[2] for r in rows[i : j + 1])
            if long >= width and covered >= share * long:
                fits[i, j] = covered
    most = lambda i: 0 if i >= len(rows) else max([most(i + 1)] + [fits[i, j] + most(j + 1) for j in range(i, len(rows)) if (i, j) in fits])
    return most(0), fits


def test_chain_is_the_best_of_all():
    for seed in range(300):
        r, rows, x = random.Random(seed), [], 0
        for _ in range(r.randint(0, 8)):
            x += r.randint(1, 9)
            e = x + r.randint(0, 5)
            rows.append((x, e, r.randint(1, e - x + 1)))
            x = e + 1
        for share in (0.5, 0.75, 1.0):
            width, gap = r.randint(1, 8), r.randint(0, 3)
            got = peaks.chain(rows, width, share, gap)
            best, fits = plain_chains(rows, width, share, gap)
            assert sum(g[2] for g in got) == best
            at = [([r[0] for r in rows].index(s), [r[1] for r in rows].index(e)) for s, e, _ in got]
            assert all(fits[a] == g[2] for a, g in zip(at, got)) and all(a[1] < b[0] for a, b in zip(at, at[1:]))


def test_chain_of_a_very_long_gene():
    rows = [(3 * i, 3 * i + 1, 2) for i in range(200_000)]
    got = peaks.chain(rows, 5, 0.6, 2)  # splits cover as much as the whole, so short stretches stay
    assert sum(g[2] for g in got) == 400_000 and max(e - s + 1 for s, e, _ in got) <= 8
    assert peaks.chain(rows, 5, 0.9, 2) == []


def test_chains_take_no_call_per_gene(spark):
    r, rows = random.Random(5), []
    for g in range(300):
        x = 0
        for _ in range(r.randint(1, 40 if g else 4000)):  # runs end within batches, at their ends, and go over several
            x += r.randint(1, 14 if g else 6)
            e = x + r.randint(0, 7)
            rows.append((f"g{g}" if g % 50 else None if g else "long", x, e, r.randint(1, e - x + 1)))
            x = e + 1
    d = spark.createDataFrame(r.sample(rows, len(rows)), "name string, start long, end long, covered long")
    best = peaks.best_chain(d, width=5, share=0.6, gap=2)
    assert "FlatMapGroups" not in best._jdf.queryExecution().executedPlan().toString()
    by = {}
    for n, *x in rows:
        by.setdefault(n, []).append(tuple(x))
    del by[None]  # several genes in one
    want = sorted((n, *c) for n, v in by.items() for c in peaks.chain(v, 5, 0.6, 2))
    for size in ("7", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert sorted(tuple(x) for x in best.where("name IS NOT NULL").collect()) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert best.where("false").count() == 0


def test_parts_grow_with_the_input(spark, tmp_path):
    from tripletlab.functions.tables import dealt
    from tripletlab.plans import catalogue

    spark.range(20_000).selectExpr("id % 500 AS name", "id AS x").coalesce(1).write.parquet(f"{tmp_path}/t")
    d = spark.read.parquet(f"{tmp_path}/t")
    mb = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) / 1e6
    few, many = (dealt(d, "name", mb / k) for k in (9.5, 95))
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (10, 95)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, d.collect()))
    assert dealt(d, "name", mb) is d
    wide = catalogue._wide(spark, "/root/testdata/sf0.001")
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # windows and groups share it


def test_kept_genes_are_not_computed_twice(spark):
    d = spark.createDataFrame([("a", "s", 5), ("a", "t", 3), ("b", "s", 7), (None, "s", 99)], "name string, sample string, x long")
    k = density.expressed(d, 4, n_samples=2)
    assert {tuple(r) for r in k.collect()} == {("a", "s", 5), ("a", "t", 3)} and k.columns == d.columns
    assert {tuple(r) for r in density.expressed(d, 4).collect()} == {("a", "s", 5), ("a", "t", 3), ("b", "s", 7)}
    assert "Join" not in k._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_assays(spark):
    wide = lambda *s: spark.createDataFrame([("a", 1, 0, -5, "cds", "ATG", *[2] * (3 * len(s)))], "name string, now_nt int, from_tis int, from_tts int, region string, codon string, " + ", ".join(f"{x}_f{k} int" for x in s for k in range(3)))
    p = density.ingest_pair(wide("r1", "r2"), wide("m1", "m2"))
    assert p.pairs == [("r1", "m1"), ("r2", "m2")] and p.ribo.rows.count() == 2
    with pytest.raises(ValueError):
        density.ingest_pair(wide("r1", "r2"), wide("m1"))
    assert density.ingest_pair(wide("r1", "r2"), wide("m1"), pairs=[("r1", "m1")]).pairs == [("r1", "m1")]
    given = spark.createDataFrame([("r1", 60), ("r2", 6)], "sample string, total int")
    per = {r["sample"]: r for r in peaks.pulldown_table(wide("r1", "r2"), ["r1"], ["r2"], given)[1].collect()}
    assert (per["r1"].side, per["r1"].mean_rpm, per["r2"].total) == ("control", 1e5, 6)


def test_edges_and_labels(spark):
    p = spark.createDataFrame([("g", 4, 5)], "name string, start long, end long")
    prof = spark.createDataFrame([("g", i, 0.0 if i in (1, 9) else 2.0, "cds" if i < 5 else "3utr") for i in range(1, 11)], "name string, pos long, smooth double, region string")
    e = peaks.extend_edges(p, prof, 1.0).first()
    assert (e.left, e.right) == (2, 8)
    a = peaks.annotate(p, prof).first()
    assert (a.start_region, a.end_region) == ("cds", "3utr")
    left = spark.createDataFrame([("g", 1, 200), ("g", 300, 310), ("h", 1, 2)], "name string, start long, end long")
    right = spark.createDataFrame([("g", 200, 250), ("h", 3, 4)], "name string, start long, end long")
    got = {(r.name, r.start): r.overlap for r in peaks.overlap_label(left, right, ["name"]).collect()}
    assert got == {("g", 1): True, ("g", 300): False, ("h", 1): False}


def test_gates_and_fill(spark):
    d = spark.createDataFrame([("g", i, i, 0.0 if i == 2 else 4.0, 1.0 if i < 30 else 9.0) for i in range(1, 40)], "name string, pos long, from_tis long, ck double, ip double")
    assert peaks.background_gate(d, ["ip"], 2.0).first().ok
    for mode, want in ((0, 4 * 38 / 39), (-1, 4 * 38 / 39), (4, 3.0)):
        assert peaks.fill_empty(d, "ck", mode).where("pos = 2").first().ck == pytest.approx(want)
    assert compare.replicate_gate(d.withColumn("ip2", F.col("ip") * 2), ["ip", "ip2"], 0.9).first().ok


def test_usage_and_adaptation(spark):
    c = spark.createDataFrame([("AAA", "K", 3), ("AAG", "K", 1), ("TGG", "W", 2)], "codon string, aa string, n long")
    u = {r.codon: r for r in profiles.codon_usage(c).collect()}
    assert u["AAA"].rscu == 1.5 and u["AAG"].weight == pytest.approx(1 / 3) and u["TGG"].optimal and not u["AAG"].optimal
    genes = spark.createDataFrame([("g", "AAA"), ("g", "AAG")], "name string, codon string")
    assert profiles.adaptation_index(genes, profiles.codon_usage(c)).first().cai == pytest.approx((1 / 3) ** 0.5)


def test_efficiency_and_counts(spark):
    te = spark.createDataFrame([("g", 4.0, 4.4, 2.0, 2.2)], "name string, a double, b double, c double, d double")
    r = compare.efficiency_change(te, ["a", "b"], ["c", "d"]).first()
    assert r.fold == pytest.approx(2.0) and r.log2_fold == pytest.approx(1.0) and 0 < r.p < 0.05
    counts = spark.createDataFrame([(f"g{i}", s, (10 + i) * k * (8 if i == 0 and s in "cd" else 1)) for i in range(30) for s, k in zip("abcd", (1, 2, 1, 2))], "name string, sample string, x long")
    f = {r.sample: r.size_factor for r in compare.size_factors(counts).collect()}
    assert f["b"] / f["a"] == pytest.approx(2.0)
    groups = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "t"), ("d", "t")], "sample string, group string")
    factors = compare.size_factors(counts)
    got = compare.count_test(counts, factors, groups, ("u", "t")).orderBy("p").collect()
    assert got[0].name == "g0" and got[0].log2_fold == pytest.approx(3, abs=0.4)


def test_matrices(spark):
    wide = spark.createDataFrame([(1.0, 2.0, 9.0), (2.0, 4.0, 3.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    r = {(x.a, x.b): x.r for x in compare.correlations(wide, ["a", "b", "c"]).collect()}
    assert r[("a", "b")] == pytest.approx(1.0)
    assert len(compare.principal_components(wide, ["a", "b", "c"])) == 3
    import numpy as np

    assert compare.ward_order(["x", "y", "z"], np.array([[0.0], [10.0], [0.1]])) in (["y", "x", "z"], ["x", "z", "y"])


def read_rows(spark, rows):
    return spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, mapq int, length int, block_start int, block_end int, tags map<string,string>")


def test_reads(spark):
    rows = [("r1", 0, "t", 2, 30, 30, 2, 32, {"NH": "1"}), ("r2", 16, "t", 2, 30, 30, 2, 32, {"NH": "3"}), ("r3", 256, "t", 5, 30, 28, 5, 33, {}), ("r4", 4, "*", -1, 0, 30, -1, -1, {})]
    d = read_rows(spark, rows)
    assert {r.qname for r in reads.filter_reads(d, 10).collect()} == {"r1", "r2"}
    assert {r.qname for r in reads.unique_reads(d).collect()} == {"r1"}
    h = {r.length: (r.plus, r.minus) for r in reads.length_by_strand(d.where("pos >= 0")).collect()}
    assert h == {30: (1, 1), 28: (1, 0)}
    off = spark.createDataFrame([(30, [12]), (28, [-1])], "length int, p_site array<int>")
    hits = {r.nt: r.n for r in reads.psite_hits(d.where("flag <> 16"), off).collect()}
    assert hits[15] == 2 and sum(hits.values()) == 1 + 28
    ann = spark.createDataFrame([("t", 14, 30, 9)], "name string, utr5_length int, cds_length int, utr3_length int")
    e = {(r.site, r.end, r.offset) for r in reads.end_offsets(d.where("flag = 0"), ann).collect()}
    assert e == {("tis", "5end", 12), ("tis", "3end", 17)}
    f = reads.frame_offsets(d.where("flag = 0"), ann).first()
    assert f.p_site == 13 and f.periodicity == 100.0
    t = {(r.strand, r.start): r.density for r in reads.genome_track(d.where("length = 30 AND pos >= 0"), off).collect()}
    assert t == {("+", 14): 1, ("-", 19): -1}
    assert reads.ribosome_class(reads.length_by_strand(d.where("pos >= 0"))).first().kind == "monosome"
    assert reads.smooth_offsets([(28, 12), (29, 9), (30, 12)], 30) == {28: 12, 29: 12, 30: 12}


def test_saturation(spark):
    d = spark.range(5000).select("id", (F.col("id") % 97).alias("g"))
    got = [r.genes for r in reads.saturation(d, "id", "g").orderBy("step").collect()]
    assert got == sorted(got) and got[-1] <= 97 and len(got) == 9


def test_tracks(spark):
    d = spark.createDataFrame([("c", 5, 4.0), ("c", 9, 2.0)], "chr string, pos long, x double")
    got = {r.pos: r.x for r in tracks.smooth(d, [0.25, 0.5, 0.25], ["chr"], "pos", "x").collect()}
    assert got == {4: 1.0, 5: 2.0, 6: 1.0, 8: 0.5, 9: 1.0, 10: 0.5}
    assert tracks.polynomial_weights(5, 2) == pytest.approx([-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35])
    assert sum(tracks.gaussian_weights(2.0)) == pytest.approx(1.0)
    codons = spark.createDataFrame([("g", i + 1, c) for i, c in enumerate(["ATG", "GCT", "AAA", "TAA"])], "name string, pos long, codon string")
    peak = spark.createDataFrame([("g", 2, 2)], "name string, start long, end long")
    r = tracks.peak_sequences(peak, codons, 1).first()
    assert (r.seq, r.protein) == ("ATGGCTAAA", "MAK")
    seqs = spark.createDataFrame([("a", "AC"), ("b", "GG")], "id string, seq string")
    found, missing = tracks.lookup(seqs, spark.createDataFrame([(">a",), ("z",)], "x string"))
    assert [x.id for x in found.collect()] == ["a"] and [x.id for x in missing.collect()] == ["z"]
    m = spark.createDataFrame([("g", 0, 1.0), ("g", 1, 2.0)], "name string, bin int, m double")
    assert tracks.bin_matrix(m, 2).first()["1"] == 2.0


def test_psites_move_by_codons():
    from tripletlab.operators.reads import into_range

    def slow(sites):
        out = {}
        for n, (length, v) in enumerate(sorted(sites)):
            while v is not None and (v < 7 or v > 19):
                last = out.get(length - 1)
                if n == 0:
                    v += 3 if v < 7 else -3
                elif last is not None and last + 2 < v and v > 19:
                    v -= 3
                elif last is not None and v < last - 2 and v < 7:
                    v += 3
                else:
                    v = None
            out[length] = v
        return out

    for a in range(1, 30):
        for b in range(1, 30):
            sites = [(27, a), (28, b), (29, 6), (30, 22), (32, 4)]
            assert into_range(sites) == slow(sites)
    assert into_range([(28, 12), (29, 25)]) == {28: 12, 29: 19}
    assert into_range([(28, 8), (29, 6)]) == {28: 8, 29: None}
    assert into_range([]) == {}


def test_pair_of_groups(spark):
    from tripletlab.operators import compare

    rows = [(f"g{g}", f"s{s}", float(50 * (g + 1) * (4 if g == 0 and s > 2 else 1) + s)) for g in range(6) for s in range(1, 6)] + [("low", "s1", 1.0)]
    counts = spark.createDataFrame(rows, "name string, sample string, x double")
    design = spark.createDataFrame([("s1", "A"), ("s2", "B"), ("s3", "C"), ("s4", "C"), ("s5", "Z")], "sample string, `group` string")
    got = {r["name"]: r for r in compare.pair_test(counts, design, "A+B_vs_C", 10).collect()}
    assert set(got) == {f"g{g}" for g in range(6)}
    assert set(got["g1"]["counts"]) == {"s1", "s2", "s3", "s4"} and got["g1"]["counts"]["s3"] == 103.0
    assert got["g0"]["log2_fold"] > 1.5 and abs(got["g3"]["log2_fold"]) < 0.3
    assert min(got.values(), key=lambda r: r["p"])["name"] == "g0"


def test_flexibility_of_a_window():
    from tripletlab.functions.sequence import FLEXIBILITY, FLEXIBILITY_WEIGHTS

    assert len(FLEXIBILITY) == 20 and sum(FLEXIBILITY_WEIGHTS) == 5.25
