"""Sequence functions, statistics and codon tables on hand-worked cases."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripletlab.functions import codons, sequence, stats


def one(spark, column, **values):
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return d.select(column.alias("x")).first()[0]


def test_code_table(spark):
    d = codons.codon_dimension(spark)
    assert d.count() == 64 and d.where("aa = '*'").count() == 3
    assert codons.CODE["ATG"] == "M" and codons.CODE["TGG"] == "W" and codons.CODE["GGA"] == "G" and codons.CODE["TGA"] == "*"


def test_revcomp_and_translate(spark):
    assert one(spark, sequence.revcomp(F.col("s")), s="ACGTN") == "NACGT"
    assert one(spark, sequence.translate_nt(F.col("s")), s="ATGGCTTAA") == "MA*"
    assert one(spark, sequence.translate_nt(F.col("s")), s="ATGGC") is None
    assert one(spark, sequence.translate_nt(F.col("s"), start=True), s="GTGGCT") is None
    assert one(spark, sequence.translate_nt(F.col("s"), stop=True), s="ATGGCT") is None


def test_revcomp_twice_is_the_same(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.text("ACGTacgtN", max_size=30))
    def check(s):
        assert one(spark, sequence.revcomp(sequence.revcomp(F.col("s"))), s=s) == s

    check()


def test_kmers(spark):
    assert one(spark, sequence.kmers(F.col("s"), 3), s="abcde") == ["abc", "bcd", "cde"]
    assert one(spark, sequence.kmers(F.col("s"), 9), s="abc") == ["abc"]


def test_splice(spark):
    d = spark.createDataFrame([("AACCGGTT", [0, 4], [2, 6], "+"), ("AACCGGTT", [0, 4], [2, 6], "-")], "seq string, a array<int>, b array<int>, strand string")
    got = [r[0] for r in d.select(sequence.splice(F.col("seq"), F.col("a"), F.col("b"), F.col("strand"))).collect()]
    assert got == ["AAGG", "CCTT"]


def test_protein_properties(spark):
    assert one(spark, sequence.gravy(F.col("p")), p="AR") == pytest.approx(-1.35)
    assert one(spark, sequence.isoelectric_point(F.col("p")), p="KKKK") > 10
    assert one(spark, sequence.isoelectric_point(F.col("p")), p="DDDD") < 4
    f = sequence.fractions(F.col("p"))
    assert one(spark, f["helix"], p="VIAA") == 0.5


def test_random_sequence_repeats(spark):
    d = spark.range(3).select(sequence.random_sequence(F.lit(20), F.col("id")).alias("s"))
    assert [r.s for r in d.collect()] == [r.s for r in d.collect()] and len(d.first().s) == 20


def test_phred(spark):
    d = spark.createDataFrame([("!!II",), ("##II",)], "q string")
    assert sequence.phred_offset(d, "q").first().encoding == "phred33"


def test_tails(spark):
    assert one(spark, stats.norm_cdf(F.col("x")), x=1.959963984540054) == pytest.approx(0.975)
    assert one(spark, stats.t_two_sided(F.col("t"), F.col("n")), t=2.228138851964939, n=10.0) == pytest.approx(0.05, abs=1e-9)
    assert stats.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)
    assert one(spark, stats.z_tail(F.col("x")), x=0.0) == pytest.approx(1.0)


def test_bh(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5)], "i int, p double")
    got = {r.i: r.bh for r in stats.bh_adjust(d, "p", ["i"]).collect()}
    assert got == pytest.approx({1: 0.04, 2: 0.04, 3: 0.04, 4: 0.5})


def test_group_tests(spark):
    rows = [("g", "a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("g", "b", v) for v in (3.0, 4.0, 5.0, 6.0)]
    d = spark.createDataFrame(rows, "name string, side string, v double")
    t = stats.t_test(d, ["name"], "side", "v", ("a", "b")).first()
    assert t.t == pytest.approx(-2.1908902) and t.p == pytest.approx(0.0709877, abs=1e-6)
    assert stats.ks_test(d, ["name"], "side", "v", ("a", "b")).first().d == pytest.approx(0.5)
    r = stats.rank_sum(d, ["name"], "side", "v", ("a", "b")).first()
    assert r.s == 12.0 and r.z == pytest.approx((12 - 18) / math.sqrt(12))


def test_scales_and_fit(spark):
    d = spark.createDataFrame([(2.0,), (4.0,), (8.0,)], "x double")
    assert sorted(r.y for r in stats.scaled(d, "x", "minmax", [], "y").collect()) == [0.25, 0.5, 1.0]
    pts = spark.createDataFrame([(float(m), math.sqrt(2) * math.log2(3.0 / m + 1.2)) for m in range(1, 80)], "m double, c double")
    a, b = stats.fit_log_curve(pts, "m", "c")
    assert a == pytest.approx(1.2, abs=1e-3) and b == pytest.approx(3.0, abs=1e-2)


def test_beta_of_arrays():
    r = np.random.default_rng(1)
    a, x = np.concatenate([r.integers(1, 400, 500) / 2, [1, 2, 3]]), np.concatenate([r.random(500) ** r.integers(1, 9, 500), [0.0, 1.0, 1.5]])
    assert stats.beta_incs(a, 0.5, x).tolist() == pytest.approx([stats.beta_inc(p, 0.5, q) for p, q in zip(a.tolist(), x.tolist())], rel=1e-12, abs=1e-15)
    assert len(stats.beta_incs(a[:0], 0.5, x[:0])) == 0
