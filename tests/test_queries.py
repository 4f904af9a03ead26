"""Every registered query against its SQL on the smallest tables, and plan shapes."""

import glob
import math

import duckdb
import pytest

from tripletlab.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") and hasattr(v, "hour") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in got.select(*sorted(got.columns)).collect()]
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    want = con.execute(catalogue.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert sorted(map(str, rows)) == sorted(str(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["total_counts", "frame_projection", "periodicity", "codon_usage_rscu", "shift_site_a", "pausing_forward_background", "gap_islands", "interval_overlap_label", "suffix_prefix_overlap", "melt_nt", "composition", "kmers", "translate"])
def test_plans_stay_native(spark, name):
    p = plan(catalogue.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "Python" not in p and "ArrowEval" not in p
    assert name in ("codon_usage_rscu",) or "BroadcastNestedLoopJoin" not in p


def test_columns_are_pruned(spark):
    p = plan(catalogue.QUERIES["total_counts"](spark, SF))
    assert "l_linestatus" in p and "ReadSchema" in p and "l_shipdate" not in p.split("ReadSchema")[1].split("\n")[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
