"""Views of the driver's tables in the shape of density tables, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripletlab.functions.tables import dealt

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _regions(df: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("name"))
    df = df.withColumn("_n", n)
    df = df.withColumns({"from_tis": F.col("pos") - 1 - F.expr("(_n + 4) div 5"), "from_tts": F.col("pos") - F.expr("(4 * _n) div 5")}).drop("_n")
    return df.withColumn("region", F.when(F.col("from_tis") < 0, "5utr").when(F.col("from_tts") > 0, "3utr").otherwise("cds"))


def _ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key`` as name, and pos = rank within it.  The name comes before the deal, so
    that all windows and groups by name after it stay in its parts."""
    w = Window.partitionBy("name").orderBy(*order)
    return dealt(df.withColumnRenamed(key, "name"), "name").withColumn("pos", F.row_number().over(w).cast("long"))


def events_density(spark: SparkSession, sf: str) -> DataFrame:
    """name = user, pos = rank in time, codon = event type, x = value."""
    d = _ranked(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("name", "pos", F.col("event_type").alias("codon"), F.col("value").alias("x"))
    return _regions(d)


def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """name = part, sample = line status, codon, and three integer frames; no
    positions, so that aggregates need no window."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("name"), F.col("l_linestatus").alias("sample"), F.concat("l_returnflag", "l_linestatus").alias("codon"),
        F.col("l_quantity").cast("long").alias("f0"), F.round(F.col("l_discount") * 100).cast("long").alias("f1"), F.round(F.col("l_tax") * 100).cast("long").alias("f2"),
    )


def line_density(spark: SparkSession, sf: str) -> DataFrame:
    d = _ranked(table(spark, sf, "lineitem"), "l_partkey", LINE_ORDER).select(
        "name", "pos", F.col("l_linestatus").alias("sample"), F.concat("l_returnflag", "l_linestatus").alias("codon"),
        F.col("l_quantity").cast("long").alias("f0"), F.round(F.col("l_discount") * 100).cast("long").alias("f1"), F.round(F.col("l_tax") * 100).cast("long").alias("f2"),
    )
    return _regions(d)


EV = """ev0 AS (SELECT user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS codon, value AS x FROM events),
ev1 AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM ev0),
ev2 AS (SELECT name, pos, codon, x, pos - 1 - (n + 4) // 5 AS from_tis, pos - (4 * n) // 5 AS from_tts FROM ev1),
ev AS (SELECT *, CASE WHEN from_tis < 0 THEN '5utr' WHEN from_tts > 0 THEN '3utr' ELSE 'cds' END AS region FROM ev2)"""
LN0 = """ln0 AS (SELECT l_partkey AS name, l_linestatus AS sample, l_returnflag || l_linestatus AS codon, CAST(l_quantity AS BIGINT) AS f0,
CAST(round(l_discount * 100) AS BIGINT) AS f1, CAST(round(l_tax * 100) AS BIGINT) AS f2 FROM lineitem)"""
LN = f"""lp AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(LINE_ORDER)}) AS pos FROM lineitem),
ln1 AS (SELECT l_partkey AS name, pos, l_linestatus AS sample, l_returnflag || l_linestatus AS codon, CAST(l_quantity AS BIGINT) AS f0,
CAST(round(l_discount * 100) AS BIGINT) AS f1, CAST(round(l_tax * 100) AS BIGINT) AS f2, count(*) OVER (PARTITION BY l_partkey) AS n FROM lp),
ln2 AS (SELECT name, pos, sample, codon, f0, f1, f2, pos - 1 - (n + 4) // 5 AS from_tis, pos - (4 * n) // 5 AS from_tts FROM ln1),
ln AS (SELECT *, CASE WHEN from_tis < 0 THEN '5utr' WHEN from_tts > 0 THEN '3utr' ELSE 'cds' END AS region FROM ln2)"""
