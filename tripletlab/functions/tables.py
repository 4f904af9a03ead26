"""Small helpers for plans: written tables, and broadcasts of a checked size."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names; in a
    folder of our own only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tripletlab-"))
        named = _OWN[0]
    return f"{named.rstrip('/')}/tripletlab/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for plans that read it many times."""
    path = workspace(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def dealt(df: DataFrame, key: str, mb: float = 4.0) -> DataFrame:
    """``df`` dealt out by ``key`` in parts of about ``mb`` of what its plan reads,
    for windows and groups by key that hold much more than they read.  The number
    of parts grows with the input; Spark would keep its own number, or join parts by
    their compressed size.  Less than four parts are left to Spark."""
    spark = df.sparkSession
    parts = math.ceil(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / (mb * 1e6))
    return df if parts < 4 else df.repartition(max(parts, spark.sparkContext.defaultParallelism), key)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
