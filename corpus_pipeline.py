"""Corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of documents.

Defined cases: null text counts as empty and an empty text is a document like any
other (its quality is judged from its site and its shape; all empty texts are
copies of each other); rows without identifier are never dropped as copies of
rows with one by the near stage, and lose against them in the exact stage; rows
that repeat an identifier with another text are documents of their own in every
stage, rows that repeat both stay or go together; ties go to the smallest
identifier; extra columns of any name are carried along, except to packing, whose
rows are described there; an empty table stays empty; no stage cuts a long text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletlab.llm import bagminhash, exact, packing, quality, sanitise
from tripletlab.llm.common import stash, text_mark


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: documents whose posterior says low quality or toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of results cannot clash
    ident, text, host, path = (f"c{names.index(c)}" for c in ("doc_id", "text", "source", "lang"))
    return quality.score(plain, labels, ident, text, host, path).where("kept").select(*plain.columns).toDF(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5: of equal texts the row with the smallest doc_id stays."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of results cannot clash
    got = exact.exact_groups(plain, f"c{names.index('doc_id')}", f"c{names.index('text')}", "smallest", carry=plain.columns)
    return got.where("kept").select(*plain.columns).toDF(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 1: of each group of near copies the smallest doc_id stays.  Rows go by
    identifier and text, so another text under the same identifier stays."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of results cannot clash
    key, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    gone = bagminhash.near_groups(plain, key, text).where("NOT kept").select(F.col(key).alias("gone_id"), F.col("text_mark").alias("gone_mark")).distinct()
    left = plain.join(gone, (F.col(key) == F.col("gone_id")) & (text_mark(F.col(text)) == F.col("gone_mark")), "left_anti")
    return left.toDF(*names)


def remove_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4: personal data and terms that disclose it become placeholders."""
    clean = sanitise.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10: token-budget batches of all documents that are left."""
    return packing.pack(packing.word_counts(docs))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", remove_personal),
    ("packing", pack_batches),
]

#: Neither the classifier nor the dynamic program can be written as SQL; the
#: deterministic stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
