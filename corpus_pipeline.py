"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and reread as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitescope.llm import decontaminate, mixing, near_dedup, pii, quality
from suitescope.llm._common import checkpointed, table

#: Similarity, in percent, from which the pipeline treats documents as copies.
NEAR_PERCENT = 80
#: The key that tells rows apart while near copies are sought.
ROW = "_row"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field over lines predicts to be bad go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near copies stays: the one with the least id, null ids last.

    Rows are told apart by a key given here, so ids may be null or repeated.  A document without words
    stands alone and stays.  The keyed rows are written, so that each has one key in all plans.
    """
    keyed = checkpointed(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    found = near_dedup.near_duplicates(keyed, NEAR_PERCENT, id_column=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    stay = found.join(keyed.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return keyed.join(stay, ROW, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows where it is a column."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy drawn, with its shard, dealt by shard and shuffled within it."""
    mixed = mixing.mix(docs)
    return mixing.mixed_rows(mixed).select(*docs.columns, "size", "source_size", "target", "copy", "shard")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
]

#: Learned and probabilistic stages have no SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs, f"stage{k}")
    return docs
