"""A training-corpus pipeline over documents: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns rows; all but the last return
the columns of documents. Between stages the rows are kept in the shared
checkpoint folder (the check tool writes and rereads them as Parquet instead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint, ship
from spanveil.llm import linedup, mixing, nearcopy, pieces, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject; trained on the label table."""
    ship(spark)
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes the later copies of repeated line runs, and documents of which nothing is left."""
    ship(spark)
    rows = linedup.clean(docs)
    return rows.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    ship(spark)
    return nearcopy.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources by their target weights; a document appears as often as it is taken."""
    return mixing.mix(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each text's sampled piece ids, and whether they decode to the text."""
    ship(spark)
    return pieces.encode(docs, proof="lossless").withColumn("n_tokens", F.greatest(F.size("ids"), F.lit(0)).cast("long")).drop("text")


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", source_mix),
    ("pieces", piece_ids),
]

#: SQL cannot express the trained stages; tests hold the pipeline against its operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
