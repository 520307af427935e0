"""Streaming import of annotated screens: fingerprints in place of texts, written once however often a batch runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanveil.functions import rules

LABEL = "struct<label:string,category:string,ocr_text:string,draw_type:string,is_task_essential:boolean,bbox_percent:array<double>>"
SCREEN = f"id long, platform string, task_folder string, task_goal string, step_index int, image string, privacy_labels array<{LABEL}>, outcome string, done boolean"
REQUIRED = ("id", "platform", "task_folder", "task_goal", "step_index", "image", "privacy_labels")


def projected(rows: DataFrame, texts: bool = False) -> DataFrame:
    """Screens as they are kept: goals and texts only as fingerprints (with ``texts`` also as they are); a row without a required field is an error."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    told = F.concat(F.lit("row without "), F.array_join(missing, ", "))
    checked = rows.withColumn("id", F.when(F.size(missing) == 0, F.col("id")).otherwise(F.raise_error(told).cast("long")))

    def label(x: Column) -> Column:
        text = F.coalesce(x["ocr_text"], F.lit(""))
        kept = [
            F.coalesce(x["label"], F.lit("unknown")).alias("risk"),
            x["draw_type"].alias("draw_type"),
            F.coalesce(x["category"], F.lit("unknown")).alias("category"),
            F.coalesce(x["is_task_essential"], F.lit(False)).alias("is_task_essential"),
            F.coalesce(x["bbox_percent"], F.array().cast("array<double>")).alias("bbox_percent"),
            rules.fingerprint(text).alias("ocr_text_fingerprint"),
        ]
        return F.struct(*kept, *([text.alias("ocr_text")] if texts else []))

    return checked.select(
        "id",
        "platform",
        "task_folder",
        rules.fingerprint(F.col("task_goal")).alias("task_goal_fingerprint"),
        "step_index",
        F.col("image").alias("source_image"),
        F.transform("privacy_labels", label).alias("privacy_labels"),
        "outcome",
        F.coalesce("done", F.lit(False)).alias("done"),
    )


def start(stream: DataFrame, folder: str, checkpoint: str, texts: bool = False, **trigger: object) -> StreamingQuery:
    """Imports a stream of screens into ``folder``/batch=N: a batch that runs again after a failure replaces its own files, so every row is there once."""

    def write(rows: DataFrame, number: int) -> None:
        projected(rows, texts).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def imported(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that an import has written."""
    return spark.read.option("basePath", folder).parquet(folder).drop("batch")


def manifest(rows: DataFrame) -> DataFrame:
    """Counts of an import, one row: records, annotations, screens without any, trajectories; by risk, category and platform; and an order-free digest of the records."""
    each = rows.select("platform", "task_folder", F.transform("privacy_labels", lambda x: F.struct(x["risk"].alias("risk"), x["category"].alias("category"))).alias("labels"), F.xxhash64(F.to_json(F.struct(*rows.columns))).alias("h"))
    total = each.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.size("labels")), F.lit(0)).cast("long").alias("annotations"), F.count_if(F.size("labels") == 0).alias("unannotated"), F.count_distinct("task_folder").alias("trajectories"), F.bit_xor("h").alias("digest"))
    flat = each.select(F.explode("labels").alias("x"))
    by = lambda d, c, name: d.groupBy(c.alias("k")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias(name))
    # one row each
    return total.crossJoin(by(flat, F.col("x.risk"), "risks")).crossJoin(by(flat, F.col("x.category"), "categories")).crossJoin(by(each, F.col("platform"), "platforms"))
