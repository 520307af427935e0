"""Readers and writers of the formats that data sets, models and tools exchange."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """A JSON line file of a given schema; bad lines fail the read, and in strict mode blank lines too."""
    if strict:
        blank = spark.read.text(path).where(F.trim("value") == "").limit(1)
        if not blank.isEmpty():
            raise ValueError(f"{path} has a blank line")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines (committed as a whole) and returns their number and an order-free digest."""
    df.write.mode("overwrite").json(path)
    back = df.sparkSession.read.text(path)
    h = F.xxhash64("value")
    return back.agg(F.count("*").alias("records"), F.bit_xor(h).alias("digest"))


def write_json(value: object, path: str) -> None:
    """One small document, written whole or not at all, readable by its owner only."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.chmod(tmp, 0o600)
    os.replace(tmp, path)


def read_yolo(spark: SparkSession, path: str, classes: int) -> DataFrame:
    """Label files (class cx cy w h a line): file, class_id, x1, y1, x2, y2 as shares; a bad line fails the query."""
    rows = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.trim("value").alias("line")).where("line <> ''")
    return yolo_rows(rows, classes)


def yolo_rows(rows: DataFrame, classes: int) -> DataFrame:
    """Boxes out of label lines (file, line)."""
    p = F.split("line", r"\s+")
    n = [F.get(p, i).try_cast("double") for i in range(5)]
    ok = (F.size(p) == 5) & n[0].between(0, classes - 1) & (n[0] == F.floor(n[0])) & n[1].between(0, 1) & n[2].between(0, 1) & (n[3] > 0) & (n[3] <= 1) & (n[4] > 0) & (n[4] <= 1)
    checked = rows.withColumn("_ok", F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("bad label line in "), F.col("file"))).cast("boolean")))
    return checked.where("_ok").select("file", n[0].cast("int").alias("class_id"), (n[1] - n[3] / 2).alias("x1"), (n[2] - n[4] / 2).alias("y1"), (n[1] + n[3] / 2).alias("x2"), (n[2] + n[4] / 2).alias("y2"))


def dataset_yaml(root: str, names: list[str]) -> str:
    """The text of a detector data set's description."""
    return "\n".join([f"path: {root}", "train: images/train", "val: images/val", "names:", *[f"  {i}: {n}" for i, n in enumerate(names)], ""])


def sse_events(raw: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Data events of server-sent streams: key, at, data."""
    lines = raw.select(F.col(key), F.posexplode(F.split(column, r"\r?\n")).alias("at", "line")).where(F.col("line").startswith("data:"))
    return lines.select(key, "at", F.trim(F.substring("line", 6, 1 << 30)).alias("data"))


def sse_completion(raw: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Streamed completions as one text each: key, model, content, finish_reason, complete (whether [DONE] came)."""
    schema = "model string, choices array<struct<delta:struct<role:string,content:string>,finish_reason:string>>"
    e = sse_events(raw, key, column)
    x = e.withColumn("j", F.from_json("data", schema))
    return x.groupBy(key).agg(
        F.min_by("j.model", F.when(F.col("j.model").isNotNull(), F.col("at"))).alias("model"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.get("j.choices", F.lit(0))["delta"]["content"], F.lit("")).alias("c")))), lambda s: s["c"]), "").alias("content"),
        F.max_by(F.get("j.choices", F.lit(0))["finish_reason"], F.when(F.get("j.choices", F.lit(0))["finish_reason"].isNotNull(), F.col("at"))).alias("finish_reason"),
        F.bool_or(F.col("data") == "[DONE]").alias("complete"),
    )


def sse_summary(raw: DataFrame, key: str, column: str = "value") -> DataFrame:
    """The shape of each stream: events, keys seen, whether it ended."""
    e = sse_events(raw, key, column)
    return e.groupBy(key).agg(F.count("*").alias("events"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.json_object_keys("data"))))).alias("keys"), F.bool_or(F.col("data") == "[DONE]").alias("complete"))


def sse_lines(df: DataFrame, *columns: str) -> DataFrame:
    """Rows as server-sent events."""
    return df.select(F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n")).alias("value"))


def lsof_connections(raw: DataFrame, order: str = "at", column: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Connections out of lsof field lines (p pid, c command, n name), each with the process last named before it; ``by``: what tells listings (of samples, machines) apart."""
    from pyspark.sql import Window

    v = F.col(column)
    rest = F.substring(v, 2, 1 << 20)
    # without ``by`` all lines are one listing, of one machine at one time
    w = (Window.partitionBy(*by) if by else Window).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kind = F.substring(v, 1, 1)
    x = raw.withColumn("pid", F.last(F.when(kind == "p", rest.try_cast("int")), True).over(w)).withColumn("_s", F.count_if(kind == "p").over(w))
    x = x.withColumn("process", F.last(F.when(kind == "c", F.struct(F.col("_s").alias("s"), rest.alias("c"))), True).over(w)).where(kind == "n")
    name = F.split(rest, "->")
    return x.select(*by, "pid", F.when(F.col("process.s") == F.col("_s"), F.col("process.c")).alias("process"), F.get(name, F.lit(0)).alias("local"), F.get(name, F.lit(1)).alias("remote"))


def data_url_bytes(url: Column) -> Column:
    """The bytes of a base64 data URL; null if it is none."""
    return F.when(url.rlike(r"^data:[^,]*;base64,"), F.try_to_binary(F.element_at(F.split(url, ",", 2), 2), F.lit("base64")))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files of a tree: path, bytes, sha256."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def observations(rows: DataFrame, least: float = 2.0) -> DataFrame:
    """Text observations with the origin at the lower left (shares x, y, w, h) as boxes of the image from the upper left, clamped, without tiny ones."""
    from spanveil.functions import geometry as geo

    wd, ht = F.col("width"), F.col("height")
    b = geo.clamp(F.struct((F.col("x") * wd).alias("x1"), ((1 - F.col("y") - F.col("h")) * ht).alias("y1"), ((F.col("x") + F.col("w")) * wd).alias("x2"), ((1 - F.col("y")) * ht).alias("y2")), wd, ht)
    r = rows.withColumn("b", b).where((F.col("b.x2") - F.col("b.x1") >= least) & (F.col("b.y2") - F.col("b.y1") >= least))
    return r.select(*[c for c in rows.columns if c not in ("x", "y", "w", "h")], "b.x1", "b.y1", "b.x2", "b.y2")


def runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Run records out of a directory tree of JSON files (run/calls/*.json), with their run."""
    f = spark.read.schema(schema).option("multiLine", "true").json(f"{root}/*/calls/*.json")
    return f.withColumn("run_id", F.element_at(F.split(F.input_file_name(), "/"), -3))


def alphabet(spark: SparkSession, path: str) -> list[str]:
    """The characters of a recogniser's dictionary, one a line, and a blank at the end."""
    return [r["value"] for r in spark.read.text(path, wholetext=False).collect()] + [" "]  # a few thousand lines
