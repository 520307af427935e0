"""Data-set curation: mapping, deduplication, leakage, sampling, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions import rules

SPLITS = ("train", "validation", "holdout")


def english(language: Column, text: Column) -> Column:
    """Whether a row is English and has a text."""
    return F.coalesce(((language == "en") | language.rlike("^en[-_]")) & (F.trim(text) != ""), F.lit(False))


def sampled(key: Column, share: float) -> Column:
    """Whether a key is in a deterministic sample."""
    return rules.hash_share(key) < share


def split_order(split: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), split)


def first_of(records: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first record of each key by the given order.

    Partial aggregates find the first, so a key of very many records is no hot task.
    """
    rest = [c for c in records.columns if c != key]
    g = records.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in records.columns])


def without_leakage(records: DataFrame, values: DataFrame, key: str = "id") -> DataFrame:
    """Records of other splits that share no (label, canonical) value with a training record. values: key, split, label, canonical."""
    trained = values.where(F.col("split") == "train").select("label", "canonical").distinct()
    leaked = values.where(F.col("split") != "train").join(trained, ["label", "canonical"], "left_semi").select(key).distinct()
    return records.join(leaked, key, "left_anti")


def overlap_between(values: DataFrame, a: str, b: str, columns: list[str]) -> DataFrame:
    """Values that two splits share."""
    side = lambda s: values.where(F.col("split") == s).select(*columns)
    return side(a).intersect(side(b))


def key_parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    l, r = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return l.join(r, key, "full_outer").where(F.col("l").isNull() | F.col("r").isNull()).select(key, F.when(F.col("r").isNull(), "left_only").otherwise("right_only").alias("side"))


def file_mismatch(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, sha256) that a manifest lacks, that are missing, or that differ from it."""
    j = files.select("path", F.col("sha256").alias("have")).join(manifest.select("path", F.col("sha256").alias("want")), "path", "full_outer")
    what = F.when(F.col("want").isNull(), "unlisted").when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), "mismatch")
    return j.withColumn("problem", what).where(F.col("problem").isNotNull()).select("path", "problem")


def summary(records: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each of several columns in one pass: dimension, value, n (grouping sets)."""
    rows = records.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    name = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")) for c in columns])
    return rows.select(name.alias("dimension"), value.alias("value"), "n")


def content_hash(files: DataFrame, path: str = "path", sha: str = "sha256", by: str | None = None) -> DataFrame:
    """One hash over all (path, hash) in order of path: of bucket hashes, so that no group is the whole table."""
    b = F.pmod(F.conv(F.substring(F.sha2(F.col(path).cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(1024)).alias("b")
    line = F.concat_ws(" ", F.col(path).cast("string"), sha)
    part = files.groupBy(*([by] if by else []), b).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return part.groupBy(*([by] if by else [])).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("content_hash"), F.sum("n").alias("n"))


def evenly(rows: DataFrame, order: str, m: int) -> DataFrame:
    """m rows at even steps (i * n // m) of an order.

    Ranks come from the sizes of ranges of the order (one small table), then from
    places within each range.
    """
    n = rows.count()
    if n == 0 or m <= 0:
        return rows.limit(0)
    parts = max(1, min(200, n // 10_000 + 1))
    r = rows.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id())
    size = r.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = size.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row for each range: 200 at most
    at = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("_o")
    k = min(m, n)
    i = F.ceil(F.col("_at") * k / F.lit(n)).cast("long")
    return r.join(F.broadcast(offs), "_p").withColumn("_at", at).where((F.floor(i * n / F.lit(k)) == F.col("_at")) & (i < k)).drop("_p", "_o", "_at")


def deduped_boxes(annotations: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Annotations of one class and box (to four places) as one, with all their keys, clipped if any is."""
    r = [F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return annotations.groupBy(frame, "class", *r).agg(F.array_sort(F.collect_set("key")).alias("keys"), F.bool_or("clipped").alias("clipped"), F.count("*").alias("n"))


def violations(records: DataFrame, classes: list[str]) -> DataFrame:
    """What is wrong with each record: key, problem."""
    s = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"), x["value"].alias("value"))))
    bounds = F.exists(s, lambda x: (x["start"] < 0) | (x["start"] >= x["end"]) | (x["end"] > F.length("text")))
    value = F.exists(s, lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]) != x["value"])
    lap = F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.get(s, i)["start"] < F.get(s, i - 1)["end"])
    problems = F.filter(
        F.array(
            F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "split"),
            F.when(F.coalesce(F.col("text"), F.lit("")) == "", "text"),
            F.when(F.exists(s, lambda x: ~x["label"].isin(*classes)), "class"),
            F.when(bounds, "bounds"),
            F.when(F.coalesce(lap, F.lit(False)), "overlap"),
            F.when(~bounds & value, "value"),
        ),
        lambda x: x.isNotNull(),
    )
    return records.select("id", F.explode(problems).alias("problem"))


def support_minimums(records: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Whether each value makes up its least share of the records."""
    n = records.agg(F.count("*").alias("all"))
    have = records.groupBy(column).agg(F.count("*").alias("n"))
    want = records.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], f"{column} string, share double")
    return want.join(have, column, "left").join(F.broadcast(n)).select(column, F.coalesce("n", F.lit(0)).alias("n"), F.ceil(F.col("share") * F.col("all")).alias("required")).withColumn("passed", F.col("n") >= F.col("required"))


def remapped(vectors: DataFrame, old: DataFrame, pieces: DataFrame) -> DataFrame:
    """Vectors for new tokens: of the equal old token, else the mean of its pieces' vectors, else its own. vectors: token, v; old: token, v; pieces: token, piece."""
    mean = pieces.join(old.select(F.col("token").alias("piece"), F.col("v").alias("pv")), "piece").select("token", F.posexplode("pv").alias("i", "x")).groupBy("token", "i").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mv"))
    return vectors.join(old.select("token", F.col("v").alias("ov")), "token", "left").join(mean, "token", "left").select("token", F.coalesce("ov", "mv", "v").alias("v"), F.when(F.col("ov").isNotNull(), "exact").when(F.col("mv").isNotNull(), "mean").otherwise("kept").alias("how"))


def chained(*parts: DataFrame) -> DataFrame:
    """Tables one after another, with the number of each."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
