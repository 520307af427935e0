"""Queries of the box, evaluation, curation, ledger and extension operators, with their oracle SQL.

No test table has boxes: they are derived from the integer columns of lineitem, the
same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import geometry as geo
from spanveil.functions import rules
from spanveil.operators import boxes, curate, evaluate, ledger
from spanveil.plans.text import read
from spanveil.sources import files

_TRUTH = """
t AS (SELECT l_orderkey AS frame_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS id,
  CAST(l_partkey % 300 AS DOUBLE) AS x1, CAST(l_suppkey % 200 AS DOUBLE) AS y1,
  CAST(l_partkey % 300 + 20 + l_quantity AS DOUBLE) AS x2, CAST(l_suppkey % 200 + 10 + l_linenumber AS DOUBLE) AS y2,
  CASE l_returnflag WHEN 'A' THEN 'CARD_NUMBER' WHEN 'N' THEN 'NAME' ELSE 'SECRET' END AS class,
  CASE l_returnflag WHEN 'A' THEN 'CARD_NUMBER' WHEN 'N' THEN 'NAME' ELSE 'API_KEY' END AS source_class,
  l_suppkey % 5 - 1 AS d, l_partkey % 4 AS c, (l_partkey % 100) / 100.0 AS s, l_linestatus
  FROM lineitem),
r AS (SELECT frame_id, id, x1 - d AS x1, y1 - d AS y1, x2 + d AS x2, y2 + d AS y2, CAST(c AS INTEGER) AS class_id, s AS score,
  CASE c WHEN 0 THEN 'CREDIT_CARD' WHEN 1 THEN 'GIVEN_NAME' WHEN 2 THEN 'SECRET' ELSE 'EMAIL' END AS label, l_linestatus FROM t WHERE d < 3)
"""


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, true boxes and regions."""
    from pyspark.sql import Window

    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    x, y, flag = F.pmod("l_partkey", F.lit(300)), F.pmod("l_suppkey", F.lit(200)), F.col("l_returnflag")
    t = li.select(
        F.col("l_orderkey").alias("frame_id"),
        nth.alias("id"),
        x.cast("double").alias("x1"),
        y.cast("double").alias("y1"),
        (x + 20 + F.col("l_quantity")).cast("double").alias("x2"),
        (y + 10 + F.col("l_linenumber")).cast("double").alias("y2"),
        F.when(flag == "A", "CARD_NUMBER").when(flag == "N", "NAME").otherwise("SECRET").alias("class"),
        F.when(flag == "A", "CARD_NUMBER").when(flag == "N", "NAME").otherwise("API_KEY").alias("source_class"),
        (F.pmod("l_suppkey", F.lit(5)) - 1).alias("d"),
        F.pmod("l_partkey", F.lit(4)).cast("int").alias("c"),
        (F.pmod("l_partkey", F.lit(100)) / 100.0).alias("s"),
        "l_linestatus",
    )
    label = F.element_at(F.array(*[F.lit(v) for v in ("CREDIT_CARD", "GIVEN_NAME", "SECRET", "EMAIL")]), F.col("c") + 1)
    d = F.col("d")
    r = t.where(d < 3).select(
        "frame_id", "id", (F.col("x1") - d).alias("x1"), (F.col("y1") - d).alias("y1"), (F.col("x2") + d).alias("x2"), (F.col("y2") + d).alias("y2"), F.col("c").alias("class_id"), F.col("s").alias("score"), label.alias("label"), F.array(label).alias("labels"), F.array(F.when(F.col("l_linestatus") == "F", "VISUAL").otherwise("OCR")).alias("sources")
    )
    frames = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), F.lit(400).alias("width"), F.lit(300).alias("height"), F.col("o_orderpriority").alias("page_type"))
    return frames, t.select("frame_id", "id", "x1", "y1", "x2", "y2", "class", "source_class"), r


_COVER = """
, p AS (SELECT t.frame_id, t.id, t.class, t.source_class, r.label, r.id AS rid,
  CASE WHEN r.frame_id IS NOT NULL THEN greatest(0, least(t.x2, r.x2) - greatest(t.x1, r.x1)) * greatest(0, least(t.y2, r.y2) - greatest(t.y1, r.y1)) / ((t.x2 - t.x1) * (t.y2 - t.y1)) END AS cov
  FROM t LEFT JOIN r ON t.frame_id = r.frame_id),
b AS (SELECT frame_id, id, class, source_class, coalesce(max(cov), 0) >= 0.98 AS hit FROM p GROUP BY 1, 2, 3, 4)
"""


def coverage_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.region_totals(*_views(spark, sf_dir))


_TOTALS = (
    "WITH "
    + _TRUTH
    + _COVER
    + """
, m AS (SELECT DISTINCT frame_id, rid FROM p WHERE cov >= 0.98 AND (label IN (class, source_class) OR (class = 'NAME' AND label IN ('GIVEN_NAME', 'SURNAME')) OR (class = 'CARD_NUMBER' AND label = 'CREDIT_CARD') OR (class = 'SECRET' AND label IN ('SECRET', 'API_KEY')))),
f AS (SELECT o_orderkey AS frame_id FROM orders),
tf AS (SELECT frame_id, count(*) AS n, count(*) FILTER (hit) AS c, count(*) FILTER (class IN ('CARD_NUMBER', 'CVC', 'SECRET')) AS s, count(*) FILTER (hit AND class IN ('CARD_NUMBER', 'CVC', 'SECRET')) AS sc FROM b GROUP BY 1),
rf AS (SELECT frame_id, count(*) AS n, sum(greatest(0, x2 - x1) * greatest(0, y2 - y1)) AS a FROM r GROUP BY 1),
mf AS (SELECT frame_id, count(*) AS n FROM m GROUP BY 1),
e AS (SELECT coalesce(tf.n, 0) AS t, coalesce(tf.c, 0) AS c, coalesce(s, 0) AS s, coalesce(sc, 0) AS sc, coalesce(rf.n, 0) AS p, coalesce(mf.n, 0) AS m, least(1.0, coalesce(a, 0) / 120000) AS area
  FROM f LEFT JOIN tf USING (frame_id) LEFT JOIN rf USING (frame_id) LEFT JOIN mf USING (frame_id))
SELECT count(*) AS records, CAST(sum(t) AS BIGINT) AS truth, CAST(sum(c) AS BIGINT) AS covered, CAST(sum(p) AS BIGINT) AS predictions, CAST(sum(m) AS BIGINT) AS matched, CAST(sum(p) - sum(m) AS BIGINT) AS false_predictions, CAST(sum(s) - sum(sc) AS BIGINT) AS secret_misses,
  CAST(sum(c) AS DOUBLE) / sum(t) AS recall, CAST(sum(m) AS DOUBLE) / sum(p) AS proposal_precision,
  CAST(count(*) FILTER (t = 0) - count(*) FILTER (t = 0 AND p > 0) AS DOUBLE) / greatest(1, count(*) FILTER (t = 0)) AS hard_negative_pass_rate, round(sum(area) / count(*), 6) AS mean_masked_area FROM e
"""
)


def coverage_recall_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_recall(spark, sf_dir).withColumn("mean_masked_area", F.round("mean_masked_area", 6))


def per_class_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t, r = _views(spark, sf_dir)
    return evaluate.by_class(t, r)


def masked_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, r = _views(spark, sf_dir)
    return boxes.masked_area(r.join(f, "frame_id")).select("frame_id", F.round("masked_area", 9).alias("masked_area"))


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, r = _views(spark, sf_dir)
    return boxes.suppress(r).select("frame_id", "class_id", "id", "score")


def fuse_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, r = _views(spark, sf_dir)
    return boxes.fuse(r)


def greedy_truth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t, r = _views(spark, sf_dir)
    return boxes.greedy_match(t.withColumn("class_id", F.lit(0)), r.withColumn("class_id", F.lit(0)))


def cue_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t, r = _views(spark, sf_dir)
    near = F.transform(F.array("label"), lambda x: F.when(x == "EMAIL", "SECRET").when(x == "CREDIT_CARD", "CARD_NUMBER").otherwise("NAME"))
    return boxes.associate(t.withColumn("label", F.col("class")), r.withColumn("fits", near))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t, _ = _views(spark, sf_dir)
    return boxes.reading_order(t)


def same_box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, r = _views(spark, sf_dir)
    return boxes.same_box(r).groupBy("n").agg(F.count("*").alias("boxes"))


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs of regions of a frame."""
    _, _, r = _views(spark, sf_dir)
    a, b = r.alias("a"), r.alias("b")
    s = lambda t: F.struct(*[F.col(f"{t}.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    j = a.join(b, (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.id") < F.col("b.id")))
    return j.select(F.col("a.frame_id").alias("frame_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(geo.iou(s("a"), s("b")), 9).alias("iou")).where("iou > 0")


def rois_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t, r = _views(spark, sf_dir)
    return boxes.outside_rois(t, r.where(F.col("class_id") == 0)).groupBy("class").agg(F.count("*").alias("n"))


def yolo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of true boxes, read back: frame, class and box to six places."""
    _, t, _ = _views(spark, sf_dir)
    box = geo.clamp(F.struct("x1", "y1", "x2", "y2"), F.lit(400), F.lit(300))
    lines = t.select(F.col("frame_id").cast("string").alias("file"), geo.yolo_line(F.lit(0), box, F.lit(400.0), F.lit(300.0)).alias("line"))
    back = files.yolo_rows(lines, 1)
    return back.groupBy("file").agg(F.count("*").alias("n"), F.round(F.sum("x2"), 4).alias("x2"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(evaluate.nearest_rank("value", 0.5).alias("p50"), evaluate.nearest_rank("value", 0.95).alias("p95"), F.max("value").alias("maximum"), F.round(F.median("value"), 3).alias("median"), F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95_linear"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = read(spark, sf_dir, "labels").join(d, "doc_id")
    return j.select((F.pmod(F.col("n_chars") * 37, F.lit(1000)) / 1000.0).alias("score"), (F.col("quality") == 1).alias("truth"))


_SWEEP = """
WITH x AS (SELECT (n_chars * 37 % 1000) / 1000.0 AS score, quality = 1 AS truth FROM labels JOIN documents USING (doc_id)),
k AS (SELECT unnest(generate_series(0, 90)) AS k),
c AS (SELECT round(0.05 + k / 100.0, 10) AS threshold, count(*) FILTER (truth AND score >= (5 + k) / 100.0) AS tp, count(*) FILTER (NOT truth AND score >= (5 + k) / 100.0) AS fp, count(*) FILTER (truth AND score < (5 + k) / 100.0) AS fn FROM k, x GROUP BY k),
m AS (SELECT threshold, CAST(tp AS DOUBLE) / greatest(1, tp + fp) AS precision, CAST(tp AS DOUBLE) / greatest(1, tp + fn) AS recall, tp, fp, fn FROM c),
f AS (SELECT CAST(threshold AS DOUBLE) AS threshold, precision, recall, 5 * precision * recall / greatest(1e-12, 4 * precision + recall) AS f2, tp AS true_positive, fp AS false_positive, fn AS false_negative FROM m)
"""


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_sweep(_scored(spark, sf_dir)).withColumn("f2", F.round("f2", 9))


def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.choose_threshold(evaluate.threshold_sweep(_scored(spark, sf_dir)), 0.5).select("threshold", "true_positive", "false_positive", "met_target")


def gates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = evaluate.region_totals(*_views(spark, sf_dir))
    return evaluate.gates(total, [("recall", ">=", 0.97), ("proposal_precision", ">=", 0.95), ("secret_misses", "<=", 0), ("records", ">=", 200)]).withColumn("actual", F.round("actual", 9))


def dataset_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, t, _ = _views(spark, sf_dir)
    return evaluate.adequacy(f, t)


def path_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t, r = _views(spark, sf_dir)
    r = r.withColumn("path", F.when(F.col("class_id") == 0, "visual").when(F.col("class_id") == 1, "ocr").otherwise("fused"))
    return evaluate.path_saves(t, r)


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.confusion(j.select(F.when(F.col("quality") == 1, "GOOD").alias("truth_class"), F.when(F.col("lang") == "en", "GOOD").otherwise("OTHER").alias("predicted_class")))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    k = F.col("doc_id").cast("string")
    return d.where(curate.sampled(k, 0.2)).select("doc_id", rules.hash_seed(k).alias("seed"))


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.evenly(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 37)


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id", "source")
    return curate.first_of(d, "sha256", ["doc_id"])


def leakage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the later splits that share no line of 40 characters or more with the training split."""
    d = read(spark, sf_dir, "documents")
    split = F.when(F.pmod("doc_id", F.lit(10)) < 8, "train").when(F.pmod("doc_id", F.lit(10)) == 8, "validation").otherwise("holdout")
    v = d.select("doc_id", split.alias("split"), F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 40)
    v = v.select("doc_id", "split", F.lit("LINE").alias("label"), F.sha2(F.lower(rules.collapse(F.col("line"))), 256).alias("canonical"))
    return curate.without_leakage(d.select("doc_id", split.alias("split")), v, "doc_id").groupBy("split").agg(F.count("*").alias("n"))


_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'holdout' END"
_LINES = rf"l AS (SELECT doc_id, split, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS c FROM (SELECT doc_id, {_SPLIT} AS split, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 40)"


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    split = F.when(F.pmod("doc_id", F.lit(10)) < 8, "train").when(F.pmod("doc_id", F.lit(10)) == 8, "validation").otherwise("holdout")
    v = d.select(split.alias("split"), F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 40)
    v = v.select("split", F.lower(rules.collapse(F.col("line"))).alias("canonical"))
    return curate.overlap_between(v, "train", "holdout", ["canonical"]).agg(F.count("*").alias("n"))


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return curate.summary(d.select("lang", "source", F.col("quality").cast("string").alias("quality")), ["lang", "source", "quality"])


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "source")
    return curate.content_hash(d, "doc_id", "sha256", "source").select("source", "content_hash", "n")


def key_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return curate.key_parity(a, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k").groupBy("side").agg(F.count("*").alias("n"))


def english_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(curate.english(F.col("lang"), F.col("text"))).groupBy("source").agg(F.count("*").alias("n"))


def support_minimums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.support_minimums(read(spark, sf_dir, "documents"), "lang", {"en": 0.5, "fr": 0.3, "xx": 0.01})


def watchdog_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return ledger.trailing(e, "user_id", "step", "event_type").where("review").select("event_id", "user_id", "step", "suspicious")


def review_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.cooled_down(watchdog_window(spark, sf_dir).withColumn("step", F.col("step").cast("long")), "user_id", "step")


def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.changed(read(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("event_id", "user_id", "event_type")


def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ring(read(spark, sf_dir, "events"), "user_id", "event_id", 32).select("user_id", "event_id")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(read(spark, sf_dir, "events"), "user_id", "event_id", ["event_id", "event_type", "value"])


def first_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_seen(read(spark, sf_dir, "events"), "user_id", "event_id", ["event_id", "event_type"])


def carried_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return ledger.carried(e, ["user_id"], "event_id", ["purchase"]).select("event_id", "purchase")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.from_json("props", "k int").alias("p"), F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("key").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"), F.min("p.k").alias("low"), F.max("p.k").alias("high"))


def variant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of JSON properties by path."""
    e = read(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n"))


def onoff_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    r = e.select(F.when(F.pmod("user_id", F.lit(2)) == 0, "on").otherwise("off").alias("mode"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("exposed"), F.create_map(F.lit("ok"), F.col("value") > 5).alias("assertions"), F.col("value").alias("ms"))
    return evaluate.onoff(r).withColumn("wall_ms", F.round("wall_ms", 2))


def grouping_sets_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def session_window_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def tumbling_window_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")


def asof_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the user's last purchase before it: a union and a window, no range join."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("purchase_id", last).where("event_type = 'error'").select("event_id", "user_id", "purchase_id")


def approx_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of distinct users by event type (bounded error, so rows only)."""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("users"))


_EV = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events"

QUERIES = {
    f.__name__: f
    for f in (
        per_class_recall, masked_area, nms, fuse_regions, greedy_truth_match, cue_association, reading_order, same_box_merge, iou_pairs, rois_outside, yolo_lines,
        latency_percentiles, threshold_sweep, threshold_choice, gates_report, dataset_adequacy, path_saves, confusion_matrix,
        hash_sample, systematic_sample, dedup_first, leakage_filter, split_overlap, dataset_manifest, content_hash, key_parity, english_filter, support_minimums,
        watchdog_window, review_cooldown, consecutive_dedup, ring_buffer, latest_state, first_capture, carried_value, json_props, variant_keys, onoff_benchmark,
        grouping_sets_ext, session_window_ext, tumbling_window_ext, asof_ext, approx_ext,
    )
} | {"coverage_recall": coverage_recall_rounded}

_IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1)"

#: Greedy one-to-one choices, one step for each true box or cue of a frame, in order.
_MATCHED = """
WITH RECURSIVE {truth},
c AS (SELECT t.frame_id, t.id AS k, r.id AS other, {rank} AS rank, row_number() OVER (PARTITION BY t.frame_id, t.id ORDER BY r.score DESC, r.id) AS place FROM t JOIN r ON t.frame_id = r.frame_id WHERE {fits}),
n AS (SELECT frame_id, max(id) AS most FROM t GROUP BY 1),
w AS (
  SELECT frame_id, most, 0 AS k, CAST([] AS INTEGER[]) AS used, CAST(NULL AS STRUCT(rank DOUBLE, place BIGINT, other INTEGER)) AS hit FROM n
  UNION ALL
  SELECT frame_id, most, k, CASE WHEN hit IS NOT NULL AND {take} THEN list_append(used, hit.other) ELSE used END, CASE WHEN {take} THEN hit END FROM (
    SELECT w.frame_id, w.most, w.k + 1 AS k, w.used, {best}(CASE WHEN c.other IS NOT NULL THEN CAST(ROW(c.rank, c.place, c.other) AS STRUCT(rank DOUBLE, place BIGINT, other INTEGER)) END) AS hit
    FROM w LEFT JOIN c ON c.frame_id = w.frame_id AND c.k = w.k + 1 AND c.rank IS NOT NULL AND NOT list_contains(w.used, c.other) WHERE w.k < w.most GROUP BY w.frame_id, w.most, w.k, w.used)
)
SELECT frame_id, CAST(k AS BIGINT) AS {name}_id, CAST(hit.other AS BIGINT) AS {other}_id, hit.rank AS {what} FROM w WHERE hit IS NOT NULL
"""
_BOX_IOU = "greatest(0, least(t.x2, r.x2) - greatest(t.x1, r.x1)) * greatest(0, least(t.y2, r.y2) - greatest(t.y1, r.y1))"
_TALL = "greatest(1, t.y2 - t.y1)"
_RANK = f"""CASE WHEN greatest(0, least(t.y2, r.y2) - greatest(t.y1, r.y1)) >= 0.45 * least({_TALL}, greatest(1, r.y2 - r.y1)) AND r.x1 - t.x2 >= -0.35 * {_TALL}
  THEN CASE WHEN r.x1 - t.x2 <= least(480, greatest(64, 12 * {_TALL})) THEN greatest(0, r.x1 - t.x2) + 2 * (abs((t.y1 + t.y2) - (r.y1 + r.y2)) / 2) END
  WHEN r.y1 - t.y2 < -0.35 * {_TALL} OR r.y1 - t.y2 > least(96, greatest(32, 3 * {_TALL})) OR (least(t.x2, r.x2) <= greatest(t.x1, r.x1) AND abs(t.x1 - r.x1) > greatest(5 * {_TALL}, 120)) THEN NULL
  ELSE 10000 + 4 * greatest(0, r.y1 - t.y2) + abs(t.x1 - r.x1) END"""

ORACLES = {
    "nms": f"""
WITH RECURSIVE {_TRUTH.strip()},
o AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY score DESC, id) AS k FROM r),
w AS (
  SELECT frame_id, class_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id INTEGER, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, score DOUBLE)[]) AS kept FROM (SELECT DISTINCT frame_id, class_id FROM o)
  UNION ALL
  SELECT w.frame_id, w.class_id, o.k, CASE WHEN len(list_filter(w.kept, lambda r: {_BOX_IOU.replace("t.", "o.")} / ((o.x2 - o.x1) * (o.y2 - o.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {_BOX_IOU.replace("t.", "o.")}) > 0.7)) = 0
    THEN list_append(w.kept, CAST(ROW(o.id, o.x1, o.y1, o.x2, o.y2, o.score) AS STRUCT(id INTEGER, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, score DOUBLE))) ELSE w.kept END
  FROM w JOIN o ON o.frame_id = w.frame_id AND o.class_id = w.class_id AND o.k = w.k + 1
), last AS (SELECT frame_id, class_id, arg_max(kept, k) AS kept FROM w GROUP BY 1, 2)
SELECT frame_id, class_id, b.id AS id, b.score AS score FROM (SELECT frame_id, class_id, unnest(kept) AS b FROM last)
""",
    "review_cooldown": f"""
WITH RECURSIVE e AS ({_EV}), c AS (SELECT user_id, step, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY step RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS suspicious FROM e),
s AS (SELECT user_id, step FROM c WHERE suspicious >= 3),
w AS (SELECT user_id, min(step) AS step FROM s GROUP BY 1 UNION ALL SELECT w.user_id, min(s.step) FROM w JOIN s ON s.user_id = w.user_id AND s.step >= w.step + 8 GROUP BY w.user_id, w.step)
SELECT user_id, step FROM w
""",
    "greedy_truth_match": _MATCHED.format(
        truth=_TRUTH.strip(), rank=f"{_BOX_IOU} / ((t.x2 - t.x1) * (t.y2 - t.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {_BOX_IOU})", fits="true", take="hit.rank >= 0.5", best="max", name="truth", other="detection", what="iou"
    ),
    "cue_association": _MATCHED.format(
        truth=_TRUTH.strip(), rank=_RANK, fits="t.class = CASE r.label WHEN 'EMAIL' THEN 'SECRET' WHEN 'CREDIT_CARD' THEN 'CARD_NUMBER' ELSE 'NAME' END", take="true", best="min", name="cue", other="value", what="rank"
    ).replace("row_number() OVER (PARTITION BY t.frame_id, t.id ORDER BY r.score DESC, r.id)", "CAST(r.id AS BIGINT)"),
    "coverage_recall": _TOTALS,
    "per_class_recall": "WITH " + _TRUTH + _COVER + "SELECT class, count(*) AS support, count(*) FILTER (hit) AS covered, CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS recall FROM b GROUP BY 1",
    "masked_area": "WITH " + _TRUTH + "SELECT frame_id, round(least(1.0, sum(greatest(0, x2 - x1) * greatest(0, y2 - y1)) / 120000), 9) AS masked_area FROM r JOIN orders ON o_orderkey = frame_id GROUP BY 1",
    "same_box_merge": "WITH " + _TRUTH + "SELECT n, count(*) AS boxes FROM (SELECT count(*) AS n FROM r GROUP BY frame_id, x1, y1, x2, y2) GROUP BY n",
    "iou_pairs": "WITH " + _TRUTH + f"SELECT a.frame_id, a.id AS a, b.id AS b, round({_IOU} / ({_AREA.format('a')} + {_AREA.format('b')} - {_IOU}), 9) AS iou FROM r a JOIN r b ON a.frame_id = b.frame_id AND a.id < b.id WHERE {_IOU} > 0",
    "rois_outside": "WITH " + _TRUTH + "SELECT class, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.frame_id = t.frame_id AND r.class_id = 0 AND (t.x1 + t.x2) / 2 BETWEEN r.x1 AND r.x2 AND (t.y1 + t.y2) / 2 BETWEEN r.y1 AND r.y2) GROUP BY 1",
    "yolo_lines": "WITH " + _TRUTH + "SELECT CAST(frame_id AS VARCHAR) AS file, count(*) AS n, round(sum(least(400, x2) / 400), 4) AS x2 FROM t GROUP BY 1",
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS maximum, round(median(value), 3) AS median, round(quantile_cont(value, 0.95), 6) AS p95_linear FROM events GROUP BY 1",
    "threshold_sweep": _SWEEP + "SELECT threshold, precision, recall, round(f2, 9) AS f2, true_positive, false_positive, false_negative FROM f",
    "threshold_choice": _SWEEP + "SELECT threshold, true_positive, false_positive, recall >= 0.5 AS met_target FROM f ORDER BY recall >= 0.5 DESC, CASE WHEN recall >= 0.5 THEN precision ELSE f2 END DESC, CASE WHEN recall >= 0.5 THEN f2 ELSE recall END DESC, threshold DESC LIMIT 1",
    "gates_report": "WITH q AS (" + _TOTALS + ") SELECT name, round(actual, 9) AS actual, op, required, CASE op WHEN '>=' THEN actual >= required ELSE actual <= required END AS passed FROM (SELECT 'recall' AS name, recall AS actual, '>=' AS op, CAST(0.97 AS DOUBLE) AS required FROM q UNION ALL SELECT 'proposal_precision', proposal_precision, '>=', 0.95 FROM q UNION ALL SELECT 'secret_misses', secret_misses, '<=', 0 FROM q UNION ALL SELECT 'records', records, '>=', 200 FROM q)",
    "dataset_adequacy": "WITH " + _TRUTH + "SELECT count(*) AS records, CAST(sum(coalesce(n, 0)) AS BIGINT) AS truth, CAST(sum(coalesce(s, 0)) AS BIGINT) AS secrets, count(*) FILTER (n IS NULL) AS hard_negatives, count(DISTINCT o_orderpriority) AS families FROM orders LEFT JOIN (SELECT frame_id, count(*) AS n, count(*) FILTER (class IN ('CARD_NUMBER', 'CVC', 'SECRET')) AS s FROM t GROUP BY 1) ON o_orderkey = frame_id",
    "path_saves": "WITH " + _TRUTH + ", j AS (SELECT t.frame_id, t.id, t.class, coalesce(bool_or(class_id = 0 AND cov >= 0.98), false) AS v, coalesce(bool_or(class_id = 1 AND cov >= 0.98), false) AS o, coalesce(bool_or(class_id > 1 AND cov >= 0.98), false) AS f FROM (SELECT t.*, r.class_id, greatest(0, least(t.x2, r.x2) - greatest(t.x1, r.x1)) * greatest(0, least(t.y2, r.y2) - greatest(t.y1, r.y1)) / ((t.x2 - t.x1) * (t.y2 - t.y1)) AS cov FROM t LEFT JOIN r ON t.frame_id = r.frame_id) t GROUP BY 1, 2, 3) SELECT count(*) FILTER (f AND v AND NOT o) AS visual_only_saves, count(*) FILTER (f AND o AND NOT v) AS ocr_only_saves, count(*) FILTER ((v OR o) AND NOT f) AS fusion_regressions, count(*) FILTER ((v OR o) AND NOT f AND class IN ('CARD_NUMBER', 'CVC', 'SECRET')) AS secret_fusion_regressions FROM j",
    "confusion_matrix": "SELECT CASE WHEN quality = 1 THEN 'GOOD' ELSE 'SPURIOUS' END AS truth_class, CASE WHEN lang = 'en' THEN 'GOOD' ELSE 'OTHER' END AS predicted_class, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2",
    "hash_sample": "SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) AS seed FROM documents WHERE CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967295 < 0.2",
    "systematic_sample": "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM d WHERE i IN (SELECT k * (SELECT max(n) FROM d) // 37 FROM (SELECT unnest(generate_series(0, 36)) AS k))",
    "dedup_first": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
    "leakage_filter": f"WITH {_LINES}, k AS (SELECT DISTINCT a.doc_id FROM l a WHERE a.split <> 'train' AND a.c IN (SELECT c FROM l WHERE split = 'train')) SELECT {_SPLIT} AS split, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k) GROUP BY 1",
    "split_overlap": f"WITH {_LINES} SELECT count(*) AS n FROM (SELECT c FROM l WHERE split = 'train' INTERSECT SELECT c FROM l WHERE split = 'holdout')",
    "dataset_manifest": "WITH d AS (SELECT lang, source, CAST(quality AS VARCHAR) AS quality FROM documents JOIN labels USING (doc_id)) SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'quality', quality, count(*) FROM d GROUP BY 2",
    "content_hash": "WITH f AS (SELECT source, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 1024 AS b, CAST(doc_id AS VARCHAR) || CASE WHEN text IS NULL THEN '' ELSE ' ' || sha256(text) END AS line FROM documents), p AS (SELECT source, b, sha256(string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS n FROM f GROUP BY 1, 2) SELECT source, sha256(string_agg(h, chr(10) ORDER BY b)) AS content_hash, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1",
    "key_parity": "WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT side, count(*) AS n FROM (SELECT 'left_only' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'right_only' FROM b WHERE k NOT IN (SELECT k FROM a)) GROUP BY 1",
    "english_filter": "SELECT source, count(*) AS n FROM documents WHERE (lang = 'en' OR regexp_matches(lang, '^en[-_]')) AND trim(text) <> '' GROUP BY 1",
    "support_minimums": "WITH a AS (SELECT count(*) AS c FROM documents), w(lang, share) AS (VALUES ('en', 0.5), ('fr', 0.3), ('xx', 0.01)) SELECT w.lang, coalesce(n, 0) AS n, CAST(ceil(share * c) AS BIGINT) AS required, coalesce(n, 0) >= ceil(share * c) AS passed FROM w CROSS JOIN a LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) d ON d.lang = w.lang",
    "watchdog_window": f"WITH e AS ({_EV}), w AS (SELECT event_id, user_id, CAST(step AS INTEGER) AS step, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY step RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS suspicious FROM e) SELECT * FROM w WHERE suspicious >= 3",
    "consecutive_dedup": "WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT event_id, user_id, event_type FROM e WHERE p IS DISTINCT FROM event_type",
    "ring_buffer": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 32",
    "latest_state": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY 1",
    "first_capture": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, count(*) AS n FROM events GROUP BY 1",
    "carried_value": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase FROM events",
    "json_props": "SELECT 'k' AS key, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total, min(CAST(json_extract(props, '$.k') AS INTEGER)) AS low, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS high FROM events",
    "variant_keys": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "onoff_benchmark": "SELECT CASE WHEN user_id % 2 = 0 THEN 'on' ELSE 'off' END AS mode, count(*) AS runs, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS exposed, count(*) FILTER (value > 5) AS verified, round(median(value), 3) AS median_ms, round(sum(value), 2) AS wall_ms FROM events GROUP BY 1",
    "grouping_sets_ext": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "session_window_ext": "WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1",
    "tumbling_window_ext": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "asof_ext": "SELECT event_id, user_id, purchase_id FROM (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS purchase_id FROM events WHERE event_type IN ('error', 'purchase')) WHERE event_type = 'error'",
}
