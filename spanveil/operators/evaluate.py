"""Truth against prediction: coverage, precision and recall, confusion, thresholds, agreement, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions import rules
from spanveil.operators import boxes, grid
from spanveil.operators.grouped import per_pair

COVERED = 0.98


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 without b."""
    return F.when(b > 0, a / b).otherwise(0.0)


def nearest_rank(x: str, q: float) -> Column:
    """The percentile by nearest rank; 0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})"), F.lit(0.0))


def region_totals(frames: DataFrame, truth: DataFrame, regions: DataFrame, frame: str = "frame_id", covered: float = COVERED) -> DataFrame:
    """One row of totals: recall, proposal precision, secret misses, hard negatives, masked area."""
    from spanveil.functions import geometry as geo

    xy = ("x1", "y1", "x2", "y2")
    best = boxes.covered(truth.select(frame, "class", *xy), regions, frame, covered).withColumn("secret", F.col("class").isin(*rules.SECRET_CLASSES))
    t = best.groupBy(frame).agg(F.count("*").alias("truth"), F.count_if("hit").alias("covered"), F.count_if("secret").alias("secrets"), F.count_if(F.col("secret") & F.col("hit")).alias("secrets_covered"))
    fits = lambda r, t: (geo.coverage(r, t) >= covered) & boxes.compatible(t["class"], t["source_class"], r["labels"])
    met = grid.found(regions.select(frame, "id", "labels", *xy), truth.select(frame, "class", "source_class", *xy), fits, lambda t: F.lit(True), frame, "fit")
    one = met.groupBy(frame, "id").agg(F.count("*").alias("n"), F.sum(geo.area(F.struct(*xy))).alias("area"), F.coalesce(F.bool_or(F.size("fit") > 0), F.lit(False)).alias("fit"))
    r = one.groupBy(frame).agg(F.sum("n").alias("predictions"), F.sum("area").alias("area"), F.count_if("fit").alias("matched"))
    each = frames.join(t, frame, "left").join(r, frame, "left").fillna(0)
    size = F.col("width") * F.col("height")
    total = each.agg(
        F.count("*").alias("records"),
        *[F.sum(c).alias(c) for c in ("truth", "covered", "predictions", "matched", "secrets", "secrets_covered")],
        F.count_if(F.col("truth") == 0).alias("hard_negatives"),
        F.count_if((F.col("truth") == 0) & (F.col("predictions") > 0)).alias("hard_negative_false"),
        F.sum(F.when(size > 0, F.least(F.lit(1.0), F.col("area") / size)).otherwise(0.0)).alias("masked"),
    )
    return total.select(
        "records",
        "truth",
        "covered",
        "predictions",
        "matched",
        (F.col("predictions") - F.col("matched")).alias("false_predictions"),
        (F.col("secrets") - F.col("secrets_covered")).alias("secret_misses"),
        ratio(F.col("covered"), F.col("truth")).alias("recall"),
        ratio(F.col("matched"), F.col("predictions")).alias("proposal_precision"),
        ratio(F.col("hard_negatives") - F.col("hard_negative_false"), F.col("hard_negatives")).alias("hard_negative_pass_rate"),
        ratio(F.col("masked"), F.col("records")).alias("mean_masked_area"),
    )


def by_class(truth: DataFrame, regions: DataFrame, column: str = "class", covered: float = COVERED) -> DataFrame:
    """Support, covered and recall of each class."""
    best = boxes.covered(truth.select("frame_id", column, "x1", "y1", "x2", "y2"), regions, share=covered)
    return best.groupBy(column).agg(F.count("*").alias("support"), F.count_if("hit").alias("covered")).withColumn("recall", ratio(F.col("covered"), F.col("support")))


def by_source(truth: DataFrame, regions: DataFrame, frame: str = "frame_id", covered: float = COVERED) -> DataFrame:
    """Recall by class, by source class and overall, and of each source of regions (every source of a region counts), in one pass each: dimension, value, support, covered, recall."""
    from spanveil.functions import geometry as geo

    xy = ("x1", "y1", "x2", "y2")
    met = grid.found(truth.select(frame, "id", "class", "source_class", *xy), regions.select(frame, "sources", *xy), lambda t, r: geo.coverage(r, t) >= covered, lambda r: r["sources"], frame, "by")
    best = met.withColumn("hit", F.lit(covered <= 0) | F.coalesce(F.size("by") > 0, F.lit(False)))
    sums = best.groupingSets([[F.col("class")], [F.col("source_class")], []], F.col("class"), F.col("source_class")).agg(F.count("*").alias("support"), F.count_if("hit").alias("covered"), F.grouping("class").alias("_c"), F.grouping("source_class").alias("_s"))
    name = F.when(F.col("_c") == 0, "class").when(F.col("_s") == 0, "source_class").otherwise("all")
    own = sums.select(name.alias("dimension"), F.coalesce("class", "source_class", F.lit("all")).alias("value"), "support", "covered")
    each = met.select(frame, "id", *xy, F.explode(F.flatten("by")).alias("value")).distinct().groupBy("value").agg(F.count("*").alias("covered"))
    # as many rows as there are sources, against one number
    support = truth.agg(F.count("*").alias("support"))
    sources = regions.select(F.explode("sources").alias("value")).distinct().join(each, "value", "left").crossJoin(support)
    rows = own.unionByName(sources.select(F.lit("source").alias("dimension"), "value", "support", F.coalesce("covered", F.lit(0)).alias("covered")))
    return rows.withColumn("recall", ratio(F.col("covered"), F.col("support")))


def detector_report(frames: DataFrame, truth: DataFrame, regions: DataFrame, frame: str = "frame_id", covered: float = COVERED) -> DataFrame:
    """Support, covered, missed and recall by class and by the frames' page_type, and each page type's false proposals: regions that cover no true box."""
    from spanveil.functions import geometry as geo

    xy = ("x1", "y1", "x2", "y2")
    best = boxes.covered(truth.select(frame, "class", *xy), regions, frame, covered).join(frames.select(frame, "page_type"), frame)
    sums = best.groupingSets([[F.col("class")], [F.col("page_type")]], F.col("class"), F.col("page_type")).agg(F.count("*").alias("support"), F.count_if("hit").alias("covered"), F.grouping("class").alias("_c"))
    own = sums.select(F.when(F.col("_c") == 0, "class").otherwise("page_type").alias("dimension"), F.coalesce("class", "page_type").alias("value"), "support", "covered")
    met = grid.found(regions.select(frame, "id", *xy), truth.select(frame, *xy), lambda r, t: geo.coverage(r, t) >= covered, lambda t: F.lit(True), frame, "right")
    one = met.groupBy(frame, "id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.size("right") > 0), F.lit(False)).alias("right"))
    wrong = one.where(~F.col("right") | F.col("id").isNull()).join(frames.select(frame, "page_type"), frame).groupBy(F.col("page_type").alias("value")).agg(F.sum("n").alias("false_proposals")).withColumn("dimension", F.lit("page_type"))
    j = own.join(wrong, ["dimension", "value"], "full_outer").fillna(0, ["support", "covered", "false_proposals"])
    return j.withColumn("missed", F.col("support") - F.col("covered")).withColumn("recall", ratio(F.col("covered"), F.col("support")))


def sliced(rows: DataFrame, slices: dict[str, Column], **measures: Column) -> DataFrame:
    """Measures of several slices (by name: which rows) in one pass over the rows: slice, n and each measure (a sum of a column over the slice)."""
    sums = [F.struct(F.lit(k).alias("slice"), F.count_if(F.coalesce(test, F.lit(False))).alias("n"), *[F.coalesce(F.sum(F.when(test, m)), F.lit(0)).alias(name) for name, m in measures.items()]) for k, test in slices.items()]
    return rows.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def path_saves(truth: DataFrame, regions: DataFrame, frame: str = "frame_id", covered: float = COVERED) -> DataFrame:
    """Which path (visual, ocr, fused; column ``path``) covers each true box, summed up."""
    from spanveil.functions import geometry as geo

    xy = ("x1", "y1", "x2", "y2")
    met = grid.found(truth.select(frame, "id", "class", *xy), regions.select(frame, "path", *xy), lambda t, r: geo.coverage(r, t) >= covered, lambda r: r["path"], frame, "by")
    has = lambda p: F.coalesce(F.bool_or(F.array_contains("by", p)), F.lit(False)).alias(p)
    each = met.groupBy(frame, "id", "class").agg(has("visual"), has("ocr"), has("fused"))
    v, o, f = F.col("visual"), F.col("ocr"), F.col("fused")
    secret = F.col("class").isin(*rules.SECRET_CLASSES)
    return each.agg(
        F.count_if(f & v & ~o).alias("visual_only_saves"),
        F.count_if(f & o & ~v).alias("ocr_only_saves"),
        F.count_if((v | o) & ~f).alias("fusion_regressions"),
        F.count_if((v | o) & ~f & secret).alias("secret_fusion_regressions"),
    )


def threshold_sweep(scored: DataFrame, score: str = "score", truth: str = "truth", by: tuple[str, ...] = (), steps: int = 91) -> DataFrame:
    """Precision, recall and F2 at each threshold from 0.05 to 0.95.

    Scores are counted by the highest threshold that they reach (one partial
    aggregate of at most ``steps`` + 1 groups), then summed from above: the rows
    never meet the thresholds in a join.
    """
    # the k-th threshold is 0.05 + k / 100; a score reaches those up to its own place
    at = lambda k: F.round(F.lit(0.05) + k * (0.9 / (steps - 1)), 10)
    k = F.floor((F.col(score) - 0.05) / (0.9 / (steps - 1)) + 1e-9)
    place = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), k)).cast("int").alias("k")
    bins = scored.groupBy(*by, place).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    groups = bins.groupBy(*by).agg(F.sum("p").alias("all_p"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("p", "n")))).alias("m"))
    sums = groups.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).select(
        *by,
        "k",
        "all_p",
        F.aggregate(F.filter(F.map_keys("m"), lambda x: x >= F.col("k")), F.lit(0).cast("long"), lambda a, x: a + F.col("m")[x]["p"]).alias("true_positive"),
        F.aggregate(F.filter(F.map_keys("m"), lambda x: x >= F.col("k")), F.lit(0).cast("long"), lambda a, x: a + F.col("m")[x]["n"]).alias("false_positive"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return (
        sums.withColumn("false_negative", F.col("all_p") - tp)
        .withColumn("threshold", at(F.col("k")))
        .withColumn("precision", tp / F.greatest(F.lit(1), tp + fp))
        .withColumn("recall", tp / F.greatest(F.lit(1), tp + fn))
        .withColumn("f2", 5 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-12), 4 * F.col("precision") + F.col("recall")))
        .select(*by, "threshold", "precision", "recall", "f2", "true_positive", "false_positive", "false_negative")
    )


def choose_threshold(sweep: DataFrame, target_recall: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Of the thresholds that meet the recall the most precise (then F2, then the highest), else the one of the best F2 (then recall, then the lowest)."""
    row = F.struct("threshold", "precision", "recall", "f2", "true_positive", "false_positive", "false_negative")
    meets = F.col("recall") >= target_recall
    g = sweep.groupBy(*by).agg(
        F.max_by(row, F.when(meets, F.struct("precision", "f2", "threshold"))).alias("a"),
        F.max_by(row, F.struct("f2", "recall", (-F.col("threshold")).alias("t"))).alias("b"),
        F.bool_or(meets).alias("met_target"),
    )
    return g.select(*by, F.when(F.col("met_target"), F.col("a")).otherwise(F.col("b")).alias("r"), "met_target").select(*by, "r.*", "met_target", F.lit(target_recall).alias("target_recall"))


def confusion(pairs: DataFrame, truth: str = "truth_class", predicted: str = "predicted_class") -> DataFrame:
    """Counts by true and predicted class; what has no partner is MISSED or SPURIOUS."""
    return pairs.groupBy(F.coalesce(truth, F.lit("SPURIOUS")).alias("truth_class"), F.coalesce(predicted, F.lit("MISSED")).alias("predicted_class")).agg(F.count("*").alias("n"))


def entity_pairs(truth: DataFrame, predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """True and predicted spans of a text, paired by falling overlap share, each once; then what is left of both."""
    kind = truth.schema[key].dataType.simpleString()

    def run(k: object, t: list[dict], p: list[dict]) -> list[tuple]:
        cand = []
        for i, a in enumerate(t):
            for j, b in enumerate(p):
                both = min(a["end"], b["end"]) - max(a["start"], b["start"])
                if both > 0:
                    cand.append((-both / (max(a["end"], b["end"]) - min(a["start"], b["start"])), i, j))
        ui: set[int] = set()
        uj: set[int] = set()
        out: list[tuple] = []
        for v, i, j in sorted(cand):
            if i not in ui and j not in uj:
                ui.add(i)
                uj.add(j)
                out.append((k, t[i]["label"], p[j]["label"], -v))
        out += [(k, x["label"], None, 0.0) for i, x in enumerate(t) if i not in ui]
        out += [(k, None, x["label"], 0.0) for j, x in enumerate(p) if j not in uj]
        return out

    cols = [key, "start", "end", "label"]
    return per_pair(truth.select(*cols), predicted.select(*cols), key, run, f"{key} {kind}, truth_class string, predicted_class string, overlap double")


def entity_scores(truth: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("doc_id", "start", "end", "label")) -> DataFrame:
    """Exact-match precision, recall and F1 of each label."""
    t = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    n = t.join(p, list(keys), "full_outer").groupBy("label").agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def safety_score(scores: DataFrame, critical: tuple[str, ...] = rules.SECRET_CLASSES) -> DataFrame:
    """0.7 of the support-weighted recall and 0.3 of the least recall of a critical class."""
    support = F.col("tp") + F.col("fn")
    g = scores.agg(ratio(F.sum(F.col("recall") * support), F.sum(support)).alias("weighted"), F.coalesce(F.min(F.when(F.col("label").isin(*critical), F.col("recall"))), F.lit(0.0)).alias("least"))
    return g.select("weighted", "least", (0.7 * F.col("weighted") + 0.3 * F.col("least")).alias("safety_score"))


def safety_summary(metrics: DataFrame, by: tuple[str, ...] = ("epoch",), critical: tuple[str, ...] = rules.SECRET_CLASSES) -> DataFrame:
    """Least recall of the secret classes, mean recall of the others, mean precision."""
    secret = F.col("class").isin(*critical)
    return metrics.groupBy(*by).agg(F.min(F.when(secret, F.col("recall"))).alias("secret_recall_min"), F.avg(F.when(~secret, F.col("recall"))).alias("other_recall_mean"), F.avg("precision").alias("precision_mean"))


def align_classes(metrics: DataFrame, taxonomy: DataFrame, column: str = "class", values: tuple[str, ...] = ("recall", "precision")) -> DataFrame:
    """One row for each class of the taxonomy, 0 where there is no metric."""
    return taxonomy.join(metrics, column, "left").select(*taxonomy.columns, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def unknown_classes(metrics: DataFrame, taxonomy: DataFrame, column: str = "class") -> DataFrame:
    """Metrics of classes that the taxonomy lacks, or that are there twice."""
    twice = metrics.groupBy(column).count().where("count > 1").select(column, F.lit("duplicate").alias("problem"))
    return metrics.join(taxonomy, column, "left_anti").select(column, F.lit("unknown").alias("problem")).distinct().unionByName(twice)


def incumbent(epochs: DataFrame, floor: float = 0.0, by: str | None = None) -> DataFrame:
    """A fold over epochs: an epoch becomes the incumbent if its secret recall holds the high-water mark less 0.01 (and the floor) and its score is better.

    Each epoch's row tells whether it was taken, the incumbent and the mark after it.
    """
    x = F.struct("epoch", "secret_recall", "score")
    state = "struct<best:double,best_epoch:int,mark:double,out:array<struct<epoch:int,taken:boolean,best_epoch:int,mark:double>>>"
    start = F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(0.0)
    begin = F.struct(start[0].alias("best"), start[1].alias("best_epoch"), start[2].alias("mark"), F.array().cast("array<struct<epoch:int,taken:boolean,best_epoch:int,mark:double>>").alias("out")).cast(state)

    def step(a: Column, e: Column) -> Column:
        ok = (e["secret_recall"] >= floor) & (e["secret_recall"] >= a["mark"] - 0.01) & (a["best"].isNull() | (e["score"] > a["best"]))
        mark = F.greatest(a["mark"], e["secret_recall"])
        be = F.when(ok, e["epoch"]).otherwise(a["best_epoch"])
        row = F.struct(e["epoch"].cast("int").alias("epoch"), ok.alias("taken"), be.alias("best_epoch"), mark.alias("mark"))
        return F.struct(F.when(ok, e["score"]).otherwise(a["best"]).alias("best"), be.alias("best_epoch"), mark.alias("mark"), F.concat(a["out"], F.array(row)).alias("out")).cast(state)

    g = epochs.groupBy(*([by] if by else [])).agg(F.array_sort(F.collect_list(x)).alias("e"))
    return g.select(*([by] if by else []), F.explode(F.aggregate("e", begin, step, lambda a: a["out"])).alias("r")).select(*([by] if by else []), "r.*")


def agreement(a: DataFrame, b: DataFrame, key: str, column: str = "scores") -> DataFrame:
    """How far two models' score vectors agree: same best class, mean and greatest absolute difference."""
    j = a.select(key, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("y")), key)
    d = F.zip_with("x", "y", lambda u, v: F.abs(u - v))
    each = j.select((rules.argmax(F.col("x")) == rules.argmax(F.col("y"))).alias("same"), F.aggregate(d, F.lit(0.0), lambda s, v: s + v).alias("sum"), F.size(d).alias("n"), F.array_max(d).alias("top"))
    return each.agg(F.avg(F.col("same").cast("double")).alias("argmax_agreement"), (F.sum("sum") / F.sum("n")).alias("mean_abs_error"), F.max("top").alias("max_abs_error"))


def gates(metrics: DataFrame, required: list[tuple[str, str, float]]) -> DataFrame:
    """Named checks of a one-row table of metrics: (name, ">=" or "<=" or "=", required value), each with its actual value and whether it passed."""
    checks = [F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("actual"), F.lit(op).alias("op"), F.lit(float(v)).alias("required")) for n, op, v in required]
    rows = metrics.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
    passed = F.when(F.col("op") == ">=", F.col("actual") >= F.col("required")).when(F.col("op") == "<=", F.col("actual") <= F.col("required")).otherwise(F.col("actual") == F.col("required"))
    return rows.withColumn("passed", F.coalesce(passed, F.lit(False)))


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failed"))


def merged_probabilities(windows: DataFrame) -> DataFrame:
    """Tokens of overlapping windows as one: the greatest score of each class at each place (record_index, start, end, scores)."""
    x = windows.select("record_index", "start", "end", F.posexplode("scores").alias("c", "s"))
    m = x.groupBy("record_index", "start", "end", "c").agg(F.max("s").alias("s"))
    return m.groupBy("record_index", "start", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "s"))), lambda v: v["s"]).alias("scores"))


def label_sequence(tokens: DataFrame, classes: list[str], threshold: float = 0.5) -> DataFrame:
    """B- and I- labels of merged tokens: the best class that passes (ties: the first), I- right after its like."""
    names = F.array(*[F.lit(c) for c in classes])
    best = F.when(F.array_max("scores") >= threshold, F.element_at(names, rules.argmax(F.col("scores")) + 1))
    w = Window.partitionBy("record_index").orderBy("start", "end")
    t = tokens.withColumn("class", best)
    return t.withColumn("label", F.when(F.col("class").isNull(), "O").when(F.lag("class").over(w) == F.col("class"), F.concat(F.lit("I-"), "class")).otherwise(F.concat(F.lit("B-"), "class"))).drop("class")


def align_offsets(tokens: DataFrame, spans: DataFrame, key: str = "record_index") -> DataFrame:
    """Each token's BIO label by the gold span that it overlaps most."""
    s = spans.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("label").alias("_l"))
    over = F.least(F.col("end"), F.col("_e")) - F.greatest(F.col("start"), F.col("_s"))
    j = tokens.join(s, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), "left")
    g = j.groupBy(key, "start", "end").agg(F.max_by(F.struct("_l", "_s"), F.when(F.col("_k").isNotNull(), F.struct(over.alias("o"), (-F.col("_s")).alias("n")))).alias("b"))
    w = Window.partitionBy(key).orderBy("start", "end")
    same = (F.lag("b").over(w)["_s"] == F.col("b._s")) & (F.lag("b").over(w)["_l"] == F.col("b._l"))
    return g.select(key, "start", "end", F.when(F.col("b._l").isNull(), "O").otherwise(F.concat(F.when(F.coalesce(same, F.lit(False)), "I-").otherwise("B-"), F.col("b._l"))).alias("label"))


def adequacy(frames: DataFrame, truth: DataFrame, frame: str = "frame_id") -> DataFrame:
    """How much a data set holds: records, true boxes, secrets, hard negatives, families."""
    t = truth.groupBy(frame).agg(F.count("*").alias("n"), F.count_if(F.col("class").isin(*rules.SECRET_CLASSES)).alias("s"))
    j = frames.join(t, frame, "left")
    return j.agg(F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("truth"), F.coalesce(F.sum("s"), F.lit(0)).alias("secrets"), F.count_if(F.col("n").isNull()).alias("hard_negatives"), F.count_distinct("page_type").alias("families"))


def backend_status(required: DataFrame, done: DataFrame) -> DataFrame:
    """passed, failed or pending of each required backend, and its errors."""
    return required.join(done, "backend", "left").select("backend", F.when(F.col("ok").isNull(), "pending").when(F.col("ok"), "passed").otherwise("failed").alias("status"), F.filter(F.array(F.when(~F.col("ok"), F.col("error"))), lambda e: e.isNotNull()).alias("errors"))


def compare_counts(actual: DataFrame, manifest: DataFrame, columns: list[str]) -> DataFrame:
    """Recomputed figures against a manifest's: name, actual, expected and whether they are the same (nulls too)."""
    side = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias(name)) for c in columns])).alias("x")).select("x.*")
    return side(actual, "actual").join(side(manifest, "expected"), "name").withColumn("same", F.col("actual").eqNullSafe(F.col("expected")))


def onoff(results: DataFrame) -> DataFrame:
    """Runs by mode: how many, how many exposed values, how many hold all their assertions, median and wall time."""
    return results.groupBy("mode").agg(F.count("*").alias("runs"), F.sum("exposed").alias("exposed"), F.count_if(F.forall(F.map_values("assertions"), lambda x: x)).alias("verified"), F.round(F.median("ms"), 3).alias("median_ms"), F.sum("ms").alias("wall_ms"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
