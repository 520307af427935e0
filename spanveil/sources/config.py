"""Configuration documents as checked tables: policies, review criteria and label lists; a file that breaks a rule is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import rules

# The longest guidance, the most rules and the longest of them, and the bounds of a review.
GUIDANCE, RULES, RULE = 2000, 20, 500
THRESHOLD, WINDOW = (3, 100), (8, 1000)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files: path and text. Spark's reader takes them, so they may be in any store."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def checked(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """rows, if there is no problem (columns path and problem); else an error that tells the first few."""
    bad = problems.orderBy("path", "problem").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['path']}: {r['problem']}" for r in bad))
    return rows


def _no_object(docs: DataFrame, what: str) -> DataFrame:
    kind = F.schema_of_variant(F.try_parse_json("text"))
    return docs.where(~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).select("path", F.lit(f"{what} is no JSON object").alias("problem"))


def policy_problems(docs: DataFrame) -> DataFrame:
    """What is wrong with policy documents (path, text): they are objects of class names to levels."""
    bad = F.when(F.col("kind") != "string", F.concat(F.col("name"), F.lit(" is no text"))).when(~F.col("text").isin(*rules.LEVELS), F.concat(F.col("name"), F.lit(" has no level "), F.col("text")))
    return _no_object(docs, "policy").unionByName(_entries(docs).select("path", bad.alias("problem")).where(F.col("problem").isNotNull()))


def _entries(docs: DataFrame) -> DataFrame:
    """The members of each document's object: path, name, kind and text."""
    d = docs.select("path", F.try_parse_json("text").alias("v")).where("v IS NOT NULL")
    m = F.col("value")
    e = d.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer())).where(F.col("key").isNotNull())
    return e.select("path", F.col("key").alias("name"), F.lower(F.regexp_extract(F.schema_of_variant(m), "^[A-Z]+", 0)).alias("kind"), F.try_variant_get(m, "$", "string").alias("text"))


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """Classes and levels of policy files: path, pii_class, level, over the built-in ones."""
    docs = documents(spark, path)
    own = checked(_entries(docs), policy_problems(docs)).select("path", rules.normal_class(F.col("name")).alias("pii_class"), F.col("text").alias("level"))
    base = docs.select("path", F.explode(rules.mapping(rules.POLICY)).alias("pii_class", "_base"))
    return own.join(base, ["path", "pii_class"], "full_outer").select("path", "pii_class", F.coalesce("level", "_base").alias("level"))


def criteria_problems(docs: DataFrame) -> DataFrame:
    """What is wrong with review criteria (path, text)."""
    d = docs.join(_no_object(docs, "criteria"), "path", "left_anti").select("path", F.try_parse_json("text").alias("v"))
    v = F.col("v")
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    classes, said = F.try_variant_get(v, "$.classes", "map<string,variant>"), F.try_variant_get(v, "$.global_rules", "array<variant>")
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    words = lambda x: F.try_variant_get(x, "$", "string")
    names = F.transform(F.map_keys(classes), lambda k: F.upper(F.trim(k)))
    unknown = F.filter(names, lambda k: ~k.isin(*rules.POLICY))
    guidance = F.exists(F.map_values(classes), lambda x: ~is_text(x) | (F.trim(words(x)) == "") | (F.length(words(x)) > GUIDANCE))
    ruled = F.exists(said, lambda x: ~is_text(x) | (F.trim(words(x)) == "") | (F.length(words(x)) > RULE))

    def whole(p: str, most: int):
        x = F.try_variant_get(v, p, "long")
        there = kind(p).isNotNull()
        return there & ~F.coalesce((kind(p) == "BIGINT") & x.between(1, most), F.lit(False))

    no = lambda c: F.coalesce(c, F.lit(False))
    problem = F.array_compact(
        F.array(
            F.when(~no((kind("$.version") == "BIGINT") & (F.try_variant_get(v, "$.version", "long") == 1)), "version is not 1"),
            F.when(kind("$.classes").isNotNull() & classes.isNull(), "classes is no object"),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown class "), F.get(unknown, F.lit(0)))),
            F.when(no(guidance), "guidance is no text, or too long"),
            F.when(kind("$.global_rules").isNotNull() & (said.isNull() | (F.size(said) > RULES)), f"global_rules is no list of {RULES} at most"),
            F.when(no(ruled), "a global rule is no text, or too long"),
            F.when(kind("$.trace_review").isNotNull() & ~no(kind("$.trace_review").startswith("OBJECT")), "trace_review is no object"),
            F.when(no(whole("$.trace_review.denied_resolution_threshold", THRESHOLD[1])), "denied_resolution_threshold is out of bounds"),
            F.when(no(whole("$.trace_review.window_steps", WINDOW[1])), "window_steps is out of bounds"),
        )
    )
    return _no_object(docs, "criteria").unionByName(d.select("path", F.explode(problem).alias("problem")))


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """Review criteria: path, guidance (class to text), rules, threshold and window."""
    docs = documents(spark, path)
    v = F.try_parse_json("text")
    trimmed = F.transform(F.coalesce(F.try_variant_get(v, "$.global_rules", "array<string>"), F.array().cast("array<string>")), lambda r: F.trim(r))
    classes = F.coalesce(F.try_variant_get(v, "$.classes", "map<string,string>"), F.create_map().cast("map<string,string>"))
    named = F.transform_values(F.transform_keys(classes, lambda k, _: F.upper(F.trim(k))), lambda _, x: F.trim(x))
    number = lambda p, d: F.coalesce(F.try_variant_get(v, f"$.trace_review.{p}", "int"), F.lit(d))
    rows = docs.select("path", named.alias("guidance"), trimmed.alias("rules"), number("denied_resolution_threshold", THRESHOLD[0]).alias("threshold"), number("window_steps", WINDOW[0]).alias("window"))
    return checked(rows, criteria_problems(docs))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label lists: path, labels, entity_classes, secret_classes, contextual_classes; labels must be O, then B- and I- of every class in order."""
    docs = documents(spark, path)
    v = F.try_parse_json("text")
    names = ("labels", "entity_classes", "secret_classes", "contextual_classes")
    rows = docs.select("path", *[F.try_variant_get(v, f"$.{c}", "array<string>").alias(c) for c in names])
    want = F.concat(F.array(F.lit("O")), F.flatten(F.transform("entity_classes", lambda c: F.array(F.concat(F.lit("B-"), c), F.concat(F.lit("I-"), c)))))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in names]))
    problem = F.when(F.size(missing) > 0, F.concat(F.lit("no list of "), F.array_join(missing, ", "))).when(F.col("labels") != want, F.lit("labels are not O, then B- and I- of every class in order"))
    return checked(rows, rows.select("path", problem.alias("problem")).where(F.col("problem").isNotNull()))
