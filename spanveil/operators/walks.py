"""Walks through JSON documents of any depth, level by level, without Python: nodes, texts, token references, forbidden fields, tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint
from spanveil.operators.vault import REFERENCE


def nodes(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Every node of each document: key, path, name (null in arrays and at the top), kind and value (a variant).

    A level is one explode of the level above, kept; as many levels as the deepest document has. Documents that do not
    parse (or repeat a name in one object) have no nodes; see ``broken``.
    """
    spark = docs.sparkSession
    v = F.try_parse_json(F.col(column).cast("string"))
    level = docs.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), v.alias("value")).where("value IS NOT NULL")
    out = []
    while True:
        out.append(level)
        up = level.select("key", F.col("path").alias("up"), "value")
        below = up.withColumnRenamed("value", "whole").lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        path = F.when(F.col("key0").isNull(), F.concat("up", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("up", F.lit("."), "key0"))
        level = checkpoint(below.toDF("key", "up", "whole", "pos", "key0", "value").select("key", path.alias("path"), F.col("key0").alias("name"), "value"))
        if level.isEmpty():
            break
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    kind = F.lower(F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0))
    return rows.select(F.col("key").alias(key), "path", "name", kind.alias("kind"), "value")


def broken(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of the documents that are no JSON."""
    return docs.where(F.col(column).isNotNull() & F.try_parse_json(F.col(column).cast("string")).isNull()).select(key)


def texts(docs: DataFrame, key: str, column: str = "action") -> DataFrame:
    """Every text of each document with its path."""
    return nodes(docs, key, column).where("kind = 'string'").select(key, "path", F.variant_get("value", "$", "string").alias("value"))


def references(docs: DataFrame, key: str, column: str = "action") -> DataFrame:
    """The tokens that a document's texts name, bare or in marks, each once a path."""
    found = F.transform(F.regexp_extract_all("value", F.lit(REFERENCE), F.lit(0)), lambda m: F.regexp_replace(m, r"[«»\s]", ""))
    return texts(docs, key, column).select(key, "path", F.explode(F.array_distinct(found)).alias("token"))


#: Names of fields that no report may have.
FORBIDDEN = r"(?i)^(?:text|recognizedText|ocrText|value|inputPath|outputPath|fileName|filename)$"


def forbidden(docs: DataFrame, key: str, column: str, names: str = FORBIDDEN) -> DataFrame:
    """Paths of fields whose name is forbidden, at any depth."""
    return nodes(docs, key, column).where(F.col("name").rlike(names)).select(key, "path")


def objects(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Every object of each document with its path."""
    return nodes(docs, key, column).where("kind = 'object'").select(key, "path", "value")


def tool_names(document: Column) -> Column:
    """The tools that a request declares, sorted: of each item of ``tools`` the function's name, or its own where it has no function."""
    tools = F.try_variant_get(F.try_parse_json(document), "$.tools", "array<variant>")
    kind = lambda v, p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    text = lambda v, p: F.when(kind(v, p) == "STRING", F.try_variant_get(v, p, "string"))
    name = lambda v: F.when(kind(v, "$.function").startswith("OBJECT"), text(v, "$.function.name")).otherwise(text(v, "$.name"))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(tools, F.array().cast("array<variant>")), name))))


def system_text(document: Column) -> Column:
    """The contents of a request's system messages, a line each."""
    said = F.coalesce(F.try_variant_get(F.try_parse_json(document), "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    system = F.filter(said, lambda m: F.coalesce(F.try_variant_get(m, "$.role", "string") == "system", F.lit(False)))
    return F.array_join(F.transform(system, lambda m: F.coalesce(F.try_variant_get(m, "$.content", "string"), F.lit(""))), "\n")


def _number(v: Column, path: str) -> Column:
    """A number of 0 or more, or null: numbers, numeric texts and booleans; a JSON null counts as 0."""
    x = F.when(F.is_variant_null(F.try_variant_get(v, path, "variant")), F.lit(0.0)).otherwise(F.try_variant_get(v, path, "double"))
    return F.when((x >= 0) & (x < float("inf")), x)


def _texts(v: Column, path: str, width: int) -> Column:
    return F.transform(F.try_variant_get(v, path, "array<string>"), lambda s: F.substring(F.coalesce(s, F.lit("null")), 1, width))


def _region(r: Column) -> Column:
    number = lambda c: _number(r, f"$.{c}").alias(c)
    label = F.substring(F.coalesce(F.try_variant_get(r, "$.label", "string"), F.lit("UNKNOWN")), 1, 120)
    return F.struct(number("x1"), number("y1"), number("x2"), number("y2"), label.alias("label"), _texts(r, "$.labels", 120).alias("labels"), _texts(r, "$.sources", 120).alias("sources"), number("score"))


def normalised_reports(docs: DataFrame, key: str, column: str, exact: dict[str, str], positive: tuple[str, ...] = (), amounts: tuple[str, ...] = (), lists: tuple[str, ...] = (), maps: tuple[str, ...] = (), regions: tuple[str, ...] = ()) -> DataFrame:
    """Reports reduced to what may be kept, or the first thing that is wrong with each.

    exact: paths and the text that must stand there; positive: whole numbers above 0; amounts: finite numbers of 0 or
    more; lists: arrays of texts (cut to 500); maps: objects of plain names to amounts; regions: arrays of boxes.
    Paths are dotted. Columns: key, problem, and (where there is none) numbers, texts, amounts by map, regions.
    """
    d = docs.select(F.col(key), F.try_parse_json(F.col(column).cast("string")).alias("_v"))
    v = F.col("_v")
    at = lambda p: f"$.{p}"
    parts = {p: F.try_variant_get(v, at(p), "array<variant>") for p in regions}
    boxes = {p: F.transform(x, _region) for p, x in parts.items()}
    sums = {p: F.try_variant_get(v, at(p), "map<string,variant>") for p in maps}
    amount = {p: F.transform_values(x, lambda _, y: _number(y, "$")) for p, x in sums.items()}
    bad_box = lambda r: r["x1"].isNull() | r["y1"].isNull() | r["x2"].isNull() | r["y2"].isNull() | r["score"].isNull() | r["labels"].isNull() | r["sources"].isNull()
    tests = [("report", v.isNull())]
    tests += [(p, ~F.coalesce(F.try_variant_get(v, at(p), "string") == want, F.lit(False))) for p, want in exact.items()]
    tests += [(p, ~F.coalesce((_number(v, at(p)) > 0) & (F.floor(_number(v, at(p))) == _number(v, at(p))), F.lit(False))) for p in positive]
    tests += [(p, _number(v, at(p)).isNull()) for p in amounts]
    tests += [(p, _texts(v, at(p), 500).isNull()) for p in lists]
    tests += [(p, F.coalesce(sums[p].isNull() | F.exists(F.map_entries(amount[p]), lambda e: e["value"].isNull() | ~e["key"].rlike("^[A-Za-z][A-Za-z0-9]*$")), F.lit(True))) for p in maps]
    tests += [(p, F.coalesce(parts[p].isNull() | F.exists(boxes[p], bad_box), F.lit(True))) for p in regions]
    problem = F.coalesce(*[F.when(bad, F.lit(p)) for p, bad in tests], F.lit(None).cast("string"))
    named = lambda pairs, kind: F.when(F.col("problem").isNull(), F.map_from_arrays(F.array(*[F.lit(p) for p, _ in pairs]), F.array(*[x for _, x in pairs])) if pairs else F.create_map().cast(kind))
    return d.withColumn("problem", problem).select(
        key,
        "problem",
        named([(p, _number(v, at(p))) for p in (*positive, *amounts)], "map<string,double>").alias("numbers"),
        named([(p, _texts(v, at(p), 500)) for p in lists], "map<string,array<string>>").alias("texts"),
        named(list(amount.items()), "map<string,map<string,double>>").alias("amounts"),
        named(list(boxes.items()), "map<string,array<struct<x1:double,y1:double,x2:double,y2:double,label:string,labels:array<string>,sources:array<string>,score:double>>>").alias("regions"),
    )
