"""Contracts of data sets, reports, models, tools and logs: each check says what is wrong, as rows or as a column that is null where all is well."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.cluster import numbered
from spanveil.functions import rules
from spanveil.operators import spans

#: Keys of a call that name the tool, and those that are never executed.
TOOL_KEYS = ("tool_name", "name", "id", "action", "type")
THOUGHT_KEYS = ("thought", "reasoning", "note", "notes", "explanation", "rationale")
#: What semantic operations there are, and how many tokens they take.
KINDS = ("sort", "select")
LEAST_TOKENS, MOST_TOKENS, MOST_WORDS = 2, 40, 2000
#: Channels of a probe, best first, and what is left without any.
CHANNELS = ("native_skill", "structured_action", "free_text_marker")
NO_CHANNEL = "proxy_app_pseudo_tool"

#: Named detection engines: text column to an array of spans.
ENGINES = {"rules": spans.detect}


def engine(name: str):
    """The engine of a name; an unknown one is an error, never another engine."""
    if name not in ENGINES:
        raise ValueError(f"unknown engine: {name}")
    return ENGINES[name]


def _first(*cases: tuple[str, Column]) -> Column:
    """The name of the first case that holds, or null; a case that is null does not hold."""
    out = F.lit(None).cast("string")
    for name, when in reversed(cases):
        out = F.when(F.coalesce(when, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def box_problem(x: Column, y: Column, w: Column, h: Column, visible: Column, clipped: Column, width: Column, height: Column) -> Column:
    """What is wrong with an element's box and its flags; null if they agree."""
    odd = [c.isNull() | F.isnan(c.cast("double")) | (F.abs(c) == float("inf")) for c in (x, y, w, h)]
    meets = (x + w > 0) & (y + h > 0) & (x < width) & (y < height)
    beyond = (x < 0) | (y < 0) | (x + w > width) | (y + h > height)
    return _first(
        ("invalid", odd[0] | odd[1] | odd[2] | odd[3]),
        ("empty", (w <= 0) | (h <= 0)),
        ("flags", visible.isNull() | clipped.isNull()),
        ("visible_outside", visible & ~meets),
        ("clipped_disagrees", visible & (clipped != beyond)),
        ("invisible_inside", ~visible & meets),
        ("clipped_off_screen", ~visible & clipped),
    )


def elements(text: Column, count: Column, kind: str) -> Column:
    """A struct (elements, problem) of a JSON list of objects (DDL ``kind``) that must hold ``count`` of them."""
    # members as variants: nested ones stay what they are, and neither null nor a bare object counts as a list of objects
    whole = F.try_parse_json(text)
    shape = F.when(F.schema_of_variant(whole).startswith("ARRAY"), F.try_variant_get(whole, "$", "array<variant>"))
    bad = shape.isNull() | F.exists(shape, lambda x: ~F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    problem = F.when(F.coalesce(bad, F.lit(True)), "invalid").when(~F.coalesce(count == F.size(shape), F.lit(False)), "count")
    return F.struct(F.when(problem.isNull(), F.from_json(text, f"array<{kind}>")).alias("elements"), problem.alias("problem"))


def sensitivity_gate(findings: DataFrame, profile: str = "balanced") -> DataFrame:
    """Findings to mask: sensitive ones, uncertain ones with the profile high-recall only; the score is the greatest of the detector, the reader and the values, and what has no label is UNREADABLE."""
    keep = F.col("sensitive") & (~F.col("uncertain") | F.lit(profile == "high-recall"))
    labels = F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit("UNREADABLE")))
    score = F.greatest("detector_score", "ocr_confidence", F.array_max("value_scores"))
    return findings.where(F.coalesce(keep, F.lit(False))).withColumn("labels", labels).withColumn("label", F.array_join("labels", " + ")).withColumn("score", score)


def executed(path: Column) -> Column:
    """Whether a text at a path of a call (as ``vault.walk`` gives it) is executed: thoughts and the tool's name are not, of a function its arguments only."""
    top = F.regexp_extract(path, r"^\$\.([^.\[]+)", 1)
    return ~top.isin(*TOOL_KEYS, *THOUGHT_KEYS) & ((top != "function") | path.rlike(r"^\$\.function\.arguments(?:$|[.\[])"))


def resolve_nested(docs: DataFrame, vault: DataFrame, key: str, column: str = "action") -> DataFrame:
    """JSON documents of any depth with the tokens of their texts as values, keys untouched; ``unknown`` lists tokens that no vault holds, whose documents stay as they are.

    Only the tokens that a document names travel to it. Documents that are no JSON stay as they are.
    """
    row = "resolve_row"
    while row in docs.columns:
        row += "_"
    from spanveil.cluster import checkpoint

    own = checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))
    named = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(rf"\b{rules.PLACEHOLDER}\b"), F.lit(0)))
    used = own.select(F.col(row).alias("r"), F.explode(named).alias("placeholder")).join(vault.select("placeholder", "value"), "placeholder", "left")
    have = used.groupBy("r").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("placeholder", "value")))).alias("have"),
        F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("placeholder")))).alias("unknown"),
    )
    import re

    token = re.compile(rf"\b{rules.PLACEHOLDER}\b")

    @F.pandas_udf("string")
    def rebuilt(texts: pd.Series, values: pd.Series) -> pd.Series:
        def put(x: object, by: dict) -> object:
            if isinstance(x, str):
                return token.sub(lambda m: by.get(m[0], m[0]), x)
            if isinstance(x, list):
                return [put(y, by) for y in x]
            if isinstance(x, dict):
                return {k: put(y, by) for k, y in x.items()}
            return x

        def one(text: str | None, by: object) -> str | None:
            try:
                return json.dumps(put(json.loads(text), dict(by)), ensure_ascii=False)
            except (TypeError, ValueError):
                return text

        return pd.Series([one(t, b) if b is not None else t for t, b in zip(texts, values, strict=True)], dtype=object)

    j = own.join(have, F.col(row) == F.col("r"), "left").withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))
    return j.withColumn("resolved", F.when(F.size("unknown") > 0, F.col(column)).otherwise(rebuilt(F.col(column), F.col("have")))).drop("have", "r", row)


def strip_block(text: Column, begin: str, end: str, prefix: str) -> Column:
    """A text without blocks between two marks and lines of a prefix, no white space at its end; null where a block is not closed."""
    q = _quoted
    bare = F.regexp_replace(text, f"(?s){q(begin)}.*?{q(end)}", "")
    lines = F.filter(F.split(bare, r"\r\n|\n|\r", -1), lambda x: ~x.startswith(prefix))
    return F.when(~F.contains(bare, F.lit(begin)), F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", ""))


def _quoted(text: str) -> str:
    """A text as a pattern that matches it alone."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def selected_assets(assets: DataFrame, names: tuple[str, ...] = (), groups: tuple[str, ...] = (), optional: bool = False) -> DataFrame:
    """Assets (name, group, default_fetch) asked for by name or group; without any request those that are fetched by default, or all."""
    if not names and not groups:
        return assets if optional else assets.where(F.coalesce("default_fetch", F.lit(True)))
    return assets.where(F.col("name").isin(*names) | F.col("group").isin(*groups))


def forbidden_fields(reports: DataFrame, key: str, column: str, fields: tuple[str, ...]) -> DataFrame:
    """Places of a JSON document of any depth at which a forbidden field stands: key, path. What cannot be read cannot be cleared: its place is the top."""
    from spanveil.operators import walks

    found = walks.nodes(reports, key, column).where(F.col("name").isin(*fields)).select(key, "path")
    return found.unionByName(walks.broken(reports, key, column).select(key, F.lit("$").alias("path")))


def deep_contract(documents: DataFrame, key: str, column: str, required: list[tuple[str, str, str]]) -> DataFrame:
    """Named checks of JSON manifests at any depth: (dotted path, test, value as text). Tests: ``=`` (the JSON value itself, lists in order), ``>=`` (a whole number), ``sha256`` (64 hex digits). key, name, actual, required, passed; a missing field fails, and a text is no number."""
    v = F.try_parse_json(F.col(column).cast("string"))
    checks = []
    for path, test, want in required:
        x = F.try_variant_get(v, f"$.{path}", "variant")
        actual = F.when(~F.is_variant_null(x), F.to_json(x)) if test == "=" else F.try_variant_get(x, "$", "string")
        kind = F.schema_of_variant(x)
        ok = {
            "=": F.to_json(x) == F.to_json(F.try_parse_json(F.lit(want))),
            ">=": (kind == "BIGINT") & (F.try_variant_get(x, "$", "long") >= (int(want) if test == ">=" else 0)),
            "sha256": (kind == "STRING") & F.try_variant_get(x, "$", "string").rlike("^[0-9a-f]{64}$"),
        }[test]
        checks.append(F.struct(F.lit(path).alias("name"), actual.alias("actual"), F.lit(f"{test} {want}".strip()).alias("required"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return documents.select(F.col(key), F.explode(F.array(*checks)).alias("c")).select(key, "c.*")


def label_row_problem(line: Column, annotation: Column, classes: list[str], width: Column, height: Column) -> Column:
    """What is wrong with a label line (class cx cy w h) and the annotation (class, bbox_xyxy) that it must be of; null if nothing."""
    p = F.split(F.trim(line), r"\s+")
    number = [F.get(p, i).try_cast("double") for i in range(5)]
    box = annotation["bbox_xyxy"]
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    at = [F.get(box, i) for i in range(4)]
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), annotation["class"]) - 1
    return _first(
        ("bbox", F.coalesce(F.size(box) != 4, F.lit(True))),
        ("number", ~(fine(at[0]) & fine(at[1]) & fine(at[2]) & fine(at[3]))),
        ("outside", ~F.coalesce((at[0] >= 0) & (at[0] < at[2]) & (at[2] <= width) & (at[1] >= 0) & (at[1] < at[3]) & (at[3] <= height), F.lit(False))),
        ("format", F.coalesce(F.size(p) != 5, F.lit(True))),
        ("numeric", ~(F.get(p, 0).try_cast("int").isNotNull() & fine(number[1]) & fine(number[2]) & fine(number[3]) & fine(number[4]))),
        ("class", ~F.coalesce(number[0] == place, F.lit(False))),
        ("range", ~(number[1].between(0, 1) & number[2].between(0, 1) & (number[3] > 0) & (number[3] <= 1) & (number[4] > 0) & (number[4] <= 1))),
    )


def label_file_problems(records: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """Problems of records (lines, annotations, width, height) and their label lines: key, line (from 1; 0: the numbers differ), problem."""
    n = F.size("lines") != F.size("annotations")
    rows = records.select(key, F.posexplode(F.arrays_zip("lines", "annotations")).alias("at", "z"), "width", "height").where(~n)
    own = rows.select(key, (F.col("at") + 1).alias("line"), label_row_problem(F.col("z.lines"), F.col("z.annotations"), classes, F.col("width"), F.col("height")).alias("problem"))
    return records.where(n).select(key, F.lit(0).alias("line"), F.lit("count").alias("problem")).unionByName(own.where(F.col("problem").isNotNull()))


def with_instructions(messages: Column, instructions: str, begin: str, end: str, prefix: str) -> Column:
    """Messages (role, content) with a block of instructions, once however often it is done.

    Earlier blocks and lines of the prefix go. The system messages become one, the first message, with the block at its end;
    without any, the block ends the last user message; without that the result is null.
    """
    block = F.lit(f"{begin}\n{instructions}\n{end}")
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    bare = F.transform(messages, lambda m: message(m["role"], strip_block(F.coalesce(m["content"], F.lit("")), begin, end, prefix)))
    broken = F.exists(bare, lambda m: m["content"].isNull())
    system = F.filter(bare, lambda m: m["role"] == "system")
    others = F.filter(bare, lambda m: ~F.coalesce(m["role"] == "system", F.lit(False)))
    said = F.filter(F.transform(system, lambda m: F.regexp_replace(m["content"], r"\s+$", "")), lambda c: F.trim(c) != "")
    top = F.array(message(F.lit("system"), F.array_join(F.array_append(said, block), "\n\n")))
    last = F.array_max(F.transform(others, lambda m, i: F.when(m["role"] == "user", i)))
    told = F.transform(others, lambda m, i: F.when(i == last, message(m["role"], F.concat_ws("\n\n", F.nullif(m["content"], F.lit("")), block))).otherwise(m))
    return F.when(~broken & (F.size(system) > 0), F.concat(top, others)).when(~broken & last.isNotNull(), told)


def contract(manifest: DataFrame, required: list[tuple[str, str]]) -> DataFrame:
    """Named checks of a manifest of one row: (field, required value as text) with the actual text and whether they are equal; a missing field fails."""
    have = set(manifest.columns)
    checks = [F.struct(F.lit(n).alias("name"), (F.col(n).cast("string") if n in have else F.lit(None).cast("string")).alias("actual"), F.lit(v).alias("required")) for n, v in required]
    return manifest.select(F.explode(F.array(*checks)).alias("c")).select("c.*").withColumn("passed", F.coalesce(F.col("actual") == F.col("required"), F.lit(False)))


def ready_models(listings: DataFrame, key: str, column: str = "listing") -> DataFrame:
    """Models of a provider's JSON listing that are neither unready nor inactive: key, id, label (the name, else the id)."""
    kind = "struct<data:array<struct<id:string,name:string,is_ready:boolean,is_active:boolean>>>"
    m = listings.select(key, F.explode(F.from_json(F.col(column), kind)["data"]).alias("m"))
    ok = (F.coalesce("m.id", F.lit("")) != "") & F.coalesce("m.is_ready", F.lit(True)) & F.coalesce("m.is_active", F.lit(True))
    return m.where(ok).select(key, F.col("m.id").alias("id"), F.coalesce(F.nullif("m.name", F.lit("")), "m.id").alias("label"))


def class_map_problems(names: DataFrame, by: str = "context", index: str = "index", name: str = "name") -> DataFrame:
    """What is wrong with each context's class names: by, problem. Indices must be 0 to n - 1, names there and distinct."""
    g = names.groupBy(by).agg(
        F.count("*").alias("n"), F.count_distinct(index).alias("places"), F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(name).alias("names"), F.count_if(F.coalesce(name, F.lit("")) == "").alias("blank")
    )
    cases = F.array(
        F.when(F.col("places") < F.col("n"), "duplicate_index"),
        F.when((F.col("low") != 0) | (F.col("high") != F.col("places") - 1), "not_contiguous"),
        F.when(F.col("blank") > 0, "invalid_name"),
        F.when((F.col("names") < F.col("n")) & (F.col("blank") == 0), "duplicate_name"),
    )
    return g.select(by, F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("problem"))


def unmapped(annotations: DataFrame, table: dict[str, str | None], key: str = "key") -> DataFrame:
    """Source keys that a disposition table does not name (it must be exhaustive), with their numbers; a null class in it is a decision, too."""
    return annotations.where(~F.coalesce(F.col(key).isin(*table), F.lit(False))).groupBy(key).agg(F.count("*").alias("n"))


def bracket_tokens(text: Column) -> Column:
    """The playground's tokens of a text, [CLASS_n], in order."""
    return F.regexp_extract_all(text, F.lit(r"(\[[A-Z][A-Z_]*_\d+\])"), F.lit(1))


def recommended_channel(results: DataFrame, by: str) -> DataFrame:
    """The first channel (of ``CHANNELS``) whose round trip worked, for each probe: by, channel."""
    order = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel"))
    good = F.when(F.col("permitted") & F.col("emitted") & F.col("round_trip"), order)
    return results.groupBy(by).agg(F.coalesce(F.min_by("channel", good), F.lit(NO_CHANNEL)).alias("channel"))


def process_table(lines: DataFrame, column: str = "line") -> DataFrame:
    """pid, pgid and command of the lines of a process listing; a line of another form has null ids and fails a caller's check."""
    p = r"^\s*(\d+)\s+(\d+)(?:\s+(.*?))?\s*$"
    part = lambda i: F.regexp_extract(column, p, i)
    return lines.select("*", F.nullif(part(1), F.lit("")).cast("long").alias("pid"), F.nullif(part(2), F.lit("")).cast("long").alias("pgid"), part(3).alias("command"))


def detached(processes: DataFrame, name: str, group: int | Column) -> DataFrame:
    """Processes whose command is a program of this name outside a process group."""
    return processes.where(F.col("command").endswith(f"/{name}") & (F.col("pgid") != (group if isinstance(group, Column) else F.lit(group))))


def catalogue(cached: DataFrame, presets: DataFrame, now: Column, ttl: float, key: str = "provider") -> DataFrame:
    """Each provider's models: the cached ones (models, live, at in seconds) while they are young enough, else the presets, which are not live."""
    c = cached.where(now - F.col("at") < ttl).select(key, F.col("models").alias("_m"), F.col("live").alias("_l"))
    return presets.join(c, key, "left").select(key, F.coalesce("_m", "models").alias("models"), F.coalesce("_l", F.lit(False)).alias("live"))


def hidden_sort(requests: DataFrame, vault: DataFrame, key: str) -> DataFrame:
    """Tokens in the order of their hidden values (case folded), then by token; null unless 2 to 40 distinct ones, all known. No value comes out."""
    from spanveil.operators.vault import casefold

    n = F.size("tokens")
    fine = n.between(LEAST_TOKENS, MOST_TOKENS) & (F.size(F.array_distinct("tokens")) == n)
    named = requests.where(fine).select(F.col(key).alias("k"), F.explode("tokens").alias("placeholder")).join(vault.select("placeholder", casefold("value").alias("v")), "placeholder", "left")
    g = named.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "placeholder"))), lambda x: x["placeholder"]).alias("sorted"), F.bool_and(F.col("v").isNotNull()).alias("known"))
    return requests.join(g, F.col(key) == F.col("k"), "left").withColumn("sorted", F.when(F.col("known"), F.col("sorted"))).drop("k", "known")


def request_problem(kind: Column, instruction: Column, tokens: Column, count: Column) -> Column:
    """What is wrong with a semantic request; null if nothing."""
    n = F.size(tokens)
    return _first(
        ("kind", ~F.coalesce(kind.isin(*KINDS), F.lit(False))),
        ("instruction", F.coalesce(F.trim(instruction) == "", F.lit(True)) | (F.length(instruction) > MOST_WORDS)),
        ("size", ~n.between(LEAST_TOKENS, MOST_TOKENS)),
        ("repeated", F.size(F.array_distinct(tokens)) != n),
        ("shape", F.exists(tokens, lambda t: ~t.rlike(f"^{rules.PLACEHOLDER}$"))),
        ("count", count.isNotNull() & ((kind != "select") | ~count.between(0, n))),
    )


def answer_problem(kind: Column, values: Column, returned: Column, count: Column) -> Column:
    """What is wrong with the reply to a semantic request; null if nothing."""
    n = F.size(returned)
    return _first(
        ("shape", returned.isNull()),
        ("unknown", F.size(F.array_except(returned, values)) > 0),
        ("repeated", F.size(F.array_distinct(returned)) != n),
        ("missing", (kind == "sort") & (n != F.size(values))),
        ("count", (kind == "select") & count.isNotNull() & (n != count)),
    )


def subset(rows: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """The first ``most`` rows of an order; all without a positive limit."""
    return rows.orderBy(*order).limit(most) if most and most > 0 else rows


def ratio_batches(boxes: DataFrame, order: list[str], size: int = 6) -> DataFrame:
    """boxes in order of their aspect ratio (1 at least), in batches of ``size``; equal ratios keep the given order."""
    ratio = F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")) / F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")))
    placed = numbered(boxes.withColumn("ratio", ratio), "ratio", *order, name="place")
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long"))


def unknown_rate(texts: DataFrame, vocabulary: DataFrame, column: str = "text") -> DataFrame:
    """tokens, unknown and their rate: words (of the texts) that a vocabulary (token) lacks; words are counted before they meet it."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    j = words.join(vocabulary.select("token", F.lit(True).alias("known")).distinct(), "token", "left")
    t = j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))
    return t.withColumn("rate", F.col("unknown") / F.greatest(F.lit(1), F.col("tokens")))


def iso_utc(at: Column) -> Column:
    """A time (of a UTC session) as ISO text with microseconds and offset."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def duration_ms(begin: Column, end: Column) -> Column:
    return F.round((end.cast("double") - begin.cast("double")) * 1000, 3)


def once(rows: DataFrame, column: str, name: str, fn) -> DataFrame:
    """rows with name = fn(column), computed once for each distinct value (what a cache of exact contents saves); null values stay null."""
    done = rows.select(F.col(column).alias("_v")).where(F.col("_v").isNotNull()).distinct().withColumn(name, fn(F.col("_v")))
    return rows.join(done, F.col(column) == F.col("_v"), "left").drop("_v")


def register(spark) -> list[str]:
    """The rule functions of one text as SQL functions of a session (tools by name)."""
    for name in ("tool_digits", "tool_collapse", "tool_redact"):
        if name == "tool_digits":
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN regexp_replace(t, '[^0-9]', '')")
        elif name == "tool_collapse":
            spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, '\\s+', ' '))")
        else:
            spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN regexp_replace(t, '(?i)(password|token|secret)=\\S+', '$1=[REDACTED]')")
    return ["tool_collapse", "tool_digits", "tool_redact"]
