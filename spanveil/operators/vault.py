"""Policy levels, session tokens, scrubbing, resolving and leak audits."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanveil.cluster import checkpoint, numbered
from spanveil.functions import rules
from spanveil.operators import spans as sp


def levels(labels: DataFrame, column: str = "label", policy: dict[str, str] | None = None) -> DataFrame:
    """labels with pii_class and level; unknown classes are blocked."""
    return labels.withColumn("pii_class", rules.normal_class(F.col(column))).withColumn("level", rules.level_of(F.col(column), policy))


def snapshot(spark, policy: dict[str, str] | None = None) -> DataFrame:
    """One row for each class of the policy: its place, class and level."""
    rows = [(i, k, v) for i, (k, v) in enumerate((rules.POLICY | (policy or {})).items())]
    return spark.createDataFrame(rows, "place int, pii_class string, level string")


def grouped_policy(policy: DataFrame) -> DataFrame:
    """For each level its classes in policy order, comma-joined."""
    return policy.groupBy("level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "pii_class"))), lambda x: x["pii_class"]), ",").alias("classes"))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility form (no built-in has it)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    """Full case folding (lower() keeps ß and the like)."""
    return texts.map(lambda t: None if t is None else t.casefold())


def tokens(found: DataFrame, order: list[str], nonce: str = "0000", policy: dict[str, str] | None = None, normalise: bool = False) -> DataFrame:
    """The vault: one row for each class and canonical value that may be kept, numbered by first sight.

    found has label and text (the value) and the order columns. Distinct values
    are made by a partial aggregate, so a value that fills a third of all rows is
    one row before any numbering.
    """
    value = nfkc("text") if normalise else F.col("text")
    rows = levels(found, policy=policy).where(F.col("level") != "blocked").withColumn("value", value).where(F.trim("value") != "")
    rows = rows.withColumn("canonical", rules.canonical(F.col("label"), F.col("value")))
    seen = F.struct(*order)
    first = rows.groupBy("pii_class", "canonical").agg(F.min(seen).alias("first_seen"), F.min_by("value", seen).alias("value"), F.count("*").alias("uses"))
    # sorted over the cluster: a class of very many values is no task of its own
    placed = numbered(first, "pii_class", "first_seen", "canonical", name="place")
    base = placed.groupBy("pii_class").agg((F.min("place") - 1).alias("base"))
    n = (F.col("place") - F.col("base")).cast("string")
    return placed.join(base, "pii_class").withColumn("placeholder", F.concat_ws("_", "pii_class", n, F.lit(nonce))).select("placeholder", "pii_class", "value", "canonical", "uses")


def scrub(docs: DataFrame, nonce: str = "0000", key: str = "doc_id", keep: tuple[str, ...] = rules.KEEP_LABELS, counters: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts with every rule span as its token (or a marker, if blocked), and the vault.

    Rows are told apart by a number of their own, so keys may be null or repeat:
    no row gets another's spans. It fails closed: a span without a token (a
    blocked class, a blank value) becomes a marker. Only rows with spans are kept
    and joined; a row without any passes through. A null text stays null.

    ``counters`` is filled by the first action on the texts, in the same pass: documents, changed, replaced and blocked
    (spans), tokens (replaced less blocked), and of each class of the policy its spans.
    """
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("found", "row", "by", "kinds"):
        while name in taken:
            name += "_"
        names.append(name)
    found, row, by, kinds = names
    d = docs.withColumn(found, sp.merge(F.filter(sp.detect(F.col("text")), lambda s: ~s["label"].isin(*keep))))
    some = F.coalesce(F.size(found), F.lit(0)) > 0
    hit = checkpoint(d.where(some).withColumn(row, F.monotonically_increasing_id()))  # kept, so the numbers hold
    flat = hit.select(F.col(key).alias("key"), F.col(row).alias("row"), F.explode(found).alias("s")).select("key", "row", "s.*")
    vault = checkpoint(tokens(flat, ["key", "start", "row"], nonce))
    marker = F.concat(F.lit("[BLOCKED_"), "pii_class", F.lit("]"))
    named = (
        levels(flat)
        .withColumn("canonical", rules.canonical(F.col("label"), F.col("text")))
        .join(vault.select("pii_class", "canonical", "placeholder"), ["pii_class", "canonical"], "left")
        .withColumn("by", F.when(F.col("level") == "blocked", marker).otherwise(F.coalesce("placeholder", marker)))
        .groupBy(F.col("row").alias(row))
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "by", "pii_class"))).alias(by))
    )
    done = hit.join(named, row).withColumn("scrubbed", sp.replaced(F.col("text"), F.col(by), lambda s: s["by"])).withColumn("n_replaced", F.size(by))
    clean = d.where(~some).withColumn("scrubbed", F.col("text")).withColumn("n_replaced", F.lit(0)).drop(found)
    if counters is None:
        return done.drop(found, row, by).unionByName(clean), vault
    kind = F.transform(by, lambda s: F.struct(s["pii_class"].alias("kind"), F.startswith(s["by"], F.lit("[BLOCKED_")).alias("blocked")))
    none = F.array().cast("array<struct<kind:string,blocked:boolean>>")
    out = done.withColumn(kinds, kind).drop(found, row, by).unionByName(clean.withColumn(kinds, none))
    n = lambda test: F.coalesce(F.sum(F.size(F.filter(kinds, test))), F.lit(0))
    counts = [F.count("*").alias("documents"), F.count_if(F.col("n_replaced") > 0).alias("changed"), n(lambda x: F.lit(True)).alias("replaced"), n(lambda x: x["blocked"]).alias("blocked"), n(lambda x: ~x["blocked"]).alias("tokens")]
    of = lambda c: lambda x: x["kind"] == c
    counts += [n(of(c)).alias(c) for c in rules.POLICY]
    counts += [n(lambda x: ~x["kind"].isin(*rules.POLICY)).alias("other")]
    return out.observe(counters, *counts).drop(kinds), vault


def replace_variants(text: Column, variants: list[tuple[str, str, str]]) -> Column:
    """A text with known values (value, placeholder, class) replaced, the longest first; names only as whole words, tokens untouched."""
    import re

    ordered = sorted(variants, key=lambda v: -len(v[0]))

    def plain(t: Column) -> Column:
        for value, token, kind in ordered:
            if kind == "NAME":
                t = F.regexp_replace(t, rf"(?U)(?<!\w){re.escape(value)}(?!\w)", token.replace("$", r"\$"))
            else:
                t = F.replace(t, F.lit(value), F.lit(token))
        return t

    shape = rf"\b{rules.PLACEHOLDER}\b"
    gaps = F.transform(F.split(text, shape, -1), plain)
    kept = F.concat(F.regexp_extract_all(text, F.lit(shape), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, kept, lambda a, b: F.concat(a, b)), "")


#: A token as it stands, or in its marks.
REFERENCE = rf"«\s*{rules.PLACEHOLDER}\s*»|\b{rules.PLACEHOLDER}\b"


def _bare(reference: Column) -> Column:
    return F.regexp_replace(reference, r"[«»\s]", "")


def references(text: Column) -> Column:
    """The distinct tokens that a text names, bare or in marks, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _bare))


def resolve(texts: DataFrame, vault: DataFrame, key: str, column: str = "text") -> DataFrame:
    """texts with their tokens as values; names of unknown tokens are listed in ``unknown``.

    Rows are told apart by a number of their own, so keys may be null or repeat (the
    key's column only passes through). Tokens are replaced in one pass: a value that
    looks like a token stays as it is. Marks around a token go with it; a reference
    that is not known stays.
    """
    names, taken = [], {c.lower() for c in texts.columns}
    for name in ("row", "have"):
        while name in taken:
            name += "_"
        names.append(name)
    row, have = names
    assert key in texts.columns
    hit = checkpoint(texts.where(F.col(column).rlike(REFERENCE)).withColumn(row, F.monotonically_increasing_id()))  # kept, so the numbers hold
    used = hit.select(F.col(row), F.explode(references(F.col(column))).alias("placeholder"))
    known = vault.select("placeholder", "value").dropDuplicates(["placeholder"])
    found = used.join(known, "placeholder", "left").groupBy(row).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("placeholder", "value")))).alias(have),
        F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("placeholder")))).alias("unknown"),
    )
    gaps = F.split(F.col(column), REFERENCE, -1)
    marks = F.transform(F.regexp_extract_all(F.col(column), F.lit(REFERENCE), F.lit(0)), lambda m: F.coalesce(F.element_at(F.col(have), _bare(m)), m))
    whole = F.array_join(F.zip_with(gaps, F.array_append(marks, F.lit("")), lambda a, b: F.concat(a, b)), "")
    done = hit.join(found, row).withColumn("resolved", whole).drop(row, have)
    rest = texts.where(~F.coalesce(F.col(column).rlike(REFERENCE), F.lit(False))).withColumn("unknown", F.array().cast("array<string>")).withColumn("resolved", F.col(column))
    return done.unionByName(rest)


#: Hidden values up to which one automaton over them is sent to all tasks; beyond, texts and values meet in a join.
AUTOMATON = 100_000


def leaks(outputs: DataFrame, values: DataFrame, key: str, output: str = "text", value: str = "value", normalise: bool = True, most: int = AUTOMATON) -> DataFrame:
    """Distinct pairs of an output's key (null is one, too) and a hidden value that it contains, by normal form (3 characters or more) or by digits (6 or more).

    Up to ``most`` values, each text runs once through an automaton of all of
    them. More values meet the texts by a hash of their rarest stretch.
    """
    form = (lambda c: F.regexp_replace(casefold(nfkc(c)), r"\s+", "")) if normalise else (lambda c: F.lower(F.regexp_replace(F.col(c), r"\s+", "")))
    outs = outputs.select(F.col(key), form(output).alias("hay"), rules.digits(F.col(output)).alias("hay_digits"))
    vals = values.select(F.col(value).alias("value"), form(value).alias("needle"), rules.digits(F.col(value)).alias("digits")).distinct()
    some = vals.limit(most + 1).collect()
    if len(some) > most:
        return _leaks_joined(outs, vals, key)
    kind = outs.schema[key].dataType.simpleString()
    rows = [(r["value"], r["needle"], r["digits"]) for r in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = []
        for column, least, name in ((1, 3, "normalized"), (2, 6, "digits")):
            by: dict[str, list[str]] = {}
            for r in rows:
                if r[column] and len(r[column]) >= least:
                    by.setdefault(r[column], []).append(r[0])
            auto = ahocorasick.Automaton()
            for k, v in by.items():
                auto.add_word(k, (k, v))
            if by:
                auto.make_automaton()
            found.append((column, name, auto, by))
        for b in batches:
            keys, out = b.column(0).to_pylist(), []
            for column, name, auto, by in found:
                if by:
                    for k, t in zip(keys, b.column(column).to_pylist(), strict=True):
                        out += [(k, v, name) for v in {v for _, (_, vs) in auto.iter(t or "") for v in vs}]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=[key, "value", "kind"])

    return outs.mapInArrow(run, f"{key} {kind}, value string, kind string").distinct()


#: Lengths of the stretches by which values and texts meet, the longest that a value has first.
STRETCHES = (24, 12, 6, 3)


def _leaks_joined(outs: DataFrame, vals: DataFrame, key: str) -> DataFrame:
    """The same by joins, for any number of values: each value waits at the stretch of it that fewest texts have, and only texts with that stretch are searched for it.

    A value with a stretch that no text has meets nothing. Texts are numbered, so they are fetched once for all their candidates.
    """
    texts = checkpoint(outs.withColumn("_row", F.monotonically_increasing_id()))  # kept, so the numbers hold

    def stretches(c: Column | str, n: int) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        at = F.sequence(F.lit(1), F.length(c) - (n - 1))
        return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.substring(c, i, F.lit(n)))))

    def met(hay: str, needle: str, least: int, kind: str) -> DataFrame:
        sizes = [n for n in STRETCHES if n >= least]
        pairs = None
        for n, longer in zip(sizes, [None, *sizes], strict=False):
            own = vals.where(F.length(needle) >= n)
            own = own if longer is None else own.where(F.length(needle) < longer)
            waits = own.select("value", F.col(needle).alias("want"), F.explode(stretches(needle, n)).alias("g"))
            has = texts.where(F.length(hay) >= n).select("_row", F.explode(stretches(hay, n)).alias("g"))
            often = has.join(waits.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("n"))
            rare = waits.join(often, "g", "left").groupBy("value", "want").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where(F.col("r.n") > 0)
            near = has.join(rare.select("value", "want", F.col("r.g").alias("g")), "g").select("_row", "value", "want")
            pairs = near if pairs is None else pairs.unionByName(near)
        found = texts.select("_row", key, hay).join(pairs, "_row").where(F.contains(F.col(hay), F.col("want")))
        return found.select(key, "value", F.lit(kind).alias("kind"))

    return met("hay", "needle", 3, "normalized").unionByName(met("hay_digits", "digits", 6, "digits")).distinct()


def observed(texts: DataFrame, vault: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Texts in which a kept value is seen again: names as whole words, others whole (or cut off, in the words of six characters or more)."""
    words = F.array_distinct(F.split(rules.collapse(F.lower(column)), r"[^\p{L}\p{N}@._-]+"))
    first = F.element_at(F.split("canonical", r"[^\p{L}\p{N}@._-]+"), 1)
    v = vault.withColumn("w", first).where(F.length(F.regexp_replace("canonical", r"[^\p{L}\p{N}_]", "")) >= F.when(F.col("pii_class") == "NAME", 3).otherwise(4))
    t = texts.select(F.col(key), rules.collapse(F.lower(column)).alias("c"), F.explode(words).alias("w"))
    return t.join(v, "w").where(F.contains(F.concat(F.lit(" "), F.regexp_replace("c", r"[^\p{L}\p{N}@._-]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace("canonical", r"[^\p{L}\p{N}@._-]+", " "), F.lit(" ")))).select(key, "placeholder").distinct()


def manifest(visible: DataFrame, session: DataFrame) -> DataFrame:
    """Tokens of the current view, and those of the session that it does not show."""
    seen = visible.select("placeholder").distinct().withColumn("state", F.lit("visible"))
    return seen.unionByName(session.select("placeholder").distinct().join(seen, "placeholder", "left_anti").withColumn("state", F.lit("session")))


def check_manifest(claimed: DataFrame, vault: DataFrame) -> DataFrame:
    """Claimed tokens with what is wrong with them: forged (bad shape or unknown), stale (another session) or nothing."""
    nonce = F.element_at(F.split("placeholder", "_"), -1)
    known = vault.select(F.col("placeholder").alias("k"), F.lit(True).alias("known"))
    own = vault.select(F.element_at(F.split("placeholder", "_"), -1).alias("n")).distinct().withColumn("own", F.lit(True))
    j = claimed.join(known, F.col("placeholder") == F.col("k"), "left").join(own, nonce == F.col("n"), "left")
    bad = F.when(~F.col("placeholder").rlike(f"^{rules.PLACEHOLDER}$"), "forged").when(F.col("known"), F.lit(None)).when(F.col("own").isNull(), "stale").otherwise("forged")
    return j.select("placeholder", bad.alias("violation"))


def walk(actions: DataFrame, key: str, column: str = "action") -> DataFrame:
    """Every text of a JSON document with its path: key, path, value. Documents of any depth, level by level."""
    from spanveil.operators import walks

    return walks.texts(actions, key, column)
