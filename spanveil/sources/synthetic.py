"""Synthetic records: deterministic fake values and texts by split and number."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.functions import rules

FIRST = ("Alex", "Maria", "Jordan", "Priya", "Chen", "Fatima", "Lucas", "Amara")
LAST = ("Rivera", "Novak", "Okafor", "Lindqvist", "Tanaka", "Haddad", "Silva", "Moreau")
STREETS = ("Oak Street", "Hill Road", "Lake Avenue", "Mill Lane")


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(i, F.lit(len(values))).cast("int") + 1)


def fake_values(i: Column, split: str = "train") -> Column:
    """A struct of made-up values; the splits use different numbers, so they share none."""
    shift = {"train": 0, "validation": 3_000_000, "holdout": 6_000_000}[split]
    n = (i + shift).cast("long")
    first, last = _pick(FIRST, n), _pick(LAST, F.floor(n / len(FIRST)))
    body = F.concat(F.lit("4"), F.lpad(F.pmod(n * 7919 + 13, F.lit(10**14)).cast("string"), 14, "0"))
    tail = rules.base36(n + 46656)
    return F.struct(
        F.concat_ws(" ", first, last).alias("name"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), n.cast("string"), F.lit("@example.com")).alias("email"),
        F.format_string("+1 (%03d) 555-%04d", F.pmod(n, F.lit(800)) + 200, F.pmod(n * 31, F.lit(10000))).alias("phone"),
        F.concat(body, rules.luhn_digit(body)).alias("card"),
        F.format_string("%d %s", F.pmod(n, F.lit(900)) + 100, _pick(STREETS, n)).alias("address"),
        F.concat(F.lit("sk-live-"), F.lpad(tail, 12, "0")).alias("api_key"),
    )


def records(spark: SparkSession, split: str, n: int, seed: int = 0, noise: float = 0.0) -> DataFrame:
    """n training records with exact spans; with ``noise``, that share of records (by hash) has a letter of its template replaced."""
    i = F.col("id")
    r = spark.range(n).withColumn("v", fake_values(i + seed, split)).withColumn("k", F.pmod(i, F.lit(3)))
    noisy = rules.hash_share(F.concat_ws(":", F.lit(split), i.cast("string"))) < noise
    lead = F.when(F.col("k") == 0, F.lit("Contact ")).when(F.col("k") == 1, F.lit("Customer name: ")).otherwise(F.lit("Key for "))
    lead = F.when(noisy, F.translate(lead, "o", "0")).otherwise(lead)
    mid = F.when(F.col("k") == 0, F.lit(" at ")).when(F.col("k") == 1, F.lit(", phone ")).otherwise(F.lit(" is "))
    second = F.when(F.col("k") == 0, F.col("v.email")).when(F.col("k") == 1, F.col("v.phone")).otherwise(F.col("v.api_key"))
    label = F.when(F.col("k") == 0, "EMAIL").when(F.col("k") == 1, "PHONE").otherwise("API_KEY")
    s1 = F.length(lead)
    s2 = s1 + F.length("v.name") + F.length(mid)
    span = lambda s, x, l: F.struct(s.cast("int").alias("start"), (s + F.length(x)).cast("int").alias("end"), l.alias("label"), x.alias("value"))
    return r.select(
        F.concat_ws("-", F.lit(split), F.lpad(i.cast("string"), 8, "0")).alias("id"),
        F.concat(lead, F.col("v.name"), mid, second).alias("text"),
        F.array(span(s1, F.col("v.name"), F.lit("NAME")), span(s2, second, label)).alias("spans"),
        F.lit(split).alias("split"),
        F.lit("synthetic").alias("source"),
        F.concat(F.lit("t"), F.col("k").cast("string")).alias("template_id"),
        (i + seed).alias("seed"),
        F.lit("en").alias("language"),
        F.lit("US").alias("region"),
        noisy.alias("noisy"),
    )


# What a recogniser reads in place of some letters, and how often it does so or loses one.
READ_AS = {"O": "0", "o": "0", "I": "1", "l": "1", "S": "5", "B": "8"}
REPLACED, DELETED = 0.025, 0.003


_NOISED = (
    T.StructType()
    .add("text", "string")
    .add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("label", "string").add("value", "string")))
    .add("operations", T.ArrayType(T.StructType().add("op", "string").add("index", "integer").add("was", "string").add("becomes", "string")))
)


def _draws(key: str, at: int) -> tuple[float, float]:
    """Two numbers in [0, 1) for a place: one for losing it, one for misreading it."""
    h = hashlib.md5(f"{key}:{at}".encode()).hexdigest()
    return int(h[:8], 16) / 2**32, int(h[8:16], 16) / 2**32


@F.pandas_udf(_NOISED)
def _noised(texts: pd.Series, spans: pd.Series, keys: pd.Series, replaced: pd.Series, deleted: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found, key, often, lost in zip(texts, spans, keys, replaced, deleted, strict=True):
        if text is None:
            rows.append((None, None, None))
            continue
        found = [] if found is None else [(int(s["start"]), int(s["end"]), s["label"]) for s in found]
        single = {a for a, b, _ in found if b - a == 1}
        out, ops, before = [], [], [0]
        for i, c in enumerate(text):
            gone, misread = _draws(key, i)
            if gone < lost and i not in single and not c.isspace():
                ops.append({"op": "delete", "index": i, "was": c, "becomes": ""})
            elif c in READ_AS and misread < often:
                ops.append({"op": "replace", "index": i, "was": c, "becomes": READ_AS[c]})
                out.append(READ_AS[c])
            else:
                out.append(c)
            before.append(len(out))
        noisy = "".join(out)
        new = [(before[a], before[b], label) for a, b, label in found]
        if any(b <= a for a, b, _ in new):
            noisy, new, ops = text, found, []
        rows.append((noisy, [{"start": a, "end": b, "label": label, "value": noisy[a:b]} for a, b, label in new], ops))
    return pd.DataFrame(rows, columns=["text", "spans", "operations"])


def noised(text: Column, spans: Column, key: Column, replaced: float = REPLACED, deleted: float = DELETED) -> Column:
    """A text as a recogniser might read it, its spans (start, end, label) moved along, and the operations: drawn by hash of the key and the place.

    White space and spans of one character are not lost; if a span would vanish, the text stays as it is. A null text stays null.
    A struct (text, spans of (start, end, label, value), operations of (op, index, was, becomes)).
    """
    return _noised(text, spans, key.cast("string"), F.lit(replaced), F.lit(deleted))
