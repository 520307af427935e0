"""Typed spans in texts: finding, merging, masking and filtering.

A span is a struct (start, end, label, score, source, text) with code-point
offsets, end exclusive; a document's spans are an array column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import rules

_NONE = f"array<{rules.SPAN}>"


def _span(start: Column, end: Column, label: Column, score: Column, source: Column, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"), score.cast("double").alias("score"), source.alias("source"), text.alias("text"))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern that never matches nothing: array of (start, end, text).

    No built-in gives match places; the texts between matches do (split and extract agree on them).
    """
    kind = "array<struct<start:int,end:int,text:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["m"].alias("text")))).alias("out"))

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
        return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(F.array().cast(kind))

    # the matches are bound to a name: each text is scanned once, and split only if there are any
    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed), 1)


def detect(text: Column) -> Column:
    """Rule spans of a text: cards and social security numbers by digit runs, then e-mail, URLs and addresses of machines."""

    def labelled(pattern: str, label: str, hint: Column) -> Column:
        m = F.transform(matches(text, pattern), lambda x: _span(x["start"], x["end"], F.lit(label), F.lit(1.0), F.lit("heuristic"), x["text"]))
        return F.when(hint, m).otherwise(F.array().cast(_NONE))

    runs = F.transform(matches(text, rules.DIGIT_RUN), lambda x: _span(x["start"], x["end"], rules.card_or_ssn(x["text"]), F.lit(1.0), F.lit("heuristic"), x["text"]))
    runs = F.when(text.rlike(r"\d(?:[ .-]?\d){8}"), F.filter(runs, lambda x: x["label"].isNotNull())).otherwise(F.array().cast(_NONE))
    return F.concat(
        runs,
        labelled(rules.EMAIL, "EMAIL", F.contains(text, F.lit("@"))),
        labelled(rules.URL_SCHEME, "URL", F.contains(text, F.lit("://"))),
        labelled(rules.URL_WWW, "URL", F.contains(text, F.lit("www."))),
        labelled(rules.IPV4, "IP_ADDRESS", text.rlike(r"\d\.\d")),
        labelled(rules.MAC, "IP_ADDRESS", text.rlike(r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]")),
    )


def spread(rows: DataFrame, *keep: str, **array: Column) -> DataFrame:
    """One row for each element of an array (its name gives the column's).

    An outer explode, as Spark guards an inner one with filters that compute the array again.
    """
    (name, values), *_ = array.items()
    return rows.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def exploded(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each rule span: key and the span's fields."""
    return spread(docs, key, s=detect(F.col(text))).select(key, "s.*")


def _preferred(a: Column, b: Column) -> Column:
    la, lb = a["end"] - a["start"], b["end"] - b["start"]
    return F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], a).otherwise(b)).when(la != lb, F.when(la > lb, a).otherwise(b)).otherwise(F.when(a["source"] == "heuristic", a).otherwise(b))


def merge(spans: Column) -> Column:
    """Overlapping spans as one: by start, the longer first; the better score, then the longer, then a rule gives the label."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), i.alias("i"), s.alias("s")))

    def step(acc: Column, k: Column) -> Column:
        s = k["s"]
        last = F.try_element_at(acc, F.lit(-1))
        win = _preferred(last, s)
        wide = F.struct(F.least(last["start"], s["start"]).alias("start"), F.greatest(last["end"], s["end"]).alias("end"), win["label"].alias("label"), win["score"].alias("score"), win["source"].alias("source"), win["text"].alias("text"))
        joined = F.when(last["end"] >= s["end"], win).otherwise(wide)
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) == 0) | (s["start"] >= last["end"]), F.concat(acc, F.array(s))).otherwise(F.concat(head, F.array(joined)))

    return F.aggregate(F.array_sort(keyed), F.array().cast(_NONE), step)


def coalesce_same(text: Column, spans: Column, gap: str = r"^[\s_.-]{0,3}$") -> Column:
    """Neighbouring spans of one class with next to nothing between them as one, with the greatest score."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s")))

    def step(acc: Column, k: Column) -> Column:
        s = k["s"]
        last = F.try_element_at(acc, F.lit(-1))
        between = F.substring(text, last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))
        joined = _span(last["start"], s["end"], last["label"], F.greatest(last["score"], s["score"]), last["source"], F.substring(text, last["start"] + 1, s["end"] - last["start"]))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        same = (F.size(acc) > 0) & (rules.normal_class(last["label"]) == rules.normal_class(s["label"])) & between.rlike(gap)
        return F.when(F.coalesce(same, F.lit(False)), F.concat(head, F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(keyed), F.array().cast(_NONE), step)


def join_mapped(text: Column, spans: Column) -> Column:
    """Mapped training spans: same labels at most eight separators apart become one, of overlapping ones the longer stays."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s")))

    def step(acc: Column, k: Column) -> Column:
        s = k["s"]
        last = F.try_element_at(acc, F.lit(-1))
        between = F.substring(text, last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        apart = s["start"] >= last["end"]
        same = (s["label"] == last["label"]) & apart & (F.length(between) <= 8) & between.rlike(r"^[\s,./'()-]*$")
        joined = _span(last["start"], s["end"], last["label"], last["score"], last["source"], F.substring(text, last["start"] + 1, s["end"] - last["start"]))
        longer = F.when(s["end"] - s["start"] > last["end"] - last["start"], s).otherwise(last)
        return F.when(F.size(acc) == 0, F.array(s)).when(same, F.concat(head, F.array(joined))).when(apart, F.concat(acc, F.array(s))).otherwise(F.concat(head, F.array(longer)))

    return F.aggregate(F.array_sort(keyed), F.array().cast(_NONE), step)


def replaced(text: Column, spans: Column, by) -> Column:
    """A text with each span (sorted, disjoint) replaced by ``by(span)``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, by(s)).alias("out")))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def premask(text: Column, spans: Column) -> Column:
    """A text with its spans as [LABEL], and where each stretch of it comes from: (start, end, raw_start, raw_end, mask)."""
    kind = "array<struct<start:int,end:int,raw_start:int,raw_end:int,mask:boolean>>"
    begin = F.struct(F.lit(0).alias("raw"), F.lit(0).alias("at"), F.lit("").alias("text"), F.array().cast(kind).alias("map"))

    def piece(a, b, c, d, m) -> Column:
        return F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), c.cast("int").alias("raw_start"), d.cast("int").alias("raw_end"), F.lit(m).alias("mask"))

    def step(acc: Column, s: Column) -> Column:
        gap = s["start"] - acc["raw"]
        label = F.concat(F.lit("["), s["label"], F.lit("]"))
        mid = acc["at"] + gap
        rows = F.array(piece(acc["at"], mid, acc["raw"], s["start"], False), piece(mid, mid + F.length(label), s["start"], s["end"], True))
        new = F.struct(s["end"].alias("raw"), (mid + F.length(label)).alias("at"), F.concat(acc["text"], F.substring(text, acc["raw"] + 1, gap), label).alias("text"), F.concat(acc["map"], rows).alias("map"))
        return F.when(s["start"] < acc["raw"], acc).otherwise(new)

    def finish(acc: Column) -> Column:
        rest = F.length(text) - acc["raw"]
        return F.struct(
            F.concat(acc["text"], F.substring(text, acc["raw"] + 1, rest)).alias("text"),
            F.filter(F.concat(acc["map"], F.array(piece(acc["at"], acc["at"] + rest, acc["raw"], F.length(text), False))), lambda r: r["end"] > r["start"]).alias("map"),
        )

    return F.aggregate(merge(spans), begin, step, finish)


def contextual(spans: Column, text: Column, complete: float = 0.4, context: float = 0.5, multiword: float = 0.72) -> Column:
    """Without address parts and names that nothing around them supports."""
    address = ("BUILDING_NUMBER", "STREET_NAME", "SECONDARY_ADDRESS")
    is_name = lambda s: s["label"].isin("GIVEN_NAME", "SURNAME")
    kinds = F.array_distinct(F.transform(F.filter(spans, lambda s: s["label"].isin(*address)), lambda s: s["label"]))
    has_address = text.rlike(rules.ADDRESS_CONTEXT) | (F.size(kinds) >= 2)
    whole = F.exists(spans, lambda s: s["label"] == "GIVEN_NAME") & F.exists(spans, lambda s: s["label"] == "SURNAME")
    cue = text.rlike(rules.NAME_CONTEXT)
    many = F.exists(spans, lambda s: is_name(s) & (s["score"] >= multiword) & F.trim(s["text"]).rlike(r"^\p{L}[^\n]*\s+\p{L}[^\n]*$"))
    long = lambda s: F.length(F.trim(s["text"])) >= 2
    good = lambda s: long(s) & ((whole & (s["score"] >= complete)) | (cue & (s["score"] >= context)) | (many & (s["score"] >= multiword)))
    return F.filter(spans, lambda s: (~s["label"].isin(*address) | has_address) & (~is_name(s) | good(s)))


def credible_person(spans: Column, text: Column) -> Column:
    """Without name fragments: a name of a model ends at word edges and has three letters (two after a cue)."""

    def good(s: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), s["start"] - 39), F.least(s["start"], F.lit(40)))
        edge = ~F.substring(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0)).rlike(r"[\p{L}\p{N}]") & ~F.substring(text, s["end"] + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
        letters = F.regexp_count(F.trim(s["text"]), F.lit(r"\p{L}"))
        return edge & (letters >= F.when(before.rlike(rules.PERSON_CUE), 2).otherwise(3))

    return F.filter(spans, lambda s: ~s["label"].isin("GIVEN_NAME", "SURNAME") | (s["source"] != "ner") | good(s))


def bio_spans(tokens: Column, text: Column, keep: float = 0.4, least: float = 0.15) -> Column:
    """Spans out of tagged tokens (start, end, tag, score): B- starts, I- of the same label goes on, a line break ends."""
    cur = "struct<label:string,start:int,end:int,sum:double,n:int>"
    begin = F.struct(F.lit(None).cast(cur).alias("cur"), F.array().cast(_NONE).alias("out"))

    def flushed(acc: Column) -> Column:
        c = acc["cur"]
        s = _span(c["start"], c["end"], c["label"], c["sum"] / c["n"], F.lit("ner"), F.substring(text, c["start"] + 1, c["end"] - c["start"]))
        return F.when(c.isNotNull() & (c["sum"] / c["n"] >= keep) & (c["end"] > c["start"]), F.concat(acc["out"], F.array(s))).otherwise(acc["out"])

    def step(acc: Column, t: Column) -> Column:
        c = acc["cur"]
        label = F.substring(t["tag"], 3, 1000)
        cut = F.contains(F.substring(text, c["end"] + 1, F.greatest(t["start"] - c["end"], F.lit(0))), F.lit("\n"))
        open_ = c.isNotNull() & ~F.coalesce(cut, F.lit(False))
        out = (t["tag"] == "O") | (t["score"] < least)
        on = open_ & (c["label"] == label) & t["tag"].startswith("I-")
        longer = F.struct(c["label"].alias("label"), c["start"].alias("start"), t["end"].cast("int").alias("end"), (c["sum"] + t["score"]).alias("sum"), (c["n"] + 1).alias("n"))
        fresh = F.struct(label.alias("label"), t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"), t["score"].cast("double").alias("sum"), F.lit(1).alias("n"))
        ended = F.struct(F.lit(None).cast(cur).alias("cur"), flushed(acc).alias("out"))
        return F.when(t["start"] == t["end"], acc).when(out, ended).when(F.coalesce(on, F.lit(False)), F.struct(longer.cast(cur).alias("cur"), acc["out"].alias("out"))).otherwise(F.struct(fresh.cast(cur).alias("cur"), flushed(acc).alias("out")))

    return F.aggregate(tokens, begin, step, flushed)


def ctc_text(classes: Column, scores: Column, alphabet: Column, blank: int = 0) -> Column:
    """Text and mean score of a class sequence: repeats and blanks go."""
    pairs = F.zip_with(classes, scores, lambda c, s: F.struct(c.alias("c"), s.alias("s")))
    kept = F.filter(F.transform(pairs, lambda x, i: F.struct(x["c"].alias("c"), x["s"].alias("s"), F.when(i > 0, F.get(classes, i - 1)).alias("p"))), lambda x: (x["c"] != blank) & (x["p"].isNull() | (x["p"] != x["c"])))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["s"])
    return F.struct(
        F.array_join(F.transform(kept, lambda x: F.get(alphabet, x["c"] - 1)), "").alias("text"),
        F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(0.0).alias("confidence"),
    )


def merge_windows(spans: Column) -> Column:
    """Spans of overlapping windows: the same label overlapping the last kept one widens it, with the greatest score."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s")))

    def step(acc: Column, k: Column) -> Column:
        s = k["s"]
        last = F.try_element_at(acc, F.lit(-1))
        same = (F.size(acc) > 0) & (last["label"] == s["label"]) & (s["start"] < last["end"])
        wide = _span(F.least(last["start"], s["start"]), F.greatest(last["end"], s["end"]), s["label"], F.greatest(last["score"], s["score"]), last["source"], last["text"])
        return F.when(F.coalesce(same, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wide))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(keyed), F.array().cast(_NONE), step)


def document_of(findings: DataFrame, by: str = "frame_id", order: str = "idx") -> DataFrame:
    """One text for each frame, its findings joined by line breaks, and each finding's offsets in it."""
    kept = findings.withColumn("t", F.trim("text")).where(F.length("t") > 0)
    g = kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col("t")))).alias("x"))
    place = F.aggregate(
        "x",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<idx:int,start:int,end:int>>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x["t"]) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(x["i"].cast("int").alias("idx"), a["at"].alias("start"), (a["at"] + F.length(x["t"])).alias("end")))).alias("out")),
        lambda a: a["out"],
    )
    return g.select(by, F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("document"), place.alias("entries"))


def overlap(spans: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Spans and findings of one key that share a character."""
    s, f = spans.alias("s"), findings.alias("f")
    return s.join(f, (F.col(f"s.{key}") == F.col(f"f.{key}")) & (F.col("s.start") < F.col("f.end")) & (F.col("s.end") > F.col("f.start")))


def projected(found: DataFrame, entries: DataFrame, key: str, keep: tuple[str, ...] = rules.KEEP_LABELS) -> DataFrame:
    """Spans of an assembled document on the findings that it was made of: each finding's values (clipped to it, by start), labels and sources, and whether one is sensitive.

    found: key, start, end, label, score, source; entries: key, idx, start, end. A finding without a span is there, too.
    """
    j = overlap(found, entries, key)
    at = lambda c: F.col(f"f.{c}")
    value = F.struct((F.greatest(F.col("s.start"), at("start")) - at("start")).alias("start"), (F.least(F.col("s.end"), at("end")) - at("start")).alias("end"), F.col("s.label"), F.col("s.score"), F.col("s.source"))
    g = j.groupBy(at(key).alias(key), at("idx").alias("idx")).agg(F.array_sort(F.collect_list(value)).alias("values"))
    names = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce("values", F.array().cast("array<struct<start:int,end:int,label:string,score:double,source:string>>")), lambda v: v[c])))
    return entries.join(g, [key, "idx"], "left").select(key, "idx", "values", names("label").alias("labels"), names("source").alias("sources"), F.coalesce(F.exists("values", lambda v: ~v["label"].isin(*keep)), F.lit(False)).alias("sensitive"))
