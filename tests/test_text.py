"""Rules, spans, policy and vault against literal examples."""

import random
import re

from pyspark.sql import functions as F

from spanveil.functions import rules
from spanveil.operators import spans, vault


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


def test_detects_card_and_email_with_offsets(spark):
    text = "Email alice@example.com and card 4111-1111-1111-1111"
    got = [(s["label"], text[s["start"] : s["end"]]) for s in one(spark, text, spans.detect)]
    assert got == [("CREDIT_CARD", "4111-1111-1111-1111"), ("EMAIL", "alice@example.com")]


def test_matches_agree_with_a_scan(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab@.com 12é") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (rules.DIGIT_RUN, rules.EMAIL):
        got = [[(m["start"], m["end"]) for m in r["m"]] for r in df.select("t", spans.matches(F.col("t"), p).alias("m")).collect()]
        assert got == [[m.span() for m in re.finditer(p, t)] for t in texts]


def test_cues_need_a_value(spark):
    labels = lambda t: one(spark, t, rules.value_cues)
    assert labels("Account password") == [] and labels("API key") == []
    assert labels("Password: hunter2") == ["PASSWORD"]
    assert labels("phone +1 (415) 555-0136") == ["PHONE"]
    assert labels("sk-live-abcdefgh1234") == ["API_KEY"]
    assert labels("eyJabcd.efghijkl.signature") == ["AUTH_TOKEN"]
    assert "BANK_ACCOUNT" in labels("GB82 WEST 1234 5698 7654 32")


def test_merge_prefers_score_then_length_then_rule(spark):
    rows = [[(0, 5, "A", 0.5, "ner", "x"), (3, 9, "B", 0.9, "ner", "y"), (20, 22, "C", 1.0, "heuristic", "z"), (20, 22, "D", 1.0, "ner", "z")]]
    got = spark.createDataFrame([(r,) for r in rows], f"s array<{rules.SPAN}>").select(spans.merge(F.col("s")).alias("m")).first()["m"]
    assert [(s["start"], s["end"], s["label"]) for s in got] == [(0, 9, "B"), (20, 22, "C")]


def test_coalesce_joins_neighbours(spark):
    text = "John  Smith, x"
    df = spark.createDataFrame([(text, [(0, 4, "GIVEN_NAME", 0.5, "ner", "John"), (6, 11, "SURNAME", 0.9, "ner", "Smith")])], f"t string, s array<{rules.SPAN}>")
    got = df.select(spans.coalesce_same(F.col("t"), F.col("s")).alias("m")).first()["m"]
    assert [(s["start"], s["end"], s["score"], s["text"]) for s in got] == [(0, 11, 0.9, "John  Smith")]


def test_premask_maps_back(spark):
    text = "a b@c.de z"
    got = one(spark, text, lambda t: spans.premask(t, spans.detect(t)))
    assert got["text"] == "a [EMAIL] z"
    assert [(r["start"], r["end"], r["raw_start"], r["raw_end"]) for r in got["map"]] == [(0, 2, 0, 2), (2, 9, 2, 8), (9, 11, 8, 10)]


def test_bio_cuts_at_line_breaks(spark):
    text = "Alice\nMargulis"
    tokens = [(0, 5, "B-GIVEN_NAME", 0.9), (6, 14, "I-GIVEN_NAME", 0.8)]
    df = spark.createDataFrame([(text, tokens)], "t string, k array<struct<start:int,end:int,tag:string,score:double>>")
    got = df.select(spans.bio_spans(F.col("k"), F.col("t")).alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in got] == [(0, 5), (6, 14)]


def test_ctc(spark):
    df = spark.createDataFrame([([1, 1, 0, 1, 2, 0, 3], [0.9] * 7, ["a", "b", " "])], "c array<int>, s array<double>, a array<string>")
    r = df.select(spans.ctc_text(F.col("c"), F.col("s"), F.col("a")).alias("x")).first()["x"]
    assert r["text"] == "aab " and abs(r["confidence"] - 0.9) < 1e-9


def test_birth_dates_need_context(spark):
    df = spark.createDataFrame([("born on 1990-01-02", "DATE", 8), ("seen on 1990-01-02", "DATE", 8), ("x", "GIVENNAME1", 0), ("x", "CITY", 0)], "t string, l string, s int")
    assert [r["m"] for r in df.select(rules.mapped_label(F.col("t"), F.col("l"), F.col("s")).alias("m")).collect()] == ["DOB", None, "NAME", "ADDRESS"]


def test_unknown_classes_are_blocked(spark):
    df = spark.createDataFrame([("GIVEN_NAME",), ("credit card",), ("PASSPORT",), ("api-key",)], "l string")
    assert [tuple(r) for r in df.select(rules.normal_class(F.col("l")), rules.level_of(F.col("l"))).collect()] == [("NAME", "hide_use"), ("CARD_NUMBER", "blocked"), ("PASSPORT", "blocked"), ("API_KEY", "approval")]


def test_scrub_keeps_no_value_and_resolves_back(spark):
    docs = spark.createDataFrame([(1, "mail Bob@x.org, card 4111 1111 1111 1111"), (2, "bob@x.org again"), (3, None)], "doc_id int, text string")
    out, kept = vault.scrub(docs)
    rows = {r["doc_id"]: r["scrubbed"] for r in out.collect()}
    assert rows == {1: "mail EMAIL_1_0000, card [BLOCKED_CARD_NUMBER]", 2: "EMAIL_1_0000 again", 3: None}
    assert vault.leaks(out.select("doc_id", F.col("scrubbed").alias("text")), kept.select("value"), "doc_id").count() == 0
    back = vault.resolve(spark.createDataFrame([(1, "to EMAIL_1_0000 and EMAIL_9_0000")], "k int, text string"), kept, "k").first()
    assert back["resolved"] == "to Bob@x.org and EMAIL_9_0000" and back["unknown"] == ["EMAIL_9_0000"]


def test_scrub_counts_in_the_same_pass(spark):
    from pyspark.sql import Observation

    rows = [(1, "mail Bob@x.org, card 4111 1111 1111 1111", "k"), (1, "bob@x.org and 10.0.0.1", "k"), (None, None, "k"), (3, "nothing", "k"), (4, "ssn 123-45-6789", "k")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, kinds string").repartition(3)
    seen = Observation("scrub")
    out, kept = vault.scrub(docs, counters=seen)
    assert out.columns == vault.scrub(docs)[0].columns and {r["kinds"] for r in out.collect()} == {"k"}
    got = seen.get
    again = out.agg(F.count("*").alias("documents"), F.count_if(F.col("n_replaced") > 0).alias("changed"), F.sum("n_replaced").alias("replaced")).first().asDict()
    assert {k: got[k] for k in again} == again == {"documents": 5, "changed": 3, "replaced": 5}
    text = " ".join(r["scrubbed"] or "" for r in out.collect())
    assert got["blocked"] == text.count("[BLOCKED_") and got["tokens"] == got["replaced"] - got["blocked"] == 2
    assert (got["EMAIL"], got["CARD_NUMBER"], got["SSN"], got["other"]) == (2, 1, 1, 1) and kept.count() == 1
    empty = Observation("none")
    vault.scrub(docs.limit(0), counters=empty)[0].collect()
    assert empty.get["documents"] == 0 and empty.get["replaced"] == 0


def test_leaks_both_ways_agree(spark):
    outs = spark.createDataFrame([(1, "call 555-12 34 99 now"), (2, "the Secret  Word"), (3, "nothing"), (4, None)], "id int, text string")
    vals = spark.createDataFrame([("5551234 99",), ("secretword",), ("no",), (None,)], "value string")
    want = {(1, "5551234 99", "digits"), (2, "secretword", "normalized")}
    for most in (10, 0):
        assert {tuple(r) for r in vault.leaks(outs, vals, "id", most=most).collect()} == want


def test_name_variants_are_whole_words(spark):
    v = [("odel", "NAME_1_0000", "NAME"), ("secret1", "API_KEY_1_0000", "API_KEY")]
    assert one(spark, "model odel xsecret1y NAME_1_0000", lambda t: vault.replace_variants(t, v)) == "model NAME_1_0000 xAPI_KEY_1_0000y NAME_1_0000"


def test_walk(spark):
    a = spark.createDataFrame([(1, '{"x":[{"y":"EMAIL_1_0000"}],"z":"q"}'), (2, "not json")], "id int, action string")
    assert {tuple(r) for r in vault.walk(a, "id").collect()} == {(1, "$.x[0].y", "EMAIL_1_0000"), (1, "$.z", "q")}


def test_manifest_checks(spark):
    v = spark.createDataFrame([("EMAIL_1_abcd",)], "placeholder string")
    c = spark.createDataFrame([("EMAIL_1_abcd",), ("EMAIL_7_abcd",), ("EMAIL_1_ffff",), ("junk",)], "placeholder string")
    assert {r["placeholder"]: r["violation"] for r in vault.check_manifest(c, v).collect()} == {"EMAIL_1_abcd": None, "EMAIL_7_abcd": "forged", "EMAIL_1_ffff": "stale", "junk": "forged"}


def test_scalars(spark):
    df = spark.createDataFrame([("[::1]:80", "127.0.0.1:5173", "8.8.8.8:53")], "a string, b string, c string")
    r = df.select(rules.host(F.col("a")), rules.port(F.col("b")), rules.is_loopback(F.col("a")), rules.is_loopback(F.col("b")), rules.is_loopback(F.col("c"))).first()
    assert tuple(r) == ("::1", 5173, True, True, False)
    assert one(spark, "run API_KEY=abc ok", rules.redact_assignments) == "run API_KEY=[REDACTED] ok"
    assert one(spark, "411111111111111", rules.luhn_digit) == "1"


def test_field_cues_and_plausibility(spark):
    from spanveil.functions import cues

    df = spark.createDataFrame([("Card number 4000 0000 0000 0002 Security c0de 007", None), ("E-mail  address: *", "EMAIL"), ("Tax ID", "GOVERNMENT_ID"), ("Submit", None)], "t string, f string")
    rows = df.select("f", cues.bare_cues(F.col("t")).alias("b"), cues.field_cue(F.col("t")).alias("g")).collect()
    assert rows[0]["b"] == ["CVC", "CARD_NUMBER"] and all(r["f"] == r["g"] for r in rows)
    v = spark.createDataFrame([("EMAIL", "a@b.c", True), ("CVC", "12", False), ("CVC", "123", True), ("NAME", "Ann O'Neil", True), ("NAME", "save", False), ("CARD_NUMBER", "4111 1111 1111 1111", True)], "l string, t string, w boolean")
    assert all(r["w"] == r["p"] for r in v.select("w", cues.plausible(F.col("l"), F.col("t")).alias("p")).collect())


def test_contextual_names_and_dispositions(spark):
    from spanveil.functions import cues

    df = spark.createDataFrame([("Hello, Maria del Rey", "Maria del Rey"), ("Deliver to John Smith", "John Smith"), ("Hi Guest", None), ("something", None)], "t string, n string")
    assert all(r["n"] == (r["x"] and r["x"]["name"]) for r in df.select("n", cues.contextual_name(F.col("t")).alias("x")).collect())
    k = spark.createDataFrame([("PII_FIRSTNAME", "map", "NAME"), ("PII_COMPANY", "hard-negative", None), ("PII_CARD_CVV2", "map", "CVC"), ("ODD", "unmapped", None), ("PII_DOB_YEAR", "map", "SENSITIVE_FIELD")], "k string, a string, c string")
    assert all((r["a"], r["c"]) == tuple(r["d"]) for r in k.select("a", "c", cues.disposition(F.col("k")).alias("d")).collect())


def test_actions(spark):
    from spanveil.operators import actions as ac

    a = spark.createDataFrame([(1, '{"tool_calls":[{"name":"send","url":"u"},{"type":"function","function":{"name":"f"}}],"tool_call":{"tool_name":"t"}}'), (2, '{"tool_name":"x","args":{"target":" d "}}'), (3, '{"action":{"type":"click"}}'), (4, '{"action":"type","text":"hi"}'), (5, '{"note":"n"}')], "id int, action string")
    got = ac.calls(a, "id").select("id", ac.call_name(F.col("call")).alias("n"), ac.call_target(F.col("call")).alias("t")).collect()
    assert sorted((r["id"], r["n"], r["t"] or "") for r in got) == [(1, "f", ""), (1, "send", "u"), (1, "t", ""), (2, "x", "d"), (3, "click", ""), (4, "type", "")]
    t = spark.createDataFrame([('so {"a":1} then {"b":{"c":2}} end',), ("none {",)], "t string")
    assert [r["x"] for r in t.select(ac.last_object("t").alias("x")).collect()] == ['{"b": {"c": 2}}', None]
    s = spark.createDataFrame([('{"properties":{"a":{"type":"string","enum":["x"]},"b":{"properties":{"c":{}}}}}',)], "t string").select(ac.schema_shape("t").alias("s")).first()["s"]
    assert s["string_fields"] == ["a"] and "b" in s["property_paths"] and s["enums"] == ["x"]
    tools = spark.createDataFrame([("add", '{"a":1,"b":2}', "3"), ("sort", '{"items":["b","a"]}', "a, b"), ("echo", '{"text":"q"}', "q")], "n string, a string, w string")
    assert all(r["w"] == r["g"] for r in tools.select("w", ac.run_tool(F.col("n"), F.col("a")).alias("g")).collect())


def test_premask_projection_takes_all_documents(spark, tmp_path):
    from spanveil.plans import text as plans

    rows = [(1, "mail a@b.org"), (2, "host 10.0.0.1 and https://x.org/a"), (3, "card 4111 1111 1111 1111"), (4, "nothing"), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", spans.merge(spans.detect(F.col("text"))).alias("s")).collect()}
    want = {}
    for k, t in rows:
        own = found[k] or []
        want[k] = (None if t is None else len(t) + sum(len(s["label"]) + 2 - (s["end"] - s["start"]) for s in own), len(own))
    got = {r["doc_id"]: (r["masked_chars"], r["n_masks"]) for r in plans.premask_projection(spark, str(tmp_path)).collect()}
    assert got == want and got[2][1] == 2 and got[3][1] == 1 and got[4] == (7, 0) and got[5] == (0, 0) and got[6] == (None, 0)


def test_leak_scan_items_takes_every_line(spark, tmp_path):
    from spanveil.plans import text as plans

    items = [(0, "first line\nsecond Stra\u00dfe line"), (1, "first line\nother end"), (2, None)]
    docs = [(1, "has SECOND strasse line only"), (2, "first line"), (3, "the first  line\nother end."), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    form = lambda t: "".join(t.casefold().split())
    want = {(d, i, n) for d, t in docs if t for i, x in items if x for n, v in enumerate([x, *x.split("\n")]) if form(v) in form(t)}
    assert {(r["doc_id"], r["item_id"], r["line"]) for r in plans.leak_scan_items(spark, str(tmp_path)).collect()} == want
    assert (1, 0, 2) in want and (3, 1, 0) in want


def test_leaks_of_repeated_and_null_keys_agree(spark):
    outs = spark.createDataFrame([(1, "secretword"), (1, "a secret word"), (None, "secret word"), (None, "secretword 5551234")], "id int, text string")
    vals = spark.createDataFrame([("secretword",), ("5551234",)], "value string")
    want = [("1", "secretword", "normalized"), ("None", "5551234", "digits"), ("None", "5551234", "normalized"), ("None", "secretword", "normalized")]
    for most in (10, 1):
        assert sorted((str(r["id"]), r["value"], r["kind"]) for r in vault.leaks(outs, vals, "id", most=most).collect()) == want


def test_leaks_of_many_values_by_stretches(spark):
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9)))
    texts = [(i if i % 5 else None, " ".join(word() for _ in range(rnd.randrange(0, 40)))) for i in range(120)] + [(500, "x" * 60), (501, None), (502, "12-34-56-78 z")]
    values = [(word() + " " + word() * rnd.randrange(1, 5),) for _ in range(150)] + [(texts[7][1][3:40],), ("xxxx" * 8,), ("345678",), ("3456",), (None,), ("",)]
    outs, vals = spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame(values, "value string")
    squeezed = lambda t: "".join((t or "").split())
    digits = lambda t: "".join(c for c in t or "" if c.isdigit())
    want = {(i, v, "normalized") for i, t in texts for (v,) in values if v and len(squeezed(v)) >= 3 and squeezed(v) in squeezed(t)} | {(i, v, "digits") for i, t in texts for (v,) in values if len(digits(v)) >= 6 and digits(v) in digits(t)}
    assert {tuple(r) for r in vault.leaks(outs, vals, "id", most=3).collect()} == want == {tuple(r) for r in vault.leaks(outs, vals, "id").collect()}


def test_round_trip_is_its_sql_on_odd_documents(spark, tmp_path):
    import duckdb

    from spanveil.plans import text as plans

    # spelt in two ways; a blocked value within an address; a marker in the text; ids that are null or repeat
    rows = [(1, "mail Bob@x.org"), (2, "bob@x.org again"), (3, "to 123-45-6789@x.org"), (4, "[BLOCKED_CARD_NUMBER] kim@x.org"), (5, "a@x.org"), (5, "b@x.org"), (6, "c@x.org"), (6, "10.0.0.1"), (None, "d@x.org"), (7, "nothing"), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in plans.resolve_round_trip(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == con.execute(plans.ORACLES["resolve_round_trip"]).fetchall() == [(True, 5)]
