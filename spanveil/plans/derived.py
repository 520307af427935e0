"""Queries of rules over texts and records that are derived from the tables; the expected answers stand in the SQL, written by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import cues, rules
from spanveil.functions import geometry as geo
from spanveil.operators import boxes, curate, evaluate, ledger, spans, vault
from spanveil.plans.contracts import _case, _pick
from spanveil.plans.text import read
from spanveil.sources import synthetic

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its oracle if SQL can express it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _with_key(text: Column, key: str) -> Column:
    return F.replace(text, F.lit("{k}"), F.col(key).cast("string"))


# phrase, labels of cues with a value, labels of bare cues
_PHRASES = (
    ("Password: hunter{k}", "PASSWORD", "PASSWORD"),
    ("Account password {k}", "", "PASSWORD"),
    ("API key", "", "API_KEY"),
    ("api_key = abc{k}defg", "API_KEY", "API_KEY"),
    ("CVV: 123, row {k}", "CVC", "CVC"),
    ("security c0de", "", "CVC"),
    ("bearer abcdefgh{k}", "AUTH_TOKEN", "AUTH_TOKEN"),
    ("card number 4000 0000 0000 0002", "CARD_NUMBER", "CARD_NUMBER"),
    ("passport is X{k}99999", "GOVERNMENT_ID", "GOVERNMENT_ID"),
    ("date of birth: 1/2/1990", "DOB", "DOB"),
    ("iban: {k}12345", "BANK_ACCOUNT", "BANK_ACCOUNT"),
    ("seed phrase is word{k}", "SECRET", "SECRET"),
    ("call +1 (415) 555-0136", "PHONE", "PHONE"),
    ("sk-live-abcdefgh{k}", "API_KEY", "API_KEY"),
    ("eyJabcd.efgh{k}.sig", "AUTH_TOKEN", "AUTH_TOKEN"),
    ("GB82 WEST 1234 5698 7654 32", "BANK_ACCOUNT", "BANK_ACCOUNT"),
    ("BEGIN RSA PRIVATE KEY", "PRIVATE_KEY", "PRIVATE_KEY"),
    ("nothing of note {k}", "", ""),
)


@query(f"SELECT doc_id, {_case('doc_id', *[p[1] for p in _PHRASES])} AS labels FROM documents")
def cue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of cues that carry a value."""
    t = _with_key(_pick(F.col("doc_id"), *[p[0] for p in _PHRASES]), "doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(rules.value_cues(t))), ",").alias("labels"))


@query(f"SELECT doc_id, {_case('doc_id', *[p[2] for p in _PHRASES])} AS labels FROM documents")
def bare_cue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of cues with or without a value."""
    t = _with_key(_pick(F.col("doc_id"), *[p[0] for p in _PHRASES]), "doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(cues.bare_cues(t)), ",").alias("labels"))


_FIELDS = (
    ("E-mail  address: *", "EMAIL"), ("Mobile no.", "PHONE"), ("Full  Name *", "NAME"), ("address line 2:", "ADDRESS"), ("Credit card", "CARD_NUMBER"), ("CVV2", "CVC"), ("Date of birth", "DOB"), ("D.O.B.", "DOB"), ("Tax ID", "GOVERNMENT_ID"),
    ("Routing number", "BANK_ACCOUNT"), ("passcode", "PASSWORD"), ("api-key", "API_KEY"), ("Authorization:", "AUTH_TOKEN"), ("recovery phrase", "SECRET"), ("Submit", "none"), ("my email address", "none"), ("Phone number of a friend", "none"),
)


@query(f"SELECT {_case('event_id', *[f[1] for f in _FIELDS])} AS label, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def field_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form labels by the class that they ask for."""
    t = _pick(F.col("event_id"), *[f[0] for f in _FIELDS])
    return read(spark, sf_dir, "events").groupBy(F.coalesce(cues.field_cue(t), F.lit("none")).alias("label"), "event_type").agg(F.count("*").alias("n"))


_FOREIGN = (("first_name", "GIVEN_NAME", "hide_use"), ("LAST_NAME", "SURNAME", "hide_use"), ("card_cvv", "CREDIT_CARD", "blocked"), ("api_key", "API_KEY", "approval"), ("access_token", "AUTH_TOKEN", "approval"), ("odd_label", "ODD_LABEL", "blocked"), ("city", "CITY", "blocked"), ("Phone_Number", "PHONE", "hide_use"), ("national_id_number", "GOVERNMENT_ID", "blocked"), ("street_address", "STREET_NAME", "hide_use"))


@query(f"SELECT {_case('event_id', *[f[0] for f in _FOREIGN])} AS source_label, {_case('event_id', *[f[1] for f in _FOREIGN])} AS label, {_case('event_id', *[f[2] for f in _FOREIGN])} AS level, count(*) AS n FROM events GROUP BY ALL")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of another model in the engine's vocabulary, with their policy level."""
    e = read(spark, sf_dir, "events").withColumn("source_label", _pick(F.col("event_id"), *[f[0] for f in _FOREIGN]))
    return e.groupBy("source_label", cues.model_label(F.col("source_label")).alias("label"), rules.level_of(cues.model_label(F.col("source_label"))).alias("level")).agg(F.count("*").alias("n"))


@query(
    """WITH p(place, k, level) AS (VALUES (0, 'NAME', 'hide_use'), (1, 'EMAIL', 'hide_use'), (2, 'PHONE', 'hide_use'), (3, 'ADDRESS', 'hide_use'), (4, 'DOB', 'hide_use'), (5, 'GOV_ID', 'blocked'), (6, 'SSN', 'blocked'), (7, 'BANK_ACCOUNT', 'blocked'), (8, 'CARD_NUMBER', 'blocked'), (9, 'CVC', 'blocked'), (10, 'PASSWORD', 'blocked'), (11, 'API_KEY', 'approval'), (12, 'AUTH_TOKEN', 'approval'), (13, 'PRIVATE_KEY', 'blocked'), (14, 'SECRET', 'blocked')),
n AS (SELECT c_nationkey % 5 AS s, count(*) AS customers FROM customer GROUP BY 1)
SELECT n.s, CASE WHEN k = 'PHONE' AND n.s = 1 OR k = 'EMAIL' AND n.s = 2 THEN 'blocked' WHEN k = 'SSN' AND n.s = 2 THEN 'approval' ELSE level END AS level, string_agg(k, ',' ORDER BY place) AS classes, any_value(customers) AS customers FROM n CROSS JOIN p GROUP BY 1, 2"""
)
def policy_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by level for groups of customers, two of which have set levels of their own."""
    own = {1: {"PHONE": "blocked"}, 2: {"EMAIL": "blocked", "SSN": "approval"}}
    c = read(spark, sf_dir, "customer").groupBy(F.pmod("c_nationkey", F.lit(5)).alias("s")).agg(F.count("*").alias("customers"))
    each = [vault.grouped_policy(vault.snapshot(spark, own.get(s))).withColumn("s", F.lit(s)) for s in range(5)]
    return c.join(evaluate.union_all(each), "s").select("s", "level", "classes", "customers")


def _span(label: str, start: Column | int, end: Column | int, score: Column, text: str, source: str = "ner") -> Column:
    at = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(at(start).alias("start"), at(end).alias("end"), F.lit(label).alias("label"), score.cast("double").alias("score"), F.lit(source).alias("source"), F.lit(text).alias("text"))


@query(
    """WITH t AS (SELECT (l_partkey + l_linenumber) % 7 AS c, (l_partkey % 20) / 20.0 AS a, (l_suppkey % 20) / 20.0 AS b FROM lineitem)
SELECT c, CASE c WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN a >= 0.4 THEN 1 ELSE 0 END + CASE WHEN b >= 0.4 THEN 1 ELSE 0 END WHEN 2 THEN CASE WHEN a >= 0.5 THEN 1 ELSE 0 END WHEN 3 THEN CASE WHEN a >= 0.72 THEN 1 ELSE 0 END WHEN 4 THEN 0 WHEN 5 THEN 2 ELSE 2 END AS kept, count(*) AS n FROM t GROUP BY 1, 2"""
)
def context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which model spans survive their context, by kind of text and scores."""
    a, b = F.pmod("l_partkey", F.lit(20)) / 20.0, F.pmod("l_suppkey", F.lit(20)) / 20.0
    cases = (
        ("Margulis", (_span("GIVEN_NAME", 0, 3, a, "Mar"), _span("GIVEN_NAME", 3, 6, b, "gul"))),
        ("John Smith", (_span("GIVEN_NAME", 0, 4, a, "John"), _span("SURNAME", 5, 10, b, "Smith"))),
        ("full name Ann", (_span("GIVEN_NAME", 10, 13, a, "Ann"),)),
        ("then Ann Lee went", (_span("GIVEN_NAME", 5, 12, a, "Ann Lee"),)),
        ("build 5173 done", (_span("BUILDING_NUMBER", 6, 10, a, "5173"),)),
        ("Ship to 12 Oak", (_span("BUILDING_NUMBER", 8, 10, a, "12"), _span("STREET_NAME", 11, 14, b, "Oak"))),
        ("12, floor 3", (_span("BUILDING_NUMBER", 0, 2, a, "12"), _span("SECONDARY_ADDRESS", 4, 11, b, "floor 3"))),
    )
    c = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(7))
    kept = F.lit(0)
    for i, (text, found) in enumerate(cases):
        kept = F.when(c == i, F.size(spans.contextual(F.array(*found), F.lit(text)))).otherwise(kept)
    return read(spark, sf_dir, "lineitem").groupBy(c.alias("c"), kept.alias("kept")).agg(F.count("*").alias("n"))


@query(
    """SELECT problem, count(*) AS n FROM (SELECT unnest(CASE o_orderkey % 10 WHEN 1 THEN ['bounds'] WHEN 2 THEN ['value'] WHEN 3 THEN ['overlap', 'value'] WHEN 4 THEN ['class'] WHEN 5 THEN ['split'] WHEN 6 THEN ['text', 'bounds'] WHEN 7 THEN ['split', 'class'] WHEN 8 THEN ['bounds'] ELSE [] END) AS problem FROM orders) GROUP BY 1"""
)
def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records, eight in ten of them broken, by what is wrong with them."""
    k, o = F.pmod("o_orderkey", F.lit(10)), F.col("o_orderkey").cast("string")
    text = F.when(k == 6, "").otherwise(F.concat(F.lit("Ann Lee pays "), o))
    s = lambda a, b, label, value: F.struct(F.lit(a).alias("start"), (b if isinstance(b, Column) else F.lit(b)).cast("int").alias("end"), F.lit(label).alias("label"), (value if isinstance(value, Column) else F.lit(value)).alias("value"))
    fine = F.array(s(13, 13 + F.length(o), "CARD_NUMBER", o), s(0, 7, "NAME", "Ann Lee"))
    found = (
        F.when(k == 1, F.array(s(0, 99, "NAME", "x")))
        .when(k == 2, F.array(s(0, 3, "NAME", "Bob")))
        .when(k == 3, F.array(s(4, 9, "NAME", "Lee p"), s(0, 7, "NAME", "wrong")))
        .when(k.isin(4, 7), F.array(s(0, 3, "PERSON", "Ann")))
        .when(k == 6, F.array(s(0, 3, "NAME", "Ann")))
        .when(k == 8, F.array(s(5, 5, "NAME", "")))
        .otherwise(fine)
    )
    split = F.when(k.isin(5), "test").when(k != 7, "train")
    r = read(spark, sf_dir, "orders").select(o.alias("id"), text.alias("text"), found.alias("spans"), split.alias("split"))
    return curate.violations(r, ["NAME", "CARD_NUMBER"]).groupBy("problem").agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT c_custkey, c_custkey + CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 3000000 ELSE 6000000 END AS n FROM customer),
b AS (SELECT *, '4' || lpad(CAST((n * 7919 + 13) % 100000000000000 AS VARCHAR), 14, '0') AS body FROM n),
l AS (SELECT *, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(body[i] AS INTEGER) > 4 THEN 2 * CAST(body[i] AS INTEGER) - 9 ELSE 2 * CAST(body[i] AS INTEGER) END ELSE CAST(body[i] AS INTEGER) END)) AS s FROM b)
SELECT c_custkey, body || CAST((10 - s % 10) % 10 AS VARCHAR) AS card, printf('+1 (%03d) 555-%04d', n % 800 + 200, n * 31 % 10000) AS phone FROM l"""
)
def synthetic_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up cards and telephones of customers, in three splits that share none."""
    c = read(spark, sf_dir, "customer").select("c_custkey")
    kind = F.pmod("c_custkey", F.lit(3))
    each = [c.where(kind == i).select("c_custkey", synthetic.fake_values(F.col("c_custkey"), s).alias("v")) for i, s in enumerate(("train", "validation", "holdout"))]
    return evaluate.union_all(each).select("c_custkey", "v.card", "v.phone")


_FOLD = """f AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 60, l_partkey % 60 + 3 + l_suppkey % 20, l_linenumber, l_extendedprice) AS i, CAST(l_partkey % 60 AS INTEGER) AS a, CAST(l_partkey % 60 + 3 + l_suppkey % 20 AS INTEGER) AS b, ['NAME', 'EMAIL'][l_suppkey % 2 + 1] AS l, (l_partkey % 100) / 100.0 AS s FROM lineitem)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.pmod("l_partkey", F.lit(60)).cast("int")
    b = (a + 3 + F.pmod("l_suppkey", F.lit(20))).cast("int")
    label = F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "NAME").otherwise("EMAIL")
    s = F.struct(a.alias("start"), b.alias("end"), label.alias("label"), (F.pmod("l_partkey", F.lit(100)) / 100.0).alias("score"), F.lit("ner").alias("source"), F.lit("").alias("text"))
    keyed = F.array_sort(F.collect_list(F.struct(a.alias("a"), b.alias("b"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("p"), s.alias("s"))))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(keyed, lambda x: x["s"]).alias("spans"))


@query(
    f"""WITH RECURSIVE {_FOLD},
r AS (SELECT k, i, [{{'a': a, 'b': b, 'l': l, 's': s}}] AS o FROM f WHERE i = 1 UNION ALL
  SELECT f.k, f.i, CASE WHEN o[-1].l = f.l AND f.a < o[-1].b THEN list_append(o[:-2], {{'a': least(o[-1].a, f.a), 'b': greatest(o[-1].b, f.b), 'l': f.l, 's': greatest(o[-1].s, f.s)}}) ELSE list_append(o, {{'a': f.a, 'b': f.b, 'l': f.l, 's': f.s}}) END FROM r JOIN f ON f.k = r.k AND f.i = r.i + 1)
SELECT k, array_to_string(list_transform(arg_max(o, i), lambda x: x.l || ':' || x.a || '-' || x.b || ':' || CAST(CAST(round(x.s * 100) AS INTEGER) AS VARCHAR)), ' ') AS spans FROM r GROUP BY k"""
)
def window_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of overlapping windows, those of one label that follow each other joined."""
    m = spans.merge_windows(F.col("spans"))
    said = F.transform(m, lambda s: F.concat(s["label"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), F.round(s["score"] * 100).cast("int").cast("string")))
    return _folded(spark, sf_dir).select("k", F.array_join(said, " ").alias("spans"))


@query(
    """WITH d AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS p, l_partkey % 640 / 2.0 AS cx, (l_suppkey % 480 + 80) AS y, l_quantity / 2.0 AS w, CAST(l_linenumber * 4 AS DOUBLE) AS h, CASE WHEN l_discount >= l_tax THEN 0 ELSE 1 END AS class_id, greatest(l_discount, l_tax) AS score FROM lineitem),
e AS (SELECT *, (y - 80) / 2.0 AS cy, greatest(0.04 * w, 2.0) AS px, greatest(0.04 * h / 2, 2.0) AS py FROM d),
b AS (SELECT *, least(320, greatest(0, cx - w / 2 - px)) AS x1, least(240, greatest(0, cy - h / 4 - py)) AS y1, least(320, greatest(0, cx + w / 2 + px)) AS x2, least(240, greatest(0, cy + h / 4 + py)) AS y2 FROM e)
SELECT k, class_id, count(*) AS boxes, round(sum(x1 + y1 + x2 + y2), 4) AS edges, round(sum(score), 6) AS score FROM b WHERE x2 - x1 >= 2 AND y2 - y1 >= 2 GROUP BY 1, 2"""
)
def decoded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector cells of images of 320 x 240 as boxes, by class."""
    cells = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.pmod("l_partkey", F.lit(640)).cast("double").alias("cx"), (F.pmod("l_suppkey", F.lit(480)) + 80).cast("double").alias("cy"), F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 4).cast("double").alias("h"), F.array("l_discount", "l_tax").alias("scores"), F.lit(320).alias("width"), F.lit(240).alias("height")
    )
    b = F.col("b")
    return boxes.decoded(cells).groupBy("k", "class_id").agg(F.count("*").alias("boxes"), F.round(F.sum(b["x1"] + b["y1"] + b["x2"] + b["y2"]), 4).alias("edges"), F.round(F.sum("score"), 6).alias("score"))


@query(
    """SELECT p_size, CAST(round_even(p_size * 31 * s, 0) AS INTEGER) AS width, CAST(round_even((p_partkey % 700 + 1) * s, 0) AS INTEGER) AS height, CAST(floor((640 - round_even(p_size * 31 * s, 0)) / 2) AS INTEGER) AS pad_x, CAST(floor((640 - round_even((p_partkey % 700 + 1) * s, 0)) / 2) AS INTEGER) AS pad_y, count(*) AS n
FROM (SELECT p_size, p_partkey, least(640.0::DOUBLE / (p_size * 31), 640.0::DOUBLE / (p_partkey % 700 + 1)) AS s FROM part) GROUP BY ALL"""
)
def letterboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How images of many sizes are fitted into a square."""
    box = geo.letterbox(F.col("p_size") * 31, F.pmod("p_partkey", F.lit(700)) + 1)
    p = read(spark, sf_dir, "part").withColumn("b", box)
    return p.groupBy("p_size", *[F.col(f"b.{c}").alias(c) for c in ("width", "height", "pad_x", "pad_y")]).agg(F.count("*").alias("n"))


_SOURCES = (("GIVEN-NAME12", "GIVENNAME", "NAME"), ("credit_card_number", "CREDITCARDNUMBER", "CARD_NUMBER"), ("DATE", "DATE", "DOB"), ("date", "DATE", ""), ("BUILDINGNUM3", "BUILDINGNUM", "ADDRESS"), ("oddity", "ODDITY", ""), ("DOB", "DOB", "DOB"), ("Telephone_Num", "TELEPHONENUM", "PHONE"))


@query(f"SELECT {_case('c_custkey', *[s[1] for s in _SOURCES])} AS name, {_case('c_custkey', *[s[2] for s in _SOURCES])} AS class, count(*) AS n FROM customer GROUP BY 1, 2")
def mapped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source labels of training data and their classes; a date counts as a birth date only after words that say so."""
    label = _pick(F.col("c_custkey"), *[s[0] for s in _SOURCES])
    text = F.when(label == "DATE", "Birthday: 1/2/1990").otherwise("Invoice of 1/2/1990")
    return read(spark, sf_dir, "customer").groupBy(rules.source_label(label).alias("name"), F.coalesce(rules.mapped_label(text, label, F.lit(10)), F.lit("")).alias("class")).agg(F.count("*").alias("n"))


_KEYS = (("PII_FULLNAME", "map", "NAME"), ("PII_LOCATION2_NAME", "map", "NAME"), ("PII_EMAIL_2", "map", "EMAIL"), ("PII_CARD_CVV", "map", "CVC"), ("PII_CARD_TYPE", "hard-negative", ""), ("PII_X_COMPANY", "hard-negative", ""), ("PII_GIFT_PIN", "map", "SECRET"), ("PII_AVATAR", "map", "SENSITIVE_IMAGE"), ("PII_CARD_EXPIRY", "map", "SENSITIVE_FIELD"), ("PII_POSTCODE", "map", "ADDRESS"), ("PII_CARD_LAST4", "map", "CARD_NUMBER"), ("PII_THING", "unmapped", ""), ("PII_PROMO_CODE_NAME", "hard-negative", ""))


@query(f"SELECT {_case('o_orderkey', *[k[1] for k in _KEYS])} AS kind, {_case('o_orderkey', *[k[2] for k in _KEYS])} AS class, {_case('o_orderkey', *[k[0] for k in _KEYS])} AS key, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page elements by disposition, class and key."""
    key = _pick(F.col("o_orderkey"), *[k[0] for k in _KEYS])
    d = cues.disposition(key)
    return read(spark, sf_dir, "orders").groupBy(d["kind"].alias("kind"), F.coalesce(d["class"], F.lit("")).alias("class"), key.alias("key")).agg(F.count("*").alias("n"))


_VALUES = (("EMAIL", "a{k}@b.org", True), ("EMAIL", "a b@c.d", False), ("PHONE", "555-0136 {k}", True), ("PHONE", "12-34", False), ("NAME", "Ann O’Neil", True), ("NAME", "Ann {k}", False), ("ADDRESS", "{k}th", True), ("ADDRESS", "Elm", False), ("CVC", "1 23", True), ("CVC", "12x3", False), ("DOB", "in 1990", True), ("BANK_ACCOUNT", "GB82WESTABCD", True), ("OTHER", "abc", False), ("OTHER", "abcd", True), ("NAME", "submit", False), ("CARD_NUMBER", "4000 0000 0000 {k}", True))


@query(f"SELECT {_case('l_partkey', *[v[0] for v in _VALUES])} AS label, {_case('l_partkey', *[str(v[2]).lower() for v in _VALUES])} AS fits, count(*) AS n FROM lineitem GROUP BY 1, 2")
def plausible_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that can and cannot be values of a class."""
    label, text = _pick(F.col("l_partkey"), *[v[0] for v in _VALUES]), _with_key(_pick(F.col("l_partkey"), *[v[1] for v in _VALUES]), "l_linenumber")
    return read(spark, sf_dir, "lineitem").groupBy(label.alias("label"), cues.plausible(label, text).cast("string").alias("fits")).agg(F.count("*").alias("n"))


@query(
    """SELECT event_id, round(1 / (1 + exp(y - x)), 9) AS p, CASE WHEN x >= y THEN 0 ELSE 1 END AS best, lower(to_base(event_id * 7919, 36)) AS b36, CASE WHEN event_id % 4 = 0 THEN 7.5 WHEN event_id % 4 = 1 THEN 0.0 ELSE value END AS finite, strftime(ts, '%Y%m%d-%H%M%S') || '-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 4) AS run
FROM (SELECT *, value / 10 AS x, (event_id % 13) / 3.0 AS y FROM events)"""
)
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax, best place, base 36, finite numbers and run names of events."""
    n, x = F.col("event_id"), F.array(F.col("value") / 10, F.pmod("event_id", F.lit(13)) / 3.0)
    given = F.when(n % 4 == 0, "7.5").when(n % 4 == 1, _pick(n, "inf", "NaN", "x", "")).otherwise(F.col("value").cast("string"))
    return read(spark, sf_dir, "events").select(n.alias("event_id"), F.round(rules.softmax(x)[0], 9).alias("p"), rules.argmax(x).alias("best"), rules.base36(n * 7919).alias("b36"), rules.finite(given).alias("finite"), ledger.run_id(F.col("ts"), n).alias("run"))


@query(
    """SELECT doc_id, md5('set API_TOKEN=[REDACTED] and my_password=[REDACTED] ' || CAST(doc_id AS VARCHAR)) AS md5, true AS folded, 'fi 1' AS nfkc FROM documents"""
)
def inline_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments of secrets without their values; full case folding and compatibility forms."""
    k = F.col("doc_id").cast("string")
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("set API_TOKEN = s"), k, F.lit(" and my_password=p"), k, F.lit(" "), k).alias("t"), F.lit("Straße").alias("a"), F.lit("ﬁ ①").alias("b"))
    return d.select("doc_id", F.md5(rules.redact_assignments(F.col("t"))).alias("md5"), (vault.casefold("a") == F.lit("strasse")).alias("folded"), vault.nfkc("b").alias("nfkc"))


@query(
    """WITH t AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE length(trim(coalesce(text, ''))) > 0), e AS (SELECT conv_id, turn, t, coalesce(sum(length(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM t)
SELECT conv_id, md5(string_agg(t, chr(10) ORDER BY turn)) AS document, CAST(sum(turn * a) AS BIGINT) AS starts, CAST(max(a + length(t)) AS BIGINT) AS "end" FROM e GROUP BY 1"""
)
def finding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as one document with the place of each."""
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), "text")
    d = spans.document_of(c, "conv_id")
    starts = F.aggregate("entries", F.lit(0).cast("long"), lambda a, x: a + x["idx"] * x["start"])
    return d.select("conv_id", F.md5("document").alias("document"), starts.alias("starts"), F.array_max(F.transform("entries", lambda x: x["end"])).cast("long").alias("end"))


@query(
    """WITH m AS (SELECT p_partkey % 40 AS r, p_size AS s, max(p_retailprice % 100 / 100) AS a, max(p_retailprice % 70 / 100) AS b FROM part GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN greatest(a, b) >= 0.5 THEN CASE WHEN a >= b THEN 'NAME' ELSE 'CVC' END END AS k FROM m)
SELECT label, count(*) AS n FROM (SELECT CASE WHEN k IS NULL THEN 'O' WHEN lag(k) OVER (PARTITION BY r ORDER BY s) = k THEN 'I-' || k ELSE 'B-' || k END AS label FROM c) GROUP BY 1"""
)
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of overlapping windows merged by their greatest scores, and their labels."""
    w = read(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(40)).alias("record_index"), F.col("p_size").alias("start"), (F.col("p_size") + 1).alias("end"), F.array((F.col("p_retailprice") % 100) / 100, (F.col("p_retailprice") % 70) / 100).alias("scores"))
    return evaluate.label_sequence(evaluate.merged_probabilities(w), ["NAME", "CVC"]).groupBy("label").agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT l_orderkey AS k, CAST(l_linenumber * 10 AS INTEGER) AS s, ['NAME', 'EMAIL', 'CVC'][l_partkey % 3 + 1] AS l FROM lineitem), p AS (SELECT k, CAST(s + CASE WHEN x % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS s, l FROM (SELECT l_orderkey AS k, l_linenumber * 10 AS s, ['NAME', 'EMAIL', 'CVC'][l_suppkey % 3 + 1] AS l, l_suppkey AS x FROM lineitem)),
a AS (SELECT DISTINCT * FROM t), b AS (SELECT DISTINCT * FROM p), j AS (SELECT coalesce(a.l, b.l) AS label, a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k AND a.s = b.s AND a.l = b.l),
n AS (SELECT label, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS tp, count(*) FILTER (x IS NULL) AS fp, count(*) FILTER (y IS NULL) AS fn FROM j GROUP BY 1)
SELECT label, tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 9) AS f1 FROM n"""
)
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-match precision, recall and F1 of labels."""
    line = read(spark, sf_dir, "lineitem")
    side = lambda by, late: line.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10 + late).alias("start"), (F.col("l_linenumber") * 10 + 5).alias("end"), _pick(F.col(by), "NAME", "EMAIL", "CVC").alias("label"))
    s = evaluate.entity_scores(side("l_partkey", F.lit(0)), side("l_suppkey", F.when(F.pmod("l_suppkey", F.lit(4)) == 0, 1).otherwise(0)))
    return s.select("label", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (event_id * 37 % 101) / 100.0 AS r, value AS s FROM events),
f AS (SELECT user_id, i, r >= 0.2 AS taken, CASE WHEN r >= 0.2 THEN s END AS best, CASE WHEN r >= 0.2 THEN i END AS be, r AS mark FROM e WHERE i = 1 UNION ALL
  SELECT user_id, i, o, CASE WHEN o THEN s ELSE best END, CASE WHEN o THEN i ELSE be END, greatest(mark, r)
  FROM (SELECT e.user_id, e.i, e.r, e.s, f.best, f.be, f.mark, e.r >= 0.2 AND e.r >= f.mark - 0.01 AND (f.best IS NULL OR e.s > f.best) AS o FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, count(*) AS epochs, count(*) FILTER (taken) AS taken, CAST(arg_max(be, i) AS INTEGER) AS best_epoch, round(max(mark), 6) AS mark FROM f GROUP BY 1"""
)
def incumbents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which epochs became the incumbent."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = read(spark, sf_dir, "events").select("user_id", n.alias("epoch"), (F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0).alias("secret_recall"), F.col("value").alias("score"))
    out = evaluate.incumbent(e, 0.2, "user_id")
    return out.groupBy("user_id").agg(F.count("*").alias("epochs"), F.count_if("taken").alias("taken"), F.max_by("best_epoch", "epoch").alias("best_epoch"), F.round(F.max("mark"), 6).alias("mark"))


@query(
    """WITH t AS (SELECT o_orderkey AS k, [CAST(o_orderkey % 3 AS INTEGER), CAST(o_orderkey // 3 % 3 AS INTEGER), CAST(o_orderkey // 9 % 3 AS INTEGER), CAST(o_orderkey // 27 % 3 AS INTEGER)] AS c FROM orders),
x AS (SELECT k, list_filter(range(1, 5), lambda i: c[i] <> 0 AND (i = 1 OR c[i] <> c[i - 1])) AS hit, c FROM t)
SELECT k, array_to_string(list_transform(hit, lambda i: ['a', 'b'][c[i]]), '') AS text, CASE WHEN len(hit) > 0 THEN round(list_sum(list_transform(hit, lambda i: i / 10.0)) / len(hit), 9) ELSE 0 END AS confidence FROM x"""
)
def recogniser_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class sequences as texts: repeats and blanks go."""
    k = F.col("o_orderkey")
    c = F.array(*[F.pmod(F.floor(k / 3**i), F.lit(3)).cast("int") for i in range(4)])
    text = spans.ctc_text(c, F.array(*[F.lit((i + 1) / 10.0) for i in range(4)]), F.array(F.lit("a"), F.lit("b")))
    return read(spark, sf_dir, "orders").select(k.alias("k"), text["text"].alias("text"), F.round(text["confidence"], 9).alias("confidence"))


_SPOKEN = (("Ann Lee_Ray", (0, 3, 4, 7), "1", "0-7"), ("Ann....Lee", (0, 3, 7, 10), "2", "0-3 7-10"), ("Ann\nLee x", (0, 3, 4, 7), "1", "0-7"), ("Ann--x Lee", (0, 3, 7, 10), "2", "0-3 7-10"))


@query(f"SELECT event_id, {_case('event_id', *[s[3] for s in _SPOKEN])} AS spans, round(greatest(event_id % 10, 3) / 10.0, 6) AS best FROM events")
def coalesced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring spans of one class with next to nothing between them as one."""
    n = F.col("event_id")
    out = F.lit(None).cast("array<struct<start:int,end:int,label:string,score:double,source:string,text:string>>")
    for i, (text, at, _, _) in enumerate(_SPOKEN):
        s = F.array(_span("GIVEN_NAME", at[0], at[1], n % 10 / 10.0, "Ann"), _span("SURNAME", at[2], at[3], F.lit(0.3), "Lee"))
        out = F.when(F.pmod(n, F.lit(len(_SPOKEN))) == i, spans.coalesce_same(F.lit(text), s)).otherwise(out)
    said = F.array_join(F.transform(out, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " ")
    return read(spark, sf_dir, "events").select("event_id", said.alias("spans"), F.round(F.array_max(F.transform(out, lambda s: s["score"])), 6).alias("best"))


@query(
    r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).') AS c, length(text) >= 30 AS long FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, list_transform(range(len(c)), lambda i: CASE WHEN NOT regexp_matches(c[i + 1], '^[\s\p{Z}]$') AND NOT (long AND i = 7) AND CAST('0x' || md5(doc_id || ':' || i)[1:8] AS BIGINT) / 4294967296.0 < 0.003 THEN '' WHEN c[i + 1] IN ('O', 'o', 'I', 'l', 'S', 'B') AND CAST('0x' || md5(doc_id || ':' || i)[9:16] AS BIGINT) / 4294967296.0 < 0.025
  THEN CASE c[i + 1] WHEN 'O' THEN '0' WHEN 'o' THEN '0' WHEN 'I' THEN '1' WHEN 'l' THEN '1' WHEN 'S' THEN '5' ELSE '8' END ELSE c[i + 1] END) AS o FROM t)
SELECT doc_id, md5(array_to_string(o, '')) AS md5, CASE WHEN long THEN '0-' || (5 - len(list_filter(o[1:5], lambda x: x = ''))) || ' ' || (7 - len(list_filter(o[1:7], lambda x: x = ''))) || '-' || (8 - len(list_filter(o[1:8], lambda x: x = ''))) || ' ' || (10 - len(list_filter(o[1:10], lambda x: x = ''))) || '-' || (30 - len(list_filter(o[1:30], lambda x: x = ''))) ELSE '' END AS spans,
  CAST(len(list_filter(range(len(c)), lambda i: o[i + 1] <> c[i + 1])) AS INTEGER) AS operations FROM e"""
)
def recogniser_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a recogniser might read them, with their spans moved along."""
    s = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("NAME").alias("label"))
    found = F.when(F.length("text") >= 30, F.array(s(0, 5), s(7, 8), s(10, 30))).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>"))
    n = read(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", synthetic.noised(F.col("text"), found, F.col("doc_id").cast("string")).alias("n"))
    said = F.array_join(F.transform("n.spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), " ")
    return n.select("doc_id", F.md5("n.text").alias("md5"), said.alias("spans"), F.size("n.operations").alias("operations"))
