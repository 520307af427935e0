"""Queries of contract checks, log rules, alignment and small rules, with their oracle SQL.

The test tables hold no such records: they are derived from integer and text columns, the same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import cues, rules
from spanveil.functions import geometry as geo
from spanveil.operators import checks, curate, evaluate, ledger, vault
from spanveil.plans.text import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its oracle."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


def _pick(number: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _case(number: str, *values: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][CAST({number} % {len(values)} AS INTEGER) + 1]"


@query(
    """WITH e AS (SELECT CAST(l_partkey % 300 - 50 AS DOUBLE) AS x, CAST(l_suppkey % 200 - 20 AS DOUBLE) AS y, l_quantity - 1 AS w, CAST(l_linenumber * 9 AS DOUBLE) AS h, l_returnflag <> 'A' AS v, l_linestatus = 'F' AS c FROM lineitem),
f AS (SELECT *, x + w > 0 AND y + h > 0 AND x < 200 AND y < 150 AS meets, x < 0 OR y < 0 OR x + w > 200 OR y + h > 150 AS beyond FROM e)
SELECT coalesce(CASE WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN v AND NOT meets THEN 'visible_outside' WHEN v AND c <> beyond THEN 'clipped_disagrees' WHEN NOT v AND meets THEN 'invisible_inside' WHEN NOT v AND c THEN 'clipped_off_screen' END, 'none') AS problem, count(*) AS n FROM f GROUP BY 1"""
)
def box_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by what is wrong with their boxes and flags."""
    e = read(spark, sf_dir, "lineitem")
    p = checks.box_problem(
        (F.pmod("l_partkey", F.lit(300)) - 50).cast("double"), (F.pmod("l_suppkey", F.lit(200)) - 20).cast("double"), F.col("l_quantity") - 1, (F.col("l_linenumber") * 9).cast("double"), F.col("l_returnflag") != "A", F.col("l_linestatus") == "F", F.lit(200), F.lit(150)
    )
    return e.groupBy(F.coalesce(p, F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query(
    """SELECT profile, CASE WHEN l_linenumber % 3 = 0 THEN 'UNREADABLE' WHEN l_linenumber % 3 = 1 THEN 'EMAIL' ELSE 'EMAIL + NAME' END AS label, count(*) AS n, round(sum(greatest(l_discount, l_tax, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity / 100 END)), 6) AS score
FROM lineitem, (VALUES ('balanced'), ('high-recall')) p(profile) WHERE l_returnflag <> 'A' AND (l_linestatus = 'O' OR profile = 'high-recall') GROUP BY 1, 2"""
)
def sensitivity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings to mask by profile and label."""
    n = F.pmod("l_linenumber", F.lit(3))
    f = read(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") != "A").alias("sensitive"),
        (F.col("l_linestatus") != "O").alias("uncertain"),
        F.slice(F.array(F.lit("EMAIL"), F.lit("NAME")), F.lit(1), n).alias("labels"),
        F.col("l_discount").alias("detector_score"),
        F.col("l_tax").alias("ocr_confidence"),
        F.when(n > 0, F.array(F.col("l_quantity") / 100)).otherwise(F.array().cast("array<double>")).alias("value_scores"),
    )
    both = [checks.sensitivity_gate(f, p).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score")).withColumn("profile", F.lit(p)) for p in ("balanced", "high-recall")]
    return both[0].unionByName(both[1])


_CALL = "to_json(struct(role AS tool_name, text AS thought, named_struct('name', 'f', 'arguments', named_struct('q', text, 'more', array(role, text))) AS function, text AS query))"


@query(
    """SELECT conv_id, turn, path, length(value) AS size FROM (
SELECT conv_id, turn, '$.function.arguments.q' AS path, text AS value FROM conversations UNION ALL SELECT conv_id, turn, '$.function.arguments.more[0]', role FROM conversations UNION ALL SELECT conv_id, turn, '$.function.arguments.more[1]', text FROM conversations UNION ALL SELECT conv_id, turn, '$.query', text FROM conversations) WHERE value IS NOT NULL"""
)
def executed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of calls that are executed, by path."""
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("k"), F.expr(_CALL).alias("action"))
    w = vault.walk(c, "k").where(checks.executed(F.col("path")))
    return w.select(F.floor(F.col("k") / 100_000).alias("conv_id"), F.pmod("k", F.lit(100_000)).alias("turn"), "path", F.length("value").cast("long").alias("size"))


_RUNNER = ("\t--- redaction ON: ", "--- redaction OFF", "--- preflight: x answered a 1-token probe", "--- preflight: ", "ERROR: model m rejected a 1-token probe (HTTP 402)", "--- runs dir shredded", "--- holo exit: 0", "some Error here", '{"error": 1}', "model advertised: True", "nothing to see ")


@query(
    f"""WITH l AS (SELECT ltrim({_case("event_id", *_RUNNER)}, chr(9)) || CASE WHEN event_id % 11 IN (0, 3, 6, 10) THEN event_type ELSE '' END AS line FROM events)
SELECT coalesce(CASE WHEN line LIKE '--- redaction ON%' THEN 'engine_ready' WHEN line LIKE '--- redaction OFF%' THEN 'bypassed' WHEN line LIKE '%advertised: True' THEN 'model_found' WHEN line LIKE '--- preflight:%answered a 1-token probe' THEN 'provider_connected' WHEN line LIKE '--- preflight:%' THEN 'provider_checked'
WHEN line LIKE 'ERROR: model %rejected a 1-token probe (HTTP 402)%' THEN 'model_unavailable' WHEN line LIKE '--- runs dir shredded%' THEN 'artifacts_cleared' WHEN regexp_matches(line, '^--- holo exit: 0') THEN 'agent_finished' WHEN contains(upper(line), 'ERROR') AND NOT line LIKE '{{%' THEN 'error' END, 'private') AS kind, count(*) AS n FROM l GROUP BY 1"""
)
def runner_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A runner's lines by the kind of event that they tell of."""
    line = F.concat(_pick(F.col("event_id"), *_RUNNER), F.when(F.pmod("event_id", F.lit(11)).isin(0, 3, 6, 10), F.col("event_type")).otherwise(""))
    return read(spark, sf_dir, "events").groupBy(F.coalesce(ledger.runner_event(line), F.lit("private")).alias("kind")).agg(F.count("*").alias("n"))


_LOG = ("--- step ", "💭 ", "⚡ do ", "│ 📝 ", "failed: ", "user: ", "│ ─── ", "MY_API_KEY=abc123 click ", "plain ", "\x1b[31mThought\x1b[0m ", "\t user: action ", "\u00a0user: click ", "\u2003\x1b[1m--- task: ")


@query(
    f"""WITH l AS (SELECT doc_id, regexp_replace(regexp_replace({_case("doc_id", *_LOG)} || coalesce(text, ''), chr(27) || '\\[[0-9;]*m', '', 'g'), '^[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\p{{Z}}]+|[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\p{{Z}}]+$', '', 'g') AS t FROM documents),
u AS (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(t, '^[│ ]+|[│ ]+$', '', 'g'), '(?i)\\b([A-Z_]*(?:API_KEY|AUTH_TOKEN|PASSWORD|SECRET|TOKEN|KEY))\\s*=\\s*([^\\s]+)', '\\1=[REDACTED]', 'g'), '[\\x00-\\x08\\x0a-\\x1f]', '', 'g') AS k FROM l),
v AS (SELECT doc_id, t, CASE WHEN length(k) > 2000 THEN substr(k, 1, 1997) || '…' ELSE k END AS k FROM u),
c AS (SELECT doc_id, k, CASE WHEN k LIKE '---%' THEN 'runtime' WHEN contains(k, '💭') OR regexp_matches(k, '^(?i:thought|reasoning)') THEN 'reasoning' WHEN contains(k, '⚡') OR regexp_matches(k, '(?i)click|write|scroll|keypress|tool_call|action') THEN 'action' WHEN contains(k, '📝') OR regexp_matches(k, '(?i)answer') THEN 'answer' WHEN regexp_matches(k, '(?i)error|failed') THEN 'error' END AS channel FROM v WHERE NOT t LIKE 'user:%' AND NOT t LIKE '--- task:%' AND NOT regexp_matches(k, '^[─━═╭╮╰╯┌┐└┘┄┈ ]*$'))
SELECT doc_id, channel, md5(k) AS text_md5 FROM c WHERE channel IS NOT NULL"""
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be kept of log lines, by channel."""
    line = F.concat(_pick(F.col("doc_id"), *_LOG), F.coalesce("text", F.lit("")))
    d = read(spark, sf_dir, "documents").select("doc_id", ledger.log_line(line).alias("l")).where(F.col("l").isNotNull())
    return d.select("doc_id", F.col("l.channel").alias("channel"), F.md5("l.text").alias("text_md5"))


@query(
    """SELECT 'default' AS request, p_brand AS "group", count(*) AS n FROM part WHERE p_size % 3 <> 0 GROUP BY 2 UNION ALL SELECT 'all', p_brand, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'named', p_brand, count(*) FROM part WHERE p_name = 'red widget' OR p_brand = 'Brand#2' GROUP BY 2"""
)
def asset_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets selected by default, all of them, and by name or group."""
    a = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("group"), (F.pmod("p_size", F.lit(3)) != 0).alias("default_fetch"))
    sets = {"default": checks.selected_assets(a), "all": checks.selected_assets(a, optional=True), "named": checks.selected_assets(a, ("red widget",), ("Brand#2",))}
    return evaluate.union_all([x.groupBy("group").agg(F.count("*").alias("n")).withColumn("request", F.lit(k)) for k, x in sets.items()])


@query(
    """SELECT path, count(*) AS n FROM (SELECT '$.value' AS path FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT '$.items[1].value' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT '$.items[0].more.value' FROM orders UNION ALL SELECT '$' FROM orders WHERE false) GROUP BY 1"""
)
def forbidden_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which reports hold a raw value."""
    k = "o_orderkey"
    text = F.concat(
        F.lit('{"name": "r", '), F.when(F.pmod(k, F.lit(5)) == 0, F.lit('"value": 1, ')).otherwise(""), F.lit('"items": [{"more": {"value": "x"}}, {'), F.when(F.pmod(k, F.lit(3)) == 0, F.lit('"value": null')).otherwise(F.lit('"values": 2')), F.lit("}]}")
    )
    f = checks.forbidden_fields(read(spark, sf_dir, "orders").select(k, text.alias("report")), k, "report", ("value",))
    return f.groupBy("path").agg(F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT count(*) AS records, count(DISTINCT lang) AS languages, bool_and(text IS NOT NULL) AS complete FROM documents)
SELECT name, actual, required, coalesce(actual = required, false) AS passed FROM (SELECT 'records' AS name, CAST(records AS VARCHAR) AS actual, '1000' AS required FROM m UNION ALL SELECT 'languages', CAST(languages AS VARCHAR), '4' FROM m UNION ALL SELECT 'complete', CAST(complete AS VARCHAR), 'true' FROM m UNION ALL SELECT 'test_used', NULL, 'false' FROM m)"""
)
def manifest_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus manifest against what is required of it."""
    m = read(spark, sf_dir, "documents").agg(F.count("*").alias("records"), F.count_distinct("lang").alias("languages"), F.bool_and(F.col("text").isNotNull()).alias("complete"))
    return checks.contract(m, [("records", "1000"), ("languages", "4"), ("complete", "true"), ("test_used", "false")])


@query("""SELECT s_nationkey AS provider, CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END AS label FROM supplier WHERE s_suppkey % 3 <> 0 AND s_acctbal > 0""")
def ready_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready models of providers' JSON listings."""
    s = read(spark, sf_dir, "supplier")
    name = F.when(F.pmod("s_suppkey", F.lit(4)) == 0, F.lit("")).otherwise(F.col("s_name"))
    m = F.struct(F.col("s_suppkey").cast("string").alias("id"), name.alias("name"), (F.pmod("s_suppkey", F.lit(3)) != 0).alias("is_ready"), F.when(F.col("s_acctbal") <= 0, F.lit(False)).alias("is_active"))
    listing = s.groupBy(F.col("s_nationkey").alias("provider")).agg(F.to_json(F.struct(F.collect_list(m).alias("data"))).alias("listing"))
    return checks.ready_models(listing, "provider")


@query(
    """WITH c AS (SELECT n_regionkey AS context, n_nationkey % 5 + CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS i, CASE WHEN n_regionkey = 2 THEN 'same' WHEN n_regionkey = 3 AND n_nationkey % 2 = 0 THEN '' ELSE n_name END AS name FROM nation),
g AS (SELECT context, count(*) AS n, count(DISTINCT i) AS places, min(i) AS low, max(i) AS high, count(DISTINCT name) AS names, count(*) FILTER (name = '') AS blank FROM c GROUP BY 1)
SELECT context, 'duplicate_index' AS problem FROM g WHERE places < n UNION ALL SELECT context, 'not_contiguous' FROM g WHERE low <> 0 OR high <> places - 1 UNION ALL SELECT context, 'invalid_name' FROM g WHERE blank > 0 UNION ALL SELECT context, 'duplicate_name' FROM g WHERE names < n AND blank = 0"""
)
def class_map_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with class maps."""
    r, k = F.col("n_regionkey"), F.col("n_nationkey")
    name = F.when(r == 2, "same").when((r == 3) & (F.pmod(k, F.lit(2)) == 0), "").otherwise(F.col("n_name"))
    return checks.class_map_problems(read(spark, sf_dir, "nation").select(r.alias("context"), (F.pmod(k, F.lit(5)) + F.when(r == 1, 1).otherwise(0)).alias("index"), name.alias("name")))


_TABLE = {"ship": "ADDRESS", "click": "NAME", "view": None}


@query("SELECT event_type AS key, count(*) AS n FROM events WHERE event_type NOT IN ('ship', 'click', 'view') GROUP BY 1")
def unmapped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source keys that a disposition table leaves out."""
    return checks.unmapped(read(spark, sf_dir, "events"), _TABLE, "event_type").withColumnRenamed("event_type", "key")


@query(
    """SELECT event_id, len(t) AS n, CASE WHEN len(t) > 0 THEN t[1] END AS first FROM (SELECT event_id, regexp_extract_all('to [' || upper(event_type) || '_' || user_id || '] or ' || CASE WHEN event_id % 3 = 0 THEN '[x_1] [A_' || event_id || ']' ELSE '[AB]' END, '(\\[[A-Z][A-Z_]*_\\d+\\])', 1) AS t FROM events)"""
)
def bracket_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playground tokens of texts."""
    e = F.col("event_id").cast("string")
    text = F.concat(F.lit("to ["), F.upper("event_type"), F.lit("_"), F.col("user_id").cast("string"), F.lit("] or "), F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("[x_1] [A_"), e, F.lit("]"))).otherwise("[AB]"))
    t = read(spark, sf_dir, "events").select("event_id", checks.bracket_tokens(text).alias("t"))
    return t.select("event_id", F.size("t").cast("long").alias("n"), F.get("t", F.lit(0)).alias("first"))


@query(
    """WITH r AS (SELECT user_id, event_id % 3 AS c, bool_or(value > 5 AND event_type <> 'error' AND event_id % 7 <> 0) AS ok FROM events GROUP BY 1, 2)
SELECT user_id, coalesce(['native_skill', 'structured_action', 'free_text_marker'][CAST(min(c) FILTER (ok) AS INTEGER) + 1], 'proxy_app_pseudo_tool') AS channel FROM r GROUP BY 1"""
)
def probe_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommended channel of each probe."""
    e = read(spark, sf_dir, "events").select("user_id", _pick(F.col("event_id"), *checks.CHANNELS).alias("channel"), (F.col("event_type") != "error").alias("permitted"), (F.col("value") > 5).alias("emitted"), (F.pmod("event_id", F.lit(7)) != 0).alias("round_trip"))
    return checks.recommended_channel(e, "user_id")


@query(
    """SELECT pgid, count(*) AS members, count(*) FILTER (d) AS detached FROM (SELECT user_id % 20 AS pgid, event_type = 'click' AND user_id % 20 <> 3 AS d FROM events) GROUP BY 1"""
)
def process_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of process groups in a listing, and runtimes detached from group 3."""
    line = F.concat_ws(" ", F.lit(" "), F.col("event_id").cast("string"), F.pmod("user_id", F.lit(20)).cast("string"), F.concat(F.lit("/opt/x/"), F.col("event_type")))
    p = checks.process_table(read(spark, sf_dir, "events").select(line.alias("line")))
    out = checks.detached(p, "click", 3).groupBy("pgid").agg(F.count("*").alias("detached"))
    return p.groupBy("pgid").agg(F.count("*").alias("members")).join(out, "pgid", "left").withColumn("detached", F.coalesce("detached", F.lit(0)).cast("long"))


@query(
    """SELECT n_nationkey AS provider, CASE WHEN a.n IS NOT NULL AND n_nationkey * 30 % 400 < 300 AND n_nationkey % 4 <> 0 THEN 'live ' || a.n ELSE 'preset' END AS models, coalesce(a.n IS NOT NULL AND n_nationkey * 30 % 400 < 300 AND n_nationkey % 4 <> 0 AND n_nationkey % 2 = 0, false) AS live FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) a ON s_nationkey = n_nationkey"""
)
def model_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached model lists while they are young, presets otherwise."""
    k = F.col("s_nationkey")
    cached = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).where(F.pmod(k, F.lit(4)) != 0)
    cached = cached.select(k.alias("provider"), F.concat(F.lit("live "), F.col("n").cast("string")).alias("models"), (F.pmod(k, F.lit(2)) == 0).alias("live"), (F.lit(1000.0) - F.pmod(k * 30, F.lit(400))).alias("at"))
    presets = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("provider"), F.lit("preset").alias("models"))
    return checks.catalogue(cached, presets, F.lit(1000.0), 300.0)


@query(
    """WITH r AS (SELECT c_custkey % 150 AS request, list('NAME_' || c_custkey || '_0000' ORDER BY c_custkey) AS tokens, count(*) AS n, list('NAME_' || c_custkey || '_0000' ORDER BY lower(c_mktsegment || c_custkey % 7), 'NAME_' || c_custkey || '_0000') AS sorted, bool_and(c_custkey % 211 <> 0) AS known FROM customer GROUP BY 1)
SELECT request, n, CASE WHEN known AND n BETWEEN 2 AND 40 THEN array_to_string(sorted, ' ') END AS sorted FROM r"""
)
def hidden_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in order of the values that they hide."""
    c = read(spark, sf_dir, "customer")
    token = F.concat(F.lit("NAME_"), F.col("c_custkey").cast("string"), F.lit("_0000"))
    kept = c.where(F.pmod("c_custkey", F.lit(211)) != 0).select(token.alias("placeholder"), F.concat("c_mktsegment", F.pmod("c_custkey", F.lit(7)).cast("string")).alias("value"))
    r = c.groupBy(F.pmod("c_custkey", F.lit(150)).alias("request")).agg(F.collect_set(token).alias("tokens"))
    return checks.hidden_sort(r, kept, "request").select("request", F.size("tokens").cast("long").alias("n"), F.array_join("sorted", " ").alias("sorted"))


@query(
    """WITH r AS (SELECT o_orderkey AS k, ['sort', 'select', 'rank'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS kind, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS instruction, CAST(o_orderkey % 5 AS INTEGER) AS n, o_orderkey % 13 = 0 AS twice, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 6 AS INTEGER) END AS c FROM orders)
SELECT coalesce(CASE WHEN kind = 'rank' THEN 'kind' WHEN trim(instruction) = '' THEN 'instruction' WHEN n + twice::INT NOT BETWEEN 2 AND 40 THEN 'size' WHEN twice AND n > 0 THEN 'repeated' WHEN c IS NOT NULL AND (kind <> 'select' OR c > n + twice::INT) THEN 'count' END, 'none') AS problem, count(*) AS n FROM r GROUP BY 1"""
)
def semantic_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic requests by what is wrong with them."""
    k = F.col("o_orderkey")
    n = F.pmod(k, F.lit(5)).cast("int")
    tokens = F.transform(F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), n), lambda i: F.concat(F.lit("NAME_"), (i + 1).cast("string"), F.lit("_00ab")))
    tokens = F.when(F.pmod(k, F.lit(13)) == 0, F.concat(tokens, F.array(F.lit("NAME_1_00ab")))).otherwise(tokens)
    p = checks.request_problem(_pick(k, "sort", "select", "rank"), F.when(F.pmod(k, F.lit(11)) == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")), tokens, F.when(F.pmod(k, F.lit(4)) == 0, F.pmod("o_custkey", F.lit(6)).cast("int")))
    return read(spark, sf_dir, "orders").groupBy(F.coalesce(p, F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def subset_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred documents: the limit is the feature."""
    return checks.subset(read(spark, sf_dir, "documents"), ["doc_id"], 100).select("doc_id", "source")


@query(
    """WITH b AS (SELECT p_partkey, greatest(1.0, CAST(p_size * 3 AS DOUBLE) / greatest(1.0, CAST(p_partkey % 9 AS DOUBLE))) AS ratio FROM part)
SELECT p_partkey, CAST((row_number() OVER (ORDER BY ratio, p_partkey) - 1) // 6 AS BIGINT) AS batch FROM b"""
)
def ratio_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in batches by aspect ratio."""
    z = F.lit(0.0)
    b = read(spark, sf_dir, "part").select("p_partkey", z.alias("x1"), z.alias("y1"), (F.col("p_size") * 3).cast("double").alias("x2"), F.pmod("p_partkey", F.lit(9)).cast("double").alias("y2"))
    return checks.ratio_batches(b, ["p_partkey"]).select("p_partkey", "batch")


@query(
    """WITH w AS (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS t FROM documents), v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS t FROM benchmark)
SELECT count(*) AS tokens, count(*) FILTER (v.t IS NULL) AS unknown, count(*) FILTER (v.t IS NULL) / greatest(1, count(*)) AS rate FROM w LEFT JOIN v ON w.t = v.t"""
)
def unknown_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of the documents the benchmark's vocabulary lacks."""
    v = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("token")).distinct()
    return checks.unknown_rate(read(spark, sf_dir, "documents"), v)


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp, round(epoch_us(ts) / 1000.0 - epoch_us(TIMESTAMP '2024-01-01') / 1000.0, 3) AS ms FROM events""")
def iso_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO texts, and milliseconds since the year began."""
    t = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", checks.iso_utc(t).alias("stamp"), checks.duration_ms(F.lit("2024-01-01").cast("timestamp"), t).alias("ms"))


@query(
    """SELECT conv_id, turn, rtrim('head' || chr(10) || 'tail ' || role || chr(10) || text || chr(10) || 'end', chr(10) || ' ') AS t, (turn % 7 = 6) AS open FROM conversations WHERE turn % 7 <> 6
UNION ALL SELECT conv_id, turn, NULL, true FROM conversations WHERE turn % 7 = 6"""
)
def teaching_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without teaching blocks and manifest lines; a block left open gives null."""
    close = F.when(F.pmod("turn", F.lit(7)) == 6, "").otherwise("[/TEACH]")
    text = F.concat(F.lit("head\n"), F.lit("[TEACH]how\nto"), close, F.lit("tail "), F.col("role"), F.lit("\n[TOKENS] a, b\n"), F.col("text"), F.lit("\nend \n"))
    t = checks.strip_block(text, "[TEACH]", "[/TEACH]", "[TOKENS]")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"), t.isNull().alias("open"))


@query(
    """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN '{"a": "NAME_9_ffff and EMAIL_' || (user_id + 1) || '_0000", "b": ["EMAIL_' || (user_id + 1) || '_0000", {"NAME_1_0000": 3}]}' ELSE '{"a": "' || CASE WHEN event_id % 6 = 5 THEN 'NAME_9_ffff' ELSE 'plain' END || ' and u"' || (user_id + 1) || '@x.org", "b": ["u"' || (user_id + 1) || '@x.org", {"NAME_1_0000": 3}]}' END AS resolved, CASE WHEN event_id % 6 = 5 THEN 'NAME_9_ffff' ELSE '' END AS unknown FROM events""".replace(
        'u"', 'u\\"'
    )
)
def nested_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of nested JSON as values; documents with unknown tokens stay."""
    e = read(spark, sf_dir, "events")
    u = (F.col("user_id") + 1).cast("string")
    token = F.concat(F.lit("EMAIL_"), u, F.lit("_0000"))
    text = F.concat(F.lit('{"a": "'), F.when(F.pmod("event_id", F.lit(6)) == 5, "NAME_9_ffff").otherwise("plain"), F.lit(" and "), token, F.lit('", "b": ["'), token, F.lit('", {"NAME_1_0000": 3}]}'))
    kept = e.select(token.alias("placeholder"), F.concat(F.lit('u"'), u, F.lit("@x.org")).alias("value")).distinct().unionByName(e.sparkSession.createDataFrame([("NAME_1_0000", "no key")], "placeholder string, value string"))
    out = checks.resolve_nested(e.select("event_id", text.alias("action")), kept, "event_id")
    return out.select("event_id", "resolved", F.array_join("unknown", ",").alias("unknown"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(greatest(0, floor(l_partkey % 300 - 20.5)) AS INTEGER) AS x1, CAST(greatest(0, floor(l_suppkey % 200 - 10.25)) AS INTEGER) AS y1, CAST(least(400, ceil(l_partkey % 300 + l_quantity * 3.5)) AS INTEGER) AS x2, CAST(least(300, ceil(l_suppkey % 200 + l_linenumber * 20.5)) AS INTEGER) AS y2, CAST(greatest(32, round_even(l_partkey / 32.0, 0) * 32) AS INTEGER) AS side FROM lineitem"""
)
def mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pixels under boxes, and detector sides."""
    x, y = F.pmod("l_partkey", F.lit(300)), F.pmod("l_suppkey", F.lit(200))
    b = F.struct((x - 20.5).alias("x1"), (y - 10.25).alias("y1"), (x + F.col("l_quantity") * 3.5).alias("x2"), (y + F.col("l_linenumber") * 20.5).alias("y2"))
    return read(spark, sf_dir, "lineitem").withColumn("m", geo.mask_cells(b, F.lit(400), F.lit(300))).select("l_orderkey", "l_linenumber", "l_partkey", "m.*", geo.detector_side(F.col("l_partkey")).alias("side"))


@query("SELECT l_orderkey, min(l_extendedprice) AS x1, min(l_quantity) AS y1, max(l_extendedprice) AS x2, max(l_quantity) AS y2 FROM lineitem GROUP BY 1")
def quad_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each order's points."""
    p = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array("l_extendedprice", "l_quantity")).alias("p"))
    return p.select("l_orderkey", geo.quad_bounds(F.col("p")).alias("b")).select("l_orderkey", "b.*")


@query(
    """SELECT event_id, coalesce(TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'abc' WHEN 1 THEN NULL ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0) AS finite, greatest(0, 20 - value) AS remaining, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'interrupted' WHEN event_type = 'click' THEN 'running' ELSE event_type END AS status FROM events"""
)
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite numbers, time that remains, interrupted runs."""
    k = F.pmod("event_id", F.lit(4))
    v = F.when(k == 0, F.lit("abc")).when(k == 1, F.lit(None).cast("string")).otherwise(F.col("value").cast("string"))
    status = F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type"))
    alive = F.when(F.pmod("user_id", F.lit(2)) == 1, F.lit(True))
    return read(spark, sf_dir, "events").select("event_id", rules.finite(v).alias("finite"), ledger.remaining(F.lit(20.0), F.col("value")).alias("remaining"), ledger.interrupted(status, alive).alias("status"))


@query("SELECT event_id, user_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 20) THEN 'flagged' ELSE event_type END AS event_type FROM events")
def marked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users with a great error, marked."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return ledger.marked(e, e.where("event_type = 'error' AND value > 20"), "user_id", "event_type", "flagged").drop("value")


@query(
    """WITH c AS (SELECT DISTINCT o_orderpriority AS class FROM orders), m AS (SELECT o_orderpriority AS class, o_orderstatus AS s, avg(o_totalprice) / 500000 AS recall, min(o_totalprice) / 500000 AS p FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1, 2)
SELECT class, round(coalesce(recall, 0), 9) AS recall, round(coalesce(p, 0), 9) AS precision FROM c LEFT JOIN m USING (class)"""
)
def aligned_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics for every class of a taxonomy."""
    o = read(spark, sf_dir, "orders")
    m = o.where("o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'").groupBy(F.col("o_orderpriority").alias("class")).agg((F.avg("o_totalprice") / 500000).alias("recall"), (F.min("o_totalprice") / 500000).alias("precision"))
    a = evaluate.align_classes(m, o.select(F.col("o_orderpriority").alias("class")).distinct())
    return a.select("class", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query(
    """WITH m AS (SELECT user_id % 20 AS epoch, CASE event_type WHEN 'error' THEN 'SECRET' WHEN 'click' THEN 'CVC' ELSE event_type END AS class, avg(value) / 100 AS recall, min(value) / 100 AS precision FROM events GROUP BY 1, 2)
SELECT epoch, round(min(recall) FILTER (class IN ('SECRET', 'CVC', 'CARD_NUMBER')), 9) AS secret_recall_min, round(avg(recall) FILTER (class NOT IN ('SECRET', 'CVC', 'CARD_NUMBER')), 9) AS other_recall_mean, round(avg(precision), 9) AS precision_mean FROM m GROUP BY 1"""
)
def safety_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safety figures of each epoch."""
    c = F.when(F.col("event_type") == "error", "SECRET").when(F.col("event_type") == "click", "CVC").otherwise(F.col("event_type"))
    m = read(spark, sf_dir, "events").groupBy(F.pmod("user_id", F.lit(20)).alias("epoch"), c.alias("class")).agg((F.avg("value") / 100).alias("recall"), (F.min("value") / 100).alias("precision"))
    s = evaluate.safety_summary(m)
    return s.select("epoch", *[F.round(x, 9).alias(x) for x in ("secret_recall_min", "other_recall_mean", "precision_mean")])


@query(
    """WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, [l_discount, l_tax, 0.05] AS x, [l_tax, l_discount, 0.06] AS y FROM lineitem),
e AS (SELECT list_position(x, list_max(x)) = list_position(y, list_max(y)) AS same, 2 * abs(x[1] - x[2]) + 0.01 AS s, greatest(abs(x[1] - x[2]), 0.01) AS top FROM j)
SELECT round(avg(same::INT), 9) AS argmax_agreement, round(sum(s) / (3 * count(*)), 9) AS mean_abs_error, round(max(top), 9) AS max_abs_error FROM e"""
)
def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two models' scores agree."""
    li = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")]).alias("k"), "l_discount", "l_tax")
    a, b = li.select("k", F.array("l_discount", "l_tax", F.lit(0.05)).alias("scores")), li.select("k", F.array("l_tax", "l_discount", F.lit(0.06)).alias("scores"))
    r = evaluate.agreement(a, b, "k")
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@query("""SELECT 'records' AS name, CAST(count(*) AS VARCHAR) AS actual, CAST(count(*) + 1 AS VARCHAR) AS expected, false AS same FROM documents UNION ALL SELECT 'languages', CAST(count(DISTINCT lang) AS VARCHAR), CAST(count(DISTINCT lang) AS VARCHAR), true FROM documents""")
def compared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed figures against a manifest's."""
    m = read(spark, sf_dir, "documents").agg(F.count("*").alias("records"), F.count_distinct("lang").alias("languages"))
    c = evaluate.compare_counts(m, m.withColumn("records", F.col("records") + 1), ["records", "languages"])
    return c.toDF("name", "actual", "expected", "same")


@query(
    """WITH d AS (SELECT s_nationkey AS b, bool_and(s_acctbal > 0) AS ok FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY 1) SELECT n_name AS backend, CASE WHEN ok IS NULL THEN 'pending' WHEN ok THEN 'passed' ELSE 'failed' END AS status, CASE WHEN NOT ok THEN 'low' ELSE '' END AS errors FROM nation LEFT JOIN d ON b = n_nationkey"""
)
def backend_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each required backend stands."""
    n = read(spark, sf_dir, "nation")
    done = read(spark, sf_dir, "supplier").where("s_nationkey % 5 <> 0").groupBy("s_nationkey").agg(F.bool_and(F.col("s_acctbal") > 0).alias("ok"))
    done = done.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("backend"), "ok", F.lit("low").alias("error"))
    s = evaluate.backend_status(n.select(F.col("n_name").alias("backend")), done)
    return s.toDF("backend", "status", "errors").withColumn("errors", F.array_join("errors", ","))


@query(
    """SELECT l_orderkey, class, x1, y1, x2, y2, array_to_string(list_sort(list_distinct(list(key))), ',') AS keys, bool_or(clipped) AS clipped, count(*) AS n FROM (SELECT l_orderkey, l_returnflag AS class, CAST(l_partkey % 3 AS DOUBLE) AS x1, CAST(l_suppkey % 2 AS DOUBLE) AS y1, CAST(l_partkey % 3 + 4 AS DOUBLE) AS x2, CAST(l_suppkey % 2 + 5 AS DOUBLE) AS y2, 'k' || l_linenumber AS key, l_linestatus = 'F' AS clipped FROM lineitem) GROUP BY ALL"""
)
def deduped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of equal class and box as one."""
    x, y = F.pmod("l_partkey", F.lit(3)).cast("double"), F.pmod("l_suppkey", F.lit(2)).cast("double")
    a = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("class"), x.alias("x1"), y.alias("y1"), (x + 4).alias("x2"), (y + 5).alias("y2"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("key"), (F.col("l_linestatus") == "F").alias("clipped"))
    return curate.deduped_boxes(a, "l_orderkey").withColumn("keys", F.array_join("keys", ","))


@query(
    """SELECT coalesce(a.p, b.p) AS path, CASE WHEN b.p IS NULL THEN 'unlisted' WHEN a.p IS NULL THEN 'missing' ELSE 'mismatch' END AS problem FROM (SELECT CAST(doc_id AS VARCHAR) AS p, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS p, sha256(coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 11 <> 0) b ON a.p = b.p WHERE a.h IS DISTINCT FROM b.h"""
)
def file_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against a manifest of their hashes."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("t"))
    have = d.where("doc_id % 7 <> 0").select("path", F.sha2("t", 256).alias("sha256"))
    want = d.where("doc_id % 11 <> 0").select("path", F.sha2(F.concat("t", F.when(F.pmod("doc_id", F.lit(10)) == 0, "x").otherwise("")), 256).alias("sha256"))
    return curate.file_mismatch(have, want)


@query("SELECT part, count(*) AS n, count(text) AS texts FROM (SELECT 0 AS part, text FROM documents UNION ALL SELECT 1, text FROM benchmark UNION ALL SELECT 2, text FROM conversations) GROUP BY 1")
def chained_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with texts one after another."""
    return curate.chained(*[read(spark, sf_dir, t) for t in ("documents", "benchmark", "conversations")]).groupBy("part").agg(F.count("*").alias("n"), F.count("text").alias("texts"))


_TOOLS = ("⟦TOOL:sort:NAME_1_aa,NAME_2_aa:r1⟧", "⟦TOOL:select:EMAIL_1_aa:r2:pick one⟧", "⟦TOOL:dance:A_1_a:r3⟧")


@query(
    f"""WITH t AS (SELECT doc_id, {_case("doc_id", *_TOOLS)} || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN {_case("(doc_id + 1)", *_TOOLS)} || {_case("doc_id", *_TOOLS)} ELSE '' END AS t FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(t, '⟦TOOL:[a-z_]+:[^:⟧]*:[A-Za-z0-9_-]+(?::[^⟧]*)?⟧')[1:2]) AS m FROM t)
SELECT doc_id, regexp_extract(m, '^⟦TOOL:([a-z_]+)', 1) AS verb, CASE WHEN regexp_extract(m, '^⟦TOOL:([a-z_]+)', 1) IN ('echo', 'add', 'sort') THEN 'deterministic' WHEN regexp_extract(m, '^⟦TOOL:([a-z_]+)', 1) IN ('select', 'rank', 'sort_by') THEN 'semantic' END AS route, len(string_split(regexp_extract(m, '^⟦TOOL:[a-z_]+:([^:⟧]*)', 1), ',')) AS tokens FROM m"""
)
def tool_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool markers in texts, and where they go."""
    k = F.col("doc_id")
    text = F.concat(_pick(k, *_TOOLS), F.coalesce("text", F.lit("")), F.when(F.pmod(k, F.lit(2)) == 0, F.concat(_pick(k + 1, *_TOOLS), _pick(k, *_TOOLS))).otherwise(""))
    m = read(spark, sf_dir, "documents").select("doc_id", F.explode(ledger.markers(text)).alias("m"))
    return m.select("doc_id", "m.verb", ledger.routed(F.col("m.verb")).alias("route"), F.size("m.tokens").cast("long").alias("tokens"))


@query(
    """SELECT event_type, profile, CASE profile WHEN 'balanced' THEN CASE k WHEN 'NAME' THEN 0.25 WHEN 'CVC' THEN 0.03 WHEN 'SENSITIVE_IMAGE' THEN 0.5 END ELSE CASE k WHEN 'NAME' THEN 0.1 WHEN 'CVC' THEN 0.01 WHEN 'SENSITIVE_IMAGE' THEN 0.35 END END ::DOUBLE AS least, count(*) AS n FROM (SELECT event_type, CASE event_type WHEN 'click' THEN 'NAME' WHEN 'error' THEN 'CVC' ELSE 'SENSITIVE_IMAGE' END AS k FROM events), (VALUES ('balanced'), ('high-recall')) p(profile) GROUP BY ALL"""
)
def least_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least score of each class by profile."""
    k = F.when(F.col("event_type") == "click", "NAME").when(F.col("event_type") == "error", "CVC").otherwise("SENSITIVE_IMAGE")
    e = read(spark, sf_dir, "events")
    return evaluate.union_all([e.groupBy("event_type", cues.least_score(k, p).alias("least")).agg(F.count("*").alias("n")).withColumn("profile", F.lit(p)) for p in ("balanced", "high-recall")])


@query(
    """SELECT c_custkey, '10.0.' || c_nationkey || '.7' AS host, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1000 + c_nationkey END AS port, false AS loopback FROM customer WHERE c_custkey % 4 <> 0
UNION ALL SELECT c_custkey, '::1', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1000 + c_nationkey END, true FROM customer WHERE c_custkey % 4 = 0"""
)
def connection_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and ports of addresses, and which are the machine itself."""
    n = F.col("c_nationkey").cast("string")
    h = F.when(F.pmod("c_custkey", F.lit(4)) == 0, "[::1]").otherwise(F.concat(F.lit("10.0."), n, F.lit(".7")))
    a = F.concat(h, F.when(F.pmod("c_custkey", F.lit(3)) == 0, "").otherwise(F.concat(F.lit(":"), (F.col("c_nationkey") + 1000).cast("string"))))
    return read(spark, sf_dir, "customer").select("c_custkey", rules.host(a).alias("host"), rules.port(a).alias("port"), rules.is_loopback(a).alias("loopback"))


@query(
    """SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160) AS preview, trim(regexp_replace(source, '[^A-Za-z0-9_.-]+', '-', 'g'), '-') || '-' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 10) AS stem FROM documents"""
)
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews and file stems: the first 160 characters are the feature."""
    return read(spark, sf_dir, "documents").select("doc_id", rules.preview(F.col("text")).alias("preview"), rules.safe_stem(F.col("source"), F.col("doc_id").cast("string")).alias("stem"))


@query("SELECT user_id, event_type, count(*) AS n, length(event_type) AS size FROM events GROUP BY 1, 2")
def computed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of a text, computed once for each distinct text."""
    return checks.once(read(spark, sf_dir, "events"), "event_type", "size", lambda c: F.length(c).cast("long")).groupBy("user_id", "event_type", "size").agg(F.count("*").alias("n"))


@query(
    """SELECT problem, count(*) AS n, CAST(sum(CASE WHEN problem = 'none' AND o_orderkey % 6 IN (0, 2) THEN o_orderkey ELSE 0 END) AS BIGINT) AS keys FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 3, 5) THEN 'invalid' WHEN o_orderkey % 4 = 0 THEN 'count' ELSE 'none' END AS problem FROM orders) GROUP BY 1"""
)
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lists of elements by what is wrong with them."""
    k = F.col("o_orderkey")
    text = F.replace(_pick(k, '[{"key": "{k}"}, {"key": {"deep": [1, null]}}]', "[1, 2]", '[{"key": "{k}", "more": {"key": [{}]}}, {}]', '{"key": "{k}"}', "[]", '[{"key": "{k}"}, null]'), F.lit("{k}"), k.cast("string"))
    count = F.when(F.pmod(k, F.lit(6)) == 4, 0).otherwise(2) + F.when(F.pmod(k, F.lit(4)) == 0, 1).otherwise(0)
    e = checks.elements(text, count, "struct<key:string>")
    key = F.coalesce(F.get(e["elements"], F.lit(0))["key"].try_cast("long"), F.lit(0))
    return read(spark, sf_dir, "orders").groupBy(F.coalesce(e["problem"], F.lit("none")).alias("problem")).agg(F.count("*").alias("n"), F.sum(key).alias("keys"))


@query(
    """SELECT n_nationkey AS token, CASE WHEN n_nationkey % 3 = 0 THEN [n_nationkey::DOUBLE, 1.0] WHEN n_nationkey % 3 = 1 THEN [n_nationkey // 3 * 3 + 1.5, 1.0] ELSE [-1.0, -1.0] END AS v FROM nation"""
)
def remapped_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of new tokens: the old one's, else the mean of the pieces' vectors, else their own."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("token"))
    own = n.withColumn("v", F.array(F.lit(-1.0), F.lit(-1.0)))
    ids = spark.range(0, 40).select(F.col("id").cast("int").alias("token"))
    old = ids.where("token % 3 = 0").withColumn("v", F.array(F.col("token").cast("double"), F.lit(1.0)))
    base = F.floor(F.col("token") / 3).cast("int") * 3
    pieces = n.where("token % 3 = 1").select("token", F.explode(F.array(base, base + 3)).alias("piece"))
    return curate.remapped(own, old, pieces).select("token", "v")
