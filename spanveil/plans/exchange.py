"""Queries of exchange formats: JSON lines, event streams, actions, schemas, manifests; and of reports by slice, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.cluster import shared
from spanveil.operators import actions, checks, curate, evaluate, spans, vault
from spanveil.plans.contracts import _case, _pick
from spanveil.plans.tables import _COVER, _TRUTH, _views
from spanveil.plans.text import read
from spanveil.sources import config, files

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


@query("SELECT doc_id, lang, n_chars, md5(text) AS md5 FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read again under a schema, blank lines not allowed."""
    d = read(spark, sf_dir, "documents")
    path = f"{shared(spark)}/lines-{uuid.uuid4().hex}"
    files.write_jsonl(d, path)
    return files.read_jsonl(spark, path, d.schema, strict=True).select("doc_id", "lang", "n_chars", F.md5("text").alias("md5"))


_STREAM = "concat('event: x\\n', 'data: ', to_json(struct('m' AS model, array(struct(struct(role, text AS content) AS delta, if(turn % 3 = 2, 'stop', null) AS finish_reason)) AS choices)), '\\r\\n\\n', if(turn % 4 = 3, 'data: [DONE]\\n', ': note\\n'))"


@query(
    """SELECT conv_id, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS content, arg_max(CASE WHEN turn % 3 = 2 THEN 'stop' END, CASE WHEN turn % 3 = 2 THEN turn END) AS finish_reason, bool_or(turn % 4 = 3) AS complete, CAST(count(*) + count(*) FILTER (turn % 4 = 3) AS BIGINT) AS events FROM conversations GROUP BY 1"""
)
def event_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as server-sent events, put together again."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_STREAM).alias("part"))
    raw = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "").alias("value"))
    done = files.sse_completion(raw, "conv_id").select("conv_id", F.md5("content").alias("content"), "finish_reason", "complete")
    return done.join(files.sse_summary(raw, "conv_id").select("conv_id", "events"), "conv_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE sha256(text) END AS sha256 FROM documents")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes out of base64 data URLs; others have none."""
    head = F.when(F.pmod("doc_id", F.lit(5)) == 4, "data:text/plain,").otherwise("data:image/png;name=x;base64,")
    url = F.concat(head, F.base64(F.col("text").cast("binary")))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(files.data_url_bytes(url), 256).alias("sha256"))


_SHAPES = (
    '{"tool_calls":[{"tool_name":"open","url":" https://a/{k} "},{"function":{"name":"type"},"type":"function"}]}',
    '{"tool_call":{"name":"send","arguments":{"target":"t{k}"}}}',
    '{"tool_name":"click","coordinates":[1,2]}',
    '{"action":"write","text":"x{k}"}',
    '{"action":{"type":"scroll","args":{"destination":"d"}}}',
    '{"note":"none"}',
)


@query(
    """SELECT o_orderkey AS k, n - 1 AS at, CASE o_orderkey % 6 WHEN 0 THEN ['open', 'type'][n] WHEN 1 THEN 'send' WHEN 2 THEN 'click' WHEN 3 THEN 'write' ELSE 'scroll' END AS name, CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN n = 1 THEN 'https://a/' || o_orderkey END WHEN 1 THEN 't' || o_orderkey WHEN 4 THEN 'd' END AS target
FROM orders, (SELECT unnest(range(1, 3)) AS n) WHERE o_orderkey % 6 <> 5 AND (n = 1 OR o_orderkey % 6 = 0)"""
)
def executed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of actions of four shapes, their names and targets."""
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.replace(_pick(F.col("o_orderkey"), *_SHAPES), F.lit("{k}"), F.col("o_orderkey").cast("string")).alias("action"))
    return actions.calls(a, "k").select("k", F.col("at").cast("long").alias("at"), actions.call_name(F.col("call")).alias("name"), actions.call_target(F.col("call")).alias("target"))


@query(
    """SELECT doc_id, sha256('{"a":[1,{"b":"' || doc_id || '"}],"z":' || doc_id || '}') AS digest, '{"k": ' || doc_id || ', "v": "x"}' AS last, CASE doc_id % 3 WHEN 0 THEN 'hi ' || doc_id WHEN 1 THEN CAST(doc_id + 2 AS VARCHAR) ELSE 'a, b, ' || doc_id END AS tool FROM documents WHERE doc_id % 3 < 2 UNION ALL
SELECT doc_id, sha256('{"a":[1,{"b":"' || doc_id || '"}],"z":' || doc_id || '}'), '{"k": ' || doc_id || ', "v": "x"}', array_to_string(list_sort(['b', CAST(doc_id AS VARCHAR), 'a']), ', ') FROM documents WHERE doc_id % 3 = 2"""
)
def json_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests, last objects in prose, and the deterministic tools."""
    k = F.col("doc_id").cast("string")
    doc = F.concat(F.lit('{ "z": '), k, F.lit(', "a" : [1, {"b": "'), k, F.lit('"}]}'))
    prose = F.concat(F.lit('first {"k": 0} then {broken and {"v": "x", "k": '), k, F.lit("} done"))
    kind = _pick(F.col("doc_id"), "echo", "add", "sort")
    args = F.when(kind == "echo", F.concat(F.lit('{"text":"hi '), k, F.lit('"}'))).when(kind == "add", F.concat(F.lit('{"a":'), k, F.lit(',"b":2}'))).otherwise(F.concat(F.lit('{"items":["b","'), k, F.lit('","a"]}')))
    return read(spark, sf_dir, "documents").select("doc_id", actions.canonical_digest(doc).alias("digest"), actions.last_object(prose).alias("last"), actions.run_tool(kind, args).alias("tool"))


@query(
    """SELECT conv_id, 'messages,model,stream,tools' AS keys, count(*) AS messages, string_agg(role, ',' ORDER BY turn) AS roles, conv_id % 2 = 0 AS stream, true AS has_tools, 'a,properties.a.b' AS paths, 'properties.a.b' AS strings, 'x' || conv_id AS enums FROM conversations GROUP BY conv_id"""
)
def request_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of requests and of their tools' schemas, without contents."""
    m = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
    k = F.col("conv_id")
    schema = F.concat(F.lit('{"properties":{"a":{"type":"object","properties":{"b":{"type":"string","enum":["x'), k.cast("string"), F.lit('",3]}}}}}'))
    r = m.select("conv_id", F.to_json(F.struct(F.lit("m").alias("model"), "messages", (k % 2 == 0).alias("stream"), F.array(F.lit(1)).alias("tools"))).alias("request"), actions.schema_shape(schema).alias("s"))
    shape = actions.request_shape(r, "conv_id")
    said = lambda c: F.array_join(c, ",")
    paths = r.select("conv_id", said("s.property_paths").alias("paths"), said("s.string_fields").alias("strings"), said("s.enums").alias("enums"))
    return shape.select("conv_id", said("request_keys").alias("keys"), F.col("messages").cast("long").alias("messages"), said("roles").alias("roles"), "stream", "has_tools").join(paths, "conv_id")


@query(
    """WITH v AS (SELECT c_custkey, 'EMAIL_' || (c_custkey + 1) || '_' || CASE WHEN c_custkey % 2 = 0 THEN 'aaaa' ELSE 'bbbb' END AS t FROM customer WHERE c_custkey % 3 <> 0),
c AS (SELECT 'EMAIL_' || (c_custkey + 1) || '_' || CASE c_custkey % 4 WHEN 0 THEN 'aaaa' WHEN 1 THEN 'bbbb' WHEN 2 THEN 'cccc' ELSE 'XYZ' END AS t FROM customer)
SELECT CASE WHEN t LIKE '%XYZ' THEN 'forged' WHEN t IN (SELECT t FROM v) THEN 'none' WHEN t LIKE '%cccc' THEN 'stale' ELSE 'forged' END AS violation, count(*) AS n, (SELECT count(*) FROM v WHERE c_custkey % 5 = 0) AS visible, (SELECT count(*) FROM v WHERE c_custkey % 5 <> 0) AS session FROM c GROUP BY 1"""
)
def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed tokens by what is wrong with them, and the tokens of a view and of the rest of its session."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    token = lambda end: F.concat(F.lit("EMAIL_"), (k + 1).cast("string"), F.lit("_"), end)
    kept = c.where(k % 3 != 0).select(k, token(F.when(k % 2 == 0, "aaaa").otherwise("bbbb")).alias("placeholder"))
    bad = vault.check_manifest(c.select(token(_pick(k % 4, "aaaa", "bbbb", "cccc", "XYZ")).alias("placeholder")), kept)
    sides = vault.manifest(kept.where(k % 5 == 0), kept).agg(F.count_if(F.col("state") == "visible").alias("visible"), F.count_if(F.col("state") == "session").alias("session"))
    return bad.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("n")).crossJoin(sides)  # one row of sums


@query(
    """SELECT CASE WHEN c.dim = 1 THEN 'class' WHEN c.dim = 2 THEN 'source_class' ELSE 'all' END AS dimension, c.value, c.support, c.covered FROM (SELECT 1 AS dim, class AS value, count(*) AS support, count(*) FILTER (hit) AS covered FROM b GROUP BY 2 UNION ALL SELECT 2, source_class, count(*), count(*) FILTER (hit) FROM b GROUP BY 2 UNION ALL SELECT 3, 'all', count(*), count(*) FILTER (hit) FROM b) c
UNION ALL SELECT 'source', s.source, (SELECT count(*) FROM t), count(DISTINCT (p.frame_id, p.id)) FILTER (p.cov >= 0.98) FROM (SELECT unnest(['VISUAL', 'OCR']) AS source) s LEFT JOIN (SELECT p.*, q.source FROM p JOIN q ON q.frame_id = p.frame_id AND q.rid = p.rid) p ON p.source = s.source GROUP BY s.source"""
)
def recall_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by class, source class and source of the regions."""
    _, t, r = _views(spark, sf_dir)
    return evaluate.by_source(t, r).drop("recall")


ORACLES["recall_by_source"] = "WITH " + _TRUTH + _COVER + ", q AS (SELECT frame_id, id AS rid, CASE l_linestatus WHEN 'F' THEN 'VISUAL' ELSE 'OCR' END AS source FROM r) " + ORACLES["recall_by_source"]


@query()
def detector_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, misses and false proposals of regions by class and page type."""
    return evaluate.detector_report(*_views(spark, sf_dir)).withColumn("recall", F.round("recall", 9))


ORACLES["detector_slices"] = (
    "WITH "
    + _TRUTH
    + _COVER
    + """, f AS (SELECT o_orderkey AS frame_id, o_orderpriority AS page_type FROM orders), d AS (SELECT 'class' AS dimension, class AS value, count(*) AS support, count(*) FILTER (hit) AS covered FROM b GROUP BY 2 UNION ALL SELECT 'page_type', page_type, count(*), count(*) FILTER (hit) FROM b JOIN f USING (frame_id) GROUP BY 2),
w AS (SELECT 'page_type' AS dimension, page_type AS value, count(*) AS false_proposals FROM r JOIN f USING (frame_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.frame_id = r.frame_id AND p.rid = r.id AND p.cov >= 0.98) GROUP BY 2)
SELECT dimension, value, coalesce(support, 0) AS support, coalesce(covered, 0) AS covered, coalesce(false_proposals, 0) AS false_proposals, coalesce(support - covered, 0) AS missed, round(coalesce(covered / nullif(support, 0), 0), 9) AS recall FROM d FULL JOIN w USING (dimension, value)"""
)


@query(
    """SELECT * FROM (SELECT 'all' AS slice, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents UNION ALL SELECT 'english', count(*), CAST(sum(n_chars) AS BIGINT) FROM documents WHERE lang = 'en' UNION ALL SELECT 'long', count(*), CAST(coalesce(sum(n_chars), 0) AS BIGINT) FROM documents WHERE n_chars > 5000 UNION ALL SELECT 'none', 0, 0)"""
)
def one_pass_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of several slices of the documents in one pass."""
    d = read(spark, sf_dir, "documents")
    return evaluate.sliced(d, {"all": F.lit(True), "english": F.col("lang") == "en", "long": F.col("n_chars") > 5000, "none": F.col("lang") == "xx"}, characters=F.col("n_chars"))


@query(
    """WITH t AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE length(trim(coalesce(text, ''))) > 0), e AS (SELECT conv_id, turn, length(t) AS n, coalesce(sum(length(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM t),
s AS (SELECT conv_id, CAST(40 * g AS INTEGER) AS b, CAST(40 * g + 15 AS INTEGER) AS z, ['NAME', 'URL'][g % 2 + 1] AS l FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(range(0, 12)) AS g)),
j AS (SELECT e.conv_id, turn, list_sort(list(DISTINCT l)) AS labels, CAST(sum(least(z, a + n) - greatest(b, a)) AS BIGINT) AS covered, bool_or(l = 'NAME') AS sensitive FROM e JOIN s ON s.conv_id = e.conv_id AND s.b < e.a + e.n AND s.z > e.a GROUP BY 1, 2)
SELECT e.conv_id, e.turn AS idx, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(covered, 0) AS covered, coalesce(sensitive, false) AS sensitive FROM e LEFT JOIN j ON j.conv_id = e.conv_id AND j.turn = e.turn"""
)
def spans_on_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of assembled documents on the turns that they were made of."""
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), "text")
    entries = spans.document_of(c, "conv_id").select("conv_id", F.explode("entries").alias("e")).select("conv_id", "e.*")
    g = F.explode(F.sequence(F.lit(0), F.lit(11)))
    s = c.select("conv_id").distinct().withColumn("g", g).select("conv_id", (F.col("g") * 40).alias("start"), (F.col("g") * 40 + 15).alias("end"), _pick(F.col("g"), "NAME", "URL").alias("label"), F.lit(1.0).alias("score"), F.lit("ner").alias("source"))
    p = spans.projected(s, entries, "conv_id")
    covered = F.coalesce(F.aggregate("values", F.lit(0), lambda a, v: a + v["end"] - v["start"]), F.lit(0)).cast("long")
    return p.select("conv_id", F.col("idx").cast("long").alias("idx"), F.array_join("labels", ",").alias("labels"), covered.alias("covered"), "sensitive")


@query(
    """WITH t AS (SELECT l_orderkey AS k, CAST(l_linenumber * 5 AS INTEGER) AS a, CAST(l_linenumber * 5 + 4 AS INTEGER) AS b FROM lineitem GROUP BY ALL), s AS (SELECT o_orderkey AS k, CAST(7 + o_custkey % 5 AS INTEGER) AS a, CAST(7 + o_custkey % 5 + 9 AS INTEGER) AS b, 'NAME' AS l FROM orders),
j AS (SELECT t.k, t.a, s.l FROM t LEFT JOIN s ON s.k = t.k AND t.a < s.b AND t.b > s.a), w AS (SELECT *, lag(l) OVER (PARTITION BY k ORDER BY a) AS p FROM j)
SELECT a AS start, CASE WHEN l IS NULL THEN 'O' WHEN p = l THEN 'I-NAME' ELSE 'B-NAME' END AS label, count(*) AS n FROM w GROUP BY 1, 2"""
)
def aligned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of tokens by the gold span that they overlap most."""
    t = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_index"), (F.col("l_linenumber") * 5).alias("start"), (F.col("l_linenumber") * 5 + 4).alias("end")).distinct()
    a = (F.pmod("o_custkey", F.lit(5)) + 7).cast("int")
    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_index"), a.alias("start"), (a + 9).alias("end"), F.lit("NAME").alias("label"))
    return evaluate.align_offsets(t, s).groupBy("start", "label").agg(F.count("*").alias("n"))


@query("SELECT value, count(*) AS tables FROM (SELECT DISTINCT lang AS value FROM documents UNION SELECT DISTINCT event_type FROM events UNION SELECT DISTINCT role FROM conversations) GROUP BY 1")
def value_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different values of three tables together."""
    parts = [read(spark, sf_dir, t).select(F.col(c).alias("value")) for t, c in (("documents", "lang"), ("events", "event_type"), ("conversations", "role"))]
    return curate.chained(*parts).select("value").distinct().groupBy("value").agg(F.count("*").alias("tables"))


_WORDS = ("ask Ann Lee now", "annlee x", "the ann  lee", "card 4111-22", "xx4111-22yy", "nothing")


@query(f"SELECT event_id, {_case('event_id', 'NAME_1_0000', 'none', 'NAME_1_0000', 'API_KEY_1_0000', 'none', 'none')} AS seen FROM events")
def seen_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept values that texts show again: whole words only."""
    kept = read(spark, sf_dir, "region").limit(1).select(F.explode(F.array(F.struct(F.lit("NAME_1_0000").alias("placeholder"), F.lit("NAME").alias("pii_class"), F.lit("ann lee").alias("canonical")), F.struct(F.lit("API_KEY_1_0000").alias("placeholder"), F.lit("API_KEY").alias("pii_class"), F.lit("4111-22").alias("canonical")))).alias("x")).select("x.*")
    t = read(spark, sf_dir, "events").select("event_id", _pick(F.col("event_id"), *_WORDS).alias("text"))
    return t.join(vault.observed(t, kept, "event_id"), "event_id", "left").select("event_id", F.coalesce("placeholder", F.lit("none")).alias("seen"))


_POLICIES = ('{"EMAIL": "blocked", "NAME": "approval"}', '{"EMAIL": "maybe"}', "[1]", '{"EMAIL": {"level": "blocked"}, "NAME": "open"}', "no json", "{}")


@query(
    """SELECT problem, count(*) AS n FROM (SELECT unnest(CASE c_custkey % 6 WHEN 1 THEN ['EMAIL has no level maybe'] WHEN 2 THEN ['policy is no JSON object'] WHEN 3 THEN ['EMAIL is no text', 'NAME has no level open'] WHEN 4 THEN ['policy is no JSON object'] ELSE [] END) AS problem FROM customer) GROUP BY 1"""
)
def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy documents by what is wrong with them."""
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), _pick(F.col("c_custkey"), *_POLICIES).alias("text"))
    return config.policy_problems(d).groupBy("problem").agg(F.count("*").alias("n"))


_MANIFEST = '{"classes":["A","B"],"n":{k},"deep":{"flag":false,"hash":"{h}"}}'


@query(
    """SELECT name, required, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM (SELECT unnest([{'n': 'classes', 'r': '= ["A","B"]', 'ok': true}, {'n': 'n', 'r': '>= 100', 'ok': o_orderkey >= 100}, {'n': 'deep.flag', 'r': '= false', 'ok': true}, {'n': 'deep.hash', 'r': 'sha256', 'ok': o_orderkey % 3 = 0}, {'n': 'deep.none', 'r': '= 0', 'ok': false}], recursive := true) FROM orders) t(name, required, ok) GROUP BY 1, 2"""
)
def manifest_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of JSON manifests at any depth."""
    k = F.col("o_orderkey")
    m = F.replace(F.replace(F.lit(_MANIFEST), F.lit("{k}"), k.cast("string")), F.lit("{h}"), F.when(k % 3 == 0, F.sha2(k.cast("string"), 256)).otherwise("none"))
    need = [("classes", "=", '["A","B"]'), ("n", ">=", "100"), ("deep.flag", "=", "false"), ("deep.hash", "sha256", ""), ("deep.none", "=", "0")]
    c = checks.deep_contract(read(spark, sf_dir, "orders").select(k, m.alias("m")), "o_orderkey", "m", need)
    return c.groupBy("name", "required").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


@query(
    """SELECT coalesce(CASE l_partkey % 7 WHEN 0 THEN 'format' WHEN 1 THEN 'numeric' WHEN 2 THEN 'class' WHEN 3 THEN 'range' WHEN 4 THEN 'outside' WHEN 5 THEN 'count' END, 'none') AS problem, CASE WHEN l_partkey % 7 = 5 THEN 0 WHEN l_partkey % 7 < 5 THEN 1 END AS line, count(*) AS n FROM lineitem WHERE l_partkey % 7 < 6 GROUP BY 1, 2"""
)
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines that disagree with their records, by what is wrong."""
    k = F.pmod("l_partkey", F.lit(7))
    q = (F.col("l_quantity") / 100).cast("string")
    line = F.when(k == 0, F.concat(F.lit("1 .5 .5 "), q)).when(k == 1, "1 .5 x .1 .1").when(k == 2, F.concat(F.lit("0 .5 .5 .1 "), q)).when(k == 3, "1 .5 1.5 .1 .1").otherwise(F.concat(F.lit("1 .5 .5 .1 "), q))
    box = F.array(F.lit(1.0), F.lit(1.0), F.when(k == 4, 1000.0).otherwise(F.col("l_quantity") + 2), F.lit(9.0))
    note = F.struct(F.lit("B").alias("class"), box.alias("bbox_xyxy"))
    r = read(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("id"), F.when(k == 5, F.array(line, line)).otherwise(F.array(line)).alias("lines"), F.array(note).alias("annotations"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    return checks.label_file_problems(r, "id", ["A", "B"]).groupBy("problem", "line").agg(F.count("*").alias("n"))


@query(
    r"""SELECT conv_id, CAST(count(*) FILTER (role <> 'user') > 0 AS INTEGER) + count(*) FILTER (role = 'user') AS messages, md5(CASE WHEN count(*) FILTER (role <> 'user') > 0 THEN coalesce(string_agg(nullif(regexp_replace(regexp_replace(text, '[\r]', '', 'g'), '\s+$', ''), ''), chr(10) || chr(10) ORDER BY turn) FILTER (role <> 'user' AND trim(text) <> '') || chr(10) || chr(10), '') || '[B]' || chr(10) || 'do it' || chr(10) || '[E]'
ELSE regexp_replace(arg_max(text, turn), '\s+$', '') || chr(10) || chr(10) || '[B]' || chr(10) || 'do it' || chr(10) || '[E]' END) AS told FROM conversations GROUP BY 1"""
)
def injected_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions put into conversations twice (replies stand for system messages): they are there once."""
    role = F.when(F.col("role") == "user", "user").otherwise("system")
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    put = lambda c: checks.with_instructions(c, "do it", "[B]", "[E]", "[P]")
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(m.alias("m")).select("conv_id", put(put(F.col("m"))).alias("m"))
    said = F.when(F.exists("m", lambda x: x["role"] == "system"), F.get("m", F.lit(0))["content"]).otherwise(F.element_at("m", -1)["content"])
    return c.select("conv_id", F.size("m").cast("long").alias("messages"), F.md5(said).alias("told"))
