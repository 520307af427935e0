"""Queries of session state: approvals, token references, markers, run history, replayable feeds, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.cluster import shared
from spanveil.operators import approvals, feed, ledger, vault, walks, windows
from spanveil.plans.contracts import _case, _pick
from spanveil.plans.text import read
from spanveil.sources import history
from spanveil.streaming import imports

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


_TOKENS = ("API_KEY_1_0000", "AUTH_TOKEN_1_0000", "EMAIL_1_0000", "API_KEY_2_0000", "AUTH_TOKEN_2_0000", "SSN_1_0000", "NAME_9_0000")
_CLASSES = ("API_KEY", "AUTH_TOKEN", "EMAIL", "API_KEY", "AUTH_TOKEN", "SSN", "NAME")


def approval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user of the event table: signups and views mint, clicks and purchases act, errors revoke."""
    e, n, v = read(spark, sf_dir, "events"), F.col("event_id"), F.floor(F.col("value")).cast("long")
    token, other = _pick(n % 5 + v % 2, *_TOKENS), _pick(n % 3 + v % 3 + F.when(n % 11 == 0, 3).otherwise(0), *_TOKENS)
    pair = lambda t, p: F.struct(t.alias("token"), F.lit(p).alias("path"))
    refs = F.when(F.col("event_type") == "purchase", F.array(pair(token, "$.to"), pair(token, "$.to"))).when(F.col("event_type") == "click", F.array(pair(other, "$.to"), pair(token, " $.body ")))
    return e.select(
        F.col("user_id").cast("string").alias("session"),
        n.cast("long").alias("seq"),
        n.cast("double").alias("at"),
        F.when(F.col("event_type").isin("signup", "view"), "mint").when(F.col("event_type") == "error", "revoke").otherwise("action").alias("kind"),
        token.alias("token"),
        F.when(n % 2 == 0, "send").otherwise(" SEND").alias("tool_name"),
        F.when(n % 4 == 3, "$.body").otherwise("$.to").alias("argument_path"),
        F.when(v % 2 == 0, F.concat(F.lit("site"), (n % 2).cast("string"))).alias("target"),
        F.when(n % 3 != 0, (n % 7).cast("double") * 600).alias("ttl"),
        F.when(n % 5 != 0, (v % 6).cast("int")).alias("uses"),
        refs.alias("refs"),
    )


@query(
    f"""WITH RECURSIVE b AS (
  SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, event_type, CAST(floor(value) AS BIGINT) AS v, event_id AS n FROM events
), c AS (
  SELECT *, CASE WHEN event_type IN ('signup', 'view') THEN 'mint' WHEN event_type = 'error' THEN 'revoke' ELSE 'action' END AS kind,
    {_case("(n % 5 + v % 2)", *_TOKENS)} AS token, {_case("(n % 3 + v % 3 + CASE WHEN n % 11 = 0 THEN 3 ELSE 0 END)", *_TOKENS)} AS other,
    CASE WHEN v % 2 = 0 THEN '=site' || (n % 2) ELSE '' END AS target, CASE WHEN n % 4 = 3 THEN '$.body' ELSE '$.to' END AS path,
    CASE WHEN n % 3 <> 0 THEN CAST(n % 7 AS DOUBLE) * 600 ELSE 60 END AS ttl, CASE WHEN n % 5 <> 0 THEN CAST(v % 6 AS INTEGER) ELSE 1 END AS uses FROM b
), d AS (
  SELECT *, CASE WHEN event_type = 'click' THEN CASE WHEN other = token THEN [other || '|send|$.to|', token || '|send|$.body|'] ELSE [other || '|send|$.to|', token || '|send|$.body|'] END ELSE [token || '|send|$.to|'] END AS refs,
    row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM c
), r AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(k VARCHAR, x DOUBLE, u INTEGER)[]) AS g, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind, true AS ok, CAST(NULL AS VARCHAR) AS reason, 0 AS spent FROM d
  UNION ALL
  SELECT session, i, CASE WHEN NOT ok THEN p WHEN kind = 'mint' THEN list_append(list_filter(p, lambda s: s.k <> own), {{'k': own, 'x': CAST(n AS DOUBLE) + ttl, 'u': uses}}) WHEN kind = 'revoke' THEN list_filter(p, lambda s: s.k <> own)
    ELSE list_filter(list_transform(p, lambda s: {{'k': s.k, 'x': s.x, 'u': s.u - CASE WHEN list_contains(need, s.k) THEN 1 ELSE 0 END}}), lambda s: s.u > 0) END,
    seq, kind, ok, CASE WHEN NOT ok THEN reason END, CASE WHEN ok AND kind = 'action' THEN CAST(len(need) AS INTEGER) ELSE 0 END
  FROM (SELECT *, reason IS NULL AS ok FROM (SELECT *, CASE
      WHEN kind = 'revoke' THEN CASE WHEN NOT list_contains(list_transform(p, lambda s: s.k), own) THEN 'no_grant' END
      WHEN kind = 'mint' THEN CASE WHEN ttl <= 0 OR ttl > 3600 OR uses < 1 OR uses > 100 THEN 'invalid' WHEN token LIKE 'NAME%' THEN 'unknown' WHEN NOT (token LIKE 'API%' OR token LIKE 'AUTH%') THEN 'not_gated' END
      ELSE list_filter(list_transform(refs, lambda f: CASE WHEN f LIKE 'NAME%' THEN 'unknown' WHEN f LIKE 'SSN%' THEN 'blocked' WHEN f LIKE 'EMAIL%' THEN NULL
        WHEN NOT (list_contains(list_transform(p, lambda s: s.k), f || target) OR list_contains(list_transform(p, lambda s: s.k), f)) THEN 'no_grant' END), lambda x: x IS NOT NULL)[1] END AS reason
    FROM (SELECT *, list_transform(list_filter(refs, lambda f: f LIKE 'A%'), lambda f: CASE WHEN list_contains(list_transform(p, lambda s: s.k), f || target) THEN f || target ELSE f END) AS need
      FROM (SELECT d.*, d.token || '|send|' || d.path || '|' || d.target AS own, list_filter(r.g, lambda s: s.x > d.n AND s.u > 0) AS p FROM r JOIN d ON d.session = r.session AND d.i = r.i + 1))))
)
SELECT session, seq, kind, ok, reason, spent, CAST(len(g) AS INTEGER) AS active FROM r WHERE i > 0"""
)
def approval_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of mints, revocations and actions, in the order of each session's events."""
    events = approval_events(spark, sf_dir)
    issued = F.explode(F.array(*[F.struct(F.lit(t).alias("placeholder"), F.lit(c).alias("pii_class")) for t, c in zip(_TOKENS[:-1], _CLASSES[:-1], strict=True)]))
    known = events.select("session").distinct().select("session", issued.alias("t")).select("session", "t.*")
    return approvals.decide(approvals.with_levels(events, known))


_FORMS = ("see EMAIL_{k}_0000 now", "to « EMAIL_{k}_0000 », EMAIL_{k}_0000", "«NAME_{k}_0000» and EMAIL_{k}_0000", "xEMAIL_{k}_0000x or EMAIL_{k}_0000x", "no token")


@query(
    f"""WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey % 40 + 1 AS k, replace({_case("(l_suppkey + l_linenumber)", *_FORMS)}, '{{k}}', CAST(l_partkey % 40 + 1 AS VARCHAR)) AS t FROM lineitem),
v AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'EMAIL_' || (k + 1) || '_0000' ELSE 'u$' || k || '\\@x.org' END AS value FROM (SELECT unnest(range(1, 31)) AS k))
SELECT CASE WHEN o % 7 = 0 THEN NULL ELSE o END AS o, n, CASE WHEN value IS NULL THEN CASE WHEN contains(t, 'NAME') THEN t ELSE t END
  ELSE replace(regexp_replace(t, '« ?EMAIL_' || k || '_0000 ?»|\\bEMAIL_' || k || '_0000\\b', chr(1), 'g'), chr(1), value) END AS resolved,
  list_sort(list_filter([CASE WHEN contains(t, 'NAME') THEN 'NAME_' || k || '_0000' END, CASE WHEN value IS NULL AND regexp_matches(t, '\\bEMAIL_[0-9]+_0000\\b') THEN 'EMAIL_' || k || '_0000' END], lambda x: x IS NOT NULL)) AS unknown
FROM t LEFT JOIN v USING (k)"""
)
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with tokens, bare, in marks, inside words and unknown, as values (some of which look like tokens); a seventh of the keys is null."""
    k = F.pmod("l_partkey", F.lit(40)) + 1
    rows = read(spark, sf_dir, "lineitem")
    t = rows.select(F.when(F.pmod("l_orderkey", F.lit(7)) != 0, F.col("l_orderkey")).alias("o"), F.col("l_linenumber").alias("n"), F.replace(_pick(F.col("l_suppkey") + F.col("l_linenumber"), *_FORMS), F.lit("{k}"), k.cast("string")).alias("text"))
    n = rows.select(k.alias("k")).distinct().where(F.col("k") <= 30)
    v = n.select(F.concat(F.lit("EMAIL_"), F.col("k").cast("string"), F.lit("_0000")).alias("placeholder"), F.when(F.col("k") % 5 == 0, F.concat(F.lit("EMAIL_"), (F.col("k") + 1).cast("string"), F.lit("_0000"))).otherwise(F.concat(F.lit("u$"), F.col("k").cast("string"), F.lit("\\@x.org"))).alias("value"))
    return vault.resolve(t, v, "o").select("o", "n", "resolved", "unknown")


_MARKS = ("⟦TOOL:sort:« NAME_1_aa »,NAME_2_aa :r{i}⟧", "⟦TOOL:select:«EMAIL_1_aa»:r{j}:pick one⟧", "⟦TOOL:echo:A_1_a:r{i}⟧")


@query(
    f"""WITH t AS (SELECT conv_id, turn, replace(replace({_case("(conv_id + turn)", *_MARKS)} || coalesce(text, '') || {_case("(conv_id + turn + 1)", *_MARKS)} || {_case("conv_id", *_MARKS)}, '{{i}}', CAST(turn // 2 AS VARCHAR)), '{{j}}', CAST(turn % 2 AS VARCHAR)) AS t FROM conversations),
m AS (SELECT conv_id, turn, unnest(range(1, 3)) AS p, unnest(regexp_extract_all(t, '⟦TOOL:[a-z_]+:[^:⟧]*:[A-Za-z0-9_-]+(?::[^⟧]*)?⟧')[1:2]) AS m FROM t),
x AS (SELECT conv_id, turn, p, regexp_extract(m, '^⟦TOOL:([a-z_]+)', 1) AS verb, regexp_extract(m, '^⟦TOOL:[a-z_]+:[^:⟧]*:([A-Za-z0-9_-]+)', 1) AS id, regexp_replace(regexp_extract(m, '^⟦TOOL:[a-z_]+:([^:⟧]*)', 1), '[«» ]', '', 'g') AS tokens FROM m)
SELECT conv_id, turn, verb, id, tokens FROM x QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, p) = 1"""
)
def markers_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool markers of conversations, each id once in a conversation, with bare tokens."""
    k = F.col("conv_id") + F.col("turn")
    c = read(spark, sf_dir, "conversations")
    whole = F.concat(_pick(k, *_MARKS), F.coalesce("text", F.lit("")), _pick(k + 1, *_MARKS), _pick(F.col("conv_id"), *_MARKS))
    whole = F.replace(F.replace(whole, F.lit("{i}"), F.floor(F.col("turn") / 2).cast("string")), F.lit("{j}"), F.pmod("turn", F.lit(2)).cast("string"))
    m = ledger.new_markers(c.select("conv_id", "turn", whole.alias("text")), "conv_id", "turn")
    return m.select("conv_id", "turn", "m.verb", "m.id", F.array_join("m.tokens", ",").alias("tokens"))





_SLOT = "CAST('0x' || md5('7:slot:' || (i - 200))[1:8] AS BIGINT) % 200"
_FEED = f"""r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY source, doc_id) - 1 AS i FROM documents),
p AS (SELECT doc_id, n_chars, greatest(i - 200, -1) AS step, CASE WHEN i < 200 THEN i ELSE {_SLOT} END AS slot FROM r),
q AS (SELECT *, lead(step) OVER (PARTITION BY slot ORDER BY step) AS gone FROM p),
f AS (SELECT doc_id, n_chars, gone + 1 AS position FROM q WHERE gone IS NOT NULL UNION ALL
  SELECT doc_id, n_chars, row_number() OVER (ORDER BY CAST('0x' || md5('7:rest:' || slot)[1:8] AS BIGINT), slot) + (SELECT count(*) - 200 FROM r) FROM q WHERE gone IS NULL)"""


def _fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.buffered(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", seed=7, buffer=200)


@query(f"WITH {_FEED} SELECT doc_id, position FROM f")
def buffered_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a shuffle with a buffer of 200 gives the documents out."""
    return _fed(spark, sf_dir).select("doc_id", "position")


@query(f"WITH {_FEED} SELECT doc_id, row_number() OVER (ORDER BY position) AS place FROM f WHERE n_chars % 3 <> 0 QUALIFY place <= 100")
def feed_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred accepted documents of that feed (as many as a training split asks for)."""
    return feed.taken(_fed(spark, sf_dir), F.pmod("n_chars", F.lit(3)) != 0, 100).select("doc_id", "place")


@query(
    r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
w AS (SELECT doc_id, n, greatest(1, CAST(ceil((n - 64) / 320.0) AS BIGINT)) AS k FROM t)
SELECT doc_id, k AS windows, n + 64 * (k - 1) AS tokens, n AS "distinct" FROM w"""
)
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each document, the tokens in them, and how many different ones."""
    w = windows.cut(read(spark, sf_dir, "documents").select("doc_id", "text"))
    t = windows.token_rows(w).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_distinct("number").alias("distinct"))
    n = w.groupBy("doc_id").agg(F.count("*").alias("windows"))
    return n.join(t, "doc_id", "left").select("doc_id", "windows", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("distinct", F.lit(0)).alias("distinct"))


_CALLS = "to_json(struct(concat(role, ' EMAIL_', turn % 3 + 1, '_0000 «NAME_1_0000»') AS name, array(named_struct('q', substring(text, 1, 20), 'deep', array(array(concat('x EMAIL_1_0000 ', role), string(turn))))) AS list, named_struct('value', named_struct('filename', role)) AS more))"


@query(
    """SELECT conv_id, turn, '$.name' AS path, 'EMAIL_' || (turn % 3 + 1) || '_0000' AS token FROM conversations UNION ALL SELECT conv_id, turn, '$.name', 'NAME_1_0000' FROM conversations UNION ALL SELECT conv_id, turn, '$.list[0].deep[0][0]', 'EMAIL_1_0000' FROM conversations"""
)
def token_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token references in nested arguments, with their paths."""
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("k"), F.expr(_CALLS).alias("action"))
    return walks.references(c, "k").select(F.floor(F.col("k") / 100_000).alias("conv_id"), F.pmod("k", F.lit(100_000)).alias("turn"), "path", "token")


@query("SELECT path, count(*) AS n FROM conversations, (VALUES ('$.more.value'), ('$.more.value.filename')) p(path) GROUP BY 1")
def forbidden_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that no report may have, by path."""
    c = read(spark, sf_dir, "conversations").select("conv_id", F.expr(_CALLS).alias("action"))
    return walks.forbidden(c, "conv_id", "action").groupBy("path").agg(F.count("*").alias("n"))


_REPORT = (
    '{"pipeline":"p1","profile":"balanced","dimensions":{"width":640,"height":480},"counts":{"visual":3,"ocr":"2"},"timings":{"total":12.5},"warnings":["a"],"regions":[{"x1":1,"y1":2,"x2":"3","y2":4,"label":"NAME","labels":["NAME"],"sources":["OCR"],"score":0.5}]}',
    '{"pipeline":"p2","profile":"balanced"}',
    '{"pipeline":"p1","profile":"balanced","dimensions":{"width":0,"height":480}}',
    '{"pipeline":"p1","profile":"balanced","dimensions":{"width":1,"height":4.5}}',
    '{"pipeline":"p1","profile":"balanced","dimensions":{"width":640,"height":480},"counts":{"bad key":3},"timings":{},"warnings":[],"regions":[]}',
    '{"pipeline":"p1","profile":"balanced","dimensions":{"width":640,"height":480},"counts":{"a":-1},"timings":{},"warnings":[],"regions":[]}',
    '{"pipeline":"p1","profile":"balanced","dimensions":{"width":640,"height":480},"counts":{},"timings":{"a":null},"warnings":"x","regions":[]}',
    '{"pipeline":"p1","profile":"balanced","dimensions":{"width":640,"height":480},"counts":{},"timings":{"a":null},"warnings":[],"regions":[{"x1":1}]}',
    "not json",
)


@query(
    f"""WITH r AS (SELECT event_id, event_id % 9 AS c, replace({_case("event_id", *_REPORT)}, '12.5', CAST(event_id % 50 AS VARCHAR)) AS r FROM events)
SELECT CASE c WHEN 1 THEN 'pipeline' WHEN 2 THEN 'dimensions.width' WHEN 3 THEN 'dimensions.height' WHEN 4 THEN 'counts' WHEN 5 THEN 'counts' WHEN 6 THEN 'warnings' WHEN 7 THEN 'regions' WHEN 8 THEN 'report' ELSE 'none' END AS problem, count(*) AS n,
  CAST(sum(CASE WHEN c = 0 THEN event_id % 50 END) AS DOUBLE) AS total, CAST(sum(CASE WHEN c = 0 THEN 3 END) AS DOUBLE) AS x2, CAST(sum(CASE WHEN c = 0 THEN 640 END) AS DOUBLE) AS width FROM r GROUP BY 1"""
)
def report_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by what is wrong with them, and sums of what is kept of the others."""
    text = F.replace(_pick(F.col("event_id"), *_REPORT), F.lit("12.5"), F.pmod("event_id", F.lit(50)).cast("string"))
    r = walks.normalised_reports(
        read(spark, sf_dir, "events").select("event_id", text.alias("r")), "event_id", "r", {"pipeline": "p1", "profile": "balanced"}, ("dimensions.width", "dimensions.height"), (), ("warnings",), ("counts", "timings"), ("regions",)
    )
    return r.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(
        F.count("*").alias("n"), F.sum(F.col("amounts")["timings"]["total"]).alias("total"), F.sum(F.get(F.col("regions")["regions"], F.lit(0))["x2"]).alias("x2"), F.sum(F.col("numbers")["dimensions.width"]).alias("width")
    )


_RUN = "'run-2024' || lpad(CAST(conv_id // 1000000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(conv_id % 1000000 AS VARCHAR), 6, '0') || '-' || md5(CAST(conv_id AS VARCHAR))[1:4]"


@query(
    f"""SELECT {_RUN} AS run_id, arg_min(text, turn) FILTER (role = 'user') AS prompt, CAST(min(turn) AS DOUBLE) AS started_at, CAST(max(turn) AS DOUBLE) AS finished_at, CASE WHEN max(turn) % 2 = 0 THEN 'running' ELSE 'done' END AS status,
CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS calls, CAST(coalesce(sum(CASE WHEN role = 'assistant' AND turn > 2 THEN length(text) END), 0) AS BIGINT) AS characters FROM conversations GROUP BY conv_id"""
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written to a store of runs, listed with their calls, and the replies' length in the calls from the third turn on."""
    c = read(spark, sf_dir, "conversations")
    number = F.lpad(F.floor(F.col("conv_id") / 1_000_000).cast("string"), 4, "0")
    run = F.concat(F.lit("run-2024"), number, F.lit("-"), F.lpad(F.pmod("conv_id", F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("-"), F.substring(F.md5(F.col("conv_id").cast("string")), 1, 4))
    t = c.withColumn("run_id", run)
    status = F.when(F.pmod(F.max("turn"), F.lit(2)) == 0, "running").otherwise("done")
    runs = t.groupBy("run_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"), F.min("turn").alias("started_at"), F.max("turn").alias("finished_at"), status.alias("status"))
    folder = f"{shared(spark)}/runs-{uuid.uuid4().hex}"
    history.save(runs.select("run_id", F.to_json(F.struct("prompt", "started_at", "finished_at", "status")).alias("record")), folder, "run")
    calls = t.where("role = 'assistant'").select("run_id", (F.col("turn") + 1).alias("call_id"), F.to_json(F.struct("turn", F.col("text").alias("reply"), F.col("text").alias("response"))).alias("record"))
    history.save(calls, folder, "call")
    late = history.view(spark, folder, "calls").where("call_id > 3").groupBy("run_id").agg(F.sum(F.length(F.get_json_object("record", "$.reply"))).alias("characters"))
    return history.view(spark, folder).join(late, "run_id", "left").withColumn("characters", F.coalesce("characters", F.lit(0)).cast("long"))


@query(
    """WITH r AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 THEN 'web' ELSE 'phone' END AS platform, 't' || conv_id AS task, role, text, turn FROM conversations),
a AS (SELECT id, 'high' AS risk, role AS category FROM r WHERE turn % 2 = 0 UNION ALL SELECT id, 'unknown', 'unknown' FROM r WHERE turn % 4 = 0)
SELECT count(*) AS records, (SELECT count(*) FROM a) AS annotations, count(*) FILTER (turn % 2 = 1) AS unannotated, count(DISTINCT task) AS trajectories,
  (SELECT string_agg(risk || ':' || n, ',' ORDER BY risk) FROM (SELECT risk, count(*) AS n FROM a GROUP BY 1)) AS risks, (SELECT string_agg(category || ':' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM a GROUP BY 1)) AS categories,
  (SELECT string_agg(platform || ':' || n, ',' ORDER BY platform) FROM (SELECT platform, count(*) AS n FROM r GROUP BY 1)) AS platforms FROM r"""
)
def import_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of conversations imported as annotated screens."""
    t, none = F.col("turn"), F.lit(None).cast("string")
    label = lambda risk, category: F.struct(risk.alias("label"), category.alias("category"), F.col("text").alias("ocr_text"), none.alias("draw_type"), F.lit(True).alias("is_task_essential"), F.array(F.lit(1.0)).alias("bbox_percent"))
    labels = F.array_compact(F.array(F.when(t % 2 == 0, label(F.lit("high"), F.col("role"))), F.when(t % 4 == 0, label(none, none))))
    rows = read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + t).alias("id"), F.when(t % 3 == 0, "web").otherwise("phone").alias("platform"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("task_folder"), F.coalesce("text", F.lit("")).alias("task_goal"), t.cast("int").alias("step_index"), F.lit("x.png").alias("image"), labels.alias("privacy_labels"), none.alias("outcome"), F.lit(False).alias("done")
    )
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["k"], x["n"].cast("string"))), ",").alias(c)
    return imports.manifest(imports.projected(rows)).select("records", "annotations", "unannotated", "trajectories", said("risks"), said("categories"), said("platforms"))
