"""Ledgers of calls, frames and traces: latest states, rings, windows of suspicion, carried values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUSPICIOUS = ("error", "blocked", "denied")


def trailing(trace: DataFrame, by: str, step: str, kind: str, window: int = 8, threshold: int = 3, kinds: tuple[str, ...] = SUSPICIOUS) -> DataFrame:
    """trace with the suspicious events of the last ``window`` steps, and whether they call for a review."""
    w = Window.partitionBy(by).orderBy(step).rangeBetween(-(window - 1), 0)
    return trace.withColumn("suspicious", F.count_if(F.col(kind).isin(*kinds)).over(w)).withColumn("review", F.col("suspicious") >= threshold)


def cooled_down(reviews: DataFrame, by: str, step: str, window: int = 8) -> DataFrame:
    """Of the steps that call for a review, those at least ``window`` after the last one held: a fold in order of steps."""
    g = reviews.groupBy(by).agg(F.array_sort(F.collect_set(step)).alias("s"))
    held = F.aggregate("s", F.array().cast("array<long>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= window), F.concat(a, F.array(x.cast("long")))).otherwise(a))
    return g.select(by, F.explode(held).alias(step))


def changed(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where(~F.col(value).eqNullSafe(F.col("_p")) | (F.col("_n") == 1)).drop("_p", "_n")


def ring(rows: DataFrame, by: str, order: str, capacity: int = 32) -> DataFrame:
    """The last ``capacity`` rows of each key."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return rows.withColumn("_n", n).where(F.col("_n") <= capacity).drop("_n")


def latest(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Each key's last row, and how many there were."""
    return rows.groupBy(by).agg(F.max_by(F.struct(*columns), F.col(order)).alias("r"), F.count("*").alias("n")).select(by, "r.*", "n")


def first_seen(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Each key's first row, and how many there were."""
    return rows.groupBy(by).agg(F.min_by(F.struct(*columns), F.col(order)).alias("r"), F.count("*").alias("n")).select(by, "r.*", "n")


def carried(rows: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Nulls filled with the last value before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def marked(rows: DataFrame, ids: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """rows with a column set where the key is listed."""
    hit = ids.select(F.col(key).alias("_k")).distinct()
    return rows.join(hit, F.col(key) == F.col("_k"), "left").withColumn(column, F.when(F.col("_k").isNotNull(), F.lit(value)).otherwise(F.col(column))).drop("_k")


def interrupted(status: Column, alive: Column) -> Column:
    """A run that still claims to run without a live process was interrupted."""
    return F.when((status == "running") & ~F.coalesce(alive, F.lit(False)), "interrupted").otherwise(status)


def first_user_text(turns: DataFrame, by: str = "conv_id", order: str = "turn", width: int = 300) -> DataFrame:
    """The first user turn's text of each conversation, ``width`` characters at most."""
    return turns.where((F.col("role") == "user") & (F.trim("text") != "")).groupBy(by).agg(F.substring(F.min_by("text", order), 1, width).alias("first_user_text"))


#: Terminal colours, secrets that stand in a line, frames of boxes, and the words of each channel in order.
_COLOUR = r"\x1b\[[0-?]*[ -/]*[@-~]"
_INLINE = r"(?i)\b([A-Z_]*(?:API_KEY|AUTH_TOKEN|PASSWORD|SECRET|TOKEN|KEY))\s*=\s*([^\s]+)"
_BLANK_ENDS = r"^[\x09-\x0D\x1C-\x20\x85\p{Z}]+|[\x09-\x0D\x1C-\x20\x85\p{Z}]+$"
_FRAME = r"^[─━═╭╮╰╯┌┐└┘┄┈ ]*$"
_CHANNELS = (
    ("runtime", r"^---"),
    ("reasoning", r"💭|(?i:^(?:thought|reasoning))"),
    ("action", r"⚡|(?i:click|write|scroll|keypress|tool_call|action)"),
    ("answer", r"📝|(?i:answer)"),
    ("error", r"(?i:error|failed)"),
)


def log_line(line: Column, width: int = 2000) -> Column:
    """What may be kept of an agent's log line: (channel, text), or null. Colours, frames and control characters go, inline secrets are masked, long lines are cut; lines with the user's task, and those of no channel, are dropped."""
    t = F.regexp_replace(F.regexp_replace(line, _COLOUR, ""), _BLANK_ENDS, "")
    secret = t.rlike(r"^(?:user:|--- task:)")
    t = F.regexp_replace(t, r"^[│ ]+|[│ ]+$", "")
    kept = F.regexp_replace(F.regexp_replace(t, _INLINE, "$1=[REDACTED]"), r"[\x00-\x08\x0a-\x1f]", "")
    kept = F.when(F.length(kept) > width, F.concat(F.substring(kept, 1, width - 3), F.lit("…"))).otherwise(kept)
    channel = F.lit(None).cast("string")
    for name, pattern in reversed(_CHANNELS):
        channel = F.when(kept.rlike(pattern), F.lit(name)).otherwise(channel)
    return F.when(~secret & ~t.rlike(_FRAME) & channel.isNotNull(), F.struct(channel.alias("channel"), kept.alias("text")))


#: Kinds of a runner's events by how a line begins and ends (the first that holds counts).
_EVENTS = (
    ("engine_ready", r"^--- redaction ON"),
    ("bypassed", r"^--- redaction OFF"),
    ("model_found", r"advertised: True$"),
    ("provider_connected", r"(?s)^--- preflight:.*answered a 1-token probe$"),
    ("provider_checked", r"^--- preflight:"),
    ("model_unavailable", r"(?s)^ERROR: model .*rejected a 1-token probe \(HTTP 402\)"),
    ("artifacts_cleared", r"^(?:--- runs dir shredded|--- ephemeral runs dir removed)"),
    ("agent_finished", r"^--- {program} exit: 0"),
    ("error", r"(?is)^(?![{\[]).*error"),
)


def runner_event(line: Column, program: str = "holo") -> Column:
    """The kind of event that a runner's line tells of; null for lines that stay private. program: the one whose end counts."""
    t, out = F.regexp_replace(line, _BLANK_ENDS, ""), F.lit(None).cast("string")
    for kind, pattern in reversed(_EVENTS):
        out = F.when(t.rlike(pattern.replace("{program}", re.escape(program))), F.lit(kind)).otherwise(out)
    return out


def markers(text: Column, most: int = 2) -> Column:
    """Tool markers of a text, the first ``most`` of them, each id once: (verb, tokens, id, instruction). Tokens come without marks and white space."""
    p = r"⟦TOOL:([a-z_]+):([^:⟧]*):([A-Za-z0-9_-]+)(?::([^⟧]*))?⟧"
    found = F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, most)
    part = lambda m, i: F.regexp_extract(m, p, i)
    first = F.filter(found, lambda m, i: F.array_position(F.transform(found, lambda x: part(x, 3)), part(m, 3)) == i + 1)
    bare = lambda x: F.regexp_replace(x, r"^[«»\s\p{Z}]+|[«»\s\p{Z}]+$", "")
    tokens = lambda m: F.filter(F.transform(F.split(part(m, 2), ","), bare), lambda x: x != "")
    return F.transform(first, lambda m: F.struct(part(m, 1).alias("verb"), tokens(m).alias("tokens"), part(m, 3).alias("id"), F.nullif(part(m, 4), F.lit("")).alias("instruction")))


def new_markers(texts: DataFrame, by: str, order: str, column: str = "text", most: int = 2) -> DataFrame:
    """The markers of each conversation whose id was not seen in an earlier text of it: by, order, place and the marker."""
    each = texts.select(by, order, F.posexplode(markers(F.col(column), most)).alias("place", "m"))
    seen = F.row_number().over(Window.partitionBy(by, "m.id").orderBy(order, "place"))
    return each.withColumn("_n", seen).where(F.col("_n") == 1).drop("_n")


def routed(verb: Column) -> Column:
    """Where a verb goes: deterministic, semantic, or nowhere."""
    return F.when(verb.isin("echo", "add", "sort"), "deterministic").when(verb.isin("select", "rank", "sort_by"), "semantic")


def run_id(at: Column, key: Column) -> Column:
    return F.concat_ws("-", F.date_format(at, "yyyyMMdd"), F.date_format(at, "HHmmss"), F.substring(F.sha2(key.cast("string"), 256), 1, 4))


def remaining(expires: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), expires - now)
