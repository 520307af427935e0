"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame functions only. Each source is dealt by a row hash into ``BLOCKS``
blocks, in permuted order. A source's target asks for whole passes over its
blocks, some further whole blocks, a cut block, and a few documents added or dropped to come
nearer; these block quotas are exact. A binary tree then splits the quotas of all sources
among the output shards (at each node, the left half's counts are multivariate
hypergeometric, drawn by inverse CDF from a hash), each shard draws its disjoint
run of every source's permuted blocks, and rows are shuffled locally by a hash.

Only tables of one row a source and block (at most ``BLOCKS`` of each source)
are gathered; a source's rows are never in one task, however hot it is.

Edge cases: a null text has size 0; a null source is a source of its own, last in
order; a source without words has target 0; a text without words is not taken; equal rows share their fate, since
rows are told apart by id, source and size; an empty table gives an empty mix;
further columns pass through ``mix`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint, numbered
from spanveil.llm import vec

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BLOCKS = 256
SHARDS = 64
#: Documents moved, at most, to bring a source nearer its target.
ROUNDS = 4
SEED = 20240607
#: Rows of a source or block table up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000


def size_of(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(salt: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(SEED), F.lit(salt), *cols)


def _uniform(salt: int, *cols: Column) -> Column:
    return F.pmod(_hash(salt, *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the row's place (block, then key) in its source's permutation."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return rows.withColumn("key", _hash(1, F.col("doc_id"), F.col("source"), F.col("size"))).withColumn("block", F.pmod(_hash(2, F.col("key")), F.lit(BLOCKS)).cast("int"))


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, weight, target: the words of each source in the mix, filled like water up to the caps."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    named = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), F.asc_nulls_last("source"), name="rank")
    t = (
        named.withColumn("rank", F.col("rank").cast("int"))
        .withColumn("weight", F.element_at(weights, (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
        .withColumn("cap", CAP * F.col("source_size"))
    )
    # The level rises as sources reach their caps: each round is one aggregate, and no source is freed again.
    level, bound = 0.0, -1
    while True:
        full = (F.col("cap") <= F.col("weight") * level) if bound >= 0 else F.lit(False)
        s = t.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")
        ).first()
        if s["n"] == bound or not s["open"]:
            break
        bound, level = s["n"], ((s["all"] or 0) - (s["used"] or 0)) / s["open"]
    full = F.col("cap") <= F.col("weight") * F.lit(level)
    return t.select("source", "source_size", "rank", "weight", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _sent(df: DataFrame, small: bool) -> DataFrame:
    """A table broadcast, if a count has shown it to be small."""
    return F.broadcast(df) if small else df


def quotas(rows: DataFrame, goal: DataFrame, small: bool) -> DataFrame:
    """One row for each source and block: how often it is taken whole, and what is taken of a cut block."""
    in_order = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    g = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(CAP), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    g = g.withColumn("rest", F.when(F.col("passes") >= CAP, 0.0).otherwise(F.col("target") - F.col("passes") * F.col("source_size")))
    b = (
        rows.groupBy("source", "block")
        .agg(F.sum("size").alias("words"))
        .alias("b")
        .join(_sent(g, small).alias("g"), F.expr("b.source <=> g.source"))
        .select("g.source", "rank", "passes", "rest", "block", "words", "source_size", "target")
        .withColumn("before", F.coalesce(F.sum("words").over(in_order), F.lit(0)))
        .withColumn("whole", F.col("before") + F.col("words") <= F.col("rest"))
        .withColumn("cut", ~F.col("whole") & (F.col("before") < F.col("rest")))
    )
    return b


def cuts(rows: DataFrame, blocks: DataFrame, small: bool, rounds: int = ROUNDS) -> DataFrame:
    """For each source with a cut block: the last key taken of it, and the keys of the documents added or dropped to come nearer the target.

    Each round moves the document whose size is nearest to what is missing (or
    too much); the state that came nearest counts. A round is one partial
    aggregate over ids and sizes.
    """
    edge = blocks.where("cut").select(F.col("source").alias("s"), F.col("block").alias("cut_block"), "rest", (F.col("rest") - F.col("before")).alias("room"))
    own = rows.join(_sent(edge, small), F.col("source").eqNullSafe(F.col("s")))
    line = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    # The cut block is cut again by the first byte of the key, which follows the keys' order: only one such part is sorted.
    inside = own.where(F.col("block") == F.col("cut_block")).withColumn("part", F.shiftright("key", 56))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part = (
        inside.groupBy("source", "part", "room")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(by_part), F.lit(0)))
        .where((F.col("before") <= F.col("room")) & (F.col("before") + F.col("words") > F.col("room")))
        .select(F.col("source").alias("s4"), F.col("part").alias("cut_part"), "before")
    )
    last = (
        inside.join(_sent(part, small), F.col("source").eqNullSafe(F.col("s4")) & (F.col("part") == F.col("cut_part")))
        .withColumn("sum", F.col("before") + F.sum("size").over(line))
        .where(F.col("sum") <= F.col("room"))
        .groupBy("source")
        .agg(F.max("key").alias("in_key"), F.max("sum").alias("in_got"))
    )
    # where no row of that part fits, all before it is taken
    last = part.join(_sent(last, small), F.col("s4").eqNullSafe(F.col("source")), "left").select(
        F.col("s4").alias("s2"), F.coalesce("in_key", F.when(F.col("cut_part") > -128, F.shiftleft("cut_part", 56) - 1)).alias("last_key"), F.coalesce("in_got", "before").alias("got")
    )
    none = F.array().cast("array<long>")
    gap = F.col("room") - F.coalesce("got", F.lit(0))
    state = edge.join(_sent(last, small), F.col("s").eqNullSafe(F.col("s2")), "left").select("s", "cut_block", "last_key", gap.alias("gap"), none.alias("add"), none.alias("drop"), F.lit(0).cast("long").alias("moved"))
    state = checkpoint(state.withColumn("best", F.struct(F.abs("gap").alias("miss"), "add", "drop")))
    for _ in range(rounds):
        j = rows.join(_sent(state, small), F.col("source").eqNullSafe(F.col("s")))
        first = (F.col("block") < F.col("cut_block")) | ((F.col("block") == F.col("cut_block")) & F.coalesce(F.col("key") <= F.col("last_key"), F.lit(False)))
        taken = (first & ~F.array_contains("drop", F.col("key"))) | F.array_contains("add", F.col("key"))
        can = (F.col("size") > 0) & (F.col("key") != F.col("moved")) & F.when(F.col("gap") > 0, ~taken).otherwise(taken)
        rank = F.when(can, F.struct(F.abs(F.abs("gap") - F.col("size")).alias("miss"), F.col("key")))
        pick = j.groupBy("s").agg(F.min_by(F.struct("key", "size"), rank).alias("p")).where(F.col("p").isNotNull()).select(F.col("s").alias("s3"), "p")
        state = state.join(_sent(pick, small), F.col("s").eqNullSafe(F.col("s3")), "left")
        k, more = F.array(F.col("p.key")), F.col("gap") > 0
        away = lambda a: F.array_except(a, k)
        onto = lambda a, other: F.when(F.array_contains(other, F.col("p.key")), a).otherwise(F.array_union(a, k))
        moves = F.col("p").isNotNull() & (F.col("gap") != 0)
        add = F.when(~moves, F.col("add")).when(more, onto(F.col("add"), F.col("drop"))).otherwise(away(F.col("add")))
        drop = F.when(~moves, F.col("drop")).when(more, away(F.col("drop"))).otherwise(onto(F.col("drop"), F.col("add")))
        new = F.when(~moves, F.col("gap")).when(more, F.col("gap") - F.col("p.size")).otherwise(F.col("gap") + F.col("p.size"))
        state = state.select("s", "cut_block", "last_key", new.alias("gap"), add.alias("add"), drop.alias("drop"), F.coalesce("p.key", "moved").alias("moved"), "best")
        now = F.struct(F.abs("gap").alias("miss"), "add", "drop")
        state = checkpoint(state.withColumn("best", F.when(F.abs("gap") < F.col("best.miss"), now).otherwise(F.col("best"))))
    return state.select(F.col("s").alias("source"), "cut_block", "last_key", F.col("best.add").alias("add_keys"), F.col("best.drop").alias("drop_keys"))


def _ln_factorial(x: Column) -> Column:
    return F.when(x < 2, F.lit(0.0)).otherwise((x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x))


def _draw(total: Column, n: Column, k: Column, u: Column) -> Column:
    """A hypergeometric number: how many of the k marked among ``total`` are among the n drawn, by inverse CDF at u."""
    d = lambda c: c.cast("double")

    def weight(x: Column) -> Column:
        return -(_ln_factorial(d(x)) + _ln_factorial(d(k - x)) + _ln_factorial(d(n - x)) + _ln_factorial(d(total - k - n + x)))

    def walk(w: Column) -> Column:
        start = F.struct((u * F.aggregate(w, F.lit(0.0), lambda a, b: a + b)).alias("left"), F.lit(0).cast("long").alias("at"))
        end = F.aggregate(w, start, lambda a, b: F.struct((a["left"] - b).alias("left"), (a["at"] + F.when(a["left"] > b, 1).otherwise(0)).alias("at")))
        return F.least(end["at"], F.size(w) - 1)

    low = F.greatest(F.lit(0).cast("long"), n - (total - k))
    logs = F.transform(F.sequence(low, F.least(k, n)), weight)
    return low + _let(logs, lambda a: _let(F.array_max(a), lambda top: walk(F.transform(a, lambda x: F.exp(x - top)))))


def _split(half: int):
    """A fold over a node's sources that draws the left half's quota of each."""

    def step(acc: Column, s: Column) -> Column:
        drawn = _draw(acc["total"], acc["n"], s["q"], _uniform(3, F.col("shard"), F.lit(half), s["rank"]))
        return _let(
            drawn,
            lambda x: F.struct(
                (acc["total"] - s["q"]).alias("total"),
                (acc["n"] - x).alias("n"),
                F.concat(acc["left"], F.array(F.struct(s["rank"].alias("rank"), x.alias("q")))).alias("left"),
            ),
        )

    return step


def tree(blocks: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rank, shard, first, last: the run of each source's permuted block quota that each shard draws."""
    quota = F.col("passes") + F.when(F.col("whole") | F.col("cut"), 1).otherwise(0)
    node = (
        blocks.groupBy("rank")
        .agg(F.sum(quota).cast("long").alias("q"))
        .groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("rank", "q"))).alias("all"))
        .select(F.lit(0).alias("shard"), "all")
    )
    width = shards
    while width > 1:
        half = width // 2

        total = F.aggregate("all", F.lit(0).cast("long"), lambda a, s: a + s["q"])
        empty = F.filter("all", lambda s: F.lit(False))
        start = F.struct(F.col("total").alias("total"), F.ceil(F.col("total") * half / width).cast("long").alias("n"), empty.alias("left"))
        node = node.withColumn("total", total).withColumn("left", F.aggregate("all", start, _split(half), lambda a: a["left"]))
        right = F.zip_with("all", "left", lambda a, b: F.struct(a["rank"].alias("rank"), (a["q"] - b["q"]).alias("q")))
        both = F.array(F.struct(F.col("shard"), F.col("left").alias("all")), F.struct((F.col("shard") + half).alias("shard"), right.alias("all")))
        node = node.select(F.explode(both).alias("x")).select("x.*")
        width = half
    runs = node.select("shard", F.explode("all").alias("x")).select("shard", "x.rank", "x.q")
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("last", F.sum("q").over(upto)).where("q > 0").select("rank", "shard", (F.col("last") - F.col("q") + 1).alias("first"), "last")


def plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each source and block: source figures, its whole takes and extra take with their shards, and the cut."""
    rows = checkpoint(sized(docs))  # ids and sizes, no texts
    goal = checkpoint(targets(rows))
    small = goal.count() <= BROADCAST_ROWS  # a row for each source
    blocks = checkpoint(quotas(rows, goal, small))
    unit = blocks.select(
        "rank",
        "block",
        F.explode(F.sequence(F.lit(1), F.col("passes") + 1)).alias("copy"),
        (F.col("whole") | F.col("cut")).alias("more"),
        "passes",
    ).where((F.col("copy") <= F.col("passes")) | F.col("more"))
    dealt = Window.partitionBy("rank").orderBy(_hash(4, F.col("rank"), F.col("block"), F.col("copy")), "block", "copy")
    drawn = (
        unit.withColumn("at", F.row_number().over(dealt))
        .alias("u")
        .join(tree(blocks, shards).alias("t"), (F.col("u.rank") == F.col("t.rank")) & F.col("u.at").between(F.col("t.first"), F.col("t.last")))
        .groupBy("u.rank", "u.block")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("u.copy"), F.col("t.shard")))).alias("drawn"))
    )
    return (
        blocks.join(drawn.withColumnRenamed("rank", "r2").withColumnRenamed("block", "b2"), (F.col("rank") == F.col("r2")) & (F.col("block") == F.col("b2")), "left")
        .drop("r2", "b2")
        .alias("p")
        .join(_sent(cuts(rows, blocks, small), small).alias("c"), F.expr("p.source <=> c.source"), "left")
        .select("p.*", "c.cut_block", "c.last_key", "c.add_keys", "c.drop_keys")
    )


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, source and text with ``_mix_size``, ``_mix_source_size``, ``_mix_target`` and ``_mix_takes``: the shards that take the row, one for each copy."""
    return _assigned(docs.select("doc_id", "source", "text"), shards, "_mix_")


def _assigned(docs: DataFrame, shards: int, pre: str) -> DataFrame:
    p = checkpoint(plan(docs, shards).select(*[F.col(c).alias(pre + c) for c in ("source", "block", "passes", "whole", "cut_block", "last_key", "add_keys", "drop_keys", "drawn", "source_size", "target")]))
    size, key = F.col(f"{pre}size"), F.col(f"{pre}key")
    block = F.pmod(_hash(2, key), F.lit(BLOCKS)).cast("int")
    own = docs.withColumn(f"{pre}size", size_of(F.col("text"))).withColumn(f"{pre}key", _hash(1, F.col("doc_id"), F.col("source"), size)).withColumn(f"{pre}at", block)
    small = p.count() <= BROADCAST_ROWS
    joined = own.join(_sent(p, small), F.col("source").eqNullSafe(F.col(f"{pre}source")) & (F.col(f"{pre}at") == F.col(f"{pre}block")), "left")
    never = F.lit(False)
    first = F.col(f"{pre}whole") | F.coalesce((F.col(f"{pre}at") == F.col(f"{pre}cut_block")) & (key <= F.col(f"{pre}last_key")), never)
    extra = (first & ~F.coalesce(F.array_contains(f"{pre}drop_keys", key), never)) | F.coalesce(F.array_contains(f"{pre}add_keys", key), never)
    passes = F.col(f"{pre}passes")
    spare = F.pmod(_hash(5, key), F.lit(shards)).cast("int")
    count = F.when(size > 0, passes + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)).otherwise(0)
    drawn = F.coalesce(F.transform(f"{pre}drawn", lambda x: x["shard"]), F.array().cast("array<int>"))
    # A document that was added may lie outside the drawn blocks: it goes to a shard by its hash.
    takes = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.coalesce(F.get(drawn, i - 1), spare))
    return joined.withColumn(f"{pre}takes", F.when(F.coalesce(count, F.lit(0)) > 0, takes).otherwise(F.array().cast("array<int>")))


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mixed rows, each as often as it is taken, with the columns of docs, laid out by shard and shuffled within."""
    pre = "_mix_"
    while any(c.lower().startswith(pre) for c in docs.columns):
        pre += "_"
    own = [F.col(vec.quoted(c)) for c in docs.columns]
    rows = _assigned(docs, shards, pre).select(*own, f"{pre}key", F.posexplode(f"{pre}takes").alias(f"{pre}copy", f"{pre}shard"))
    order = _hash(6, F.col(f"{pre}key"), F.col(f"{pre}copy"))
    rows = rows.withColumn(f"{pre}order", order)
    return rows.repartitionByRange(f"{pre}shard", f"{pre}order").sortWithinPartitions(f"{pre}shard", f"{pre}order").select(*own)
