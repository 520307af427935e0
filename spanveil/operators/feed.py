"""A replayable training feed: the bounded-buffer shuffle of a stream, computed for all rows at once.

The shuffle that a reader does row by row (hold ``buffer`` rows; for each further row
give out the one in a drawn slot and put the new one there; at the end give out what is
left, mixed) fixes for every row the slot that it enters and the step at which it
does. It leaves at the step of the row that enters the same slot next, so a window over
each slot has the whole order: no state, the same for every partitioning, and
replayable from the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.cluster import numbered

BUFFER = 10_000


def draw(seed: int, number: Column, below: int, use: str = "slot") -> Column:
    """A number below a bound, drawn for a step by hash."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{use}:"), number.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(below))


def buffered(rows: DataFrame, *order: Column | str, seed: int, buffer: int = BUFFER, name: str = "position") -> DataFrame:
    """rows with the place (from 1) at which a buffered shuffle of them, read in ``order``, gives each out.

    An order with ties is completed by itself once and kept; a buffer as large as the table is a
    full shuffle; an empty table gives no rows.
    """
    if buffer < 1:
        raise ValueError("a buffer holds a row at least")
    at, slot, step, after = "_at", "_slot", "_step", "_after"
    read = numbered(rows, *order, name=at)
    n = read.count()
    held = min(buffer, n)
    i = F.col(at) - 1
    placed = read.withColumn(step, F.greatest(i - held, F.lit(-1))).withColumn(slot, F.when(i < held, i).otherwise(draw(seed, i - held, max(held, 1))))
    gone = placed.withColumn(after, F.lead(step).over(Window.partitionBy(slot).orderBy(step)))
    # what is left at the end is one row a slot: as many as the buffer holds
    rest = F.row_number().over(Window.orderBy(draw(seed, F.col(slot), 1 << 32, "rest"), slot))
    last = gone.where(F.col(after).isNull()).withColumn(name, (rest + (n - held)).cast("long"))
    first = gone.where(F.col(after).isNotNull()).withColumn(name, (F.col(after) + 1).cast("long"))
    return first.unionByName(last).drop(at, slot, step, after)


def taken(fed: DataFrame, accept: Column, limit: int, position: str = "position", name: str = "place") -> DataFrame:
    """The first ``limit`` accepted rows of a feed, numbered in its order; fewer accepted rows are an error."""
    ready = numbered(fed.where(accept), position, name=name)
    n = ready.count()
    if n < limit:
        raise ValueError(f"{limit} rows were asked for, {n} accepted")
    return ready.where(F.col(name) <= limit)
