"""Facts with validity: as of a time, their timeline, overlaps, and superseding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallix.operators.hot import running_totals, sequenced
from recallix.operators.intervals import OPEN_END, OPEN_START


def as_of(facts: DataFrame, at: Column, start: str = "from_us", end: str = "until_us", superseded: str | None = None) -> DataFrame:
    """Facts that hold at a time (half-open; null bounds are open); with `superseded` only those not yet replaced."""
    out = facts.where((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at)))
    return out.where(F.col(superseded).isNull()) if superseded else out


def timeline(facts: DataFrame, keys: list[str], start: str, order: str, base: int = 50_000) -> DataFrame:
    """Facts with their place in the order of their key, and the next start as implied end where it is open.

    An open start comes first. Keys with very many facts are ranked in shards.
    """
    rows = facts.withColumn("__start", F.coalesce(start, F.lit(OPEN_START)))
    out = sequenced(rows, keys, "__start", order, base)
    return out.withColumn("next_start", F.when(F.col("after") > OPEN_START, F.col("after"))).drop("__start", "before", "after")


def overlap_counts(facts: DataFrame, keys: list[str], row_id: str, start: str, end: str, base: int = 50_000) -> DataFrame:
    """(keys, row id, overlaps): with how many other facts of its key each fact overlaps.

    Counted by two running sums over the sorted bounds, not by listing pairs: those that start before my end less
    those that end by my start, less myself. Rows whose end isn't after their start overlap with none.
    """
    s, e = F.coalesce(start, F.lit(OPEN_START)), F.coalesce(end, F.lit(OPEN_END))
    rows = facts.select(*keys, F.col(row_id).alias("__id"), s.alias("__s"), e.alias("__e")).where("__e > __s")
    starts = rows.groupBy(*keys, F.col("__s").alias("__at")).agg(F.count(F.lit(1)).alias("__starts"))
    ends = rows.groupBy(*keys, F.col("__e").alias("__at")).agg(F.count(F.lit(1)).alias("__ends"))
    points = starts.withColumn("__ends", F.lit(0)).unionByName(ends.withColumn("__starts", F.lit(0))).groupBy(*keys, "__at").agg(F.sum("__starts").alias("__starts"), F.sum("__ends").alias("__ends"))
    sums = running_totals(points, keys, "__at", {"__begun": "__starts", "__ended": "__ends"}, base).withColumn("__begun", F.col("__begun") - F.col("__starts"))
    mine = rows.join(sums.select(*keys, F.col("__at").alias("__s"), "__ended"), [*keys, "__s"])
    mine = mine.join(sums.select(*keys, F.col("__at").alias("__e"), "__begun"), [*keys, "__e"])
    return mine.select(*keys, F.col("__id").alias(row_id), (F.col("__begun") - F.col("__ended") - 1).alias("overlaps"))


def close_superseded(facts: DataFrame, row_id: str, by: str, start: str, end: str) -> DataFrame:
    """Facts with the end of a superseded one set to the start of its successor, if it was open."""
    later = facts.select(F.col(row_id).alias("__by"), F.col(start).alias("__from"))
    out = facts.join(later, F.col(by) == F.col("__by"), "left")
    return out.select(*[F.coalesce(end, "__from").alias(end) if c == end else facts[c] for c in facts.columns])
