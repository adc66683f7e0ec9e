"""Continuous periods and gaps of overlapping, nested, touching or separate time intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallix.operators.hot import hot_bounds, shard_of, with_cuts

#: Stand for an open start and an open end, in microseconds; no instant of years 1 to 9999 reaches them.
OPEN_START, OPEN_END = -(2**62), 2**62


def utc_text_to_micros(text: Column) -> Column:
    """Microseconds since 1970 of ISO text in UTC, of any precision from a date on. Null if it is none.

    Whatever zone the session has, text without a zone is UTC; a bare date is its midnight.
    """
    t = F.trim(text)
    zoned = t.rlike(r":\d\d(\.\d+)?\s*(Z|[+-]\d\d(:?\d\d)?)$")
    iso = F.when(zoned, t).when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d\d?:\d\d$"), F.concat(t, F.lit(":00Z"))).when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d"), F.concat(t, F.lit("Z")))
    return F.unix_micros(iso.try_cast("timestamp"))


def micros_to_utc_text(us: Column) -> Column:
    """2021-03-04T10:15:00 (and a fraction, if there is one), in UTC, whatever zone the session has."""
    seconds = (us.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.translate(at.cast("string"), " ", "T")


def _coalesced(pieces: DataFrame, within: list[str]) -> DataFrame:
    """The continuous periods of pieces (__s, __e) with equal `within`; touching pieces are continuous."""
    w = Window.partitionBy(*within).orderBy("__s", "__e")
    before = F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("__new", F.when(before.isNull() | (F.col("__s") > before), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*within, "__island").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e")).drop("__island")


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, base: int = 64) -> DataFrame:
    """For each key the maximal continuous periods and the gaps between two of them.

    start and end are bigint columns in any one unit; intervals are half-open, a null bound is open. Returns the
    keys and kind (`period` or `gap`), starts, ends; an open bound is null again (names get a trailing `_`
    where a key has them). Other columns of df play no part.

    Two-level merge. Equal starts of a key are collapsed to their largest end first. Keys with more than about
    `base` starts are cut into time shards at quantiles of the start (others are one shard); each interval is clipped
    to the shards it begins and ends in, those it covers wholly are noted once a shard. Every shard is merged by
    itself; then coverage that touches a shard's edge (two pieces a shard at most) is stitched. No task gets a whole
    hot key.

    Defined cases: rows whose end isn't after their start are no intervals; a null key is a key like any other;
    repeated rows and ties change nothing; an empty table gives no rows.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(x).alias(y) for x, y in zip(keys, k)], F.coalesce(F.col(start), F.lit(OPEN_START)).alias("__s"), F.coalesce(F.col(end), F.lit(OPEN_END)).alias("__e"))
    rows = rows.where("__e > __s").groupBy(*k, "__s").agg(F.max("__e").alias("__e"))
    bounds = hot_bounds(rows, k, "__s", base)
    cut = with_cuts(rows, k, bounds)
    first, last = shard_of("__s"), F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col("__e"))))
    cut = cut.withColumns({"__a": first, "__z": last})
    low = lambda shard: F.get("__cuts", shard - 1)
    part = lambda shard, s, e: F.struct(shard.alias("shard"), s.alias("s"), e.alias("e"))
    clipped = F.when(F.col("__a") == F.col("__z"), F.array(part(F.col("__a"), F.col("__s"), F.col("__e")))).otherwise(F.array(part(F.col("__a"), F.col("__s"), F.get("__cuts", F.col("__a"))), part(F.col("__z"), low(F.col("__z")), F.col("__e"))))
    pieces = cut.select(*k, F.explode(clipped).alias("__x")).select(*k, F.col("__x.shard").alias("__shard"), F.col("__x.s").alias("__s"), F.col("__x.e").alias("__e"))
    if bounds is not None:  # what covers whole shards
        spans = cut.where("__z - __a > 1").select(*k, "__a", "__z").distinct()
        whole = spans.select(*k, F.explode(F.sequence(F.col("__a") + 1, F.col("__z") - 1)).alias("__shard")).distinct()
        pieces = pieces.unionByName(with_cuts(whole, k, bounds).select(*k, "__shard", F.get("__cuts", F.col("__shard") - 1).alias("__s"), F.get("__cuts", F.col("__shard")).alias("__e")))
    local = with_cuts(_coalesced(pieces, [*k, "__shard"]), k, bounds)
    touches = F.when(F.col("__cuts").isNull(), False).otherwise(F.coalesce(F.col("__s") == F.get("__cuts", F.col("__shard") - 1), F.lit(False)) | F.coalesce(F.col("__e") == F.get("__cuts", F.col("__shard")), F.lit(False)))
    local = local.withColumns({"__t": touches, "__p": F.lag("__e").over(Window.partitionBy(*k, "__shard").orderBy("__s"))})
    piece = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), F.col(s).alias("s"), F.col(e).alias("e"))
    made = F.filter(F.array(F.when(~F.col("__t"), piece("period", "__s", "__e")), F.when(F.col("__p").isNotNull(), piece("gap", "__p", "__s"))), lambda x: x.isNotNull())
    shown = [*k, F.col("__x.kind").alias("__kind"), F.col("__x.s").alias("__s"), F.col("__x.e").alias("__e")]
    out = local.select(*k, F.explode(made).alias("__x")).select(*shown)
    if bounds is not None:  # stitch
        stitched = _coalesced(local.where("__t").select(*k, "__s", "__e"), k).select(*k, piece("period", "__s", "__e").alias("__x"))
        ends = local.where("__cuts is not null").groupBy(*k, "__shard").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))
        across = ends.withColumn("__p", F.lag("__e").over(Window.partitionBy(*k).orderBy("__shard"))).where("__p < __s").select(*k, piece("gap", "__p", "__s").alias("__x"))
        out = out.unionByName(stitched.unionByName(across).select(*shown))
    name = lambda x: x + "_" if x in keys else x
    starts, ends_ = F.when(F.col("__s") > OPEN_START, F.col("__s")), F.when(F.col("__e") < OPEN_END, F.col("__e"))
    return out.select(*[F.col(y).alias(x) for x, y in zip(keys, k)], F.col("__kind").alias(name("kind")), starts.alias(name("starts")), ends_.alias(name("ends")))
