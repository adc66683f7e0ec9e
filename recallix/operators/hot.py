"""Range shards for keys that hold too many rows for one task.

A key is hot if it has more rows than max(base, total / limit). At most `limit` keys can have more than
total / limit rows, so the table of hot keys has a proven size and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallix.session import checkpoint


#: Quantiles taken of a hot key, so the most shards it can have.
QUANTILES = 512


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on null-safe equality of keys; the keys stand once in the result. small: broadcasts right."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(F.broadcast(right) if small else right, on, how).drop(*[f"__right_{k}" for k in keys])


def hot_bounds(df: DataFrame, keys: list[str], order: str, base: int, limit: int = 10_000, most: int = QUANTILES) -> DataFrame | None:
    """For each hot key its ascending cuts of `order` (quantiles), about one for every `base` rows.

    None if no key is hot. `most` limits the cuts of a key; beyond it the shards get larger, none is dropped.
    """
    counts = checkpoint(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    least = max(base, -(-total // limit))
    if total <= least:
        return None
    hot = counts.where(F.col("__n") > least)
    if hot.isEmpty():
        return None
    rows = join_keys(df, hot, keys, small=True).withColumn("__o", F.col(order))
    steps = F.least(F.lit(most), F.ceil(F.col("__n") / F.lit(least)).cast("int"))
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("__o", [i / QUANTILES for i in range(1, QUANTILES)], 20 * QUANTILES).alias("__q"), F.max(steps).alias("__m"), F.min("__o").alias("__lo"))
    every = F.transform(F.sequence(F.lit(1), F.col("__m") - 1), lambda i: F.element_at("__q", F.greatest(F.lit(1), F.floor(i * QUANTILES / F.col("__m")).cast("int"))))
    return sketch.select(*keys, F.array_sort(F.array_distinct(F.filter(every, lambda x: x > F.col("__lo")))).alias("__cuts")).where(F.size("__cuts") > 0)


def with_cuts(df: DataFrame, keys: list[str], bounds: DataFrame | None) -> DataFrame:
    """df with `__cuts`: the cuts of its key, null where the key isn't hot."""
    if bounds is None:
        return df.withColumn("__cuts", F.lit(None).cast("array<bigint>"))
    return join_keys(df, bounds, keys, "left", small=True)


def shard_of(value: Column | str, cuts: Column | str = "__cuts") -> Column:
    """The number of cuts at or below value: shard k holds cuts[k-1] <= value < cuts[k]. 0 without cuts."""
    value, cuts = (F.col(x) if isinstance(x, str) else x for x in (value, cuts))
    return F.when(cuts.isNull(), F.lit(0)).otherwise(F.size(F.filter(cuts, lambda c: c <= value)))


def running_totals(df: DataFrame, keys: list[str], order: str, values: dict[str, str], base: int = 50_000) -> DataFrame:
    """df with the running totals of columns (new name -> column) up to and with each row, by a bigint order.

    Rows of equal order count together. Hot keys are summed in shards, with the totals of the shards before added.
    """
    bounds = hot_bounds(df, keys, order, base)
    rows = with_cuts(df, keys, bounds).withColumn("__shard", shard_of(order)).drop("__cuts")
    w = Window.partitionBy(*keys, "__shard").orderBy(order)
    rows = rows.withColumns({n: F.sum(c).over(w) for n, c in values.items()})
    if bounds is None:
        return rows.drop("__shard")
    hot = join_keys(df, bounds.select(*keys), keys, small=True)
    shards = with_cuts(hot, keys, bounds).withColumn("__shard", shard_of(order)).groupBy(*keys, "__shard").agg(*[F.sum(c).alias(f"__{n}") for n, c in values.items()])
    before = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(*keys, "__shard", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in values])
    out = join_keys(rows, shards, [*keys, "__shard"], "left", small=True)
    return out.withColumns({n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in values}).drop("__shard", *[f"__{n}" for n in values])


def sequenced(df: DataFrame, keys: list[str], order: str, tie: str, base: int = 50_000) -> DataFrame:
    """df with `place` (from 1), `before` and `after`: the order of the rows next to each in its key, ties by `tie`.

    Hot keys are ranked in shards, with the sizes of the shards before as offsets and the edges of their neighbours.
    """
    bounds = hot_bounds(df, keys, order, base)
    rows = with_cuts(df, keys, bounds).withColumn("__shard", shard_of(order)).drop("__cuts")
    w = Window.partitionBy(*keys, "__shard").orderBy(order, tie)
    rows = rows.withColumns({"place": F.row_number().over(w).cast("long"), "before": F.lag(order).over(w), "after": F.lead(order).over(w)})
    if bounds is None:
        return rows.drop("__shard")
    hot = join_keys(df, bounds.select(*keys), keys, small=True)
    shards = with_cuts(hot, keys, bounds).withColumn("__shard", shard_of(order)).groupBy(*keys, "__shard").agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__low"), F.max(order).alias("__high"))
    w = Window.partitionBy(*keys).orderBy("__shard")
    shards = shards.select(*keys, "__shard", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__skip"), F.lag("__high").over(w).alias("__high"), F.lead("__low").over(w).alias("__low"))
    out = join_keys(rows, shards, [*keys, "__shard"], "left", small=True)
    return out.withColumns({"place": F.col("place") + F.coalesce("__skip", F.lit(0)), "before": F.coalesce("before", "__high"), "after": F.coalesce("after", "__low")}).drop("__shard", "__skip", "__high", "__low")
