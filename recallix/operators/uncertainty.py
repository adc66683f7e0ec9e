"""Contradicting claims and their resolution, source reliability, and answers from incomplete information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rivals(claims: DataFrame, keys: list[str], value: str, row_id: str, confidence: str) -> DataFrame:
    """Each claim that has a rival (another value of its key), with the strongest one: columns `rival_*`.

    The rival is the surest claim of the key with another value, then the one of the least id. Of each key only its
    best claim and its best claim with another value are joined back, so a key with very many claims emits a row
    for each claim, not for each pair.
    """
    columns = [c for c in claims.columns if c not in keys]
    order = F.struct((-F.coalesce(confidence, F.lit(0.0))).alias("c"), F.col(row_id).alias("i"))
    whole = F.struct(*columns)
    per_value = claims.groupBy(*keys, value).agg(F.min_by(whole, order).alias("__best"), F.min(order).alias("__order"))
    two = per_value.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__order"))).where("__n <= 2")
    top = two.groupBy(*keys).agg(F.max(F.when(F.col("__n") == 1, F.col("__best"))).alias("__first"), F.max(F.when(F.col("__n") == 2, F.col("__best"))).alias("__second")).where("__second is not null")
    out = claims.join(top, keys).withColumn("__rival", F.when(F.col(f"__first.{value}") == F.col(value), F.col("__second")).otherwise(F.col("__first")))
    return out.select(*keys, *columns, *[F.col(f"__rival.{c}").alias(f"rival_{c}") for c in columns])


def resolve(pairs: DataFrame, strategy: str, value: str, confidence: str, time: str, source: str, reliability: DataFrame | None = None, recency_weight: float = 0.6, reliability_weight: float = 0.4) -> DataFrame:
    """Adds `strategy`, `winner` (1 the claim, 2 its rival, 0 both), `resolved` and `certainty` to pairs of rivals.

    auto: by reliability if both have a source, else by recency if both have a time, else by confidence if both have
    one, else both are kept. Ties go to the rival. Sources without a reliability count as 0.5; kept both, the
    confidence is nine tenths of the mean, missing confidences 0.5.
    """
    c1, c2, t1, t2, s1, s2 = (F.col(p + c) for c in (confidence, time, source) for p in ("", "rival_"))
    v1, v2 = F.col(value).cast("string"), F.col("rival_" + value).cast("string")
    out = pairs
    if reliability is None:
        r1 = r2 = F.lit(0.5)
    else:
        for name, s in (("__r1", s1), ("__r2", s2)):
            table = reliability.select(F.col("source").alias(name + "s"), F.col("reliability").alias(name))
            out = out.join(table, s == F.col(name + "s"), "left").drop(name + "s")
        r1, r2 = F.coalesce("__r1", F.lit(0.5)), F.coalesce("__r2", F.lit(0.5))
    chosen: Column = F.lit(strategy)
    if strategy == "auto":
        chosen = F.when(s1.isNotNull() & s2.isNotNull(), "reliability").when(t1.isNotNull() & t2.isNotNull(), "recency").when(c1.isNotNull() & c2.isNotNull(), "confidence").otherwise("keep_both")
    z1, z2 = F.coalesce(t1, F.lit(0.0)), F.coalesce(t2, F.lit(0.0))
    fresh1, fresh2 = F.when(z1 >= z2, 1.0).otherwise(0.0), F.when(z2 >= z1, 1.0).otherwise(0.0)
    first = (
        F.when(F.col("strategy") == "recency", z1 > z2)
        .when(F.col("strategy") == "confidence", F.coalesce(c1, F.lit(0.0)) > F.coalesce(c2, F.lit(0.0)))
        .when(F.col("strategy") == "reliability", r1 > r2)
        .when(F.col("strategy") == "weighted", fresh1 * recency_weight + r1 * reliability_weight > fresh2 * recency_weight + r2 * reliability_weight)
    )
    half = F.lit(0.5)
    winner = F.when(F.col("strategy") == "keep_both", 0).when(first, 1).otherwise(2)
    out = out.withColumn("strategy", chosen).withColumn("winner", winner)
    resolved = F.when(F.col("winner") == 0, F.concat(v1, F.lit(" OR "), v2)).when(F.col("winner") == 1, v1).otherwise(v2)
    certainty = F.when(F.col("winner") == 0, (F.coalesce(c1, half) + F.coalesce(c2, half)) / 2 * 0.9).when(F.col("winner") == 1, F.coalesce(c1, half)).otherwise(F.coalesce(c2, half))
    return out.withColumn("resolved", resolved).withColumn("certainty", certainty).drop("__r1", "__r2")


def apply_resolution(claims: DataFrame, resolved: DataFrame, row_id: str) -> DataFrame:
    """Claims without those that lost to a rival."""
    return claims.join(resolved.where("winner = 2").select(row_id).distinct(), row_id, "left_anti")


def coverage(items: DataFrame, required: list[str], answer: str, confidence: str, least: float = 0.3, top: int = 3) -> DataFrame:
    """Partial matches: (answer, matched, match_confidence, rank) of items that cover the required columns best.

    A column is covered where it isn't null; an item counts if it covers more than `least` of them.
    """
    matched = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in required)
    share = matched / F.lit(float(len(required)))
    rows = items.select(F.col(answer).alias("answer"), matched.alias("matched"), (share * F.coalesce(confidence, F.lit(0.5))).alias("match_confidence"), share.alias("__share")).where(F.col("__share") > least)
    return rows.orderBy(F.desc("match_confidence"), "answer").limit(top).select("answer", "matched", F.round("match_confidence", 6).alias("match_confidence"))


def missing_fields(required: list[str]) -> Column:
    """The names of the required columns that are null in a row."""
    return F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())


def incomplete_answer(items: DataFrame, keys: list[str], answer: str, required: list[str], confidence: str, tie: str, least: float = 0.3) -> DataFrame:
    """(keys, answer, confidence, complete): the best answer of each key from items that may lack required fields.

    A complete item counts with its confidence (0.5 if unknown), before all others; an incomplete one with its coverage
    times its confidence times 0.8, if it covers more than `least`; without any of these it is `Unknown` with 0.1.
    """
    share = (F.lit(len(required)) - F.size(missing_fields(required))) / F.lit(float(len(required)))
    sure = F.coalesce(F.col(confidence), F.lit(0.5))
    score = F.when(share == 1, sure).when(share > least, share * sure * 0.8)
    rank = F.struct((share == 1).alias("whole"), F.coalesce(F.round(score, 9), F.lit(-1.0)).alias("v"), (-F.col(tie)).alias("t"))
    best = items.groupBy(*keys).agg(F.max_by(F.struct(F.col(answer).alias("a"), score.alias("s"), (share == 1).alias("w")), rank).alias("b"))
    return best.select(*keys, F.when(F.col("b.s").isNull(), "Unknown").otherwise(F.col("b.a")).alias("answer"), F.round(F.coalesce("b.s", F.lit(0.1)), 6).alias("confidence"), F.col("b.w").alias("complete"))
