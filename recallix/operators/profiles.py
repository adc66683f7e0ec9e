"""What is known of users and conversations: moods, relationships, sessions, summaries, snapshots.

Histories of a user are summed or ranked, never gathered: recurrences have closed forms, windows are bounded.
"""

from __future__ import annotations

import functools
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallix.operators.hot import running_totals, sequenced

#: Stages of a relationship with the interactions and the trust they take.
STAGES = [("deep", 100, 0.80), ("established", 40, 0.55), ("developing", 15, 0.30), ("acquaintance", 5, 0.15)]


def last_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The last n rows of each key; Spark limits each group before the shuffle. Adds `back`, 1 for the last."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("back") <= n)


def mood_trend(moods: DataFrame, key: str, order: list, n: int = 20) -> DataFrame:
    """(key, avg_valence, avg_arousal, dominant, direction, samples) over the last n moods of each key.

    Dominant is the commonest emotion, the one seen first on ties; the direction compares the halves (0.15 apart).
    """
    last = last_n(moods, [key], order, n)
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    rows = last.withColumn("size", size).withColumn("place", F.col("size") - F.col("back")).withColumn("late", F.col("place") >= F.floor(F.col("size") / 2))
    half = lambda late: F.avg(F.when(F.col("late") == late, F.col("valence")))
    base = rows.groupBy(key).agg(F.round(F.avg("valence"), 3).alias("avg_valence"), F.round(F.avg("arousal"), 3).alias("avg_arousal"), (half(True) - half(False)).alias("d"), F.count(F.lit(1)).alias("samples"))
    count = rows.groupBy(key, "primary").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    top = count.groupBy(key).agg(F.min_by("primary", F.struct((-F.col("n")).alias("n"), "first")).alias("dominant"))
    direction = F.when(F.col("samples") < 4, "stable").when(F.col("d") > 0.15, "rising").when(F.col("d") < -0.15, "falling").otherwise("stable")
    return base.join(top, key).select(key, "avg_valence", "avg_arousal", "dominant", direction.alias("direction"), "samples")


def mood_shifts(moods: DataFrame, key: str, order: list, n: int = 20, least: float = 0.3) -> DataFrame:
    """Moods that are far from the mean of those before them in a window of n (at least two before)."""
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(-(n - 1), -1)
    rows = moods.withColumns({"seen": F.count(F.lit(1)).over(before), "from_emotion": F.lag("primary").over(w), "valence_delta": F.col("valence") - F.avg("valence").over(before), "arousal_delta": F.col("arousal") - F.avg("arousal").over(before)})
    far = (F.abs("valence_delta") > least) | (F.abs("arousal_delta") > least)
    return rows.where((F.col("seen") >= 2) & far).withColumns({"valence_delta": F.round("valence_delta", 3), "arousal_delta": F.round("arousal_delta", 3)})


def relationships(messages: DataFrame, key: str) -> DataFrame:
    """(key, interactions, trust, comfort, rapport, stage) from messages with role, content and an emotion struct.

    Trust grows with each message by 0.005, by vulnerable (0.02) or warm (0.01) moods, long messages (0.005 or
    0.002) and questions (0.003) of the user, to 1 at most: all growth is positive, so it is a sum with a limit.
    Comfort follows min(1, n / 200) by a twentieth each time, which has a closed form. The stage is the highest
    whose numbers are met. So a history of any length is one aggregate.
    """
    words = F.size(F.split(F.trim(F.regexp_replace("content", r"\s+", " ")), " "))
    user = F.when((F.col("emotion.valence") < -0.3) & (F.col("emotion.intensity") > 0.5), 0.02).otherwise(0.0)
    user = user + F.when(F.col("emotion.primary").isin("trust", "joy"), 0.01).otherwise(0.0)
    user = user + F.when(words > 50, 0.005).when(words > 20, 0.002).otherwise(0.0) + F.when(F.col("content").contains("?"), 0.003).otherwise(0.0)
    growth = F.lit(0.005) + F.when(F.col("role") == "user", user).otherwise(0.0)
    n = F.col("interactions")
    early = lambda m: m / 200.0 - 0.095 + 0.095 * F.pow(F.lit(0.95), m)
    comfort = F.when(n <= 200, early(n)).otherwise(1 - (1 - early(F.lit(200))) * F.pow(F.lit(0.95), n - 200))
    out = messages.groupBy(key).agg(F.count(F.lit(1)).alias("interactions"), F.least(F.lit(1.0), F.round(F.sum(growth), 9)).alias("trust")).withColumn("comfort", comfort)
    stage = F.lit("introduction")
    for name, count, trust in reversed(STAGES):
        stage = F.when((n >= count) & (F.col("trust") >= trust), name).otherwise(stage)
    return out.withColumns({"rapport": 0.6 * F.col("trust") + 0.4 * F.col("comfort"), "stage": stage})


def active_sessions(rows: DataFrame, user: str, session: str, at: str, most: int) -> DataFrame:
    """(user, session, last_at): the newest `most` sessions of each user."""
    last = rows.groupBy(user, session).agg(F.max(at).alias("last_at"))
    return last_n(last, [user], [F.desc("last_at"), F.desc(session)], most).drop("back")


def expired(rows: DataFrame, session: str, at: str, now: float, ttl: float) -> DataFrame:
    """(session, last_at): sessions not touched for longer than ttl."""
    return rows.groupBy(session).agg(F.max(at).alias("last_at")).where(F.col("last_at") < now - ttl)


def sessionise(events: DataFrame, key: str, at: str, gap: int, tie: str = "event_id", base: int = 50_000) -> DataFrame:
    """Events with `session`, counted up for each key where more than `gap` passed since the one before.

    at is a bigint time. Keys with very many events are ranked and summed in shards.
    """
    rows = sequenced(events, [key], at, tie, base)
    cut = F.when(F.col("before").isNull() | (F.col(at) - F.col("before") > gap), 1).otherwise(0)
    return running_totals(rows.withColumn("__cut", cut), [key], "place", {"session": "__cut"}, base).drop("__cut", "place", "before", "after")


def snapshot_changes(log: DataFrame, key: str, bin_of, state: list[str]) -> DataFrame:
    """(bin, added, changed, kept): keys first seen, seen with another last state, or seen with the same as before.

    Each key counts in the bins in which it has rows, with the state of the last of them (columns order, then state).
    """
    rows = log.select(F.col(key).alias("k"), bin_of.alias("bin"), F.struct("order", F.xxhash64(F.to_json(F.struct(*state), {"ignoreNullFields": "false"})).alias("h")).alias("s"))
    last = rows.groupBy("k", "bin").agg(F.max_by("s.h", "s.order").alias("h"))
    w = Window.partitionBy("k").orderBy("bin")
    seen = last.withColumn("before", F.lag("h").over(w))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return seen.groupBy("bin").agg(n(F.col("before").isNull()).alias("added"), n(F.col("before") != F.col("h")).alias("changed"), n(F.col("before") == F.col("h")).alias("kept"))


#: Which facts overwrite a profile's value, and which are added to a list.
SINGLE, LISTED = ["name", "occupation", "location", "age", "relationship_status"], ["preference", "interest", "routine", "boundary", "possession"]


def profile_fold(facts: DataFrame, key: str) -> DataFrame:
    """One row a key from facts (key, at, type, value): the last value of single facts, the distinct ones of lists.

    List values stand in the order in which they first came, at most 50 of each.
    """
    last = [F.max_by("value", F.when(F.col("type") == t, F.col("at"))).alias(t) for t in SINGLE]
    first = facts.where(F.col("type").isin(LISTED)).groupBy(key, "type", F.lower("value").alias("low")).agg(F.min_by("value", "at").alias("value"), F.min("at").alias("at"))
    few = last_n(first, [key, "type"], ["at", "low"], 50)
    lists = few.groupBy(key).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("at", "low", "value")))), lambda x: x["value"]).alias(t) for t in LISTED])
    singles = facts.groupBy(key).agg(*last)
    empty = F.array().cast("array<string>")
    return singles.join(lists, key, "left").select(key, *SINGLE, *[F.coalesce(t, empty).alias(t) for t in LISTED])


def aggregate_runs(runs: DataFrame, kind: str, took: str) -> DataFrame:
    """(kind, n, total, mean, least, most): a profile of timed runs."""
    return runs.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(took).alias("total"), F.avg(took).alias("mean"), F.min(took).alias("least"), F.max(took).alias("most"))


def profiled(runs: list[tuple[str, float, float]], name: str | None = None):
    """A decorator that notes (name, seconds since 1970, seconds taken) of each call in `runs`; see aggregate_runs."""

    def wrap(f):
        @functools.wraps(f)
        def timed(*args, **kwargs):
            at, began = time.time(), time.perf_counter()
            try:
                return f(*args, **kwargs)
            finally:
                runs.append((name or f.__name__, at, time.perf_counter() - began))

        return timed

    return wrap
