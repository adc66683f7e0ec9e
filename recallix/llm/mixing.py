"""A mix of sources that meets target shares by tokens, with a limit on repetition."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallix.session import checkpoint


def temperature_shares(tokens: dict[str, float], tau: float) -> dict[str, float]:
    """Shares proportional to tokens ** tau; sources without tokens get none. 1 is natural, 0 is even."""
    powered = {s: t**tau if t > 0 else 0.0 for s, t in tokens.items()}
    total = sum(powered.values())
    return {s: p / total if total else 0.0 for s, p in powered.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def _bisect(good, low: float, high: float, rounds: int = 60) -> float:
    """The least value of [low, high] that is good, if all beyond it are."""
    if good(low):
        return low
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def tau_for_entropy(tokens: dict[str, float], target: float) -> float:
    """The exponent in 0..1 at which the shares have the target entropy (the nearest that can be reached)."""
    return _bisect(lambda tau: entropy(temperature_shares(tokens, tau)) <= target, 0.0, 1.0)


def exponent_for(natural: float, share: float) -> float:
    """The least exponent tau at which natural ** tau is no more than share; inf where none is."""
    if natural <= 0 or share >= 1:
        return 0.0
    if share <= 0 or natural >= 1:
        return math.inf
    high = 1.0
    while natural**high > share:
        high *= 2
    return _bisect(lambda tau: natural**tau <= share, 0.0, high, 200)


def plan_shares(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, dict]:
    """For each source of targets (share, repetitions): tokens to take, whether its share is out of reach, and why.

    The mix is as large as all tokens of its sources. Each source has an exponent tau: its natural share (of the tokens)
    to the power of tau is its weight. tau is bisected to meet the target share, but goes no lower than the repetition
    limit allows (the exponent at which the weight is max_repeats times the natural share): a source whose limit stops
    it before its target is out of reach. What such sources leave open goes to the others by one more exponent, the
    same for all: in proportion to tokens ** tau, tau the least (most even) in 0..1 that breaks no repetition limit;
    where none does, the limits hold and the mix gets smaller.
    """
    have = {s: int(tokens.get(s, 0)) for s in targets}
    total = sum(have.values())
    most = {s: have[s] * max(0, r) for s, (_, r) in targets.items()}
    take, own, short = {}, {}, set()
    for s, (q, r) in targets.items():
        natural = have[s] / total if total else 0.0
        wanted, limit = exponent_for(natural, q), exponent_for(natural, max(0, r) * natural)
        own[s] = max(wanted, limit)
        # Bisection ends within rounding; equal exponents are equal shares.
        if wanted < limit - 1e-12 * max(1.0, abs(wanted)) or (natural == 0 and q > 0 and total > 0):
            short.add(s)
        take[s] = 0.0 if natural == 0 or math.isinf(own[s]) else total * natural ** own[s]
        take[s] = min(take[s], float(most[s]))
    tau = 1.0
    left = total * sum(q for q, _ in targets.values()) - sum(take.values())
    open_ = {s: float(have[s]) for s in targets if take[s] < most[s] - 1e-6 and s not in short}
    if left > 1e-6 and open_:
        fits = lambda t: all(take[s] + left * p <= most[s] + 1e-6 for s, p in temperature_shares(open_, t).items())
        tau = _bisect(fits, 0.0, 1.0)
        while left > 1e-6 and open_:  # beyond all limits: fill up, source by source
            shares = temperature_shares(open_, tau)
            given = {s: min(left * p, most[s] - take[s]) for s, p in shares.items()}
            for s, g in given.items():
                take[s] += g
            left -= sum(given.values())
            open_ = {s: t for s, t in open_.items() if most[s] - take[s] > 1e-6}
            if sum(given.values()) < 1e-6:
                break
    return {s: {"tokens": have[s], "target_share": float(targets[s][0]), "max_repeats": int(targets[s][1]), "planned": int(take[s] + 1e-6), "out_of_reach": s in short, "tau": own[s], "tau_rest": tau} for s in targets}


def read_targets(targets: DataFrame, most: int = 10_000) -> dict[str, tuple[float, int]]:
    """source -> (share, repetitions) of a table of targets, which must have at most `most` sources."""
    rows = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("q"), F.max("max_repeats").alias("r")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources in the targets")
    return {r.source: (r.q or 0.0, r.r or 0) for r in rows}


def mix(docs: DataFrame, plan: dict[str, dict], key: str, source: str, tokens: str, blocks: int = 1024, seed: int = 17) -> DataFrame:
    """(key, source, tokens, repeats): how often each record is used, so that each source gets its planned tokens.

    A source is used as a whole as often as its plan allows; the rest is a prefix of a random permutation. The
    permutation is one of blocks (by a seeded hash of the key): whole blocks in order while they fit the budget,
    then, in the first block that doesn't, records in order of their hash while they fit. So a block is the most
    that one task sorts, and no record is used more than max_repeats times.

    Defined cases: records with a null source, without tokens, or of a source without a plan aren't used; repeated
    rows are records of their own only if their keys differ; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = [(s, max(0, p["planned"] // p["tokens"]), p["planned"] % p["tokens"]) for s, p in plan.items() if p["tokens"] > 0]
    wanted = spark.createDataFrame(rows or [("", 0, 0)], "source string, whole int, budget bigint").where("source <> ''")
    used = docs.where(f"{tokens} > 0").groupBy(F.col(key).alias("__key"), F.col(source).alias("__source")).agg(F.max(tokens).alias("__tokens"))
    used = used.select("__key", "__source", "__tokens", F.xxhash64(F.col("__key").cast("string"), F.lit(seed)).alias("__h"))
    used = used.join(F.broadcast(wanted), used["__source"] == wanted["source"]).drop("source").withColumn("__block", F.pmod("__h", F.lit(blocks)))
    sums = used.groupBy("__source", "__block").agg(F.sum("__tokens").alias("n"))  # at most `blocks` rows a source
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy(F.xxhash64("__block", F.lit(seed)), "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = used.join(F.broadcast(sums.withColumn("__before", before)), ["__source", "__block"])
    within = F.col("__before") + F.sum("__tokens").over(Window.partitionBy("__source", "__block").orderBy("__h", "__key").rowsBetween(Window.unboundedPreceding, 0))
    split = placed.where("__before < budget and __before + n > budget").withColumn("__extra", F.when(within <= F.col("budget"), 1).otherwise(0))
    plain = placed.where("not (__before < budget and __before + n > budget)").withColumn("__extra", F.when(F.col("__before") + F.col("n") <= F.col("budget"), 1).otherwise(0))
    columns = [F.col("__key").alias(key), F.col("__source").alias("source"), F.col("__tokens").alias("tokens"), (F.col("whole") + F.col("__extra")).cast("int").alias("repeats")]
    return plain.unionByName(split).select(*columns).where("repeats > 0")


def report(mixed: DataFrame, plan: dict[str, dict]) -> DataFrame:
    """One row for each source of the plan: what it has, its target, and the share it reached."""
    spark = mixed.sparkSession
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.count(F.lit(1)).alias("records"), F.max("repeats").alias("most_used"))
    rows = [(s, p["tokens"], p["target_share"], p["max_repeats"], p["out_of_reach"]) for s, p in plan.items()]
    planned = spark.createDataFrame(rows, "source string, tokens bigint, target_share double, max_repeats int, out_of_reach boolean")
    out = planned.join(F.broadcast(checkpoint(reached)), "source", "left").fillna(0, ["used", "records", "most_used"])  # a row for each source
    total = F.greatest(F.sum("used").over(Window.partitionBy(F.lit(0))), F.lit(1))
    return out.withColumn("reached_share", F.col("used") / total)
