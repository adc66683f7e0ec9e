"""Records with several parts: n-ary relations, belief revisions, distributions, test cases, JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallix.operators.hot import running_totals, sequenced
from recallix.session import checkpoint


def nary(headers: DataFrame, participants: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    """Headers with `participants`, a map role -> names of the entities that take it, in order."""
    names = participants.join(entities.select(F.col("id").alias("entity_id"), "entity"), "entity_id").groupBy("relationship_id", "role").agg(F.array_sort(F.collect_set("entity")).alias("names"))
    roles = names.groupBy("relationship_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "names")))).alias("participants"))
    return headers.join(roles, headers[key] == roles["relationship_id"], "left").drop("relationship_id")


def nary_query(headers: DataFrame, participants: DataFrame, relation: str | None = None, entity: int | None = None, role: str | None = None, newest: str = "timestamp", limit: int = 100) -> DataFrame:
    """The newest `limit` headers with a relation, a participant and a role, each if given."""
    out = headers.where(F.col("relation_type") == relation) if relation is not None else headers
    if entity is not None or role is not None:
        hit = participants if entity is None else participants.where(F.col("entity_id") == entity)
        hit = hit if role is None else hit.where(F.col("role") == role)
        out = out.join(hit.select("relationship_id").distinct(), out["id"] == F.col("relationship_id"), "left_semi")
    return out.orderBy(F.desc(newest), "id").limit(limit)


def revise_beliefs(edges: DataFrame, revisions: DataFrame, key: str = "rel_id") -> tuple[DataFrame, DataFrame]:
    """(edges, log): edges retargeted by the last revision (key, value, certainty, at) of each, and what it changed."""
    last = revisions.groupBy(key).agg(F.max_by(F.struct("value", "certainty"), "at").alias("v"), F.max("at").alias("at"))
    joined = edges.join(last, key, "left")
    log = joined.where("v is not null").select(key, F.col("t").alias("before"), F.col("v.value").alias("after"), F.col("c").alias("confidence_before"), F.col("v.certainty").alias("confidence_after"), "at")
    new = joined.select(*[F.coalesce("v.value", "t").alias("t") if c == "t" else F.coalesce("v.certainty", "c").alias("c") if c == "c" else F.col(c) for c in edges.columns])
    return new, log


def latest_distribution(distributions: DataFrame) -> DataFrame:
    """The last distribution of each entity and relation, its JSON data as a map of values to probabilities."""
    last = distributions.groupBy("entity_id", "relation_id").agg(F.max_by(F.struct("distribution_type", "distribution_data"), "id").alias("d"))
    return last.select("entity_id", "relation_id", "d.distribution_type", F.from_json("d.distribution_data", "map<string,double>").alias("distribution"))


def revision_impact(snapshots: DataFrame, events: DataFrame, recovery: float = 0.95, base: int = 50_000, block: int = 1000) -> DataFrame:
    """(event, before, after, drop, recovered_at): the score of snapshots (at: bigint, score) around each event (event, at).

    before is the mean of the last three snapshots up to it, after the first one after it; recovered_at the time of
    the first later one with at least `recovery` of before. Snapshots are numbered in time shards; an event meets the
    four around it by number. The first recovered one is looked for in the event's block of `block` snapshots, then in the
    first later block whose greatest score is enough: nothing is gathered. Ties in time go by the score.
    """
    one = F.lit(0).alias("k")
    s = sequenced(snapshots.select(one, F.col("at").cast("bigint").alias("at"), "score"), ["k"], "at", "score", base).select("k", "at", "score", "place")
    asked = events.select(one, F.col("at").cast("bigint").alias("at"), F.col("event").cast("string").alias("event"))
    both = s.select("k", "at", F.lit(1).alias("is"), F.lit(None).cast("string").alias("event")).unionByName(asked.select("k", "at", F.lit(0).alias("is"), "event"))
    spots = checkpoint(running_totals(both, ["k"], "at", {"seen": "is"}, base).where("event is not null").select("event", F.col("seen").alias("spot")))
    around = spots.select("event", "spot", F.explode(F.array(*[F.col("spot") + i for i in (-2, -1, 0, 1)])).alias("place")).join(s, "place")
    means = around.groupBy("event", "spot").agg(F.avg(F.when(F.col("place") <= F.col("spot"), F.col("score"))).alias("before"), F.max(F.when(F.col("place") > F.col("spot"), F.col("score"))).alias("after"))
    goal = means.where("before is not null").select("event", "spot", (recovery * F.col("before")).alias("goal"), F.floor(F.col("spot") / block).alias("own"))
    blocks = s.withColumn("b", F.floor(F.col("place") / block))
    later = goal.join(blocks.groupBy("b").agg(F.max("score").alias("most")), (F.col("b") > F.col("own")) & (F.col("most") >= F.col("goal"))).groupBy("event").agg(F.min("b").alias("b"))
    tries = goal.select("event", "spot", "goal", F.col("own").alias("b")).unionByName(goal.join(later, "event").select("event", "spot", "goal", "b"))
    back = tries.join(blocks, "b").where("place > spot and score >= goal").groupBy("event").agg(F.min_by("at", "place").alias("recovered_at"))
    return spots.select("event").join(means, "event", "left").join(back, "event", "left").select("event", "before", "after", (F.col("before") - F.col("after")).alias("drop"), "recovered_at")


def path_tests(paths: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """`n` test cases (question, expected, path) from paths of two hops or more, drawn by a seeded hash."""
    shown = F.array_join(F.col("path").cast("array<string>"), ">")
    drawn = paths.where("hops >= 2").withColumn("shown", shown).orderBy(spread_key(seed, "start", "goal", "shown"), "start", "goal", "shown").limit(n)
    return drawn.select(F.concat(F.lit("How is "), F.col("start").cast("string"), F.lit(" related to "), F.col("goal").cast("string"), F.lit("?")).alias("question"), F.col("goal").alias("expected"), "path")


def spread_key(seed: int, *columns: str) -> Column:
    """A bigint that depends on the columns and the seed only: 60 bits of an md5."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def counterfactual_tests(edges: DataFrame, n: int, seed: int = 1, base: int = 50_000) -> DataFrame:
    """`n` triples (s, r, t) that don't hold: targets of a relation, moved on by one among its sources in a seeded order.

    Places are counted in shards (hot.sequenced) and met by a join, so a relation of any number of edges is no single task.
    """
    rows = edges.select("s", "r", "t").distinct().withColumn("h", spread_key(seed, "s", "t")).withColumn("tie", F.struct("s", "t"))
    placed = sequenced(rows, ["r"], "h", "tie", base).select("s", "r", "t", "place")
    next_ = placed.select("r", (F.col("place") - 1).alias("place"), F.col("t").alias("moved"))
    moved = placed.join(next_, ["r", "place"]).select("s", "r", F.col("moved").alias("t")).where("s <> t")
    return moved.join(edges.select("s", "r", "t"), ["s", "r", "t"], "left_anti").distinct().orderBy(spread_key(seed, "s", "r", "t"), "s", "r", "t").limit(n)


def reasoning_chain(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(chain, score): the mean Jaccard similarity of the steps (chain, pos, words) at equal places, times the share covered."""
    both = expected.join(actual.select("chain", "pos", F.col("words").alias("got")), ["chain", "pos"], "left")
    like = F.when(F.col("got").isNull(), 0.0).otherwise(F.size(F.array_intersect("words", "got")) / F.greatest(F.size(F.array_union("words", "got")), F.lit(1)))
    return both.groupBy("chain").agg((F.sum(like) / F.greatest(F.count("got"), F.lit(1)) * F.count("got") / F.count(F.lit(1))).alias("score"))


def write_json(rows: DataFrame, path: str) -> None:
    """Writes rows as JSON lines: test suites, reasoning sessions, profiles."""
    rows.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; the schema is given, so nothing is read twice."""
    return spark.read.schema(schema).json(path)
