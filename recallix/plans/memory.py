"""Queries of memory, profiles, sessions and snapshots, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallix.functions import text as X
from recallix.operators import memory as M
from recallix.operators import profiles as P
from recallix.plans.text import MESSAGE_MOODS, MESSAGES, said, words_sql
from recallix.sources.tables import table, utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


TOKENS = f"greatest(1, {words_sql('content')} * 13 // 10)"


@query("memory_context", f"WITH {MESSAGES}, s AS (SELECT episode, pos, sum({TOKENS}) OVER (PARTITION BY episode ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM msg) SELECT episode, pos, used FROM s WHERE used <= 60")
def memory_context(spark, folder):
    rows = said(spark, folder).withColumn("tokens", X.token_estimate(F.col("content")))
    return M.fill_context(rows.withColumn("pos", F.col("pos").cast("long")), ["episode"], "pos", "tokens", 60).select("episode", F.col("pos").cast("long").alias("pos"), "used")


@query("memory_by_role", f"WITH {MESSAGES} SELECT role, count(*) AS n, sum({TOKENS})::BIGINT AS tokens FROM msg GROUP BY ALL")
def memory_by_role(spark, folder):
    return said(spark, folder).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(X.token_estimate(F.col("content"))).alias("tokens"))


@query("memory_summaries", f"WITH {MESSAGES} SELECT episode, count(*) AS n, count(*) FILTER (role = 'user') AS by_user, arg_min(content, pos) AS first, arg_max(content, pos) AS last FROM msg GROUP BY ALL")
def memory_summaries(spark, folder):
    return said(spark, folder).groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("role") == "user", 1)).alias("by_user"), F.min_by("content", "pos").alias("first"), F.max_by("content", "pos").alias("last"))


@query("memory_tiers")
def memory_tiers(spark, folder):
    """Where each message ends up with small tiers (tokens 60, 80, 100)."""
    return M.tier_cascade(M.conversations(said(spark, folder)), (60, 80, 100)).select("episode", "pos", "tier", "tokens")


@query("memory_tier_stats")
def memory_tier_stats(spark, folder):
    return memory_tiers(spark, folder).groupBy("tier").agg(F.count(F.lit(1)).alias("segments"), F.sum("tokens").alias("tokens"))


@query("memory_progressive")
def memory_progressive(spark, folder):
    return M.progressive(M.conversations(said(spark, folder)), 60)


@query("memory_weights")
def memory_weights(spark, folder):
    asked = said(spark, folder).where("role = 'user'")
    return M.dynamic_weights(asked.select("episode", "pos", X.query_complexity(F.col("content")).alias("complexity"), X.document_type(F.col("content")).alias("kind")))


@query("session_close", f"WITH {MESSAGES}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY episode DESC, pos DESC) AS back FROM msg WHERE session_id IS NOT NULL) SELECT session_id, count(*) AS n, string_agg(left(content, 200), ' | ' ORDER BY back DESC) AS digest FROM b WHERE back <= 20 GROUP BY ALL")
def session_close(spark, folder):
    last = P.last_n(said(spark, folder).where("session_id is not null"), ["session_id"], [F.desc("episode"), F.desc("pos")], 20)
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("b"), F.substring("content", 1, 200).alias("c")))), lambda x: x["c"])
    return last.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, " | ").alias("digest"))


@query(
    "session_summary",
    """SELECT session_id, count(*) AS episodes, min(start_time) AS first_start, max(importance) AS importance, len(list_distinct(flatten(list(CASE WHEN json_valid(topics) THEN from_json(topics, '["VARCHAR"]') ELSE [] END))))::INT AS topics FROM episodes WHERE session_id IS NOT NULL GROUP BY ALL""",
)
def session_summary(spark, folder):
    topics = F.coalesce(F.from_json("topics", "array<string>"), F.array().cast("array<string>"))
    return table(spark, folder, "episodes").where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("episodes"), F.min("start_time").alias("first_start"), F.max("importance").alias("importance"), F.size(F.array_distinct(F.flatten(F.collect_list(topics)))).alias("topics"))


@query("sessions_capped", f"WITH {MESSAGES}, l AS (SELECT user_id, session_id, max(moment) AS last_at FROM msg WHERE user_id IS NOT NULL AND moment IS NOT NULL GROUP BY ALL) SELECT user_id, session_id, last_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, session_id DESC) AS n FROM l) WHERE n <= 3")
def sessions_capped(spark, folder):
    return P.active_sessions(said(spark, folder).where("user_id is not null and at is not null"), "user_id", "session_id", "at", 3)


@query("sessions_expired", f"WITH {MESSAGES} SELECT session_id, max(moment) AS last_at FROM msg WHERE moment IS NOT NULL GROUP BY ALL HAVING max(moment) < 1735689600.0 - 86400")
def sessions_expired(spark, folder):
    return P.expired(said(spark, folder).where("at is not null"), "session_id", "at", 1735689600.0, 86400)


@query("episodes_recent", "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS place FROM episodes WHERE user_id IS NOT NULL QUALIFY place <= 10")
def episodes_recent(spark, folder):
    return P.last_n(table(spark, folder, "episodes").where("user_id is not null"), ["user_id"], [F.desc("id")], 10).select("user_id", "id", F.col("back").alias("place"))


@query(
    "episodes_recalled",
    r"""WITH t AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), '[\p{L}\p{N}]+')) AS term FROM episodes), q AS (SELECT id AS qid, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS term FROM episodes WHERE id % 100 = 0),
h AS (SELECT qid, id, count(DISTINCT term) AS hits FROM (SELECT DISTINCT * FROM q) JOIN (SELECT DISTINCT * FROM t) USING (term) GROUP BY ALL) SELECT * FROM (SELECT qid, id, hits, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id) AS rank FROM h) WHERE rank <= 5""",
)
def episodes_recalled(spark, folder):
    from recallix.operators.retrieval import terms

    e = table(spark, folder, "episodes")
    t = e.select("id", F.explode(F.array_distinct(terms(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))))).alias("term"))
    q = e.where("id % 100 = 0").select(F.col("id").alias("qid"), F.explode(F.array_distinct(terms(F.col("title")))).alias("term"))
    hits = q.join(t, "term").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), "id"))).where("rank <= 5")


def _moods(spark, folder):
    rows = said(spark, folder).where("role = 'user' and user_id is not null")
    return X.with_emotion(rows, "content")


@query(
    "mood_trend",
    f"""WITH {MESSAGE_MOODS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY episode DESC, pos DESC) AS back FROM mood WHERE role = 'user' AND user_id IS NOT NULL QUALIFY back <= 20), r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS size FROM l), x AS (SELECT *, size - back AS place, size - back >= size // 2 AS late FROM r),
b AS (SELECT user_id, round(avg(valence), 3) AS avg_valence, round(avg(arousal), 3) AS avg_arousal, avg(valence) FILTER (late) - avg(valence) FILTER (NOT late) AS d, count(*) AS samples FROM x GROUP BY ALL), c AS (SELECT user_id, primary_emotion, count(*) AS n, min(place) AS first FROM x GROUP BY ALL), t AS (SELECT user_id, primary_emotion AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM c) WHERE k = 1)
SELECT user_id, avg_valence, avg_arousal, dominant, CASE WHEN samples < 4 THEN 'stable' WHEN d > 0.15 THEN 'rising' WHEN d < -0.15 THEN 'falling' ELSE 'stable' END AS direction, samples FROM b JOIN t USING (user_id)""",
)
def mood_trend(spark, folder):
    m = _moods(spark, folder).select("user_id", "episode", "pos", "emotion.*")
    return P.mood_trend(m, "user_id", [F.desc("episode"), F.desc("pos")])


@query(
    "mood_shifts",
    f"""WITH {MESSAGE_MOODS}, m AS (SELECT * FROM mood WHERE role = 'user' AND user_id IS NOT NULL), s AS (SELECT user_id, episode, pos, primary_emotion, count(*) OVER b AS seen, lag(primary_emotion) OVER (PARTITION BY user_id ORDER BY episode, pos) AS from_emotion, valence - avg(valence) OVER b AS dv, arousal - avg(arousal) OVER b AS da FROM m WINDOW b AS (PARTITION BY user_id ORDER BY episode, pos ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))
SELECT user_id, episode, pos, from_emotion, primary_emotion AS to_emotion, round(dv, 3) AS valence_delta, round(da, 3) AS arousal_delta FROM s WHERE seen >= 2 AND (abs(dv) > 0.3 OR abs(da) > 0.3)""",
)
def mood_shifts(spark, folder):
    m = _moods(spark, folder).select("user_id", "episode", "pos", "emotion.*")
    return P.mood_shifts(m, "user_id", ["episode", "pos"]).select("user_id", "episode", F.col("pos").cast("long").alias("pos"), "from_emotion", F.col("primary").alias("to_emotion"), "valence_delta", "arousal_delta")


EVENT_MOODS = "m AS (SELECT user_id, event_id, value / 500.0 AS valence, -value / 500.0 AS arousal, event_type AS primary_ FROM events)"


@query(
    "event_trend",
    f"""WITH {EVENT_MOODS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM m QUALIFY back <= 20), r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS size FROM l), x AS (SELECT *, size - back AS place, size - back >= size // 2 AS late FROM r),
b AS (SELECT user_id, avg(valence) FILTER (late) - avg(valence) FILTER (NOT late) AS d, count(*) AS samples FROM x GROUP BY ALL), c AS (SELECT user_id, primary_, count(*) AS n, min(place) AS first FROM x GROUP BY ALL), t AS (SELECT user_id, primary_ AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM c) WHERE k = 1)
SELECT user_id, dominant, CASE WHEN samples < 4 THEN 'stable' WHEN d > 0.15 THEN 'rising' WHEN d < -0.15 THEN 'falling' ELSE 'stable' END AS direction, samples FROM b JOIN t USING (user_id)""",
)
def event_trend(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", (F.col("value") / 500).alias("valence"), (-F.col("value") / 500).alias("arousal"), F.col("event_type").alias("primary"))
    return P.mood_trend(e, "user_id", [F.desc("event_id")]).select("user_id", "dominant", "direction", "samples")


@query(
    "event_shifts",
    f"""WITH {EVENT_MOODS}, s AS (SELECT user_id, event_id, count(*) OVER b AS seen, valence - avg(valence) OVER b AS d FROM m WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)) SELECT user_id, count(*) AS shifts FROM s WHERE seen >= 2 AND abs(d) > 0.3 GROUP BY ALL""",
)
def event_shifts(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", (F.col("value") / 500).alias("valence"), (-F.col("value") / 500).alias("arousal"), F.col("event_type").alias("primary"))
    return P.mood_shifts(e, "user_id", ["event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("shifts"))


STATES = f"""{MESSAGE_MOODS}, g AS (SELECT user_id, 0.005 + CASE WHEN role = 'user' THEN CASE WHEN valence < -0.3 AND intensity > 0.5 THEN 0.02 ELSE 0.0 END + CASE WHEN primary_emotion IN ('trust', 'joy') THEN 0.01 ELSE 0.0 END + CASE WHEN w > 50 THEN 0.005 WHEN w > 20 THEN 0.002 ELSE 0.0 END + CASE WHEN contains(content, '?') THEN 0.003 ELSE 0.0 END ELSE 0.0 END AS d
  FROM (SELECT *, len(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ')) AS w FROM mood WHERE user_id IS NOT NULL)), s1 AS (SELECT user_id, count(*) AS interactions, least(1.0, round(sum(d), 9))::DOUBLE AS trust FROM g GROUP BY ALL),
s2 AS (SELECT *, CASE WHEN interactions <= 200 THEN interactions / 200.0 - 0.095 + 0.095 * pow(0.95, interactions) ELSE 1 - (1 - (1 - 0.095 + 0.095 * pow(0.95, 200))) * pow(0.95, interactions - 200) END AS comfort FROM s1),
states AS (SELECT user_id, interactions, trust, comfort, 0.6 * trust + 0.4 * comfort AS rapport, CASE WHEN interactions >= 100 AND trust >= 0.8 THEN 'deep' WHEN interactions >= 40 AND trust >= 0.55 THEN 'established' WHEN interactions >= 15 AND trust >= 0.3 THEN 'developing' WHEN interactions >= 5 AND trust >= 0.15 THEN 'acquaintance' ELSE 'introduction' END AS stage FROM s2)"""


@query("relationship_states", f"WITH {STATES} SELECT user_id, interactions, round(trust, 6) AS trust, round(comfort, 6) AS comfort, round(rapport, 6) AS rapport, stage FROM states")
def relationship_states(spark, folder):
    m = X.with_emotion(said(spark, folder).where("user_id is not null"), "content")
    return P.relationships(m, "user_id").select("user_id", "interactions", F.round("trust", 6).alias("trust"), F.round("comfort", 6).alias("comfort"), F.round("rapport", 6).alias("rapport"), "stage")


SESSIONS = "x AS (SELECT *, floor(epoch(ts)) AS z, lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS zb FROM events), sx AS (SELECT *, sum(CASE WHEN zb IS NULL OR z - zb > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY z, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM x)"


def _sessions(spark, folder):
    e = table(spark, folder, "events").withColumn("at", F.unix_timestamp(utc(F.col("ts"))))
    return P.sessionise(e, "user_id", "at", 1800)


@query("reasoning_sessions", f"WITH {SESSIONS} SELECT user_id, session, count(*) AS steps, count(DISTINCT event_type) AS kinds, round(max(value), 6) AS most, round(min(value), 6) AS least FROM sx GROUP BY ALL")
def reasoning_sessions(spark, folder):
    return _sessions(spark, folder).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("steps"), F.count_distinct("event_type").alias("kinds"), F.round(F.max("value"), 6).alias("most"), F.round(F.min("value"), 6).alias("least"))


@query("reasoning_analysis", f"WITH {SESSIONS}, n AS (SELECT user_id, session, count(*) AS steps FROM sx GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(steps) AS longest, round(avg(steps), 6) AS mean_steps FROM n GROUP BY ALL")
def reasoning_analysis(spark, folder):
    n = _sessions(spark, folder).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("steps"))
    return n.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("steps").alias("longest"), F.round(F.avg("steps"), 6).alias("mean_steps"))


@query(
    "snapshot_changes",
    """WITH r AS (SELECT relationship_id AS k, floor(timestamp / 31557600)::BIGINT AS bin, timestamp, id, row(relation_type, weight, confidence, provenance) AS s FROM relationship_versions), l AS (SELECT k, bin, s FROM (SELECT *, row_number() OVER (PARTITION BY k, bin ORDER BY timestamp DESC, id DESC) AS n FROM r) WHERE n = 1), b AS (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY bin) AS before, row_number() OVER (PARTITION BY k ORDER BY bin) AS n FROM l)
SELECT bin, sum((n = 1)::INT)::BIGINT AS added, sum((n > 1 AND s IS DISTINCT FROM before)::INT)::BIGINT AS changed, sum((n > 1 AND s IS NOT DISTINCT FROM before)::INT)::BIGINT AS kept FROM b GROUP BY ALL""",
)
def snapshot_changes(spark, folder):
    log = table(spark, folder, "relationship_versions").withColumn("order", F.struct("timestamp", "id"))
    return P.snapshot_changes(log, "relationship_id", F.floor(F.col("timestamp") / 31557600), ["relation_type", "weight", "confidence", "provenance"])


@query(
    "growth_bins",
    """WITH r AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM knowledge_items), b AS (SELECT least(9, floor((timestamp - lo) / (hi - lo) * 10))::INT AS bin, count(*) AS n FROM knowledge_items, r WHERE timestamp IS NOT NULL GROUP BY ALL)
SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS total FROM b""",
)
def growth_bins(spark, folder):
    k = table(spark, folder, "knowledge_items").where("timestamp is not null")
    low, high = k.agg(F.min("timestamp"), F.max("timestamp")).first()
    span = max((high or 0) - (low or 0), 1e-9)
    bins = k.groupBy(F.least(F.lit(9), F.floor((F.col("timestamp") - F.lit(low)) / F.lit(span) * 10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bin")))  # ten rows


def _planner_sql() -> str:
    from recallix.plans.graph import _propagation

    return f"""{_propagation(4)}, ix AS (SELECT DISTINCT r1 AS r FROM (SELECT a.r AS r1, b.r AS r2 FROM e a JOIN e b ON a.t = b.s WHERE a.s <> b.t GROUP BY ALL HAVING count(*) >= 10))
SELECT e.r, CASE WHEN a.community = b.community THEN 0.3 WHEN ix.r IS NOT NULL THEN 0.5 ELSE 0.7 END::DOUBLE AS cost, count(*) AS n FROM e JOIN l4 a ON a.node = s JOIN l4 b ON b.node = t LEFT JOIN ix ON ix.r = e.r GROUP BY ALL"""


@query("planner_costs", _planner_sql())
def planner_costs(spark, folder):
    """Costs of looking up each current edge: 0.3 within a component, 0.7 across, 0.5 where its hop pattern is indexed."""
    from recallix.operators import graph as G
    from recallix.plans.graph import edges

    e = edges(spark, folder)
    labels = G.communities(e)
    a, b = labels.select(F.col("node").alias("s"), F.col("community").alias("cs")), labels.select(F.col("node").alias("t"), F.col("community").alias("ct"))
    indexed = G.two_hop_patterns(e).select(F.col("r1").alias("r")).distinct().withColumn("indexed", F.lit(True))
    cost = F.when(F.col("cs") == F.col("ct"), 0.3).when(F.col("indexed"), 0.5).otherwise(0.7)
    return e.join(a, "s").join(b, "t").join(indexed, "r", "left").groupBy("r", cost.alias("cost")).agg(F.count(F.lit(1)).alias("n"))
