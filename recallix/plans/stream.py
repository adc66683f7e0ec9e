"""Streaming queries, run over what is there, and their SQL on the same input as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallix.functions import text as X
from recallix.plans.text import MESSAGES, any_sql, q, said, words_sql
from recallix.streaming import ingest as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def stream_windows(spark, folder):
    """Events of each type by hour; with complete output, so the last windows are there, too."""
    out = I.run_once(I.windowed_counts(I.read_stream(spark, folder, "events"), "ts", "event_type"), "complete")
    return out.select(F.unix_timestamp("starts").alias("starts"), "event_type", "n")


def stream_sessions(spark, folder):
    out = I.run_once(I.session_counts(I.read_stream(spark, folder, "events"), "user_id", "ts"), "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


def ingested(spark, folder):
    """What message ingest works out for each message, in batch."""
    done = I.ingest(said(spark, folder))
    return done.select("episode", F.col("pos").cast("long").alias("pos"), F.col("safety.level").alias("level"), "category.is_question", "tokens")


QUERIES |= {"stream_windows": stream_windows, "stream_sessions": stream_sessions, "messages_ingested": ingested}
SQL["stream_windows"] = "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS starts, event_type, count(*) AS n FROM events GROUP BY ALL"
SQL["stream_sessions"] = "WITH x AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) SELECT user_id, sum((b IS NULL OR ts - b >= INTERVAL 30 MINUTE)::INT)::BIGINT AS sessions, count(*) AS events FROM x GROUP BY ALL"


def _ingested_sql() -> str:
    fired = lambda level: " OR ".join(f"regexp_matches(content, {q(p)})" for _, p, of, _ in X.SAFETY_RULES if of == level)
    asks = f"length(content) >= 3 AND (ends_with(lower(trim(content)), '?') OR {any_sql('lower(trim(content))', X.CATEGORIES['question'][:-1])})"
    return f"WITH {MESSAGES} SELECT episode, pos, CASE WHEN {fired('blocked')} THEN 'blocked' WHEN {fired('warning')} THEN 'warning' ELSE 'safe' END AS level, {asks} AS is_question, greatest(1, {words_sql('content')} * 13 // 10)::INT AS tokens FROM msg"


SQL["messages_ingested"] = _ingested_sql()
