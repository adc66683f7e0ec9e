"""Queries of the general training-data operators (problems 1, 5 and 6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallix.operators.history import is_deletion, state_history
from recallix.operators.instants import estimate_zones, parse, to_instants
from recallix.operators.intervals import micros_to_utc_text, periods_and_gaps, utc_text_to_micros
from recallix.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str, base: int = 64) -> DataFrame:
    """Periods and gaps of each subject and predicate of temporal_facts.

    A bound that is text but no time makes its row no interval; a null bound is open.
    """
    facts = table(spark, folder, "temporal_facts").select("subject", "predicate", "valid_from", "valid_until", utc_text_to_micros(F.col("valid_from")).alias("from_us"), utc_text_to_micros(F.col("valid_until")).alias("until_us"))
    facts = facts.where("(valid_from is null or from_us is not null) and (valid_until is null or until_us is not null)")
    out = periods_and_gaps(facts.select("subject", "predicate", "from_us", "until_us"), ["subject", "predicate"], "from_us", "until_us", base)
    shown = lambda c: F.coalesce(micros_to_utc_text(F.col(c)), F.lit("-")).alias(c)
    return out.select("subject", "predicate", "kind", shown("starts"), shown("ends"))


def p1_small_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The same with keys of more than 8 starts cut into shards."""
    return p1_found(spark, folder, 8)


def p5_found(spark: SparkSession, folder: str, **sizes: int) -> DataFrame:
    """The history of each relationship of relationship_versions."""
    log = table(spark, folder, "relationship_versions")
    return state_history(log, "relationship_id", "timestamp", "version", "id", ["relation_type", "weight", "confidence", "provenance"], is_deletion("change_type"), **sizes)


def p5_small_words(spark: SparkSession, folder: str) -> DataFrame:
    """The same with bitmaps of words of 4 bits, chunks of 2 words and keys of more than 8 snapshots numbered in shards."""
    return p5_found(spark, folder, base=8, word=4, chunk=2)


def _times(spark: SparkSession, folder: str) -> DataFrame:
    rows = lambda name, text, source: table(spark, folder, name).select(F.lit(name).alias("src"), F.col("id").alias("row_id"), F.col(text).alias("text"), source.alias("source"))
    return (
        rows("graph_entities", "temporal_start", F.col("provenance"))
        .unionByName(rows("episodes", "start_time", F.get_json_object("metadata", "$.origin")))
        .unionByName(rows("fact_triples", "timestamp", F.col("source")))
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The UTC instant of each valid time of graph_entities, episodes and fact_triples; undeclared sources are UTC by statement."""
    out = to_instants(_times(spark, folder), "text", "source", "row_id", table(spark, folder, "source_profiles"), stream="src", guess_undeclared=False)
    return out.where("utc_us is not null").select("src", "row_id", "utc_us")


def p6_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: the zone its order of arrival speaks for, against the declared one."""
    profiles = table(spark, folder, "source_profiles")
    names = sorted(r[0] for r in profiles.select("zone_name").where("zone_name is not null").distinct().limit(1001).collect())
    if len(names) > 1000:
        raise ValueError("more than 1,000 zones")
    parsed = parse(_times(spark, folder).join(profiles.select("source", "date_order"), "source", "left"), "text", "date_order")
    best = estimate_zones(parsed, "source", "row_id", names, "src")
    declared = profiles.select(F.col("source").alias("declared_source"), F.col("zone_name").alias("declared"))
    return best.join(declared, F.col("source") == F.col("declared_source"), "left").select("source", "zone", "declared", "n", "violation_h", "margin_h")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_small_shards": p1_small_shards, "p5_found": p5_found, "p5_small_words": p5_small_words, "p6_found": p6_found, "p6_zones": p6_zones}

P1_SQL = """
WITH b AS (
  SELECT subject, predicate, valid_from, valid_until, 
    try_cast(CASE WHEN length(valid_from) = 16 THEN valid_from || ':00' ELSE valid_from END AS TIMESTAMP) AS f,
    try_cast(CASE WHEN length(valid_until) = 16 THEN valid_until || ':00' ELSE valid_until END AS TIMESTAMP) AS u
  FROM temporal_facts
), r AS (
  SELECT subject, predicate, coalesce(f, TIMESTAMP '0001-01-01') AS s, coalesce(u, TIMESTAMP '9999-12-31') AS e
  FROM b WHERE (valid_from IS NULL OR f IS NOT NULL) AND (valid_until IS NULL OR u IS NOT NULL) AND (f IS NULL OR u IS NULL OR u > f)
), m AS (
  SELECT *, max(e) OVER (PARTITION BY subject, predicate ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r
), n AS (
  SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY subject, predicate ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m
), q AS (
  SELECT subject, predicate, i, min(s) AS s, max(e) AS e FROM n GROUP BY ALL
), g AS (
  SELECT subject, predicate, lag(e) OVER (PARTITION BY subject, predicate ORDER BY s) AS s, s AS e FROM q
), x AS (
  SELECT subject, predicate, 'period' AS kind, s, e FROM q UNION ALL SELECT subject, predicate, 'gap', s, e FROM g WHERE s IS NOT NULL
)
SELECT subject, predicate, kind,
  CASE WHEN s = TIMESTAMP '0001-01-01' THEN '-' ELSE strftime(s, '%Y-%m-%dT%H:%M:%S') END AS starts,
  CASE WHEN e = TIMESTAMP '9999-12-31' THEN '-' ELSE strftime(e, '%Y-%m-%dT%H:%M:%S') END AS ends
FROM x
"""

P5_SQL = """
WITH d AS (
  SELECT * FROM relationship_versions WHERE relationship_id IS NOT NULL AND timestamp IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY relationship_id, timestamp ORDER BY coalesce(version, -1) DESC, id DESC) = 1
), s AS (
  SELECT relationship_id, version, timestamp, lower(trim(change_type)) IN ('delete', 'deleted', 'removed', 'remove') AS gone,
    row(relation_type, weight, confidence, provenance) AS state FROM d
), c AS (
  SELECT *, lag(state) OVER w AS before, lag(gone) OVER w AS gone_before FROM s WINDOW w AS (PARTITION BY relationship_id ORDER BY timestamp)
), k AS (
  SELECT *, sum(CASE WHEN gone IS NOT TRUE AND gone_before IS NOT DISTINCT FROM FALSE AND state IS NOT DISTINCT FROM before THEN 0 ELSE 1 END)
    OVER (PARTITION BY relationship_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS i FROM c
), g AS (
  SELECT relationship_id, i, bool_or(gone) AS gone, min(timestamp) AS t, arg_min(version, timestamp) AS version FROM k GROUP BY ALL
), n AS (
  SELECT *, lead(t) OVER (PARTITION BY relationship_id ORDER BY t) AS u FROM g
)
SELECT relationship_id, CAST(version AS BIGINT) AS version, CAST(round(t * 1000) AS BIGINT) AS valid_from_ms, CAST(coalesce(round(u * 1000), -1) AS BIGINT) AS valid_until_ms
FROM n WHERE gone IS NOT TRUE
"""

SQL: dict[str, str] = {"p1_found": P1_SQL, "p1_small_shards": P1_SQL, "p5_found": P5_SQL, "p5_small_words": P5_SQL}
