"""Queries on facts: rules, validity, contradictions, look-ups, keyed state; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallix.operators import rules as R
from recallix.operators import store as S
from recallix.operators import temporal as T
from recallix.operators import uncertainty as U
from recallix.operators.intervals import micros_to_utc_text, utc_text_to_micros
from recallix.plans.graph import EDGES, edges
from recallix.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def triples(spark, folder) -> DataFrame:
    """The current edges as facts (s, r, o) of text."""
    return edges(spark, folder).select(F.col("s").cast("string").alias("s"), "r", F.col("t").cast("string").alias("o"))


FACTS = f"{EDGES}, f AS (SELECT DISTINCT CAST(s AS VARCHAR) AS s, r, CAST(t AS VARCHAR) AS o FROM e)"
RULES = [R.transitive("part_of"), R.inherited("located_in", "part_of")]


@query(
    "rules_forward_chain",
    f"""WITH RECURSIVE {FACTS}, p AS (SELECT s, o FROM f WHERE r = 'part_of' UNION SELECT p.s, f.o FROM p JOIN f ON p.o = f.s AND f.r = 'part_of'),
  q AS (SELECT s, 'part_of' AS r, o FROM p UNION SELECT p.s, 'located_in', f.o FROM p JOIN f ON p.o = f.s AND f.r = 'located_in')
SELECT s, r, o FROM q WHERE s <> o EXCEPT SELECT s, r, o FROM f""",
)
def rules_forward_chain(spark, folder):
    return R.forward_chain(triples(spark, folder), RULES, rounds=20).select("s", "r", "o")


def _rounds_sql(rounds: int) -> str:
    parts = ["k0 AS (SELECT s, r, o FROM f)"]
    for n in range(1, rounds + 1):
        k = f"k{n - 1}"
        parts.append(f"r{n} AS (SELECT DISTINCT a.s, b.r, b.o FROM {k} a JOIN {k} b ON a.o = b.s WHERE a.r = 'part_of' AND b.r IN ('part_of', 'located_in') AND a.s <> b.o EXCEPT SELECT s, r, o FROM {k})")
        parts.append(f"k{n} AS (SELECT * FROM {k} UNION ALL SELECT * FROM r{n})")
    found = " UNION ALL ".join(f"SELECT r, {n} AS round FROM r{n}" for n in range(1, rounds + 1))
    return f"WITH {FACTS}, {', '.join(parts)}, x AS ({found}) SELECT CASE r WHEN 'part_of' THEN 'part_of_transitivity' ELSE 'located_in_inheritance' END AS rule, round, count(*) AS n, CASE r WHEN 'part_of' THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence FROM x GROUP BY ALL"


@query("rules_forward_report", _rounds_sql(8))
def rules_forward_report(spark, folder):
    return R.forward_chain(triples(spark, folder), RULES, rounds=20).groupBy("rule", "round").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(
    "rules_backward_chain",
    f"""WITH RECURSIVE {FACTS}, g AS (SELECT DISTINCT CAST(source_id AS VARCHAR) AS s, CAST(target_id AS VARCHAR) AS o FROM relationship_versions WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
  w AS (SELECT s, s AS spot, 0 AS steps FROM (SELECT DISTINCT s FROM g) UNION SELECT w.s, f.o, w.steps + 1 FROM w JOIN f ON f.s = w.spot AND f.r = 'part_of' AND f.s <> f.o WHERE w.steps < 3),
  m AS (SELECT s, spot AS o, min(steps) AS steps FROM w WHERE steps > 0 GROUP BY ALL)
SELECT g.s, 'part_of' AS r, g.o, steps IS NOT NULL AS proved, steps FROM g LEFT JOIN m USING (s, o)""",
)
def rules_backward_chain(spark, folder):
    goals = table(spark, folder, "relationship_versions").where("source_id is not null and target_id is not null").select(F.col("source_id").cast("string").alias("s"), F.col("target_id").cast("string").alias("o"))
    return R.backward_chain(triples(spark, folder), goals, "part_of")


@query(
    "rules_abduction",
    f"""WITH {FACTS}, ob AS (SELECT * FROM f WHERE r = 'located_in'), h AS (
  SELECT ob.s, ob.r, ob.o, ob.s || ' part_of ' || coalesce(k.o, '?') AS hypothesis, 'located_in_inheritance' AS rule, k.s IS NOT NULL AS known FROM ob LEFT JOIN f k ON k.s = ob.s AND k.r = 'part_of'
  UNION SELECT ob.s, ob.r, ob.o, coalesce(k.s, '?') || ' located_in ' || ob.o, 'located_in_inheritance', k.s IS NOT NULL FROM ob LEFT JOIN f k ON k.o = ob.o AND k.r = 'located_in'
), n AS (SELECT *, CAST(round(CASE WHEN known THEN 0.9 ELSE 0.5 END * 0.8, 6) AS DOUBLE) AS confidence FROM h)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, r, o ORDER BY confidence DESC, hypothesis, rule) AS rank FROM n) WHERE rank <= 3""",
)
def rules_abduction(spark, folder):
    facts = triples(spark, folder).distinct()
    return R.abduce(facts, facts.where("r = 'located_in'"), [R.inherited("located_in", "part_of")])


@query("rules_pattern_query", f"WITH {FACTS} SELECT DISTINCT a.s AS person, a.o AS firm, b.o AS place FROM f a JOIN f b ON a.o = b.s WHERE a.r = 'works_at' AND b.r = 'located_in'")
def rules_pattern_query(spark, folder):
    return R.match_all(triples(spark, folder), [("?person", "works_at", "?firm"), ("?firm", "located_in", "?place")]).select("person", "firm", "place")


@query(
    "ontology_descendants",
    f"""WITH RECURSIVE {EDGES}, h AS (SELECT DISTINCT s AS child, t AS parent FROM e WHERE r = 'part_of' AND s <> t),
  d AS (SELECT parent AS ancestor, child AS node, 1 AS steps FROM h UNION SELECT d.ancestor, h.child, d.steps + 1 FROM d JOIN h ON h.parent = d.node WHERE d.steps < 60 AND h.child <> d.ancestor)
SELECT ancestor, node, min(steps) AS steps FROM d WHERE ancestor <> node GROUP BY ALL""",
)
def ontology_descendants(spark, folder):
    return R.descendants(edges(spark, folder).where("r = 'part_of'").select(F.col("s").alias("child"), F.col("t").alias("parent")))


# --- validity ----------------------------------------------------------------------------------------------

BOUNDS = """b AS (SELECT *, try_cast(valid_from AS TIMESTAMP) AS f, try_cast(valid_until AS TIMESTAMP) AS u FROM temporal_facts)"""


def facts(spark, folder) -> DataFrame:
    return table(spark, folder, "temporal_facts").withColumns({"from_us": utc_text_to_micros(F.col("valid_from")), "until_us": utc_text_to_micros(F.col("valid_until"))})


AT = "2020-06-01T00:00:00"


@query("temporal_as_of", f"WITH {BOUNDS} SELECT id, subject, predicate, object FROM b WHERE (f IS NULL OR f <= TIMESTAMP '2020-06-01') AND (u IS NULL OR u > TIMESTAMP '2020-06-01')")
def temporal_as_of(spark, folder):
    return T.as_of(facts(spark, folder), utc_text_to_micros(F.lit(AT))).select("id", "subject", "predicate", "object")


@query("temporal_current_as_of", f"WITH {BOUNDS} SELECT id, subject, predicate, object FROM b WHERE (f IS NULL OR f <= TIMESTAMP '2020-06-01') AND (u IS NULL OR u > TIMESTAMP '2020-06-01') AND superseded_by IS NULL")
def temporal_current_as_of(spark, folder):
    return T.as_of(facts(spark, folder), utc_text_to_micros(F.lit(AT)), superseded="superseded_by").select("id", "subject", "predicate", "object")


@query("temporal_timeline", f"WITH {BOUNDS}, t AS (SELECT *, row_number() OVER w AS place, lead(f) OVER w AS nf FROM b WINDOW w AS (PARTITION BY subject, predicate ORDER BY f NULLS FIRST, id)) SELECT id, subject, predicate, place, strftime(nf, '%Y-%m-%dT%H:%M:%S') AS next_start FROM t")
def temporal_timeline(spark, folder):
    return T.timeline(facts(spark, folder), ["subject", "predicate"], "from_us", "id").select("id", "subject", "predicate", "place", micros_to_utc_text(F.col("next_start")).alias("next_start"))


@query(
    "temporal_conflicts",
    f"""WITH {BOUNDS}, r AS (SELECT id, subject, predicate, coalesce(f, TIMESTAMP '0001-01-01') AS s, coalesce(u, TIMESTAMP '9999-12-31') AS e FROM b WHERE superseded_by IS NULL AND (f IS NULL OR u IS NULL OR u > f))
SELECT a.subject, a.predicate, a.id, count(*) - 1 AS overlaps FROM r a JOIN r b ON a.subject = b.subject AND a.predicate = b.predicate AND a.s < b.e AND b.s < a.e GROUP BY ALL""",
)
def temporal_conflicts(spark, folder):
    return T.overlap_counts(facts(spark, folder).where("superseded_by is null"), ["subject", "predicate"], "id", "from_us", "until_us")


@query("temporal_superseded_closed", f"WITH {BOUNDS} SELECT a.id, strftime(coalesce(a.u, n.f), '%Y-%m-%dT%H:%M:%S') AS until FROM b a LEFT JOIN b n ON a.superseded_by = n.id")
def temporal_superseded_closed(spark, folder):
    return T.close_superseded(facts(spark, folder), "id", "superseded_by", "from_us", "until_us").select("id", micros_to_utc_text(F.col("until_us")).alias("until"))


# --- contradictions ----------------------------------------------------------------------------------------

RIVALS = f"""{EDGES}, o AS (SELECT *, row_number() OVER (PARTITION BY s, r, t ORDER BY c DESC, rel_id) AS n FROM e), v AS (SELECT *, row_number() OVER (PARTITION BY s, r ORDER BY c DESC, rel_id) AS k FROM o WHERE n = 1),
x AS (SELECT e.s, e.r, e.rel_id, e.t, e.c, e.ts, e.p, b.rel_id AS rival_rel_id, b.t AS rival_t, b.c AS rival_c, b.ts AS rival_ts, b.p AS rival_p
  FROM e JOIN v a ON a.s = e.s AND a.r = e.r AND a.k = 1 JOIN v z ON z.s = e.s AND z.r = e.r AND z.k = 2 JOIN v b ON b.s = e.s AND b.r = e.r AND b.k = CASE WHEN a.t = e.t THEN 2 ELSE 1 END),
rel AS (SELECT provenance AS source, round(avg(confidence), 6) AS reliability FROM relationship_versions WHERE provenance IS NOT NULL GROUP BY ALL)"""


def _rivals(spark, folder):
    return U.rivals(edges(spark, folder), ["s", "r"], "t", "rel_id", "c")


def _reliability(spark, folder):
    return table(spark, folder, "relationship_versions").where("provenance is not null").groupBy(F.col("provenance").alias("source")).agg(F.round(F.avg("confidence"), 6).alias("reliability"))


@query("uncertainty_contradictions", f"WITH {RIVALS} SELECT s, r, rel_id, t, rival_rel_id, rival_t FROM x")
def uncertainty_contradictions(spark, folder):
    return _rivals(spark, folder).select("s", "r", "rel_id", "t", "rival_rel_id", "rival_t")


CHOSEN = f"""{RIVALS}, y AS (SELECT x.*, coalesce(a.reliability, 0.5) AS r1, coalesce(b.reliability, 0.5) AS r2 FROM x LEFT JOIN rel a ON a.source = x.p LEFT JOIN rel b ON b.source = x.rival_p)"""


def _resolved_sql(strategy: str, first: str) -> str:
    return f"WITH {CHOSEN}, z AS (SELECT *, {strategy} AS strategy FROM y), q AS (SELECT *, CASE WHEN strategy = 'keep_both' THEN 0 WHEN {first} THEN 1 ELSE 2 END AS winner FROM z) SELECT rel_id, strategy, winner, CASE winner WHEN 0 THEN t || ' OR ' || rival_t WHEN 1 THEN CAST(t AS VARCHAR) ELSE CAST(rival_t AS VARCHAR) END AS resolved, round(CASE winner WHEN 0 THEN (c + rival_c) / 2 * 0.9 WHEN 1 THEN c ELSE rival_c END, 6) AS certainty FROM q"


def _resolved(spark, folder, strategy):
    out = U.resolve(_rivals(spark, folder), strategy, "t", "c", "ts", "p", _reliability(spark, folder))
    return out.select("rel_id", "strategy", "winner", "resolved", F.round("certainty", 6).alias("certainty"))


_FIRST = {"recency": "ts > rival_ts", "confidence": "c > rival_c", "reliability": "r1 > r2", "weighted": "CASE WHEN ts >= rival_ts THEN 0.6 ELSE 0.0 END + r1 * 0.4 > CASE WHEN rival_ts >= ts THEN 0.6 ELSE 0.0 END + r2 * 0.4", "keep_both": "false"}
for _name, _first in _FIRST.items():
    query(f"uncertainty_resolve_{_name}", _resolved_sql(f"'{_name}'", _first))(lambda spark, folder, _s=_name: _resolved(spark, folder, _s))


@query("uncertainty_resolve_auto", _resolved_sql("CASE WHEN p IS NOT NULL AND rival_p IS NOT NULL THEN 'reliability' ELSE 'recency' END", "CASE WHEN strategy = 'reliability' THEN r1 > r2 ELSE ts > rival_ts END"))
def uncertainty_resolve_auto(spark, folder):
    return _resolved(spark, folder, "auto")


@query("uncertainty_applied", f"WITH {CHOSEN} SELECT rel_id, s, r, t FROM e WHERE rel_id NOT IN (SELECT rel_id FROM y WHERE NOT c > rival_c)")
def uncertainty_applied(spark, folder):
    lost = U.resolve(_rivals(spark, folder), "confidence", "t", "c", "ts", "p")
    return U.apply_resolution(edges(spark, folder), lost, "rel_id").select("rel_id", "s", "r", "t")


@query("uncertainty_partial_matches", "SELECT CAST(id AS VARCHAR) AS answer, m AS matched, round(m / 3.0 * coalesce(confidence, 0.5), 6) AS match_confidence FROM (SELECT *, (source IS NOT NULL)::INT + (timestamp IS NOT NULL)::INT + (embedding IS NOT NULL)::INT AS m FROM fact_triples) WHERE m / 3.0 > 0.3 ORDER BY m / 3.0 * coalesce(confidence, 0.5) DESC, answer LIMIT 3")
def uncertainty_partial_matches(spark, folder):
    items = table(spark, folder, "fact_triples").withColumn("answer", F.col("id").cast("string"))
    return U.coverage(items, ["source", "timestamp", "embedding"], "answer", "confidence")


# --- look-ups and keyed state ------------------------------------------------------------------------------


@query("facts_about", "SELECT subject, id, predicate, object, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC NULLS LAST, id) AS place FROM fact_triples WHERE subject IS NOT NULL QUALIFY place <= 3")
def facts_about(spark, folder):
    return S.top_by(table(spark, folder, "fact_triples").where("subject is not null"), ["subject"], F.col("confidence").desc_nulls_last(), "id", 3).select("subject", "id", "predicate", "object", "place")


@query("facts_by_predicate", "SELECT predicate, id, subject, object, row_number() OVER (PARTITION BY predicate ORDER BY confidence DESC NULLS LAST, id) AS place FROM fact_triples WHERE predicate IS NOT NULL QUALIFY place <= 5")
def facts_by_predicate(spark, folder):
    return S.top_by(table(spark, folder, "fact_triples").where("predicate is not null"), ["predicate"], F.col("confidence").desc_nulls_last(), "id", 5).select("predicate", "id", "subject", "object", "place")


@query("facts_forgotten", "SELECT id FROM knowledge_items WHERE NOT coalesce(timestamp < 1735689600 AND confidence < 0.7, false)")
def facts_forgotten(spark, folder):
    return S.forget(table(spark, folder, "knowledge_items"), "timestamp", "confidence", 1735689600 + 30 * 86400, 30, 0.7).select("id")


@query("facts_confidence_update", "SELECT id, CASE WHEN source = 'manual_entry' THEN 0.99 ELSE confidence END AS confidence FROM fact_triples")
def facts_confidence_update(spark, folder):
    return S.update_where(table(spark, folder, "fact_triples"), F.col("source") == "manual_entry", {"confidence": F.lit(0.99)}).select("id", "confidence")


@query(
    "entity_resolve",
    """WITH q AS (SELECT id AS qid, lower(entity) AS name FROM graph_entities WHERE id % 100 = 0), m AS (
  SELECT qid, id, CASE WHEN entity = name THEN 0 ELSE 1 END AS tier FROM q JOIN graph_entities ON lower(entity) = name)
SELECT qid, id, tier FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, id) AS n FROM m) WHERE n = 1""",
)
def entity_resolve(spark, folder):
    e = table(spark, folder, "graph_entities")
    return S.resolve_names(e, "id", "entity", e.where("id % 100 = 0").select(F.col("id").alias("qid"), F.lower("entity").alias("name")))


@query(
    "taxonomy_discovery",
    """WITH w AS (SELECT id, entity, unnest(list_distinct(regexp_split_to_array(lower(trim(entity)), '\\s+'))) AS token FROM graph_entities WHERE trim(entity) LIKE '% %'), o AS (SELECT id AS parent, lower(trim(entity)) AS token FROM graph_entities WHERE trim(entity) NOT LIKE '% %')
SELECT id AS child, parent, 0.7 AS confidence FROM w JOIN o USING (token)""",
)
def taxonomy_discovery(spark, folder):
    return S.token_containment(table(spark, folder, "graph_entities"), "id", "entity")


@query("versions_latest_by_provenance", "SELECT relationship_id, version, id FROM (SELECT *, row_number() OVER (PARTITION BY relationship_id ORDER BY version DESC, id DESC) AS n FROM relationship_versions) WHERE n = 1")
def versions_latest(spark, folder):
    return S.last_wins(table(spark, folder, "relationship_versions"), ["relationship_id"], ["version", "id"], []).select("relationship_id", "version", "id")


@query("users_upserted", "SELECT user_id, count(*) AS episodes, max(id) AS last_id, arg_max(title, id) FILTER (title IS NOT NULL AND title <> '') AS last_title FROM episodes WHERE user_id IS NOT NULL GROUP BY ALL")
def users_upserted(spark, folder):
    e = table(spark, folder, "episodes").where("user_id is not null")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("episodes"), F.max("id").alias("last_id"), F.max_by("title", F.when(F.col("title") != "", F.col("id"))).alias("last_title"))


@query("vectors_upserted", "SELECT count(*) AS n, count(DISTINCT id) AS ids, sum(CASE WHEN len(embedding) = 64 THEN 1 ELSE 0 END)::BIGINT AS sound FROM vector_embeddings")
def vectors_upserted(spark, folder):
    v = table(spark, folder, "vector_embeddings")
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.sum(F.when(F.size("embedding") == 64, 1).otherwise(0)).alias("sound"))


@query("vectors_deleted", "SELECT id FROM vector_embeddings WHERE id NOT IN (SELECT id FROM vector_embeddings WHERE type IS NULL)")
def vectors_deleted(spark, folder):
    v = table(spark, folder, "vector_embeddings")
    return S.delete_keys(v, v.where("type is null"), "id").select("id")


@query("columns_migrated", "SELECT id, 1 AS version, 'unknown' AS extraction_method FROM knowledge_items")
def columns_migrated(spark, folder):
    return S.with_missing_columns(table(spark, folder, "knowledge_items"), {"version": F.lit(1), "extraction_method": F.lit("unknown")}).select("id", "version", "extraction_method")


@query(
    "snapshot_document",
    f"""WITH {EDGES} SELECT g.id, count(e.rel_id) AS out_degree FROM graph_entities g LEFT JOIN e ON e.s = g.id GROUP BY g.id""",
)
def snapshot_document(spark, folder):
    return S.snapshot(table(spark, folder, "graph_entities"), edges(spark, folder)).select("id", F.size("relations").cast("long").alias("out_degree"))


@query("aliases", "SELECT id, lower(entity) AS alias FROM graph_entities WHERE entity IS NOT NULL UNION SELECT id, regexp_replace(lower(entity), '[^a-z0-9]+', ' ', 'g') FROM graph_entities WHERE entity IS NOT NULL")
def aliases(spark, folder):
    return S.aliases(table(spark, folder, "graph_entities"), "id", "entity")


@query("entities_fuzzy_merged")
def entities_fuzzy_merged(spark, folder):
    return S.fuzzy_merge(table(spark, folder, "graph_entities"), "id", "entity").select("id", "canonical", "score")


@query("source_reliability", "SELECT source, round(least(1.0, greatest(0.0, arg_max(confidence, id))), 6) AS reliability FROM fact_triples WHERE source IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL")
def source_reliability(spark, folder):
    rows = table(spark, folder, "fact_triples").where("source is not null and confidence is not null").select("source", "id", "confidence")
    last = S.last_wins(rows, ["source"], ["id"], [])
    return last.select("source", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")), 6).alias("reliability"))


@query("entities_linked", """WITH q AS (SELECT id AS qid, upper(entity) AS name FROM graph_entities WHERE id % 100 = 0), a AS (SELECT id, lower(entity) AS alias FROM graph_entities), m AS (
  SELECT qid, id, 0 AS tier FROM q JOIN graph_entities ON entity = name UNION ALL SELECT qid, id, 1 FROM q JOIN a ON lower(name) = alias) SELECT qid, id, tier FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, id) AS n FROM m) WHERE n = 1""")
def entities_linked(spark, folder):
    e = table(spark, folder, "graph_entities")
    alias = e.select("id", F.lower("entity").alias("alias"))
    return S.link_names(e, "id", "entity", alias, e.where("id % 100 = 0").select(F.col("id").alias("qid"), F.upper("entity").alias("name")))


@query(
    "rules_why_answers",
    f"""WITH {FACTS}, ob AS (SELECT * FROM f WHERE r = 'located_in'), h AS (
  SELECT ob.s, ob.r, ob.o, ob.s || ' part_of ' || coalesce(k.o, '?') AS hypothesis, k.s IS NOT NULL AS known FROM ob LEFT JOIN f k ON k.s = ob.s AND k.r = 'part_of'
  UNION SELECT ob.s, ob.r, ob.o, coalesce(k.s, '?') || ' located_in ' || ob.o, k.s IS NOT NULL FROM ob LEFT JOIN f k ON k.o = ob.o AND k.r = 'located_in'
), n AS (SELECT *, CAST(round(CASE WHEN known THEN 0.9 ELSE 0.5 END * 0.8, 6) AS DOUBLE) AS confidence FROM h), g AS (SELECT *, row_number() OVER (PARTITION BY s, r, o ORDER BY confidence DESC, hypothesis) AS k FROM n)
SELECT concat_ws(' ', s, r, o) AS qid, s, r, o, 'proved' AS how, '1 steps' AS support FROM f WHERE r = 'part_of' AND s <> o UNION ALL SELECT concat_ws(' ', s, r, o), s, r, o, 'hypothesis', hypothesis || ' (' || confidence || ')' FROM g WHERE k <= 3""",
)
def rules_why_answers(spark, folder):
    facts_ = triples(spark, folder).distinct()
    asked = facts_.where("r in ('part_of', 'located_in')").withColumn("qid", F.concat_ws(" ", "s", "r", "o"))
    return R.answer_why(facts_, asked, [R.inherited("located_in", "part_of")], "part_of")
