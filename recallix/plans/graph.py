"""Graph queries over relationship_versions and graph_entities, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallix.operators import graph as G
from recallix.operators.history import is_deletion
from recallix.sources.tables import table


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """The current edges of relationship_versions: (rel_id, s, r, t, w, c, p, ts)."""
    columns = {"s": F.col("source_id"), "r": F.col("relation_type"), "t": F.col("target_id"), "w": F.coalesce("weight", F.lit(0.5)), "c": F.coalesce("confidence", F.lit(0.5)), "p": F.col("provenance"), "ts": F.col("timestamp")}
    log = table(spark, folder, "relationship_versions")
    return G.latest(log, "relationship_id", ["timestamp", "version", "id"], columns, is_deletion("change_type")).withColumnRenamed("relationship_id", "rel_id")


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set of searches: every entity whose id is divisible by 100."""
    return table(spark, folder, "graph_entities").where("id % 100 = 0").select(F.col("id").alias("seed"))


def kinds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_entities").select(F.col("id").alias("node"), F.lower("entity_type").alias("kind"))


EDGES = """e AS (
  SELECT relationship_id AS rel_id, source_id AS s, relation_type AS r, target_id AS t, coalesce(weight, 0.5) AS w, coalesce(confidence, 0.5) AS c, provenance AS p, timestamp AS ts
  FROM (SELECT *, row_number() OVER (PARTITION BY relationship_id ORDER BY timestamp DESC, version DESC, id DESC) AS n FROM relationship_versions WHERE relationship_id IS NOT NULL)
  WHERE n = 1 AND coalesce(lower(trim(change_type)) NOT IN ('delete', 'deleted', 'deletes', 'remove', 'removed', 'removes', 'removal'), true)
), seeds AS (SELECT id AS seed FROM graph_entities WHERE id % 100 = 0)"""

STEP = "1.0 / (0.6 * least(greatest(w, 0.1), 1.0) + 0.4 * least(greatest(c, 0.1), 1.0))"


def _walks(hops: int, where: str = "true") -> str:
    """SQL: simple paths of 1 to `hops` hops from the seeds."""
    parts = ["p0 AS (SELECT seed AS start, seed AS goal, [seed] AS path, CAST([] AS VARCHAR[]) AS relations, 0.0::DOUBLE AS cost FROM seeds)"]
    for h in range(1, hops + 1):
        parts.append(f"p{h} AS (SELECT p.start, e.t AS goal, list_append(p.path, e.t) AS path, list_append(p.relations, e.r) AS relations, p.cost + {STEP} AS cost FROM p{h - 1} p JOIN e ON e.s = p.goal WHERE e.s <> e.t AND NOT list_contains(p.path, e.t) AND {where})")
    return ", ".join(parts) + ", found AS (" + " UNION ALL ".join(f"SELECT *, {h} AS hops FROM p{h}" for h in range(1, hops + 1)) + ")"


def _shown(df: DataFrame) -> DataFrame:
    """Paths with their arrays as text and their cost rounded."""
    return df.select("start", "goal", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.array_join("relations", ">").alias("relations"), F.round("cost", 6).alias("cost"), "rank")


SHOWN = "start, goal, hops, array_to_string(path, '>') AS path, array_to_string(relations, '>') AS relations, round(cost, 6) AS cost, rank"
ALLOWED = ["works_at", "part_of", "located_in", "advises"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("graph_edges", f"WITH {EDGES} SELECT rel_id, s, r, t, w, c FROM e")
def graph_edges(spark, folder):
    return edges(spark, folder).select("rel_id", "s", "r", "t", "w", "c")


@query(
    "graph_neighbours",
    f"""WITH {EDGES}, b AS (
  SELECT seed, t AS node, r, 'outgoing' AS direction, w, c, rel_id FROM e JOIN seeds ON s = seed UNION ALL SELECT seed, s, r, 'incoming', w, c, rel_id FROM e JOIN seeds ON t = seed
), n AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY direction DESC, c DESC, w DESC, rel_id) AS rank FROM b)
SELECT seed, node, r, direction, w, c, rank FROM n WHERE rank <= 10""",
)
def graph_neighbours(spark, folder):
    return G.neighbours(edges(spark, folder), seeds(spark, folder))


@query("graph_paths", f"WITH {EDGES}, {_walks(3)}, n AS (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY hops, path, relations) AS rank FROM found) SELECT {SHOWN} FROM n WHERE rank <= 5")
def graph_paths(spark, folder):
    return _shown(G.simple_paths(edges(spark, folder), seeds(spark, folder)))


@query("graph_weighted_paths", f"WITH {EDGES}, {_walks(3)}, n AS (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY cost, hops, path, relations) AS rank FROM found) SELECT {SHOWN} FROM n WHERE rank <= 5")
def graph_weighted_paths(spark, folder):
    return _shown(G.simple_paths(edges(spark, folder), seeds(spark, folder), by="cost"))


@query("graph_constrained_paths", f"WITH {EDGES}, {_walks(4, 'e.r IN (' + ', '.join(repr(r) for r in ALLOWED) + ')')}, n AS (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY hops, path, relations) AS rank FROM found) SELECT {SHOWN} FROM n WHERE rank <= 5")
def graph_constrained_paths(spark, folder):
    return _shown(G.simple_paths(edges(spark, folder).where(F.col("r").isin(ALLOWED)), seeds(spark, folder), max_hops=4))


def _beam_sql(hops: int, beam: int) -> str:
    step = "1.0 / (0.5 * least(greatest(w, 0.1), 1.0) + 0.5 * least(greatest(c, 0.1), 1.0))"
    parts = ["p0 AS (SELECT seed AS start, seed AS goal, [seed] AS path, CAST([] AS VARCHAR[]) AS relations, 0.0::DOUBLE AS cost FROM seeds)"]
    for h in range(1, hops + 1):
        parts.append(f"x{h} AS (SELECT p.start, e.t AS goal, list_append(p.path, e.t) AS path, list_append(p.relations, e.r) AS relations, p.cost + {step} AS cost FROM p{h - 1} p JOIN e ON e.s = p.goal WHERE e.s <> e.t AND NOT list_contains(p.path, e.t))")
        parts.append(f"p{h} AS (SELECT start, goal, path, relations, cost FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY cost, path, relations) AS k FROM x{h}) WHERE k <= {beam})")
    found = " UNION ALL ".join(f"SELECT *, {h} AS hops FROM p{h}" for h in range(1, hops + 1))
    return f"WITH {EDGES}, {', '.join(parts)}, n AS (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY cost, hops, path, relations) AS rank FROM ({found})) SELECT {SHOWN} FROM n WHERE rank <= 5"


@query("graph_beam_paths", _beam_sql(4, 100))
def graph_beam_paths(spark, folder):
    return _shown(G.simple_paths(edges(spark, folder), seeds(spark, folder), max_hops=4, by="cost", importance=0.5, certainty=0.5, beam=100))


@query("graph_path_text", f"WITH {EDGES}, {_walks(2)} SELECT DISTINCT start, goal, CASE WHEN hops = 1 THEN path[1] || ' -' || relations[1] || '-> ' || path[2] ELSE path[1] || ' -' || relations[1] || '-> ' || path[2] || ' -' || relations[2] || '-> ' || path[3] END AS text FROM found")
def graph_path_text(spark, folder):
    return G.explain(G.simple_paths(edges(spark, folder), seeds(spark, folder), max_hops=2, per_pair=10**6)).select("start", "goal", "text").distinct()


@query("graph_meeting_paths", f"WITH {EDGES}, {_walks(4)} SELECT DISTINCT start, goal, hops, array_to_string(path, '>') AS path FROM found")
def graph_meeting_paths(spark, folder):
    s = seeds(spark, folder)
    near = G.hop_distances(edges(spark, folder), s, 4).where("hops > 0").select("start", F.col("node").alias("goal"))
    return G.meeting_paths(edges(spark, folder), near).select("start", "goal", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(
    "graph_distances",
    f"""WITH RECURSIVE {EDGES}, d AS (SELECT seed AS start, seed AS node, 0 AS hops FROM seeds UNION SELECT d.start, e.t, d.hops + 1 FROM d JOIN e ON e.s = d.node WHERE d.hops < 3)
SELECT start, node, min(hops) AS hops FROM d GROUP BY ALL""",
)
def graph_distances(spark, folder):
    return G.hop_distances(edges(spark, folder), seeds(spark, folder))


@query("graph_contraction", f"WITH {EDGES} SELECT s, t, round(avg(w), 6) AS w, round(avg(c), 6) AS c, string_agg(DISTINCT r, ' & ' ORDER BY r) AS relations, count(*) AS n FROM e WHERE w >= 0.2 AND c >= 0.3 GROUP BY s, t")
def graph_contraction(spark, folder):
    return G.contract(edges(spark, folder))


@query(
    "graph_closure",
    f"""WITH RECURSIVE {EDGES}, b AS (
  SELECT s, t, c, w FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY c DESC, w DESC) AS n FROM e WHERE r = 'part_of' AND s <> t) WHERE n = 1
), x AS (SELECT s, t, w, c, 1 AS hops FROM b UNION ALL SELECT x.s, b.t, least(x.w, b.w) * 0.8, least(x.c, b.c) * 0.9, x.hops + 1 FROM x JOIN b ON b.s = x.t WHERE x.hops < 4 AND x.s <> b.t)
SELECT s, t, round(w, 6) AS w, round(c, 6) AS c, hops FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY c DESC, w DESC, hops) AS n FROM x) WHERE n = 1""",
)
def graph_closure(spark, folder):
    return G.closure(edges(spark, folder), "part_of").select("s", "t", F.round("w", 6).alias("w"), F.round("c", 6).alias("c"), "hops")


COMPONENTS = f"""WITH RECURSIVE {EDGES}, u AS (SELECT s AS a, t AS b FROM e UNION SELECT t, s FROM e), reach AS (SELECT a AS node, a AS other FROM u UNION SELECT reach.node, u.b FROM reach JOIN u ON u.a = reach.other), l AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


@query("graph_components", f"{COMPONENTS} SELECT node, component FROM l")
def graph_components(spark, folder):
    return G.weak_components(edges(spark, folder))


PARTS = f"""{COMPONENTS}, n AS (SELECT component AS part, count(*) AS nodes FROM l GROUP BY ALL), m AS (
  SELECT a.component AS part, count(*) AS edges FROM (SELECT DISTINCT s, t FROM e WHERE s <> t) JOIN l a ON a.node = s JOIN l b ON b.node = t WHERE a.component = b.component GROUP BY ALL
), st AS (SELECT n.part, nodes, coalesce(edges, 0) AS edges, CASE WHEN nodes > 1 THEN round(coalesce(edges, 0)::DOUBLE / (nodes * (nodes - 1)), 6) ELSE 0.0 END AS density FROM n LEFT JOIN m USING (part))"""


@query("graph_partition_stats", f"{PARTS} SELECT part, nodes, edges, density FROM st")
def graph_partition_stats(spark, folder):
    e = edges(spark, folder)
    return G.partition_stats(e, G.weak_components(e))


@query("graph_pruned_partitions", f"{PARTS} SELECT part, nodes, edges, density FROM st WHERE nodes > 1 AND density >= 0.1")
def graph_pruned_partitions(spark, folder):
    return graph_partition_stats(spark, folder).where("nodes > 1 and density >= 0.1")


def _propagation(rounds: int) -> str:
    parts = ["u AS (SELECT s AS a, t AS b FROM e WHERE s <> t UNION SELECT t, s FROM e WHERE s <> t)", "l0 AS (SELECT DISTINCT a AS node, a AS community FROM u)"]
    for i in range(1, rounds + 1):
        parts.append(f"v{i} AS (SELECT a, community, count(*) AS k FROM u JOIN l{i - 1} l ON l.node = u.b GROUP BY ALL)")
        parts.append(f"l{i} AS (SELECT a AS node, community FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY k DESC, community) AS n FROM v{i}) WHERE n = 1)")
    return f"WITH {EDGES}, " + ", ".join(parts)


@query("graph_communities", f"{_propagation(4)} SELECT node, community FROM l4")
def graph_communities(spark, folder):
    return G.communities(edges(spark, folder))


@query(
    "graph_abstraction",
    f"""{_propagation(4)}, deg AS (SELECT node, count(*) AS d FROM (SELECT s AS node FROM e WHERE s <> t UNION ALL SELECT t FROM e WHERE s <> t) GROUP BY ALL
), x AS (SELECT l4.node, community, d, coalesce(lower(entity_type), 'unknown') AS kind FROM l4 JOIN deg USING (node) LEFT JOIN graph_entities g ON g.id = l4.node
), a AS (SELECT community, count(*) AS size FROM x GROUP BY ALL
), b AS (SELECT community, node AS representative FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY d DESC, node) AS n FROM x) WHERE n = 1
), c AS (SELECT community, kind FROM (SELECT community, kind, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, kind) AS n FROM x GROUP BY community, kind) WHERE n = 1)
SELECT community, size, representative, kind FROM a JOIN b USING (community) JOIN c USING (community) WHERE size >= 3""",
)
def graph_abstraction(spark, folder):
    e = edges(spark, folder)
    return G.abstraction(e, G.communities(e), kinds(spark, folder))


@query("graph_between_communities", f"{_propagation(4)} SELECT a.community AS cs, b.community AS ct, round(avg(w), 6) AS w, count(*) AS n FROM e JOIN l4 a ON a.node = s JOIN l4 b ON b.node = t WHERE a.community <> b.community GROUP BY ALL")
def graph_between_communities(spark, folder):
    e = edges(spark, folder)
    return G.between_communities(e, G.communities(e))


@query("graph_two_hop_patterns", f"WITH {EDGES} SELECT a.r AS r1, b.r AS r2, count(*) AS n FROM e a JOIN e b ON a.t = b.s WHERE a.s <> b.t GROUP BY ALL HAVING count(*) >= 10")
def graph_two_hop_patterns(spark, folder):
    return G.two_hop_patterns(edges(spark, folder))


@query("graph_three_hop_patterns", f"WITH {EDGES} SELECT a.r || '|' || b.r || '|' || c.r AS pattern, count(*) AS n FROM e a JOIN e b ON a.t = b.s JOIN e c ON b.t = c.s GROUP BY ALL ORDER BY n DESC, pattern LIMIT 20")
def graph_three_hop_patterns(spark, folder):
    return G.three_hop_patterns(edges(spark, folder))


@query(
    "graph_subgraph",
    f"""WITH {EDGES}, b AS (
  SELECT seed, s, t, r, 'outgoing' AS direction, w, c, rel_id FROM e JOIN seeds ON s = seed UNION ALL SELECT seed, s, t, r, 'incoming', w, c, rel_id FROM e JOIN seeds ON t = seed
), n AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY direction DESC, c DESC, w DESC, rel_id) AS rank FROM b)
SELECT DISTINCT s, t, r FROM n WHERE rank <= 5""",
)
def graph_subgraph(spark, folder):
    return G.subgraph(edges(spark, folder), seeds(spark, folder))


@query(
    "graph_conflicts",
    f"""WITH {EDGES}, x AS (SELECT DISTINCT s, t, r FROM e WHERE r IN ('part_of', 'located_in'))
SELECT 'cycle' AS kind, a.s AS a, a.t AS b, a.r FROM x a JOIN x b ON a.s = b.t AND a.t = b.s AND a.r = b.r WHERE a.s < a.t
UNION ALL SELECT 'attribute', s, count(DISTINCT t), r FROM e WHERE regexp_matches(r, '^(located_in|works_at)$') GROUP BY s, r HAVING count(DISTINCT t) > 1""",
)
def graph_conflicts(spark, folder):
    return G.conflicts(edges(spark, folder), ["part_of", "located_in"], "^(located_in|works_at)$")


@query("graph_merged_relations", f"WITH {EDGES} SELECT s, r, t, max(w) AS w, max(c) AS c, coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS provenances, count(*) AS n FROM e GROUP BY s, r, t")
def graph_merged_relations(spark, folder):
    return G.merge_relations(edges(spark, folder))


@query(
    "graph_derived_edges",
    f"""WITH {EDGES}, x AS (SELECT s, r, t, 'stated' AS origin, 0 AS k FROM e UNION ALL SELECT t, r, s, 'symmetric', 2 FROM e WHERE r IN ('knows', 'competes_with')
  UNION ALL SELECT t, CASE r WHEN 'part_of' THEN 'has_part' ELSE 'supplied_by' END, s, 'inverse', 1 FROM e WHERE r IN ('part_of', 'supplies'))
SELECT s, r, t, arg_min(origin, k) AS origin FROM x GROUP BY s, r, t""",
)
def graph_derived_edges(spark, folder):
    return G.derived_edges(edges(spark, folder), ["knows", "competes_with"], {"part_of": "has_part", "supplies": "supplied_by"})


@query("graph_provenance_reliability", "SELECT provenance AS source, count(*) AS n, round(avg(confidence), 6) AS reliability FROM relationship_versions WHERE provenance IS NOT NULL GROUP BY ALL")
def graph_provenance_reliability(spark, folder):
    log = table(spark, folder, "relationship_versions").where("provenance is not null")
    return log.groupBy(F.col("provenance").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("reliability"))


@query(
    "graph_conflicts_resolved",
    f"""WITH {EDGES}, b AS (SELECT rel_id FROM (SELECT *, row_number() OVER (PARTITION BY s, r ORDER BY c DESC, w DESC, rel_id) AS n FROM e WHERE regexp_matches(r, '^(located_in|works_at)$')) WHERE n = 1)
SELECT rel_id, s, r, t FROM e WHERE NOT regexp_matches(r, '^(located_in|works_at)$') OR rel_id IN (SELECT rel_id FROM b)""",
)
def graph_conflicts_resolved(spark, folder):
    return G.resolve_conflicts(edges(spark, folder), "^(located_in|works_at)$").select("rel_id", "s", "r", "t")


@query("graph_conflicts_by_recency", f"WITH {EDGES}, b AS (SELECT rel_id FROM (SELECT *, row_number() OVER (PARTITION BY s, r ORDER BY ts DESC, rel_id) AS n FROM e WHERE r = 'knows') WHERE n = 1) SELECT rel_id, s, r, t FROM e WHERE r <> 'knows' OR rel_id IN (SELECT rel_id FROM b)")
def graph_conflicts_by_recency(spark, folder):
    return G.resolve_conflicts(edges(spark, folder), "^knows$", "recency").select("rel_id", "s", "r", "t")


@query(
    "graph_search",
    f"""WITH {EDGES}, g AS (SELECT id, entity FROM graph_entities WHERE entity IS NOT NULL), a AS (SELECT id AS qid, entity AS name FROM g WHERE id % 100 = 0), hit AS (SELECT qid, g.id AS seed, entity FROM a JOIN g ON lower(name) = lower(entity)),
b AS (SELECT seed, t AS node, r, 'outgoing' AS direction, w, c, rel_id FROM e JOIN (SELECT DISTINCT seed FROM hit) ON s = seed UNION ALL SELECT seed, s, r, 'incoming', w, c, rel_id FROM e JOIN (SELECT DISTINCT seed FROM hit) ON t = seed), nb AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY direction DESC, c DESC, w DESC, rel_id) AS k FROM b),
one AS (SELECT qid, CASE WHEN direction = 'outgoing' THEN concat_ws(' ', hit.entity, r, g.entity) ELSE concat_ws(' ', g.entity, r, hit.entity) END AS text, w AS score FROM hit JOIN nb USING (seed) JOIN g ON g.id = node WHERE k <= 10),
two AS (SELECT qid, g.entity AS text, 0.4 AS score FROM a JOIN g ON list_contains(regexp_split_to_array(lower(g.entity), '\\s+'), lower(name))), m AS (SELECT qid, text, max(score) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL)
SELECT qid, text, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, text) AS rank FROM m) WHERE rank <= 10""",
)
def graph_search(spark, folder):
    names = table(spark, folder, "graph_entities").where("entity is not null").select("id", "entity")
    asked = names.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("entity").alias("name"))
    return G.search(edges(spark, folder), names, asked)


@query("graph_multi_hop_answers", f"WITH {EDGES}, {_walks(3)}, n AS (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY hops, path, relations) AS k FROM found) SELECT 'What is the connection between ' || start || ' and ' || goal || '?' AS question, array_to_string(path, '>') AS path, 0.8::DOUBLE AS score FROM n WHERE k = 1")
def graph_multi_hop_answers(spark, folder):
    from recallix.functions.extraction import entity_pair

    best = G.simple_paths(edges(spark, folder), seeds(spark, folder), per_pair=1)
    asked = best.select(F.concat(F.lit("What is the connection between "), F.col("start").cast("string"), F.lit(" and "), F.col("goal").cast("string"), F.lit("?")).alias("question"))
    pairs = asked.select("question", entity_pair(F.col("question")).alias("p")).select("question", F.col("p.start").cast("bigint").alias("start"), F.col("p.goal").cast("bigint").alias("goal"))
    return pairs.join(best, ["start", "goal"]).select("question", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.lit(0.8).alias("score"))
