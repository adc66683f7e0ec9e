"""Queries of extraction and records, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallix.functions import extraction as E
from recallix.functions import text as X
from recallix.operators import records as D
from recallix.plans.graph import EDGES, _walks, edges, seeds
from recallix.plans.text import ITEMS, MESSAGES, WRITTEN, items, q, said, written
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


def _entities_sql() -> str:
    rest, parts = "text", []
    for kind, p in E.ENTITY_PATTERNS:
        parts.append(f"SELECT id, '{kind}' AS type, unnest(regexp_extract_all({rest}, {q(p)})) AS value FROM k")
        rest = f"regexp_replace({rest}, {q(p)}, ' ', 'g')"
    return f"WITH {ITEMS}, x AS ({' UNION ALL '.join(parts)}) SELECT id, type, value, count(*) AS n FROM x GROUP BY ALL"


@query("extract_entities", _entities_sql())
def extract_entities(spark, folder):
    return items(spark, folder).select("id", F.explode(E.entities(F.col("text"))).alias("x")).groupBy("id", "x.type", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query("extract_domain_terms")
def extract_domain_terms(spark, folder):
    return items(spark, folder).select("id", F.explode(E.domain_terms(F.col("text"))).alias("x")).select("id", "x.type", "x.value")


_PAIRS = [q(E.PAIR), q(E.PAIR_AGAIN)]


@query("extract_entity_pairs", f"WITH {WRITTEN}, p AS (SELECT *, CASE WHEN regexp_matches(text, {_PAIRS[0]}) THEN regexp_extract(text, {_PAIRS[0]}, ['a', 'b']) WHEN regexp_matches(text, {_PAIRS[1]}) THEN regexp_extract(text, {_PAIRS[1]}, ['a', 'b']) END AS p FROM wr) SELECT src, row_id, pos, trim(p.a) AS start, trim(p.b) AS goal FROM p WHERE p IS NOT NULL")
def extract_entity_pairs(spark, folder):
    return written(spark, folder).select("src", "row_id", "pos", E.entity_pair(F.col("text")).alias("p")).where("p is not null").select("src", "row_id", "pos", "p.start", "p.goal")


@query("extract_question_facts", rf"WITH {MESSAGES}, t AS (SELECT episode, pos, trim(replace(replace(lower(content), 'why ', ''), '?', '')) AS t FROM msg WHERE content LIKE 'Why %'), w AS (SELECT *, regexp_split_to_array(t, '\s+') AS w FROM t) SELECT episode, pos, CASE WHEN regexp_matches(t, '^\w+\s+is\s+\w+') THEN regexp_extract(t, '^(\w+)\s+is\s+(\w+)', 1) WHEN regexp_matches(t, '^\w+\s+has\s+\w+') THEN regexp_extract(t, '^(\w+)\s+has\s+(\w+)', 1) ELSE w[1] END AS s FROM w WHERE len(w) >= 3")
def extract_question_facts(spark, folder):
    return said(spark, folder).where(F.col("content").startswith("Why ")).select("episode", F.col("pos").cast("long").alias("pos"), E.fact_of_question(F.col("content")).alias("f")).where("f is not null").select("episode", "pos", "f.s")


@query("extract_marked_facts", rf"WITH {WRITTEN}, l AS (SELECT src, row_id, pos, unnest(string_split(trim(text), chr(10))) AS line FROM wr), w AS (SELECT *, regexp_split_to_array(trim(substr(line, 2)), '\s+') AS w FROM l WHERE starts_with(line, '📚')) SELECT src, row_id, pos, w[1] AS s, w[2] AS r, w[3] AS o FROM w WHERE len(w) >= 3")
def extract_marked_facts(spark, folder):
    return written(spark, folder).select("src", "row_id", "pos", F.explode(E.marked_facts(F.col("text"), "📚")).alias("x")).select("src", "row_id", "pos", "x.s", "x.r", "x.o")


@query("text_to_graph", f"WITH {ITEMS}, x AS (" + " UNION ALL ".join(f"SELECT id, lower(unnest(regexp_extract_all(text, {q('(?i)' + p)}, {2 if turned else 1}))) AS s, '{n}' AS r, lower(unnest(regexp_extract_all(text, {q('(?i)' + p)}, {1 if turned else 2}))) AS t FROM k" for n, p, turned in X.RELATION_PATTERNS) + ") SELECT s, r, t, count(DISTINCT id) AS sources FROM x GROUP BY ALL")
def text_to_graph(spark, folder):
    found = items(spark, folder).select("id", F.explode(X.relations(F.col("text"))).alias("x"))
    return found.groupBy(F.lower("x.subject").alias("s"), F.col("x.relation").alias("r"), F.lower("x.object").alias("t")).agg(F.count_distinct("id").alias("sources"))




@query("nary_relations", f"WITH {MESSAGES} SELECT episode AS id, count(DISTINCT role) AS roles, string_agg(DISTINCT role, ',' ORDER BY role) AS role_names, array_to_string(list_sort(list_distinct(list(role || '=' || 'message ' || pos))), '|') AS participants FROM msg WHERE role IS NOT NULL GROUP BY ALL")
def nary_relations(spark, folder):
    m = said(spark, folder).where("role is not null")
    heads = m.select(F.col("episode").alias("id")).distinct()
    parts = m.select(F.col("episode").alias("relationship_id"), "role", F.col("pos").cast("long").alias("entity_id")).distinct()
    names = m.select(F.col("pos").cast("long").alias("id")).distinct().withColumn("entity", F.concat(F.lit("message "), F.col("id").cast("string")))
    made = D.nary(heads, parts, names)
    return made.select("id", F.size("participants").cast("long").alias("roles"), F.array_join(F.array_sort(F.map_keys("participants")), ",").alias("role_names"), F.array_join(F.array_sort(F.flatten(F.transform(F.map_entries("participants"), lambda x: F.transform(x["value"], lambda n: F.concat(x["key"], F.lit("="), n))))), "|").alias("participants"))


@query("beliefs_revised", f"WITH {EDGES}, r AS (SELECT relationship_id AS rel_id, arg_max(target_id, id) AS v FROM relationship_versions WHERE changed_by IS NOT NULL GROUP BY ALL) SELECT e.rel_id, e.s, coalesce(r.v, e.t) AS t, CASE WHEN r.v IS NULL THEN e.c ELSE 0.9 END AS c FROM e LEFT JOIN r USING (rel_id)")
def beliefs_revised(spark, folder):
    r = table(spark, folder, "relationship_versions").where("changed_by is not null").select(F.col("relationship_id").alias("rel_id"), F.col("target_id").alias("value"), F.lit(0.9).alias("certainty"), F.col("id").alias("at"))
    return D.revise_beliefs(edges(spark, folder), r)[0].select("rel_id", "s", "t", "c")


def _spread_sql(*columns: str, seed: int = 1) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(columns)}, '{seed}')), 1, 15) AS BIGINT)"


@query(
    "counterfactual_tests",
    f"""WITH {EDGES}, d AS (SELECT DISTINCT s, r, t FROM e WHERE r IS NOT NULL), m AS (SELECT s, r, lead(t) OVER (PARTITION BY r ORDER BY {_spread_sql("s", "t")}, s, t) AS t FROM d), x AS (SELECT DISTINCT s, r, t FROM m WHERE t IS NOT NULL AND s <> t EXCEPT SELECT s, r, t FROM d)
SELECT s, r, t FROM x ORDER BY {_spread_sql("s", "r", "t")}, s, r, t LIMIT 50""",
)
def counterfactual_tests(spark, folder):
    return D.counterfactual_tests(edges(spark, folder).where("r is not null"), 50)


@query(
    "multi_hop_tests",
    f"""WITH {EDGES}, {_walks(3)}, n AS (SELECT *, array_to_string(path, '>') AS shown, row_number() OVER (PARTITION BY start, goal ORDER BY hops, path, relations) AS k FROM found)
SELECT 'How is ' || start || ' related to ' || goal || '?' AS question, goal AS expected FROM n WHERE k <= 5 AND hops >= 2 ORDER BY {_spread_sql("start", "goal", "shown")}, start, goal, shown LIMIT 10""",
)
def multi_hop_tests(spark, folder):
    from recallix.operators.graph import simple_paths

    return D.path_tests(simple_paths(edges(spark, folder), seeds(spark, folder)), 10).select("question", "expected")


@query("text_to_graph_entities", f"WITH {ITEMS}, x AS (" + " UNION ALL ".join(f"SELECT id, lower(unnest(regexp_extract_all(text, {q('(?i)' + p)}, {g}))) AS entity FROM k" for _, p, _ in X.RELATION_PATTERNS for g in (1, 2)) + ") SELECT entity, count(DISTINCT id) AS sources, min(id) AS first_id FROM x GROUP BY ALL")
def text_to_graph_entities(spark, folder):
    """The entities that relations in texts name, merged by their lower-cased form."""
    found = items(spark, folder).select("id", F.explode(X.relations(F.col("text"))).alias("x")).select("id", F.explode(F.array(F.lower("x.subject"), F.lower("x.object"))).alias("entity"))
    return found.groupBy("entity").agg(F.count_distinct("id").alias("sources"), F.min("id").alias("first_id"))
