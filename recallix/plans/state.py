"""Queries of keyed state: users, personas, profiles, sessions, ontology, reasoning logs, caches, dumps; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallix.functions import extraction as E
from recallix.functions import metrics as Me
from recallix.functions import text as X
from recallix.operators import graph as G
from recallix.operators import memory as M
from recallix.operators import profiles as P
from recallix.operators import records as D
from recallix.operators import rules as R
from recallix.operators import state as St
from recallix.operators import store as S
from recallix.operators import uncertainty as U
from recallix.plans.graph import EDGES, _propagation, edges, kinds
from recallix.plans.memory import SESSIONS, STATES, TOKENS, _sessions, relationship_states
from recallix.plans.retrieval import ASKED, BM25, TOKENS as TERMS, asked
from recallix.plans.retrieval import retrieve_bm25, retrieve_hybrid, retrieve_keyword, retrieve_dense
from recallix.plans.retrieval import SQL as RETRIEVAL_SQL
from recallix.plans.text import MESSAGES, any_sql, q, said
from recallix.sources.schema import conform
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


# --- appends -----------------------------------------------------------------------------------------------


@query("facts_stored", "SELECT id, subject, predicate, object, confidence, source FROM fact_triples UNION ALL SELECT (SELECT max(id) FROM fact_triples) + row_number() OVER (ORDER BY id), subject, predicate, object, 1.0, source FROM temporal_facts")
def facts_stored(spark, folder):
    new = table(spark, folder, "temporal_facts").select(F.col("id").alias("seq"), "subject", "predicate", "object", "source")
    return St.append(table(spark, folder, "fact_triples"), new, "id", "seq", {"confidence": F.lit(1.0)}).select("id", "subject", "predicate", "object", "confidence", "source")


@query("items_stored", "SELECT id, text, confidence, source FROM knowledge_items UNION ALL SELECT (SELECT max(id) FROM knowledge_items) + row_number() OVER (ORDER BY id), summary, 0.9, user_id FROM episodes WHERE summary <> ''")
def items_stored(spark, folder):
    new = table(spark, folder, "episodes").where("summary <> ''").select(F.col("id").alias("seq"), F.col("summary").alias("text"), F.col("user_id").alias("source"))
    return St.append(table(spark, folder, "knowledge_items"), new, "id", "seq", {"confidence": F.lit(0.9)}).select("id", "text", "confidence", "source")


@query("temporal_facts_added", "SELECT id, subject, predicate, object, valid_from, source FROM temporal_facts UNION ALL SELECT (SELECT max(id) FROM temporal_facts) + row_number() OVER (ORDER BY id), subject, predicate, object, timestamp, source FROM fact_triples")
def temporal_facts_added(spark, folder):
    new = table(spark, folder, "fact_triples").select(F.col("id").alias("seq"), "subject", "predicate", "object", F.col("timestamp").alias("valid_from"), "source")
    return St.append(table(spark, folder, "temporal_facts"), new, "id", "seq").select("id", "subject", "predicate", "object", "valid_from", "source")


@query("episodes_saved", "SELECT id, session_id, summary FROM episodes UNION ALL SELECT (SELECT max(id) FROM episodes) + row_number() OVER (ORDER BY i), session_id, 'Session of ' || n || ' episodes' FROM (SELECT session_id, min(id) AS i, count(*) AS n FROM episodes WHERE session_id IS NOT NULL GROUP BY ALL)")
def episodes_saved(spark, folder):
    e = table(spark, folder, "episodes")
    new = e.where("session_id is not null").groupBy("session_id").agg(F.min("id").alias("seq"), F.concat(F.lit("Session of "), F.count(F.lit(1)).cast("string"), F.lit(" episodes")).alias("summary"))
    return St.append(e, new, "id", "seq").select("id", "session_id", "summary")


@query("explicit_remembered", r"WITH k AS (SELECT id, unnest(string_split(trim(coalesce(text, '')), chr(10))) AS line FROM knowledge_items), w AS (SELECT id, line, regexp_split_to_array(trim(substr(line, 4)), '\s+') AS w FROM k WHERE starts_with(line, 'The')) SELECT id, w[1] AS s, w[2] AS r, w[3] AS o, NULL AS item FROM w WHERE len(w) >= 3 UNION ALL SELECT id, NULL, NULL, NULL, text FROM knowledge_items WHERE text <> '' AND id NOT IN (SELECT id FROM w WHERE len(w) >= 3)")
def explicit_remembered(spark, folder):
    """Lines that begin with a marker as triples of their first three words, other texts as items."""
    rows = table(spark, folder, "knowledge_items").select("id", "text", E.marked_facts(F.col("text"), "The").alias("f"))
    facts = rows.select("id", F.explode("f").alias("x")).select("id", "x.s", "x.r", "x.o", F.lit(None).cast("string").alias("item"))
    none = F.lit(None).cast("string")
    return facts.unionByName(rows.where("size(f) = 0 and text <> ''").select("id", none.alias("s"), none.alias("r"), none.alias("o"), F.col("text").alias("item")))


@query("items_cleared", "SELECT id, text FROM knowledge_items WHERE false")
def items_cleared(spark, folder):
    return table(spark, folder, "knowledge_items").where(F.lit(False)).select("id", "text")


@query("summaries_stored", "SELECT 'summary_' || session_id AS key, arg_max(summary, id) AS summary, arg_max(topics, id) AS keywords FROM episodes WHERE session_id IS NOT NULL AND summary <> '' AND topics IS NOT NULL GROUP BY ALL")
def summaries_stored(spark, folder):
    log = table(spark, folder, "episodes").where("session_id is not null and summary <> '' and topics is not null").select(F.concat(F.lit("summary_"), "session_id").alias("key"), "id", "summary", F.col("topics").alias("keywords"))
    return S.last_wins(log, ["key"], ["id"], []).select("key", "summary", "keywords")


@query("vectors_counted", "SELECT count(*) AS n FROM vector_embeddings")
def vectors_counted(spark, folder):
    return table(spark, folder, "vector_embeddings").agg(F.count(F.lit(1)).alias("n"))


@query("temporal_closed", "SELECT id, CASE WHEN source = 'metro_feed' AND valid_until IS NULL THEN '2024-01-01' ELSE valid_until END AS valid_until FROM temporal_facts")
def temporal_closed(spark, folder):
    return S.update_where(table(spark, folder, "temporal_facts"), (F.col("source") == "metro_feed") & F.col("valid_until").isNull(), {"valid_until": F.lit("2024-01-01")}).select("id", "valid_until")


@query("schema_conformed", "SELECT id, text AS entity, 'unknown' AS entity_type, confidence, timestamp, 1::INT AS version, NULL AS metadata FROM knowledge_items")
def schema_conformed(spark, folder):
    """Items as rows of the table of entities: its columns and types, defaults for what they lack."""
    rows = table(spark, folder, "knowledge_items").withColumn("entity", F.col("text")).withColumn("timestamp", F.col("timestamp").cast("string"))
    return conform(rows, "graph_entities", {"version": 1, "entity_type": "unknown"}).select("id", "entity", "entity_type", "confidence", "timestamp", "version", "metadata")


# --- users and personas ------------------------------------------------------------------------------------

USERS = "u AS (SELECT user_id, arg_max(title, id) FILTER (title <> '') AS display_name, max(id) AS at, min(id) AS created FROM episodes WHERE user_id IS NOT NULL GROUP BY ALL)"


def users(spark, folder) -> DataFrame:
    """The users of the episodes' log: the last name that isn't empty, when first and last seen."""
    log = table(spark, folder, "episodes").where("user_id is not null").select("user_id", "id", F.when(F.col("title") != "", F.col("title")).alias("display_name"), F.col("id").alias("at"))
    first = log.groupBy("user_id").agg(F.min("id").alias("created"))
    return S.last_wins(log, ["user_id"], ["id"], ["display_name"]).join(first, "user_id")


@query("users_created", f"WITH {USERS} SELECT * FROM u")
def users_created(spark, folder):
    return users(spark, folder).select("user_id", "display_name", "at", "created")


@query("users_got", f"WITH {USERS} SELECT user_id, display_name FROM u WHERE user_id IN (SELECT user_id FROM episodes WHERE id % 100 = 0)")
def users_got(spark, folder):
    wanted = table(spark, folder, "episodes").where("id % 100 = 0").select("user_id").distinct()
    return users(spark, folder).join(wanted, "user_id", "left_semi").select("user_id", "display_name")


@query("users_metadata", "SELECT user_id, k AS name, arg_max(v, id) AS value FROM (SELECT user_id, id, unnest(json_keys(metadata)) AS k, metadata FROM episodes WHERE json_valid(metadata)) AS x, LATERAL (SELECT json_extract_string(x.metadata, '$.' || x.k) AS v) WHERE user_id IS NOT NULL GROUP BY ALL")
def users_metadata(spark, folder):
    return St.merged_maps(table(spark, folder, "episodes").where("user_id is not null"), "user_id", "id", "metadata")


@query("users_deleted", f"WITH {USERS} SELECT user_id FROM u WHERE user_id NOT IN (SELECT user_id FROM episodes WHERE user_id IS NOT NULL AND importance > 0.9)")
def users_deleted(spark, folder):
    return S.delete_keys(users(spark, folder), table(spark, folder, "episodes").where("user_id is not null and importance > 0.9"), "user_id").select("user_id")


@query("users_listed", f"WITH {USERS} SELECT user_id, row_number() OVER (ORDER BY created) AS place FROM u")
def users_listed(spark, folder):
    return St.listed(users(spark, folder), "created", "user_id").select("user_id", "place")


PERSONAS = "p AS (SELECT provenance AS persona_id, arg_max(relation_type, id) AS style, min(id) AS created_at FROM relationship_versions WHERE provenance IS NOT NULL GROUP BY ALL)"


def personas(spark, folder) -> DataFrame:
    log = table(spark, folder, "relationship_versions").where("provenance is not null").select(F.col("provenance").alias("persona_id"), "id", F.to_json(F.struct(F.col("relation_type").alias("style"))).alias("definition"))
    first = log.groupBy("persona_id").agg(F.min("id").alias("created_at"))
    return S.last_wins(log, ["persona_id"], ["id"], []).join(first, "persona_id").select("persona_id", F.get_json_object("definition", "$.style").alias("style"), "created_at")


@query("personas_registered", f"WITH {PERSONAS} SELECT * FROM p")
def personas_registered(spark, folder):
    return personas(spark, folder)


@query("personas_got", f"WITH {PERSONAS} SELECT persona_id, style FROM p WHERE persona_id = 'metro_feed'")
def personas_got(spark, folder):
    return personas(spark, folder).where("persona_id = 'metro_feed'").select("persona_id", "style")


@query("personas_listed", f"WITH {PERSONAS} SELECT persona_id, row_number() OVER (ORDER BY created_at) AS place FROM p")
def personas_listed(spark, folder):
    return St.listed(personas(spark, folder), "created_at", "persona_id").select("persona_id", "place")


@query("personas_deleted", f"WITH {PERSONAS} SELECT persona_id FROM p WHERE persona_id NOT IN (SELECT source FROM source_profiles WHERE zone_name = 'UTC')")
def personas_deleted(spark, folder):
    return S.delete_keys(personas(spark, folder), table(spark, folder, "source_profiles").where("zone_name = 'UTC'").select(F.col("source").alias("persona_id")), "persona_id").select("persona_id")


EVOLUTION = [("warm", 1, "acquaintance", 0.1, {"tone": "warm", "length": "short"}), ("close", 2, "developing", 0.2, {"tone": "familiar"}), ("trusting", 3, "introduction", 0.3, {"jokes": "yes"})]


@query(
    "personas_evolved",
    f"""WITH {STATES}, r(name, o, least_stage, least_trust, tone, length, jokes) AS (VALUES ('warm', 1, 2, 0.1, 'warm', 'short', NULL), ('close', 2, 3, 0.2, 'familiar', NULL, NULL), ('trusting', 3, 1, 0.3, NULL, NULL, 'yes')),
h AS (SELECT user_id, r.* FROM states, r WHERE list_position(['introduction', 'acquaintance', 'developing', 'established', 'deep'], stage) >= least_stage AND round(trust, 6) >= least_trust)
SELECT user_id, string_agg(name, ',' ORDER BY o) AS fired, arg_max(tone, o) FILTER (tone IS NOT NULL) AS tone, arg_max(length, o) FILTER (length IS NOT NULL) AS length, arg_max(jokes, o) FILTER (jokes IS NOT NULL) AS jokes FROM h GROUP BY user_id""",
)
def personas_evolved(spark, folder):
    """The rules each user's relationship fires, and what they override."""
    rules = spark.createDataFrame(EVOLUTION, "name string, order int, least_stage string, least_trust double, effect map<string,string>")
    met = E.trigger_met(F.col("stage"), F.col("trust"), F.lit(None).cast("double"), F.col("least_stage"), F.col("least_trust"), F.lit(None).cast("double"))
    out = St.evolve(relationship_states(spark, folder), rules, "user_id", met)
    return out.select("user_id", F.array_join("fired", ",").alias("fired"), *[F.try_element_at("overrides", F.lit(k)).alias(k) for k in ("tone", "length", "jokes")])


@query("relationship_contexts", f"WITH {STATES}, t AS (SELECT user_id, upper(stage[1]) || stage[2:] AS s, interactions AS n, round_even(round(trust, 6) * 100, 0)::INT AS a, round_even(round(comfort, 6) * 100, 0)::INT AS b, round_even(round(rapport, 6) * 100, 0)::INT AS c FROM states) SELECT user_id, 'Relationship stage: ' || s || chr(10) || 'Trust level: ' || a || '%' || chr(10) || 'Comfort level: ' || b || '%' || chr(10) || 'Rapport: ' || c || '%' || chr(10) || 'Interactions: ' || n AS context FROM t")
def relationship_contexts(spark, folder):
    c = F.col
    return relationship_states(spark, folder).select("user_id", St.relationship_context(c("stage"), c("trust"), c("comfort"), c("rapport"), c("interactions")).alias("context"))


@query("relationship_deleted", f"WITH {STATES} SELECT user_id, stage FROM states WHERE user_id NOT IN (SELECT user_id FROM episodes WHERE user_id IS NOT NULL AND importance > 0.9)")
def relationship_deleted(spark, folder):
    return S.delete_keys(relationship_states(spark, folder), table(spark, folder, "episodes").where("user_id is not null and importance > 0.9"), "user_id").select("user_id", "stage")


# --- profiles ----------------------------------------------------------------------------------------------

TOPICS = """tp AS (SELECT user_id, id, title, unnest(from_json(topics, '["VARCHAR"]')) AS topic, generate_subscripts(from_json(topics, '["VARCHAR"]'), 1) AS i FROM episodes WHERE user_id IS NOT NULL AND json_valid(topics)), fi AS (SELECT user_id, lower(topic) AS low, arg_min(topic, id * 100 + i) AS topic, min(id * 100 + i) AS fi_at FROM tp WHERE trim(topic) <> '' GROUP BY ALL)"""


def _topics(spark, folder) -> DataFrame:
    e = table(spark, folder, "episodes").where("user_id is not null")
    t = e.select("user_id", "id", F.posexplode(F.from_json("topics", "array<string>")).alias("i", "topic")).where("trim(topic) <> ''")
    return t.select("user_id", (F.col("id") * 100 + F.col("i") + 1).alias("at"), "topic")


def _profiles(spark, folder) -> DataFrame:
    named = table(spark, folder, "episodes").where("user_id is not null and title <> ''").select("user_id", (F.col("id") * 100).alias("at"), F.lit("name").alias("type"), F.col("title").alias("value"))
    facts = _topics(spark, folder).select("user_id", "at", F.lit("interest").alias("type"), F.col("topic").alias("value")).unionByName(named)
    return P.profile_fold(facts, "user_id")


PROFILES = f"{TOPICS}, nm AS (SELECT user_id, arg_max(title, id) AS name FROM episodes WHERE user_id IS NOT NULL AND title <> '' GROUP BY ALL), li AS (SELECT user_id, list(topic ORDER BY fi_at) AS interest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fi_at, low) AS n FROM fi) WHERE n <= 50 GROUP BY ALL), pr AS (SELECT coalesce(nm.user_id, li.user_id) AS user_id, name, coalesce(interest, []) AS interest FROM nm FULL JOIN li ON nm.user_id = li.user_id)"


@query("profiles_folded", f"WITH {PROFILES} SELECT user_id, name, array_to_string(interest, '|') AS interests FROM pr")
def profiles_folded(spark, folder):
    return _profiles(spark, folder).select("user_id", "name", F.array_join("interest", "|").alias("interests"))


@query("profiles_got", f"WITH {PROFILES}, a AS (SELECT DISTINCT user_id FROM episodes WHERE user_id IS NOT NULL) SELECT user_id, coalesce(name, '') AS name, coalesce(len(interest), 0)::INT AS interests FROM a LEFT JOIN pr USING (user_id)")
def profiles_got(spark, folder):
    """The profile of every user, an empty one where nothing is known."""
    wanted = table(spark, folder, "episodes").where("user_id is not null").select("user_id").distinct()
    return wanted.join(_profiles(spark, folder), "user_id", "left").select("user_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.size("interest"), F.lit(0)).alias("interests"))


@query("profiles_summary", f"WITH {PROFILES}, t AS (SELECT user_id, concat_ws(chr(10), 'Name: ' || name, CASE WHEN len(interest) > 0 THEN 'Interests: ' || array_to_string(interest[1:10], ', ') END) AS s FROM pr) SELECT user_id, CASE WHEN s = '' THEN 'No profile information yet.' ELSE s END AS summary FROM t")
def profiles_summary(spark, folder):
    c = F.col
    return _profiles(spark, folder).select("user_id", E.profile_summary(c("name"), c("interest"), c("preference"), c("routine"), c("boundary")).alias("summary"))


@query("boundaries_added", f"WITH {TOPICS} SELECT user_id, topic AS boundary, fi_at AS first_at FROM fi")
def boundaries_added(spark, folder):
    return St.boundaries(_topics(spark, folder), "user_id", "at", "topic").withColumnRenamed("at", "first_at")


@query("boundaries_checked", f"WITH {MESSAGES}, {TOPICS} SELECT episode, pos, count(*) AS crossed FROM msg JOIN fi USING (user_id) WHERE contains(lower(content), lower(topic)) GROUP BY ALL")
def boundaries_checked(spark, folder):
    """How many boundaries of its user each message touches (here all of one or two words)."""
    b = St.boundaries(_topics(spark, folder), "user_id", "at", "topic")
    hit = said(spark, folder).join(b.select("user_id", "boundary"), "user_id").where(E.boundary_crossed(F.col("content"), F.col("boundary")).isNotNull())
    return hit.groupBy("episode", F.col("pos").cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("crossed"))


# --- sessions ----------------------------------------------------------------------------------------------

ACTIVE = "ss AS (SELECT session_id, arg_max(user_id, id) FILTER (user_id IS NOT NULL) AS user_id, max(id) AS last_active, count(*) AS touched FROM episodes WHERE session_id IS NOT NULL GROUP BY ALL)"


def _session_state(spark, folder) -> DataFrame:
    log = table(spark, folder, "episodes").where("session_id is not null").select("session_id", "id", "user_id", F.col("id").alias("last_active"))
    touched = log.groupBy("session_id").agg(F.count(F.lit(1)).alias("touched"))
    return S.last_wins(log, ["session_id"], ["id"], ["user_id"]).drop("id").join(touched, "session_id")


@query("sessions_touched", f"WITH {ACTIVE} SELECT session_id, user_id, last_active, touched FROM ss")
def sessions_touched(spark, folder):
    return _session_state(spark, folder).select("session_id", "user_id", "last_active", "touched")


@query("sessions_got", f"WITH {ACTIVE} SELECT session_id, user_id FROM ss WHERE session_id IN (SELECT session_id FROM episodes WHERE id % 100 = 0)")
def sessions_got(spark, folder):
    wanted = table(spark, folder, "episodes").where("id % 100 = 0").select("session_id").distinct()
    return _session_state(spark, folder).join(wanted, "session_id", "left_semi").select("session_id", "user_id")


@query("sessions_created", f"WITH {ACTIVE}, n AS (SELECT user_id, 'new-' || user_id AS session_id, max(last_active) + 1 AS last_active FROM ss WHERE user_id IS NOT NULL GROUP BY ALL), a AS (SELECT user_id, session_id, last_active FROM ss WHERE user_id IS NOT NULL UNION ALL SELECT * FROM n) SELECT user_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_active DESC, session_id DESC) AS k FROM a) WHERE k <= 3")
def sessions_created(spark, folder):
    """A new session for every user; a user's oldest ones beyond three are closed."""
    own = _session_state(spark, folder).where("user_id is not null").select("user_id", "session_id", "last_active")
    new = own.groupBy("user_id").agg((F.max("last_active") + 1).alias("last_active")).select("user_id", F.concat(F.lit("new-"), "user_id").alias("session_id"), "last_active")
    return P.active_sessions(own.unionByName(new), "user_id", "session_id", "last_active", 3).select("user_id", "session_id")


# --- metadata, aliases, ontology ---------------------------------------------------------------------------


@query("entity_metadata", "WITH g AS (SELECT id, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM graph_entities) SELECT id, TRY_CAST(json_extract_string(m, '$.mentions') AS BIGINT) AS mentions, json_extract_string(m, '$.origin') AS origin FROM g")
def entity_metadata(spark, folder):
    m = F.from_json("metadata", "map<string,string>")
    return table(spark, folder, "graph_entities").select("id", F.try_element_at(m, F.lit("mentions")).try_cast("bigint").alias("mentions"), F.try_element_at(m, F.lit("origin")).alias("origin"))


@query("relation_metadata", "SELECT relationship_id, arg_max(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.seen'), id)::BIGINT AS seen FROM relationship_versions WHERE json_valid(metadata) AND json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.seen') IS NOT NULL GROUP BY ALL")
def relation_metadata(spark, folder):
    merged = St.merged_maps(table(spark, folder, "relationship_versions"), "relationship_id", "id", "metadata")
    return merged.where("name = 'seen'").select("relationship_id", F.col("value").cast("bigint").alias("seen"))


@query("alias_dictionary", """WITH g AS (SELECT id, entity, '{"aliases": ["' || lower(entity) || '", "' || replace(entity, ' ', '_') || '"]}' AS m FROM graph_entities WHERE entity IS NOT NULL AND NOT contains(entity, '"')) SELECT DISTINCT id, unnest(from_json(json_extract(m, '$.aliases'), '["VARCHAR"]')) AS alias FROM g""")
def alias_dictionary(spark, folder):
    g = table(spark, folder, "graph_entities").where("""entity is not null and not contains(entity, '"')""")
    made = F.to_json(F.struct(F.array(F.lower("entity"), F.replace("entity", F.lit(" "), F.lit("_"))).alias("aliases")))
    return S.metadata_aliases(g.select("id", made.alias("metadata")), "id", "metadata")


CLASSES = "cl AS (SELECT DISTINCT entity_type AS name FROM graph_entities WHERE regexp_matches(entity_type, '^[A-Z][a-z]+$'))"


def _classes(spark, folder) -> DataFrame:
    return table(spark, folder, "graph_entities").where(F.col("entity_type").rlike("^[A-Z][a-z]+$")).select(F.col("entity_type").alias("name")).distinct()


@query("ontology_classes_suggested", f"WITH {CLASSES}, s AS (SELECT upper(trim(entity_type)[1]) || lower(trim(entity_type)[2:]) AS suggestion FROM graph_entities WHERE entity_type IS NOT NULL) SELECT suggestion, count(*) AS n FROM s WHERE suggestion NOT IN (SELECT name FROM cl) GROUP BY ALL")
def ontology_classes_suggested(spark, folder):
    return St.suggest_names(table(spark, folder, "graph_entities"), "entity_type", _classes(spark, folder), F.initcap(F.trim("entity_type")))


@query("ontology_relations_suggested", "SELECT predicate AS suggestion, count(*) AS n FROM fact_triples WHERE predicate IS NOT NULL AND predicate NOT IN (SELECT relation_type FROM relationship_versions WHERE relation_type IS NOT NULL) GROUP BY ALL")
def ontology_relations_suggested(spark, folder):
    known = table(spark, folder, "relationship_versions").select(F.col("relation_type").alias("name"))
    return St.suggest_names(table(spark, folder, "fact_triples"), "predicate", known, F.col("predicate"))


@query(
    "ontology_subclass_tests",
    f"""WITH RECURSIVE {EDGES}, h AS (SELECT DISTINCT s AS child, t AS parent FROM e WHERE r = 'part_of' AND s <> t), d AS (SELECT child AS name, parent AS ancestor FROM h UNION SELECT d.name, h.parent FROM d JOIN h ON h.child = d.ancestor),
a AS (SELECT DISTINCT source_id AS name, target_id AS ancestor FROM relationship_versions WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION SELECT id, id FROM graph_entities)
SELECT a.name, a.ancestor, a.name = a.ancestor OR d.name IS NOT NULL AS holds FROM a LEFT JOIN d ON d.name = a.name AND d.ancestor = a.ancestor""",
)
def ontology_subclass_tests(spark, folder):
    asked_ = table(spark, folder, "relationship_versions").where("source_id is not null and target_id is not null").select(F.col("source_id").alias("name"), F.col("target_id").alias("ancestor"))
    asked_ = asked_.unionByName(table(spark, folder, "graph_entities").select(F.col("id").alias("name"), F.col("id").alias("ancestor"))).distinct()
    parents = edges(spark, folder).where("r = 'part_of'").select(F.col("s").alias("child"), F.col("t").alias("parent"))
    return St.subclass_tests(parents, asked_).select("name", "ancestor", "holds")


@query("ontology_ancestors", f"WITH RECURSIVE {EDGES}, h AS (SELECT DISTINCT s AS child, t AS parent FROM e WHERE r = 'part_of' AND s <> t), d AS (SELECT child AS node, parent AS ancestor FROM h UNION SELECT d.node, h.parent FROM d JOIN h ON h.child = d.ancestor) SELECT node, count(DISTINCT ancestor) + 1 AS ancestors FROM (SELECT node, ancestor FROM d WHERE node <> ancestor UNION SELECT s, NULL FROM e WHERE r = 'part_of' UNION SELECT t, NULL FROM e WHERE r = 'part_of') GROUP BY ALL")
def ontology_ancestors(spark, folder):
    """How many ancestors each class has, itself among them."""
    parents = edges(spark, folder).where("r = 'part_of'").select(F.col("s").alias("child"), F.col("t").alias("parent"))
    return R.descendants(parents, itself=True).groupBy("node").agg(F.count_distinct("ancestor").alias("ancestors"))


TYPES = "rt AS (SELECT relation_type AS name, arg_max(confidence, id) AS cardinality, max(id) AS last_at FROM relationship_versions WHERE relation_type IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL)"


def _relation_types(spark, folder) -> DataFrame:
    log = table(spark, folder, "relationship_versions").where("relation_type is not null and confidence is not null").select(F.col("relation_type").alias("name"), F.col("id").alias("last_at"), F.col("confidence").alias("cardinality"))
    return S.last_wins(log, ["name"], ["last_at"], [])


@query("ontology_relations_added", f"WITH {TYPES} SELECT name, cardinality, last_at FROM rt")
def ontology_relations_added(spark, folder):
    return _relation_types(spark, folder).select("name", "cardinality", "last_at")


@query("ontology_relations_updated", f"WITH {TYPES}, c AS (SELECT predicate AS name, max(confidence) AS cardinality FROM fact_triples WHERE predicate IS NOT NULL GROUP BY ALL) SELECT name, coalesce(c.cardinality, rt.cardinality) AS cardinality FROM rt LEFT JOIN c USING (name)")
def ontology_relations_updated(spark, folder):
    changes = table(spark, folder, "fact_triples").where("predicate is not null").groupBy(F.col("predicate").alias("name")).agg(F.max("confidence").alias("cardinality"))
    return St.updated(_relation_types(spark, folder), changes, "name", ["cardinality"]).select("name", "cardinality")


@query("ontology_relations_deleted", f"WITH {TYPES} SELECT name FROM rt WHERE name NOT IN (SELECT predicate FROM fact_triples WHERE predicate IS NOT NULL)")
def ontology_relations_deleted(spark, folder):
    return S.delete_keys(_relation_types(spark, folder), table(spark, folder, "fact_triples").where("predicate is not null").select(F.col("predicate").alias("name")), "name").select("name")


NODES = "ec AS (SELECT entity_type AS name, arg_max(provenance, id) FILTER (provenance IS NOT NULL) AS parent, max(id) AS last_at FROM graph_entities WHERE entity_type IS NOT NULL GROUP BY ALL)"


def _class_table(spark, folder) -> DataFrame:
    log = table(spark, folder, "graph_entities").where("entity_type is not null").select(F.col("entity_type").alias("name"), F.col("id").alias("last_at"), F.col("provenance").alias("parent"))
    return S.last_wins(log, ["name"], ["last_at"], ["parent"])


@query("ontology_classes_added", f"WITH {NODES} SELECT name, parent, last_at FROM ec")
def ontology_classes_added(spark, folder):
    return _class_table(spark, folder).select("name", "parent", "last_at")


@query("ontology_classes_updated", f"WITH {NODES} SELECT name, CASE WHEN name = upper(name) THEN 'code' ELSE parent END AS parent FROM ec")
def ontology_classes_updated(spark, folder):
    c = _class_table(spark, folder)
    changes = c.where(F.col("name") == F.upper("name")).select("name", F.lit("code").alias("parent"))
    return St.updated(c, changes, "name", ["parent"]).select("name", "parent")


@query("ontology_classes_deleted", f"WITH {NODES} SELECT name FROM ec WHERE name <> upper(name)")
def ontology_classes_deleted(spark, folder):
    c = _class_table(spark, folder)
    return S.delete_keys(c, c.where(F.col("name") == F.upper("name")), "name").select("name")


# --- reasoning logs and caches -----------------------------------------------------------------------------

HEADERS = f"{SESSIONS}, hd AS (SELECT user_id, session, min(event_id) AS started, max(event_id) AS ended, count(*) AS steps, count(DISTINCT event_type) AS kinds, arg_max(event_type, event_id) IN ('purchase', 'click') AS success FROM sx GROUP BY ALL)"


def _headers(spark, folder) -> DataFrame:
    return St.reasoning_header(_sessions(spark, folder), ["user_id", "session"], "event_id", "event_type", ["purchase", "click"])


@query("reasoning_started", f"WITH {HEADERS} SELECT user_id, session, started, steps, kinds FROM hd")
def reasoning_started(spark, folder):
    return _headers(spark, folder).select("user_id", "session", "started", "steps", "kinds")


@query("reasoning_ended", f"WITH {HEADERS} SELECT user_id, session, ended, success FROM hd")
def reasoning_ended(spark, folder):
    return _headers(spark, folder).select("user_id", "session", "ended", "success")


@query("reasoning_logged", f"WITH {SESSIONS} SELECT user_id, session, event_id, event_type, row_number() OVER (PARTITION BY user_id, session ORDER BY event_id) AS step FROM sx")
def reasoning_logged(spark, folder):
    """Each step of each session with its number."""
    from recallix.operators.hot import sequenced

    return sequenced(_sessions(spark, folder), ["user_id", "session"], "event_id", "event_id").select("user_id", "session", "event_id", "event_type", F.col("place").alias("step"))


@query("reasoning_got", f"WITH {HEADERS} SELECT hd.*, event_id, event_type FROM hd JOIN sx USING (user_id, session) WHERE hd.user_id IN (SELECT user_id FROM events WHERE event_id % 100 = 0)")
def reasoning_got(spark, folder):
    """Headers and steps of the sessions of asked users."""
    wanted = table(spark, folder, "events").where("event_id % 100 = 0").select("user_id").distinct()
    steps = _sessions(spark, folder).select("user_id", "session", "event_id", "event_type")
    return _headers(spark, folder).join(wanted, "user_id", "left_semi").join(steps, ["user_id", "session"])


@query("reasoning_cleared", f"WITH {SESSIONS} SELECT event_id FROM sx WHERE (user_id, session) NOT IN (SELECT (user_id, session) FROM sx WHERE event_type = 'error')")
def reasoning_cleared(spark, folder):
    s = _sessions(spark, folder)
    return St.cleared(s, s.where("event_type = 'error'"), ["user_id", "session"]).select("event_id")


@query("reasoning_confidence", "SELECT relationship_id, round(avg(confidence), 6) AS confidence, array_to_string(list_sort(list_distinct(list_filter(flatten(list([source_id, target_id])), lambda x: x IS NOT NULL))), ',') AS entities FROM relationship_versions GROUP BY ALL")
def reasoning_confidence(spark, folder):
    """The mean confidence of the steps of a result, and the entities they touch (a few each)."""
    r = table(spark, folder, "relationship_versions")
    ids = F.array_sort(F.array_union(F.collect_set("source_id"), F.collect_set("target_id")))
    return r.groupBy("relationship_id").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.array_join(ids.cast("array<string>"), ",").alias("entities"))


KINDS = f"{EDGES}, kd AS (SELECT id AS node, lower(entity_type) AS kind FROM graph_entities), pt AS (SELECT rel_id, t, c, list_sort(list_distinct(list_filter([a.kind, b.kind], lambda x: x IS NOT NULL))) AS types, [r] AS path FROM e LEFT JOIN kd a ON a.node = s LEFT JOIN kd b ON b.node = t), ky AS (SELECT *, md5(concat_ws('|', array_to_string(types, ','), array_to_string(path, '>'))) AS key FROM pt)"


def _patterns(spark, folder) -> DataFrame:
    k = kinds(spark, folder)
    e = edges(spark, folder).join(k.select(F.col("node").alias("s"), F.col("kind").alias("ks")), "s", "left").join(k.select(F.col("node").alias("t"), F.col("kind").alias("kt")), "t", "left")
    types = F.array_sort(F.array_distinct(F.filter(F.array("ks", "kt"), lambda x: x.isNotNull())))
    return e.select("rel_id", "t", "c", types.alias("types"), F.array("r").alias("path")).withColumn("key", E.pattern_key(F.col("types"), F.col("path")))


@query("patterns_extracted", f"WITH {KINDS} SELECT rel_id, array_to_string(types, ',') AS types, array_to_string(path, '>') AS path, (len(path) // 2)::INT AS hops, key FROM ky")
def patterns_extracted(spark, folder):
    return _patterns(spark, folder).select("rel_id", F.array_join("types", ",").alias("types"), F.array_join("path", ">").alias("path"), F.floor(F.size("path") / 2).cast("int").alias("hops"), "key")


@query("patterns_cached", f"WITH {KINDS} SELECT key, count(*) AS hits, arg_max(t, rel_id) AS result FROM ky GROUP BY ALL")
def patterns_cached(spark, folder):
    p = _patterns(spark, folder)
    return St.cache_put(p, F.col("key"), "t", "rel_id")


@query("patterns_looked_up", f"WITH {KINDS}, cc AS (SELECT key, arg_max(t, rel_id) AS result FROM ky WHERE c >= 0.8 GROUP BY ALL) SELECT rel_id, cc.key IS NOT NULL AS hit, result FROM ky LEFT JOIN cc USING (key)")
def patterns_looked_up(spark, folder):
    p = _patterns(spark, folder)
    cache = St.cache_put(p.where("c >= 0.8"), F.col("key"), "t", "rel_id")
    return St.cache_get(cache, p.select("key", "rel_id")).select("rel_id", "hit", "result")


@query("patterns_hit_rate", f"WITH {KINDS}, cc AS (SELECT DISTINCT key FROM ky WHERE c >= 0.8) SELECT round(100.0 * count(cc.key) / count(*), 6) AS rate FROM ky LEFT JOIN cc USING (key)")
def patterns_hit_rate(spark, folder):
    got = patterns_looked_up(spark, folder).agg(F.count(F.when(F.col("hit"), 1)).alias("h"), F.count(F.when(~F.col("hit"), 1)).alias("m"))
    return got.select(F.round(E.hit_rate(F.col("h"), F.col("m")), 6).alias("rate"))


@query("query_keys", "SELECT id, md5(concat_ws('|', coalesce(subject, ''), coalesce(predicate, ''), coalesce(object, ''))) AS key FROM fact_triples")
def query_keys(spark, folder):
    c = [F.coalesce(x, F.lit("")) for x in ("subject", "predicate", "object")]
    return table(spark, folder, "fact_triples").select("id", F.md5(F.concat_ws("|", *c)).alias("key"))


@query("runs_profiled", "SELECT event_type AS kind, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def runs_profiled(spark, folder):
    out = P.aggregate_runs(table(spark, folder, "events").withColumnRenamed("event_type", "kind"), "kind", "value")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


# --- memory ------------------------------------------------------------------------------------------------


@query("memory_important", f"WITH {MESSAGES} SELECT episode, pos FROM msg WHERE CASE WHEN role = 'system' THEN 9.0 WHEN regexp_matches(content, {q(X.PERSONAL_HINT)}) THEN 8.0 WHEN {TOKENS} < 13 THEN 3.0 WHEN role = 'user' THEN 6.5 ELSE 5.0 END >= 5.0")
def memory_important(spark, folder):
    return said(spark, folder).where(X.message_importance(F.col("role"), F.col("content")) >= 5.0).select("episode", F.col("pos").cast("long").alias("pos"))


@query("memory_restored", f"WITH {MESSAGES} SELECT episode, pos, role, content, {TOKENS}::INT AS tokens FROM msg")
def memory_restored(spark, folder):
    back = St.restore_memory(St.save_memory(M.conversations(said(spark, folder)), "episode"), "episode")
    return back.select("episode", F.col("pos").cast("long").alias("pos"), "role", "content", "tokens")


@query("memory_limits", f"WITH {MESSAGES}, u AS (SELECT episode AS key, role AS tier, sum({TOKENS})::BIGINT AS used FROM msg GROUP BY ALL) SELECT key, tier, CASE WHEN used * 30 >= greatest(used, 1000) THEN used * 30 ELSE 1200 END AS limit_tokens, used * 30 >= greatest(used, 1000) AS accepted FROM u WHERE tier IS NOT NULL")
def memory_limits(spark, folder):
    """Limits of 1,200 tokens a role, and a change to thirty times what is used."""
    used = said(spark, folder).where("role is not null").groupBy(F.col("episode").alias("key"), F.col("role").alias("tier")).agg(F.sum(X.token_estimate(F.col("content"))).alias("tokens"))
    limits = used.select("key", "tier", F.lit(1200).cast("bigint").alias("limit_tokens"))
    return M.limits_updated(limits, used, used.select("key", "tier", (F.col("tokens") * 30).alias("limit_tokens")))


# --- retrieval plug points, replies, records ---------------------------------------------------------------

#: Search strategies by name: each takes (spark, folder) and gives (qid, id, rank, ...).
STRATEGIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"bm25": retrieve_bm25, "dense": retrieve_dense, "hybrid": retrieve_hybrid, "keyword": retrieve_keyword}


def search(strategy: str, spark, folder) -> DataFrame:
    """Runs a strategy by its name; one of your own is put into STRATEGIES."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[strategy](spark, folder)


@query("retrieve_by_strategy", " UNION ALL ".join(f"SELECT '{n}' AS strategy, qid, id, rank FROM ({RETRIEVAL_SQL[f'retrieve_{n}']})" for n in ("bm25", "dense", "keyword")))
def retrieve_by_strategy(spark, folder):
    parts = [search(n, spark, folder).select(F.lit(n).alias("strategy"), "qid", "id", "rank") for n in ("bm25", "dense", "keyword")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("retrieve_above", f"{RETRIEVAL_SQL['retrieve_hybrid']} AND score >= 0.5")
def retrieve_above(spark, folder):
    return retrieve_hybrid(spark, folder).where("score >= 0.5")


@query("retrieve_documents", f"WITH {BM25} SELECT qid, text AS page_content, CAST(id AS VARCHAR) AS doc, rank FROM lex JOIN knowledge_items USING (id) WHERE rank <= 10")
def retrieve_documents(spark, folder):
    """Hits as documents: the content, and a map of metadata."""
    hits = retrieve_bm25(spark, folder).join(table(spark, folder, "knowledge_items").select("id", "text"), "id")
    made = hits.select("qid", "rank", F.struct(F.col("text").alias("page_content"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("metadata")).alias("d"))
    return made.select("qid", "d.page_content", F.col("d.metadata")["id"].alias("doc"), "rank")


@query("reasoning_answers", f"WITH k AS ({RETRIEVAL_SQL['retrieve_keyword']}), {ASKED}, p AS (SELECT qid, CASE " + " ".join(f"WHEN {any_sql('lower(text)', w)} THEN '{n}'" for n, w in X.PLANS) + " ELSE 'generic' END AS template FROM (SELECT DISTINCT qid, text FROM ask WHERE text IS NOT NULL)) SELECT p.qid, template, count(k.id) AS steps, round(coalesce(avg(k.confidence), 0.0), 6)::DOUBLE AS confidence FROM p LEFT JOIN k ON k.qid = p.qid GROUP BY ALL")
def reasoning_answers(spark, folder):
    """Each question's plan, the facts found for it as steps, and their mean confidence as that of the answer."""
    plan = asked(spark, folder).where("text is not null").select("qid", X.query_plan(F.col("text")).alias("template"))
    facts = retrieve_keyword(spark, folder).groupBy("qid").agg(F.count(F.lit(1)).alias("steps"), F.avg("confidence").alias("c"))
    return plan.join(facts, "qid", "left").select("qid", "template", F.coalesce("steps", F.lit(0)).alias("steps"), F.round(F.coalesce("c", F.lit(0.0)), 6).alias("confidence"))


@query("replies_emotion", "SELECT id, CASE WHEN importance > 0.5 THEN 'joy' ELSE 'neutral' END AS emotion, CASE WHEN importance > 0.5 THEN importance ELSE 0.0 END AS intensity FROM episodes WHERE importance IS NOT NULL")
def replies_emotion(spark, folder):
    """A model's JSON where it is one (here fenced), the word list's emotion where it isn't."""
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("joy").alias("primary_emotion"), F.col("importance").alias("intensity"))), F.lit("\n```"))
    reply = F.when(F.col("importance") > 0.5, fenced).otherwise("I can't tell.")
    rows = table(spark, folder, "episodes").where("importance is not null").select("id", reply.alias("reply"), F.lit("").alias("said"))
    own = X.with_emotion(rows, "said")
    return own.select("id", E.reply_emotion(F.col("reply"), F.col("emotion")).alias("e")).select("id", F.col("e.primary").alias("emotion"), "e.intensity")


@query("replies_importance", f"WITH {MESSAGES} SELECT episode, pos, coalesce(try_cast(nullif(regexp_extract(content, '(0\\.\\d+)', 1), '') AS DOUBLE), 0.5) AS importance FROM msg WHERE role = 'assistant'")
def replies_importance(spark, folder):
    return said(spark, folder).where("role = 'assistant'").select("episode", F.col("pos").cast("long").alias("pos"), E.reply_importance(F.col("content")).alias("importance"))


@query("replies_accepted", "SELECT id, CASE WHEN summary IS NOT NULL AND trim(summary) <> '' AND length(summary) <= length(title) * 1.1 THEN summary ELSE title END AS shown FROM episodes")
def replies_accepted(spark, folder):
    return table(spark, folder, "episodes").select("id", E.reply_or(F.col("summary"), F.col("title")).alias("shown"))


@query("replies_relevance", """WITH r AS (SELECT id, '[{"item": 0, "score": ' || importance || '}, {"item": 1, "score": 0.2}]' AS reply FROM episodes WHERE importance IS NOT NULL) SELECT id, unnest([0, 1])::INT AS item, unnest([CAST(json_extract_string(reply, '$[0].score') AS DOUBLE), 0.2]) AS score FROM r""")
def replies_relevance(spark, folder):
    reply = F.concat(F.lit('Here: [{"item": 0, "score": '), F.col("importance").cast("string"), F.lit('}, {"item": 1, "score": 0.2}] .'))
    return table(spark, folder, "episodes").where("importance is not null").select("id", F.explode(E.reply_scores(reply)).alias("x")).select("id", "x.item", "x.score")


@query("replies_consistency", "WITH s AS (" + RETRIEVAL_SQL["claims_supported"] + ") SELECT cid // 1000 AS episode, round(avg(supported::INT), 6) AS support, avg(supported::INT) >= 0.5 AS consistent FROM s GROUP BY ALL")
def replies_consistency(spark, folder):
    """The share of an episode's claims that some item supports, and whether that is half of them."""
    from recallix.plans.retrieval import claims_supported

    share = F.avg(F.col("supported").cast("int"))
    return claims_supported(spark, folder).groupBy(F.floor(F.col("cid") / 1000).alias("episode")).agg(F.round(share, 6).alias("support"), (share >= 0.5).alias("consistent"))


@query("persona_prompts", "SELECT id, array_to_string(list_filter([title, summary, 'Origin: ' || json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.origin')], lambda x: trim(x) <> ''), chr(10) || chr(10)) AS prompt FROM episodes")
def persona_prompts(spark, folder):
    return table(spark, folder, "episodes").select("id", E.persona_prompt([F.col("title"), F.col("summary"), F.concat(F.lit("Origin: "), F.get_json_object("metadata", "$.origin"))]).alias("prompt"))


@query("answers_scored", f"WITH {ASKED}, k AS (SELECT row_number() OVER (ORDER BY qid) AS i, qid, text FROM (SELECT DISTINCT qid, text FROM ask WHERE text IS NOT NULL)), x AS (SELECT a.qid, lower(b.text) AS answer, list_distinct({TERMS.replace('text', 'a.text')}) AS expected FROM k a JOIN k b ON b.i = a.i + 1) SELECT qid, round(len(list_filter(expected, lambda w: contains(answer, w))) / len(expected)::DOUBLE, 6) AS score FROM x WHERE len(expected) > 0")
def answers_scored(spark, folder):
    """Each question's words looked for in the text of the next question."""
    from recallix.operators.retrieval import terms

    a = St.listed(asked(spark, folder).where("text is not null").select("qid", "text").withColumn("n", F.expr("cast(substring(qid, 4) as bigint)")), "n", "qid")
    b = a.select((F.col("place") - 1).alias("place"), F.col("text").alias("answer"))
    rows = a.join(b, "place").select("qid", "answer", F.array_distinct(terms(F.col("text"))).alias("expected")).where("size(expected) > 0")
    return rows.select("qid", F.round(Me.answer_score(F.col("answer"), F.col("expected")), 6).alias("score"))


@query("nary_found", f"WITH {MESSAGES} SELECT DISTINCT e.id FROM episodes e JOIN msg ON msg.episode = e.id AND msg.role = 'system' ORDER BY e.id DESC LIMIT 100")
def nary_found(spark, folder):
    """The newest hundred episodes in which a system message takes part."""
    heads = table(spark, folder, "episodes").select("id", F.lit("talk").alias("relation_type"), F.col("id").alias("timestamp"))
    parts = said(spark, folder).select(F.col("episode").alias("relationship_id"), "role", F.col("pos").alias("entity_id"))
    return D.nary_query(heads, parts, relation="talk", role="system").select("id")


@query("beliefs_history", f"WITH {EDGES}, r AS (SELECT relationship_id AS rel_id, arg_max(target_id, id) AS v, max(id) AS revised_at FROM relationship_versions WHERE changed_by IS NOT NULL GROUP BY ALL) SELECT rel_id, e.t AS before, v AS after, c AS confidence_before, 0.9 AS confidence_after, revised_at FROM e JOIN r USING (rel_id) ORDER BY revised_at DESC LIMIT 10")
def beliefs_history(spark, folder):
    """The ten newest revisions, with what was believed before and after."""
    r = table(spark, folder, "relationship_versions").where("changed_by is not null").select(F.col("relationship_id").alias("rel_id"), F.col("target_id").alias("value"), F.lit(0.9).alias("certainty"), F.col("id").alias("at"))
    return D.revise_beliefs(edges(spark, folder), r)[1].withColumnRenamed("at", "revised_at").orderBy(F.desc("revised_at")).limit(10)


@query("distributions_got", f"WITH {EDGES}, d AS (SELECT source_id AS entity_id, target_id AS relation_id, arg_max(confidence, id) AS p FROM relationship_versions WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL) SELECT entity_id, relation_id, 'discrete' AS kind, p AS yes FROM d")
def distributions_got(spark, folder):
    """The last distribution stored for each pair."""
    v = table(spark, folder, "relationship_versions").where("source_id is not null and target_id is not null and confidence is not null")
    log = v.select("id", F.col("source_id").alias("entity_id"), F.col("target_id").alias("relation_id"), F.lit("discrete").alias("distribution_type"), F.to_json(F.struct(F.col("confidence").alias("yes"))).alias("distribution_data"))
    return D.latest_distribution(log).select("entity_id", "relation_id", F.col("distribution_type").alias("kind"), F.col("distribution")["yes"].alias("yes"))


@query("uncertainty_missing", "SELECT id, array_to_string(list_filter([CASE WHEN subject IS NULL THEN 'subject' END, CASE WHEN source IS NULL THEN 'source' END, CASE WHEN timestamp IS NULL THEN 'timestamp' END, CASE WHEN embedding IS NULL THEN 'embedding' END], lambda x: x IS NOT NULL), ',') AS missing FROM fact_triples")
def uncertainty_missing(spark, folder):
    return table(spark, folder, "fact_triples").select("id", F.array_join(U.missing_fields(["subject", "source", "timestamp", "embedding"]), ",").alias("missing"))


@query("uncertainty_incomplete", "WITH m AS (SELECT predicate, object, (source IS NOT NULL)::INT + (timestamp IS NOT NULL)::INT + (embedding IS NOT NULL)::INT AS m, coalesce(confidence, 0.5) AS c, id FROM fact_triples WHERE predicate IS NOT NULL), s AS (SELECT predicate, object, id, CASE WHEN m = 3 THEN c WHEN m / 3.0 > 0.3 THEN m / 3.0 * c * 0.8 END AS score, m = 3 AS whole FROM m), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY whole DESC, round(score, 9) DESC NULLS LAST, id) AS n FROM s) WHERE n = 1) SELECT predicate, CASE WHEN score IS NULL THEN 'Unknown' ELSE object END AS answer, round(coalesce(score, 0.1), 6) AS confidence, whole AS complete FROM b")
def uncertainty_incomplete(spark, folder):
    """The best answer to each predicate from facts that may lack fields."""
    return U.incomplete_answer(table(spark, folder, "fact_triples").where("predicate is not null"), ["predicate"], "object", ["source", "timestamp", "embedding"], "confidence", "id")


@query("knowledge_consistency", f"WITH {EDGES}, g AS (SELECT s, r, count(DISTINCT t) AS n, count(*) AS k FROM e WHERE r IN ('located_in', 'works_at') GROUP BY ALL) SELECT r, count(*) AS groups, sum((n > 1)::INT)::BIGINT AS contradictory, round(1 - sum((n > 1)::INT) / count(*), 6) AS score FROM g GROUP BY ALL")
def knowledge_consistency(spark, folder):
    """For each relation that should have one target: sources, those with several, and the share without."""
    return G.consistency(edges(spark, folder), ["located_in", "works_at"])


@query(
    "revision_impacts",
    """WITH s AS (SELECT timestamp::BIGINT AS at, confidence AS score, row_number() OVER (ORDER BY timestamp::BIGINT, confidence) AS p FROM knowledge_items WHERE timestamp IS NOT NULL AND confidence IS NOT NULL), v AS (SELECT relationship_id, max(timestamp)::BIGINT AS at FROM relationship_versions WHERE timestamp IS NOT NULL AND relationship_id % 10 = 0 GROUP BY ALL),
x AS (SELECT CAST(relationship_id AS VARCHAR) AS event, v.at, (SELECT count(*) FROM s WHERE s.at <= v.at) AS spot FROM v), b AS (SELECT event, spot, avg(score) FILTER (p <= spot) AS before, max(score) FILTER (p > spot) AS after FROM x JOIN s ON p BETWEEN spot - 2 AND spot + 1 GROUP BY ALL), r AS (SELECT event, arg_min(s.at, p) AS recovered_at FROM b JOIN s ON p > spot AND score >= 0.95 * before GROUP BY ALL)
SELECT x.event, round(before, 6) AS before, after, round(before - after, 6) AS drop_, recovered_at FROM x LEFT JOIN b USING (event) LEFT JOIN r USING (event)""",
)
def revision_impacts(spark, folder):
    """Confidence of items around the last change of a relationship (those whose id is divisible by ten)."""
    snaps = table(spark, folder, "knowledge_items").where("timestamp is not null and confidence is not null").select(F.round("timestamp").cast("bigint").alias("at"), F.col("confidence").alias("score"))
    events = table(spark, folder, "relationship_versions").where("timestamp is not null and relationship_id % 10 = 0").groupBy("relationship_id").agg(F.round(F.max("timestamp")).cast("bigint").alias("at")).select(F.col("relationship_id").cast("string").alias("event"), "at")
    return D.revision_impact(snaps, events).select("event", F.round("before", 6).alias("before"), "after", F.round("drop", 6).alias("drop_"), "recovered_at")


@query("chains_scored", r"WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(tgt_text), '[\p{L}\p{N}]+') AS b FROM documents WHERE text IS NOT NULL AND tgt_text IS NOT NULL), x AS (SELECT doc_id, len(b) AS nb, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS i, b FROM d) SELECT doc_id, round(sum(CASE WHEN i <= nb AND w = b[i] THEN 1.0 ELSE 0.0 END) / greatest(sum((i <= nb)::INT), 1) * sum((i <= nb)::INT) / count(*), 6)::DOUBLE AS score FROM x GROUP BY ALL")
def chains_scored(spark, folder):
    """Each document's words as a chain of steps against those of its other side."""
    from recallix.operators.retrieval import terms

    d = table(spark, folder, "documents").where("text is not null and tgt_text is not null")
    steps = lambda c: d.select(F.col("doc_id").alias("chain"), F.posexplode(terms(F.col(c))).alias("pos", "w")).select("chain", "pos", F.array("w").alias("words"))
    return D.reasoning_chain(steps("text"), steps("tgt_text")).select(F.col("chain").alias("doc_id"), F.round("score", 6).alias("score"))


# --- supernodes --------------------------------------------------------------------------------------------


@query(
    "graph_supernode_paths",
    f"""{_propagation(4)}, ce AS (SELECT DISTINCT a.community AS s, b.community AS t FROM e JOIN l4 a ON a.node = s JOIN l4 b ON b.node = t WHERE a.community <> b.community), st AS (SELECT DISTINCT community AS c FROM l4 JOIN seeds ON seed = node),
p1 AS (SELECT c AS start, t AS goal, [c, t] AS path FROM st JOIN ce ON s = c), p2 AS (SELECT start, t AS goal, list_append(path, t) AS path FROM p1 JOIN ce ON s = goal WHERE NOT list_contains(path, t)), f AS (SELECT *, 1 AS hops FROM p1 UNION ALL SELECT *, 2 FROM p2)
SELECT start, goal, hops, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY hops, path) AS n FROM f) WHERE n = 1""",
)
def graph_supernode_paths(spark, folder):
    """The shortest path of communities from each seed's community to every other, of two steps at most."""
    e = edges(spark, folder)
    return G.supernode_paths(e, G.communities(e), table(spark, folder, "graph_entities").where("id % 100 = 0").select(F.col("id").alias("seed")))
