"""Queries of the llm operators (problems 2, 3, 4, 7, 8, 9 and 10) and the SQL of those SQL can express."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallix.llm import mixing, tokenizer
from recallix.llm.languages import document_segments, wrong_labels
from recallix.llm.name_variants import common_given_names, name_variants
from recallix.llm.near_duplicates import group_pairs, near_duplicates
from recallix.llm.personal import find_personal, given_names, redact_personal
from recallix.llm.similar_vectors import similar_vectors
from recallix.session import checkpoint
from recallix.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


#: The key of the pseudonyms. Where PSEUDONYM_KEY isn't set it is drawn anew, so pseudonyms of two runs can't be linked.
KEY = os.environ.get("PSEUDONYM_KEY", "").encode() or secrets.token_bytes(32)


def _personal_texts(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    def rows(name: str, *fields: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")
        return table(spark, folder, name).select(F.lit(name).alias("src"), F.col("id").alias("row_id"), each).select("src", "row_id", "x.*")

    names = given_names(table(spark, folder, "given_names"))
    names += common_given_names(table(spark, folder, "graph_entities"), names)
    return rows("knowledge_items", "text").unionByName(rows("episodes", "summary", "messages")), names


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Types of personal information in the texts of knowledge_items and episodes."""
    return find_personal(*_personal_texts(spark, folder), KEY).distinct()


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of knowledge_items and episodes with typed placeholders."""
    return redact_personal(*_personal_texts(spark, folder), KEY).drop("kinds")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Similar vectors within vector_embeddings, knowledge_items and graph_entities."""
    rows = [table(spark, folder, name).select(F.lit(name).alias("src"), F.col("id").cast("string").alias("id"), "embedding") for name in ("vector_embeddings", "knowledge_items", "graph_entities")]
    return similar_vectors(rows[0].unionByName(rows[1]).unionByName(rows[2])).select("src", "id_a", "id_b")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "knowledge_items").select(F.lit("knowledge_items").alias("src"), "id", "text")
    return items.unionByName(table(spark, folder, "fact_triples").select(F.lit("fact_triples").alias("src"), "id", F.col("object").alias("text")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair within a group of near-duplicates of knowledge_items.text or fact_triples.object."""
    return group_pairs(near_duplicates(_texts(spark, folder)))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of each record that has near-duplicates."""
    return near_duplicates(_texts(spark, folder)).withColumnRenamed("group", "group_id")


def _same_names(spark: SparkSession, folder: str) -> DataFrame:
    return name_variants(table(spark, folder, "graph_entities"), table(spark, folder, "given_names"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of graph_entities rows that name the same person or organisation."""
    groups = _same_names(spark, folder).withColumn("src", F.lit("graph_entities"))
    return group_pairs(groups).select("id_a", "id_b")


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of each row that shares its person or organisation with another."""
    return _same_names(spark, folder).withColumnRenamed("group", "group_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The byte_bpe_50k token ids of each document's text."""
    return tokenizer.encode(table(spark, folder, "documents"), ["doc_id"], "text")


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents come back from their token ids as they were."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tokenizer.encode(docs, ["doc_id"], "text").select("doc_id", tokenizer.decode(F.col("ids")).alias("back"))
    return docs.join(back, "doc_id").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("text") == F.col("back"), 1)).alias("equal"))


def _mix_plan(spark: SparkSession, folder: str, sized: DataFrame | None = None) -> dict[str, dict]:
    targets = mixing.read_targets(table(spark, folder, "mix_targets"))
    if sized is None:
        docs = table(spark, folder, "documents").where(F.col("source").isin(*targets))
        sized = tokenizer.token_counts(docs, ["source"], "text")
    sums = sized.where(F.col("source").isin(*targets)).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    return mixing.plan_shares({r.source: r.tokens for r in sums.collect()}, targets)  # a row for each source of the targets


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of mix_targets whose exponent is stopped by the repetition limit before their share."""
    return spark.createDataFrame([(s,) for s, p in sorted(_mix_plan(spark, folder).items()) if p["out_of_reach"]], "source string")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, dict]]:
    docs = table(spark, folder, "documents").where("source is not null")
    sized = checkpoint(tokenizer.encode(docs, ["doc_id", "source"], "text").select("doc_id", "source", F.size("ids").alias("tokens")))
    plan = _mix_plan(spark, folder, sized)
    return mixing.mix(sized.where(F.col("source").isin(*plan)), plan, "doc_id", "source", "tokens"), plan


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of the mix, with how often it is used."""
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For each source of mix_targets the share it reached."""
    return mixing.report(*_mixed(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of documents with a missing or wrong label or with several languages."""
    return wrong_labels(document_segments(table(spark, folder, "documents"))).select("doc_id", "lang_found")


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of each segment of each document."""
    return document_segments(table(spark, folder, "documents")).select("doc_id", "segment", "lang_found", "confidence")


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p4_found": p4_found, "p4_groups": p4_groups, "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_found": p9_found, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_segments": p10_segments}

SOUND = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_VECTORS = " UNION ALL ".join(f"SELECT '{t}' AS src, CAST(id AS VARCHAR) AS id, embedding FROM {t} WHERE {SOUND}" for t in ("vector_embeddings", "knowledge_items", "graph_entities"))
#: Brute force over all pairs.
P3_SQL = f"""WITH v AS ({_VECTORS}), u AS (SELECT DISTINCT src, id, CAST(embedding AS DOUBLE[]) AS e FROM v),
c AS (SELECT a.src, a.id AS a, b.id AS b, a.e = b.e AS same, list_cosine_similarity(a.e, b.e) AS cosine FROM u a JOIN u b ON a.src = b.src AND a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY src, a ORDER BY same DESC, cosine DESC, b) AS place FROM c)
SELECT DISTINCT src, least(a, b) AS id_a, greatest(a, b) AS id_b FROM n WHERE place <= 5 AND (cosine >= 0.85 OR same)"""

#: All pairs that share a word, linked if they share enough; groups by recursion.
_P4 = r"""WITH RECURSIVE t AS (SELECT 'knowledge_items' AS src, id, text FROM knowledge_items UNION ALL SELECT 'fact_triples', id, object FROM fact_triples),
w AS (SELECT src, id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM t WHERE text IS NOT NULL), p AS (SELECT src, id, len(w) AS n, unnest(w) AS x FROM w WHERE len(w) >= 6),
s AS (SELECT a.src, a.id AS a, b.id AS b, a.n + b.n AS n, count(*) AS shared FROM p a JOIN p b ON a.src = b.src AND a.x = b.x AND a.id < b.id GROUP BY ALL), e AS (SELECT src, a, b FROM s WHERE shared >= 0.6 * (n - shared) - 1e-9),
u AS (SELECT src, a, b FROM e UNION SELECT src, b, a FROM e), r AS (SELECT src, a AS node, a AS other FROM u UNION SELECT r.src, r.node, u.b FROM r JOIN u ON u.src = r.src AND u.a = r.other)"""
P4_SQL = f"{_P4} SELECT src, node AS id_a, other AS id_b FROM r WHERE node < other"
P4_GROUPS_SQL = f"{_P4} SELECT src, node AS id, min(other) AS group_id FROM r GROUP BY ALL"

SQL: dict[str, str] = {"p3_found": P3_SQL, "p4_found": P4_SQL, "p4_groups": P4_GROUPS_SQL, "p8_round_trip": "SELECT count(*) AS documents, count(*) AS equal FROM documents"}
