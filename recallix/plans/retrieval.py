"""Retrieval and evaluation queries over knowledge_items, fact_triples and vector_embeddings, and their SQL.

Queries are the rows of vector_embeddings whose number is divisible by 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallix.functions import metrics as M
from recallix.functions import text as X
from recallix.operators import retrieval as R
from recallix.plans.text import ITEMS, MESSAGES, q, said
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


def asked(spark, folder) -> DataFrame:
    v = table(spark, folder, "vector_embeddings").where("try_cast(substring(id, 4) as bigint) % 100 = 0")
    return v.select(F.col("id").alias("qid"), "text", F.col("embedding").alias("vector")).dropDuplicates(["qid"])


def items(spark, folder) -> DataFrame:
    return table(spark, folder, "knowledge_items").select("id", "text", F.col("embedding").alias("vector"))


ASKED = "ask AS (SELECT id AS qid, text, embedding AS vector FROM vector_embeddings WHERE try_cast(substring(id, 4) AS BIGINT) % 100 = 0)"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
BM25 = rf"""{ASKED}, d AS (SELECT id, {TOKENS} AS t FROM knowledge_items WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY ALL), st), av AS (SELECT avg(raw) AS a FROM df),
qt AS (SELECT DISTINCT qid, unnest({TOKENS}) AS term FROM ask WHERE text IS NOT NULL),
sc AS (SELECT qid, id, sum(CASE WHEN raw < 0 THEN 0.25 * a ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM qt JOIN df USING (term) JOIN tf USING (term), av, st GROUP BY ALL),
lex AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM sc WHERE score > 0)"""
SOUND = "vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
COS = "round(list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 6)"
DENSE = f"""kv AS (SELECT id, embedding AS vector FROM knowledge_items), cs AS (SELECT qid, b.id, {COS} AS score FROM (SELECT * FROM ask WHERE {SOUND}) a, (SELECT * FROM kv WHERE {SOUND}) b), den AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cs)"""


@query("retrieve_bm25", f"WITH {BM25} SELECT qid, id, round(score, 4) AS score, rank FROM lex WHERE rank <= 10")
def retrieve_bm25(spark, folder):
    return R.bm25(items(spark, folder), asked(spark, folder)).select("qid", "id", F.round("score", 4).alias("score"), "rank")


@query("retrieve_dense", f"WITH {ASKED}, {DENSE} SELECT qid, id, score, rank FROM den WHERE rank <= 10")
def retrieve_dense(spark, folder):
    return R.dense_topk(items(spark, folder), asked(spark, folder))


@query("dense_topk", f"WITH {ASKED}, cs AS (SELECT qid, b.id, {COS} AS score FROM (SELECT * FROM ask WHERE {SOUND}) a, (SELECT id, embedding AS vector FROM vector_embeddings) b WHERE {SOUND.replace('vector', 'b.vector')}) SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cs) WHERE rank <= 10")
def dense_topk(spark, folder):
    v = table(spark, folder, "vector_embeddings").select("id", F.col("embedding").alias("vector"))
    return R.dense_topk(v, asked(spark, folder))


@query("dense_topk_embeddings", f"WITH a0 AS (SELECT vec_id AS qid, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0), cs AS (SELECT qid, b.id, {COS} AS score FROM a0 a, (SELECT vec_id AS id, embedding AS vector FROM embeddings) b) SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cs) WHERE rank <= 10")
def dense_topk_embeddings(spark, folder):
    e = table(spark, folder, "embeddings")
    return R.dense_topk(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")))


FUSED = f"""{BM25}, {DENSE}, l2 AS (SELECT qid, id, (score - min(score) OVER (PARTITION BY qid)) / greatest(max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid), 1e-6) AS lex FROM lex WHERE rank <= 50),
fu AS (SELECT coalesce(l.qid, d.qid) AS qid, coalesce(l.id, d.id) AS id, round(0.3 * coalesce(lex, 0) + 0.7 * coalesce(d.score, 0), 6) AS score FROM l2 l FULL JOIN (SELECT * FROM den WHERE rank <= 50) d ON l.qid = d.qid AND l.id = d.id),
fr AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fu)"""


def _hybrid(spark, folder):
    a, b = asked(spark, folder), items(spark, folder)
    dense = R.dense_topk(b, a, 50)
    return R.fuse(R.bm25(b, a, 50), dense), dense


@query("retrieve_hybrid", f"WITH {FUSED} SELECT qid, id, score, rank FROM fr WHERE rank <= 10")
def retrieve_hybrid(spark, folder):
    return _hybrid(spark, folder)[0]


@query("retrieve_reranked", f"WITH {FUSED}, x AS (SELECT f.qid, f.id, round(0.7 * f.score + 0.3 * coalesce(d.score, 0), 6) AS score FROM fr f LEFT JOIN (SELECT * FROM den WHERE rank <= 50) d ON d.qid = f.qid AND d.id = f.id WHERE f.rank <= 10) SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 5")
def retrieve_reranked(spark, folder):
    return R.rerank(*_hybrid(spark, folder))


@query(
    "retrieve_keyword",
    rf"""WITH {ASKED}, w AS (SELECT DISTINCT id, confidence, unnest(regexp_extract_all(lower(coalesce(subject, '') || ' ' || coalesce(predicate, '') || ' ' || coalesce(object, '')), '[\p{{L}}\p{{N}}]+')) AS term FROM fact_triples), qt AS (SELECT DISTINCT qid, unnest({TOKENS}) AS term FROM ask),
h AS (SELECT DISTINCT qid, id, confidence FROM qt JOIN w USING (term)) SELECT * FROM (SELECT qid, id, confidence, row_number() OVER (PARTITION BY qid ORDER BY confidence DESC NULLS LAST, id) AS rank FROM h) WHERE rank <= 5""",
)
def retrieve_keyword(spark, folder):
    return R.keyword_search(table(spark, folder, "fact_triples"), asked(spark, folder))


@query(
    "retrieve_merged",
    f"""WITH {BM25}, {DENSE}, u AS (SELECT qid, text, 'bm25' AS source, score * 1.5 AS score, 0 AS i FROM lex JOIN knowledge_items USING (id) WHERE rank <= 5 UNION ALL SELECT qid, text, 'dense', score, 1 FROM den JOIN knowledge_items USING (id) WHERE rank <= 5)
SELECT qid, text, source, round(round(score, 6), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY i, score DESC) AS n FROM u) WHERE n = 1""",
)
def retrieve_merged(spark, folder):
    a, b = asked(spark, folder), items(spark, folder)
    texts = b.select("id", "text")
    one = R.bm25(b, a, 5).join(texts, "id").select("qid", "text", "score")
    two = R.dense_topk(b, a, 5).join(texts, "id").select("qid", "text", "score")
    return R.merge_lists([("bm25", one), ("dense", two)], {"bm25": 0.5}).select("qid", "text", "source", F.round("score", 4).alias("score"))


@query(
    "retrieve_expanded",
    rf"""WITH {MESSAGES}, w AS (SELECT episode, pos, lower(content) AS low, string_split(trim(regexp_replace(lower(content), '\s+', ' ', 'g')), ' ') AS words FROM msg WHERE contains(content, '?')),
x AS (SELECT episode, pos, list_concat(list_concat([low], words), CASE WHEN list_has_any(words, ['what', 'where', 'who', 'when', 'how', 'why']) THEN list_concat(list_concat(CASE WHEN contains(low, 'name') THEN ['is', 'called'] ELSE [] END, CASE WHEN contains(low, 'live') OR contains(low, 'location') THEN ['in', 'from', 'at'] ELSE [] END), list_concat(CASE WHEN contains(low, 'dog') OR contains(low, 'pet') THEN ['named', 'has'] ELSE [] END, CASE WHEN contains(low, 'color') OR contains(low, 'favourite') OR contains(low, 'favorite') THEN ['likes', 'prefers', 'is'] ELSE [] END)) ELSE [] END) AS t FROM w)
SELECT episode, pos, len(list_distinct(list_filter(t, lambda s: length(s) > 1)))::INT AS n_terms FROM x""",
)
def retrieve_expanded(spark, folder):
    return said(spark, folder).where(F.col("content").contains("?")).select("episode", F.col("pos").cast("long").alias("pos"), F.size(R.expand_query(F.col("content"))).alias("n_terms"))


SUPPORT_STOPS = ", ".join(q(w) for w in X.SUPPORT_STOPS)


@query(
    "claims_supported",
    rf"""WITH {MESSAGES}, {ITEMS}, c AS (SELECT episode * 1000 + pos AS cid, list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda w: w <> '' AND w NOT IN ({SUPPORT_STOPS}))) AS w FROM msg WHERE role = 'assistant'),
kw AS (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '' AND w NOT IN ({SUPPORT_STOPS}))) AS w FROM k), h AS (SELECT cid, id, count(*) AS n FROM (SELECT cid, unnest(w) AS w FROM c) JOIN kw USING (w) GROUP BY ALL)
SELECT cid, cid IN (SELECT cid FROM h WHERE n >= 3) AS supported FROM c""",
)
def claims_supported(spark, folder):
    claims = said(spark, folder).where("role = 'assistant'").select((F.col("episode") * 1000 + F.col("pos")).alias("cid"), F.col("content").alias("text"))
    return R.supported(claims, items(spark, folder), X.SUPPORT_STOPS)


# --- evaluation --------------------------------------------------------------------------------------------

EXPECTED = f"""{BM25}, ex AS (SELECT qid, list_distinct({TOKENS}) AS expected FROM ask), rt AS (SELECT l.qid, rank, lower(text) AS text, list_filter(expected, lambda w: contains(lower(text), w)) AS hit, expected FROM lex l JOIN knowledge_items USING (id) JOIN ex USING (qid) WHERE rank <= 10),
ev AS (SELECT qid, avg((len(hit) > 0)::INT) AS p, len(list_distinct(flatten(list(hit)))) / any_value(len(expected))::DOUBLE AS r, coalesce(max(CASE WHEN len(hit) > 0 THEN 1.0 / rank END), 0) AS mrr FROM rt GROUP BY qid)"""


@query("evaluate_retrieval", f"WITH {EXPECTED} SELECT qid, round(p, 6)::DOUBLE AS precision_score, round(r, 6) AS recall_score, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0.0 END AS f1, round(mrr, 6)::DOUBLE AS mrr FROM ev")
def evaluate_retrieval(spark, folder):
    a, b = asked(spark, folder), items(spark, folder)
    expected = a.select("qid", F.array_distinct(R.terms(F.col("text"))).alias("expected"))
    got = R.bm25(b, a).join(b.select("id", "text"), "id").select("qid", "rank", "text")
    return M.retrieval_scores(got, expected)


@query(
    "evaluate_paths",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(tgt_text), '[\p{L}\p{N}]+') AS b FROM documents WHERE text IS NOT NULL AND tgt_text IS NOT NULL)
SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) END AS overlap,
  CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(least(len(a), len(b)) / greatest(len(a), len(b))::DOUBLE, 6) END AS hop_accuracy FROM d""",
)
def evaluate_paths(spark, folder):
    d = table(spark, folder, "documents").where("text is not null and tgt_text is not null").select("doc_id", R.terms(F.col("text")).alias("a"), R.terms(F.col("tgt_text")).alias("b"))
    return d.select("doc_id", F.round(M.path_overlap(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(M.hop_accuracy(F.size("a"), F.size("b")), 6).alias("hop_accuracy"))


@query(
    "evaluate_path_order",
    r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(tgt_text), '[\p{L}\p{N}]+') AS b FROM documents WHERE text IS NOT NULL AND tgt_text IS NOT NULL),
l AS (SELECT doc_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0::BIGINT) AS best FROM d
  UNION ALL SELECT doc_id, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(best[k], CASE WHEN k > 1 AND a[i + 1] = b[k - 1] THEN best[k - 1] + 1 ELSE 0 END)))) FROM l WHERE i < len(a))
SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(best[len(b) + 1] / greatest(len(a), len(b))::DOUBLE, 6) END::DOUBLE AS order_accuracy FROM l WHERE i = len(a)""",
)
def evaluate_path_order(spark, folder):
    d = table(spark, folder, "documents").where("text is not null and tgt_text is not null").select("doc_id", R.terms(F.col("text")).alias("a"), R.terms(F.col("tgt_text")).alias("b"))
    return d.select("doc_id", F.round(M.order_accuracy(F.col("a"), F.col("b")), 6).alias("order_accuracy"))


@query(
    "retrieve_context",
    rf"""WITH {FUSED}, w AS (SELECT DISTINCT id, confidence, unnest(regexp_extract_all(lower(coalesce(subject, '') || ' ' || coalesce(predicate, '') || ' ' || coalesce(object, '')), '[\p{{L}}\p{{N}}]+')) AS term FROM fact_triples), qa AS (SELECT DISTINCT qid, unnest({TOKENS}) AS term FROM ask),
hk AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY confidence DESC NULLS LAST, id) AS k FROM (SELECT DISTINCT qid, id, confidence FROM qa JOIN w USING (term))) WHERE k <= 5),
u AS (SELECT qid, text, 'hybrid' AS source, score, 0 AS i FROM fr JOIN knowledge_items USING (id) WHERE rank <= 10 AND text IS NOT NULL UNION ALL SELECT qid, concat_ws(' ', subject, predicate, object), 'facts', coalesce(confidence, 0.5) * 1.5, 1 FROM hk JOIN fact_triples USING (id))
SELECT qid, text, source, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY i, score DESC) AS n FROM u) WHERE n = 1 AND round(score, 6) >= 0.2""",
)
def retrieve_context(spark, folder):
    """Hybrid hits and facts by key words as one list for each query: texts once, facts boosted by 0.5, 0.2 at least."""
    a, b = asked(spark, folder), items(spark, folder)
    hybrid, _ = _hybrid(spark, folder)
    texts = hybrid.join(b.select("id", "text"), "id").where("text is not null").select("qid", "text", "score")
    facts = table(spark, folder, "fact_triples")
    found = R.keyword_search(facts, a).join(facts.select("id", F.concat_ws(" ", "subject", "predicate", "object").alias("text")), "id").select("qid", "text", F.coalesce("confidence", F.lit(0.5)).alias("score"))
    return R.merge_lists([("hybrid", texts), ("facts", found)], {"facts": 0.5}).where("score >= 0.2")
