"""Extraction and records on hand-made inputs."""

import json

from pyspark.sql import functions as F

from recallix.functions import extraction as E
from recallix.operators import records as D
from recallix.plans import catalogue


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_entities(spark):
    got = {tuple(x) for x in one(spark, "Mail a@b.org by 12/03/2024 at 9:30, pay $5.50 or 7% of 40 #now @you https://x.org/1", E.entities)}
    assert got == {("EMAIL", "a@b.org"), ("DATE", "12/03/2024"), ("TIME", "9:30"), ("MONEY", "$5.50"), ("PERCENTAGE", "7%"), ("NUMBER", "40"), ("HASHTAG", "#now"), ("MENTION", "@you"), ("URL", "https://x.org/1")}
    assert one(spark, None, E.entities) == [] and one(spark, "", E.entities) == []
    assert {tuple(x) for x in one(spark, "C++ and Python, not python, use deep learning", E.domain_terms)} == {("PROGRAMMING_LANGUAGE", "C++"), ("PROGRAMMING_LANGUAGE", "Python"), ("AI_ML_TERM", "deep learning")}


def test_questions(spark):
    assert tuple(one(spark, "What is the connection between Ann Lee and Bo?", E.entity_pair)) == ("Ann Lee", "Bo")
    assert tuple(one(spark, "How are cats and dogs related?", E.entity_pair)) == ("cats", "dogs related") and one(spark, "Hi", E.entity_pair) is None
    assert tuple(one(spark, "Why sky is blue?", E.fact_of_question)) == ("sky", "is_a", "blue")
    assert tuple(one(spark, "why dog has fur?", E.fact_of_question)) == ("dog", "has_property", "fur")
    assert [tuple(x) for x in one(spark, "hello\n📚 Ann knows Bo well\n📚 too short", lambda c: E.marked_facts(c, "📚"))] == [("Ann", "knows", "Bo")]


def test_replies(spark):
    assert one(spark, "I'd say 0.75 or so", E.reply_importance) == 0.75 and one(spark, "none", E.reply_importance) == 0.5
    assert [tuple(x) for x in one(spark, 'Sure: [{"item": 1, "score": 0.9}] ok', E.reply_scores)] == [(1, 0.9)] and one(spark, "no", E.reply_scores) is None
    assert one(spark, "short", lambda c: E.reply_or(c, F.lit("other text"))) == "short" and one(spark, "far too long a reply", lambda c: E.reply_or(c, F.lit("text"))) == "text"
    assert one(spark, "You are kind.", lambda c: E.persona_prompt([c, F.lit(""), F.lit(None).cast("string"), F.lit("Be brief.")])) == "You are kind.\n\nBe brief."
    cross = lambda t, b: one(spark, t, lambda c: E.boundary_crossed(c, F.lit(b)))
    assert (cross("Tell me about My Ex now", "my ex"), cross("we spoke of work stress", "stress at work"), cross("nice day", "my ex")) == ("exact", "keyword_overlap", None)
    assert one(spark, "deep", lambda c: E.trigger_met(c, F.lit(0.9), F.lit(0.1), F.lit("developing"), F.lit(0.5), F.lit(None).cast("double"))) is True
    assert one(spark, "deep", lambda c: E.trigger_met(c, F.lit(0.2), F.lit(0.1), F.lit(None).cast("string"), F.lit(0.5), F.lit(None).cast("double"))) is False


def test_small_ones(spark):
    r = spark.createDataFrame([(["b", "a", "b"], ["x", "y"])], "t array<string>, p array<string>")
    assert r.select(E.pattern_key(F.col("t"), F.col("p")).alias("x")).first().x == r.select(E.pattern_key(F.array(F.lit("a"), F.lit("b")), F.col("p")).alias("x")).first().x
    assert r.select(E.hit_rate(F.lit(3), F.lit(1)).alias("x"), E.hit_rate(F.lit(0), F.lit(0)).alias("y")).first() == (75.0, 0.0)
    none = F.array().cast("array<string>")
    assert r.select(E.profile_summary(F.lit("Ann"), F.col("p"), none, none, F.col("t")).alias("x")).first().x == "Name: Ann\nInterests: x, y\nBoundaries: 3 recorded"
    assert r.select(E.profile_summary(F.lit(None).cast("string"), none, none, none, none).alias("x")).first().x == "No profile information yet."


def test_records(spark, tmp_path):
    heads = spark.createDataFrame([(1, "meeting", 5.0), (2, "sale", 9.0)], "id bigint, relation_type string, timestamp double")
    parts = spark.createDataFrame([(1, 10, "host"), (1, 11, "guest"), (1, 12, "guest"), (2, 10, "seller")], "relationship_id bigint, entity_id bigint, role string")
    names = spark.createDataFrame([(10, "Ann"), (11, "Bo"), (12, "Cy")], "id bigint, entity string")
    assert {r.id: r.participants for r in D.nary(heads, parts, names).collect()} == {1: {"guest": ["Bo", "Cy"], "host": ["Ann"]}, 2: {"seller": ["Ann"]}}
    assert [r.id for r in D.nary_query(heads, parts, entity=10).collect()] == [2, 1]
    assert [r.id for r in D.nary_query(heads, parts, relation="meeting", entity=10, role="host").collect()] == [1] and D.nary_query(heads, parts, entity=11, role="host").count() == 0
    e = spark.createDataFrame([(1, 5, 0.5), (2, 6, 0.5)], "rel_id bigint, t bigint, c double")
    new, log = D.revise_beliefs(e, spark.createDataFrame([(1, 7, 0.8, 1), (1, 8, 0.9, 2)], "rel_id bigint, value bigint, certainty double, at bigint"))
    assert {tuple(r) for r in new.collect()} == {(1, 8, 0.9), (2, 6, 0.5)} and [(r.before, r.after) for r in log.collect()] == [(5, 8)]
    dist = spark.createDataFrame([(1, 1, 1, "discrete", '{"a": 0.4}'), (2, 1, 1, "discrete", '{"a": 0.7, "b": 0.3}')], "id bigint, entity_id bigint, relation_id bigint, distribution_type string, distribution_data string")
    assert D.latest_distribution(dist).first().distribution == {"a": 0.7, "b": 0.3}
    snaps = spark.createDataFrame([(1, 1.0), (2, 0.8), (3, 0.9), (4, 0.5), (5, 0.7), (6, 0.9)], "at bigint, score double")
    hit = D.revision_impact(snaps, spark.createDataFrame([("x", 3)], "event string, at bigint")).first()
    assert (round(hit.before, 6), hit.after, hit.recovered_at) == (0.9, 0.5, 6)
    chain = spark.createDataFrame([("c", 1, ["a", "b"]), ("c", 2, ["d"])], "chain string, pos int, words array<string>")
    assert D.reasoning_chain(chain, chain.where("pos = 1")).first().score == 0.5
    D.write_json(names, str(tmp_path / "n"))
    assert D.read_json(spark, str(tmp_path / "n"), "id bigint, entity string").count() == 3
    edges = spark.createDataFrame([("a", "r", "b"), ("c", "r", "d"), ("e", "r", "f")], "s string, r string, t string")
    false = {tuple(r) for r in D.counterfactual_tests(edges, 5).collect()}
    assert false and not false & {("a", "r", "b"), ("c", "r", "d"), ("e", "r", "f")}


def test_emotion_of_all_documents(spark, small, tmp_path):
    texts = [("so happy 😭😭😭", "de"), ("I AM SO ANGRY AND FURIOUS", "EN"), ("Happy! Happy! Happy!", None), ("Café: I am very happy", "en_US"), ("no words of mood", "fr"), (None, "en")]
    rows = [(i, t, x) for i, (t, x) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.primary_emotion for r in catalogue.QUERIES["text_emotion"](spark, str(tmp_path)).collect()}
    assert got == {0: "sadness", 1: "anger", 2: "joy", 3: "joy", 4: "neutral", 5: "neutral"}
    assert catalogue.QUERIES["text_emotion"](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_facts_of_written_texts(spark, tmp_path):
    said = ["My name is Ann.", "📚 Ann knows Bo well", "How are cats and dogs related?", None]
    spark.createDataFrame([(7, "s", "u", json.dumps([{"id": i, "role": "user", "content": x, "timestamp": 1.0} for i, x in enumerate(said)])), (8, "s", "u", "[{")], "id bigint, session_id string, user_id string, messages string").write.parquet(str(tmp_path / "episodes.parquet"))
    spark.createDataFrame([(1, "Call me Bea!\nnow"), (2, "note\n📚 Bo likes tea"), (3, "What is the connection between Ann Lee and Bo?"), (4, None)], "id bigint, text string").write.parquet(str(tmp_path / "knowledge_items.parquet"))
    got = lambda name: {tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("text_personal_facts") == {("episodes", 7, 0, "name", "Ann"), ("knowledge_items", 1, 0, "name", "Bea")}
    assert got("extract_marked_facts") == {("episodes", 7, 1, "Ann", "knows", "Bo"), ("knowledge_items", 2, 0, "Bo", "likes", "tea")}
    assert got("extract_entity_pairs") == {("episodes", 7, 2, "cats", "dogs related"), ("knowledge_items", 3, 0, "Ann Lee", "Bo")}
