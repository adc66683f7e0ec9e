"""The reference's own operators on small hand-made inputs with expected values worked out by hand."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from recallix.functions import metrics as M
from recallix.functions import text as X
from recallix.functions.similarity import ratio
from recallix.operators import graph as G
from recallix.operators import memory as Mem
from recallix.operators import profiles as P
from recallix.operators import retrieval as R
from recallix.operators import rules as Ru
from recallix.operators import store as S
from recallix.operators import temporal as T
from recallix.operators import uncertainty as U
from recallix.streaming import ingest as I


def edges(spark, rows):
    return spark.createDataFrame([(i, s, t, r, w, c) for i, (s, r, t, w, c) in enumerate(rows)], "rel_id bigint, s string, t string, r string, w double, c double")


SCIENCE = [("Albert Einstein", "developed", "Theory of Relativity", 0.9, 0.95), ("Albert Einstein", "received", "Nobel Prize", 0.8, 0.9), ("Albert Einstein", "worked_at", "Princeton", 0.7, 0.85), ("Marie Curie", "discovered", "Radium", 0.9, 0.95), ("Marie Curie", "received", "Nobel Prize", 0.8, 0.9), ("Marie Curie", "worked_at", "Paris", 0.7, 0.85)]
TYPED = [("A", "related_to", "B", 1.0, 1.0), ("B", "related_to", "C", 1.0, 1.0), ("A", "causes", "D", 1.0, 1.0), ("D", "causes", "E", 1.0, 1.0), ("E", "causes", "F", 1.0, 1.0), ("B", "causes", "E", 1.0, 1.0), ("D", "related_to", "B", 1.0, 1.0)]


def test_graph(spark):
    e = edges(spark, SCIENCE)
    one = spark.createDataFrame([("Albert Einstein",)], "seed string")
    paths = G.simple_paths(e, one).collect()
    assert {(p.goal, p.hops) for p in paths} == {("Theory of Relativity", 1), ("Nobel Prize", 1), ("Princeton", 1)}
    best = G.neighbours(e, one, 2).orderBy("rank").collect()
    assert [b.node for b in best] == ["Theory of Relativity", "Nobel Prize"]
    t = edges(spark, TYPED)
    a = spark.createDataFrame([("A",)], "seed string")
    found = {(p.goal, tuple(p.path)) for p in G.simple_paths(t, a).collect()}
    assert ("E", ("A", "B", "E")) in found and ("E", ("A", "D", "E")) in found and ("B", ("A", "D", "B")) in found
    assert G.explain(G.simple_paths(t, a).where("goal = 'F'")).orderBy("text").first().text == "A -causes-> D -causes-> E -causes-> F"
    stats = G.partition_stats(t, G.weak_components(t)).collect()
    assert [(s.nodes, s.edges, s.density) for s in stats] == [(6, 7, round(7 / 30, 6))]
    assert {(r.r1, r.r2): r.n for r in G.two_hop_patterns(t, 1).collect()} == {("related_to", "related_to"): 2, ("related_to", "causes"): 2, ("causes", "causes"): 3, ("causes", "related_to"): 1}
    met = {tuple(r.path) for r in G.meeting_paths(t, spark.createDataFrame([("A", "E")], "start string, goal string")).collect()}
    assert met == {("A", "B", "E"), ("A", "D", "E"), ("A", "D", "B", "E")}
    close = {(r.s, r.t): (round(r.w, 3), round(r.c, 3), r.hops) for r in G.closure(t, "causes").collect()}
    assert close[("A", "F")] == (0.64, 0.81, 3)
    assert {(r.node, r.hops) for r in G.hop_distances(t, a).collect()} == {("A", 0), ("B", 1), ("D", 1), ("C", 2), ("E", 2), ("F", 3)}
    beam = G.simple_paths(t, a, beam=1, by="cost").collect()
    assert [p.goal for p in sorted(beam, key=lambda p: p.hops)] == ["B", "C"]
    twice = edges(spark, [("x", "r", "y", 0.5, 0.5), ("x", "q", "y", 0.7, 0.9), ("x", "p", "z", 0.1, 0.9)])
    assert [tuple(r) for r in G.contract(twice).collect()] == [("x", "y", 0.6, 0.7, "q & r", 2)]
    empty = t.limit(0)
    assert G.simple_paths(empty, a).count() == 0 and G.closure(empty, "causes").count() == 0 and G.neighbours(empty, a).count() == 0


TAXONOMY = [("mammal", "is_a", "animal"), ("bird", "is_a", "animal"), ("dog", "is_a", "mammal"), ("cat", "is_a", "mammal"), ("eagle", "is_a", "bird"), ("mammal", "has_property", "fur"), ("mammal", "has_property", "warm_blooded"), ("bird", "has_property", "feathers"), ("bird", "has_property", "warm_blooded")]


def test_rules(spark):
    f = spark.createDataFrame(TAXONOMY, "s string, r string, o string")
    rules = [Ru.transitive("is_a", 0.9), Ru.transitive("part_of"), Ru.inherited("has_property", "is_a")]
    new = Ru.forward_chain(f, rules).collect()
    assert sorted((n.r, n.s) for n in new).__len__() == 9
    assert {n.s for n in new if n.r == "is_a"} == {"dog", "cat", "eagle"} and sum(n.r == "has_property" for n in new) == 6
    fly = Ru.forward_chain(f, [*rules, Ru.Rule("fly", (("?x", "is_a", "bird"),), ("?x", "can_fly", "true"))]).where("r = 'can_fly'").collect()
    assert [n.s for n in fly] == ["eagle"]
    goals = spark.createDataFrame([("dog", "animal"), ("animal", "dog"), ("eagle", "bird")], "s string, o string")
    assert {(g.s, g.o): (g.proved, g.steps) for g in Ru.backward_chain(f, goals, "is_a").collect()} == {("dog", "animal"): (True, 2), ("animal", "dog"): (False, None), ("eagle", "bird"): (True, 1)}
    seen = spark.createDataFrame([("dog", "has_property", "fur")], "s string, r string, o string")
    why = Ru.abduce(f, seen, [Ru.inherited("has_property", "is_a")]).orderBy("rank").collect()
    assert (why[0].hypothesis, why[0].confidence) == ("dog is_a mammal", 0.72)
    assert {(d.ancestor, d.node) for d in Ru.descendants(f.where("r = 'is_a'").select(F.col("s").alias("child"), F.col("o").alias("parent"))).collect()} >= {("animal", "dog"), ("animal", "eagle"), ("mammal", "cat")}
    assert Ru.match(spark.createDataFrame([("a", "r", "a"), ("a", "r", "b")], "s string, r string, o string"), ("?x", "r", "?x")).count() == 1
    assert Ru.forward_chain(f.limit(0), rules).count() == 0


def test_temporal(spark):
    f = spark.createDataFrame([(1, "alice", "lives_in", "New York", 10, 20, None), (2, "alice", "lives_in", "San Francisco", 20, None, None), (3, "bob", "works_at", "Acme", 12, None, 4), (4, "bob", "works_at", "Beta", 18, 25, None)], "id bigint, subject string, predicate string, object string, a bigint, z bigint, by bigint")
    at = lambda t: {r.object for r in T.as_of(f, F.lit(t), "a", "z").collect()}
    assert at(15) == {"New York", "Acme"} and at(20) == {"San Francisco", "Acme", "Beta"}
    assert {r.object for r in T.as_of(f, F.lit(30), "a", "z", "by").collect()} == {"San Francisco"}
    assert {r.id: r.overlaps for r in T.overlap_counts(f, ["subject", "predicate"], "id", "a", "z").collect()} == {1: 0, 2: 0, 3: 1, 4: 1}
    assert {r.id: r.z for r in T.close_superseded(f, "id", "by", "a", "z").collect()}[3] == 18


def test_uncertainty(spark):
    c = spark.createDataFrame([(1, "e", "x", 1.0, 5.0, "s1"), (2, "e", "y", 1.0, 9.0, "s2"), (3, "e", "x", 0.2, None, None), (4, "f", "z", 0.5, 1.0, "s1")], "id bigint, k string, v string, c double, ts double, src string")
    pairs = U.rivals(c, ["k"], "v", "id", "c")
    assert {(r.id, r.rival_id) for r in pairs.collect()} == {(1, 2), (2, 1), (3, 2)}
    both = {r.id: (r.resolved, r.certainty) for r in U.resolve(pairs, "keep_both", "v", "c", "ts", "src").collect()}
    assert both[1] == ("x OR y", 0.9)
    assert {r.id: r.resolved for r in U.resolve(pairs, "confidence", "v", "c", "ts", "src").collect()}[1] == "y"
    rel = spark.createDataFrame([("s1", 0.9), ("s2", 0.1)], "source string, reliability double")
    auto = {r.id: (r.strategy, r.resolved) for r in U.resolve(pairs, "auto", "v", "c", "ts", "src", rel).collect()}
    assert auto[1] == ("reliability", "x") and auto[3] == ("confidence", "y")
    assert {r.id for r in U.apply_resolution(c, U.resolve(pairs, "recency", "v", "c", "ts", "src"), "id").collect()} == {2, 4}


def test_store(spark):
    log = spark.createDataFrame([("u", 1, "Ann", "m1"), ("u", 2, None, "m2"), ("v", 1, None, None)], "user string, ts int, name string, meta string")
    assert {r.user: (r.name, r.meta) for r in S.last_wins(log, ["user"], ["ts"], ["name"]).collect()} == {"u": ("Ann", "m2"), "v": (None, None)}
    e = spark.createDataFrame([(1, "Red Fox"), (2, "fox"), (3, None), (4, "FOX")], "id bigint, entity string")
    assert {(r.child, r.parent) for r in S.token_containment(e, "id", "entity").collect()} == {(1, 2), (1, 4)}
    asked = spark.createDataFrame([(9, "fox"), (8, "Fox"), (7, "cat")], "qid bigint, name string")
    assert {(r.qid, r.id, r.tier) for r in S.resolve_names(e, "id", "entity", asked).collect()} == {(9, 2, 0), (8, 2, 1)}
    assert S.fuzzy_merge(spark.createDataFrame([(1, "Marie Curie"), (2, "marie curie"), (3, "Marie Currie"), (4, "Mary Poppins"), (5, None)], "id bigint, entity string"), "id", "entity").orderBy("id").collect().__len__() == 4
    merged = {r.id: (r.canonical, r.score) for r in S.fuzzy_merge(spark.createDataFrame([(1, "Marie Curie"), (2, "marie curie"), (3, "Marie Currie"), (4, "Mary Poppins")], "id bigint, entity string"), "id", "entity").collect()}
    assert merged[2] == (1, 100.0) and merged[3][0] == 1 and merged[3][1] >= 85 and merged[4] == (4, 100.0)


def test_fuzzy_merge_brute(spark):
    rng = random.Random(3)
    rows = []
    for i in range(0, 900, 3):
        base = "".join(rng.choice("abcdeé ß中") for _ in range(rng.choice([3, 7, 20, 24, 63, 64, 65, 90]))).strip() or "a"
        other = "".join(c for c in base if rng.random() > 0.1)
        rows += [(i, base), (i + 1, other), (i + 2, other[::-1].upper() if i % 2 else base + "xyz"[: i % 4])]
    df = spark.createDataFrame(rows + [(5000, None), (None, "abc")], "id bigint, entity string")
    low = {i: t.lower().strip(" ") for i, t in rows}
    first = {}
    for i, t in sorted(low.items()):
        first.setdefault(t, i)
    want = {}
    for i, t in low.items():
        if t:
            scored = [(-round(100.0 * ratio(t, x), 4), j) for x, j in first.items() if x and j < first[t]]
            score, to = min([s for s in scored if -s[0] >= 85.0], default=(-100.0, first[t]))
            want[i] = (to, -score)
    for most in (1_000_000, 200):
        assert {r.id: (r.canonical, r.score) for r in S.fuzzy_merge(df, "id", "entity", most=most).collect()} == want


def test_fuzzy_merge_of_many(spark):
    # Names that share most three-letter pieces: about 18 million pairs.
    rng = random.Random(4)
    rows = [(i, "".join(rng.sample(["tok", "hek", "afa", "lbu", "sri", "jen"], 6)) + f" Trading Company {rng.randrange(10**6):06d}") for i in range(6000)]
    began = time.time()
    assert S.fuzzy_merge(spark.createDataFrame(rows, "id bigint, entity string"), "id", "entity").count() == 6000
    assert time.time() - began < 60


def test_text(spark):
    def one(text, f):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x

    def mood(text):
        return X.with_emotion(spark.createDataFrame([(text,)], "t string"), "t").first().emotion

    assert mood("I'm so happy and excited today!").primary == "joy"
    assert mood("I'm not happy at all").primary == "sadness"
    assert mood("😭😭😭").primary == "sadness" and mood("The meeting is at 3pm").primary == "neutral" and mood(None).primary == "neutral"
    assert one("My SSN is 123-45-6789", X.safety).asDict() == {"level": "blocked", "rules": ["ssn"], "text": "My SSN is [REDACTED-SSN]"}
    assert one("My card number is 4111 1111 1111 1111", X.safety).text == "My card number is [REDACTED-CC]"
    assert one("My email is john@example.com please contact me", X.safety).level == "warning"
    facts = lambda t: {(f.type, f.value) for f in one(t, X.personal_facts)}
    assert ("relationship_status", "single") in facts("I'm single and looking")
    assert ("routine", "go for a run") in facts("Every morning I go for a run")
    assert ("interest", "astronomy") in facts("I'm really interested in astronomy")
    assert facts("My name is Ann. Call me ann!") == {("name", "Ann")}
    assert one("The cat is a mammal", X.relations)[0].asDict() == {"subject": "cat", "relation": "is_a", "object": "mammal"}
    assert one("def f(): class A: return {} } import os from x const y", X.document_type) == "code"
    assert one("Why do birds fly?", X.query_plan) == "causal" and one("", X.query_plan) == "generic"
    assert one("  ", X.word_count) == 0 and one("a b  c", X.token_estimate) == 3
    assert one("One two three four. I am not one. Short one.", X.claims) == ["One two three four."]
    assert one("x" * 100_000, X.query_complexity) > 0


def test_memory(spark):
    s = lambda p, text, imp=3.0, tok=None, role="user": Mem.Segment(p, role, text, imp, tok or len(text.split()), float(p))
    t = Mem.Tiers((10, 10, 10))
    for i in range(8):
        t.add(s(i, "one two three four five six"))
    t.add(s(99, "keep me", 9.5, 2, "system"))
    assert {x.pos for x in t.tiers[0]} >= {99} and sum(map(t.used, range(3))) <= 30
    assert all(t.used(i) <= t.limits[i] for i in range(3))
    assert Mem.compress(s(1, "a b c d e f g h i j", 8.5), 0.3).text == "a b c d e f g h i j"[:17] + "..."
    long = "Alpha beats beta every time here. " * 4 + "Nothing else to say at all. " + "Alpha wins again over beta now and then for sure. "
    assert len(Mem.extract(long.strip(), 0.4)) <= int(len(long.strip()) * 0.4)
    segments = [s(i, "word " * 40, float(i % 9), 52) for i in range(6)]
    assert sum(x.tokens for x in Mem.compress_to_budget(segments, 150, 0.0)) < 312
    assert Mem.compress_to_budget(segments, 10_000, 0.0) == segments
    assert Mem.optimal_shares(0.5, "text", False) == pytest.approx((0.25, 0.35, 0.4))
    assert Mem.allocate((0.25, 0.35, 0.4), 10_000) == (2500, 3500, 4000)
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 1)], "k int, pos int, tokens int")
    assert [r.pos for r in Mem.fill_context(rows, ["k"], "pos", "tokens", 11).collect()] == [1, 2]


def test_profiles(spark):
    m = spark.createDataFrame([("u", i, "joy", v, 0.1) for i, v in enumerate([0.0, 0.0, 0.5, 0.6, 0.7, 0.8])] + [("w", 1, "fear", -0.5, 0.5)], "k string, n int, primary string, valence double, arousal double")
    t = {r.k: r for r in P.mood_trend(m, "k", [F.desc("n")]).collect()}
    assert (t["u"].direction, t["u"].dominant, t["u"].samples, t["w"].direction) == ("rising", "joy", 6, "stable")
    assert [r.n for r in P.mood_shifts(m, "k", ["n"]).orderBy("n").collect()] == [2, 3, 4, 5]
    said = spark.createDataFrame([("u", "user", "Why?"), ("u", "assistant", "So.")] * 3, "k string, role string, content string")
    got = P.relationships(X.with_emotion(said, "content"), "k").first()
    trust, comfort = 0.0, 0.0
    for i in range(6):
        trust = min(1.0, trust + 0.005 + (0.003 if i % 2 == 0 else 0))
        comfort += (min(1.0, (i + 1) / 200) - comfort) * 0.05
    assert got.trust == pytest.approx(trust) and got.comfort == pytest.approx(comfort) and got.stage == "introduction"


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "a", "c", "e", "d"]), ([], ["a"])], "a array<string>, b array<string>")
    got = df.select(M.common_subsequence(F.col("a"), F.col("b")).alias("n"), M.order_accuracy(F.col("a"), F.col("b")).alias("o"), M.path_overlap(F.col("a"), F.col("b")).alias("p"), M.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert (got[0].n, got[0].o, got[0].p) == (3, 0.6, 0.8) and (got[1].n, got[1].o, got[1].p) == (0, 0.0, 0.0)
    one = spark.createDataFrame([("the cat sat",)], "t string").select(M.answer_score(F.col("t"), F.array(F.lit("cat"))).alias("x"), M.f1(F.lit(0.0), F.lit(0.0)).alias("f"), M.hop_accuracy(F.lit(2), F.lit(3)).alias("h")).first()
    assert (one.x, one.f, round(one.h, 3)) == (1.0, 0.0, 0.667)


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog ran"), (3, "a bird sang"), (4, None), (5, "")], "id bigint, text string")
    q = spark.createDataFrame([(1, "cat"), (2, "zebra"), (3, None)], "qid bigint, text string")
    assert [(r.qid, r.id) for r in R.bm25(docs, q).collect()] == [(1, 1)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, float("nan")]), (6, [3.0, 0.1])], "id bigint, vector array<double>")
    top = R.dense_topk(v, v.where("id in (1, 3)").withColumnRenamed("id", "qid"), 2, 2, block=2).orderBy("rank").collect()
    assert [(r.qid, r.id) for r in top] == [(1, 1), (1, 6)]
    assert R.bm25(docs.limit(0), q).count() == 0 and R.dense_topk(v.limit(0), v.limit(0).withColumnRenamed("id", "qid"), 2, 2).count() == 0


def test_supported(spark):
    rng = random.Random(9)
    words = [f"w{min(int(rng.paretovariate(0.5)), 300)}" for _ in range(3000)]
    told = [(i % 180, " ".join(rng.sample(words, rng.randrange(0, 7)))) for i in range(200)] + [(900, None), (901, "the the w1 w1")]
    known = [(i, " ".join(rng.sample(words, rng.randrange(0, 9)))) for i in range(150)] + [(500, None), (501, "")]
    claims, items = spark.createDataFrame(told, "cid bigint, text string"), spark.createDataFrame(known, "id bigint, text string")
    good = {c for c, t in told for _, k in known if len(set((t or "").split()) & set((k or "").split())) >= 3}
    assert 20 < len(good) < 160
    for how in ({}, {"rare": 3}, {"rare": 3, "most": 10}, {"rare": 0}):
        assert sorted(tuple(r) for r in R.supported(claims, items, ["the"], **how).collect()) == sorted((c, c in good) for c, _ in told)
    assert {r.supported for r in R.supported(claims, items.limit(0), []).collect()} == {False} and R.supported(claims.limit(0), items, []).count() == 0


def shuffled(spark, act):
    """What act returns, and the bytes it shuffles with joins as for large tables."""

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return act(), written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_supported_in_proportion(spark):
    # Two of three common words in every item, never all three; a claim has all three and a word of its own.
    claims = spark.createDataFrame([(i, f"x y z claim{i}") for i in range(3000)], "cid bigint, text string")
    items = spark.createDataFrame([(i, ["x y", "x z", "y z"][i % 3] + (f" claim{i}" if i < 5 else "")) for i in range(3000)], "id bigint, text string")
    got, written = shuffled(spark, lambda: R.supported(claims, items, []).where("supported").collect())
    assert {r.cid for r in got} == set(range(5)) and written < 5_000_000


def test_consistency_in_proportion(spark, tmp_path):
    from recallix.plans.state import replies_consistency

    said = json.dumps([{"id": 1, "role": "assistant", "content": "xx yy zz own%d", "timestamp": 1.0}])
    spark.createDataFrame([(i, "s", "u", said % i) for i in range(3000)], "id bigint, session_id string, user_id string, messages string").write.parquet(f"{tmp_path}/episodes.parquet")
    items = [(i, ["xx yy", "xx zz", "yy zz"][i % 3] + (f" own{i}" if i < 5 else ""), [0.0]) for i in range(3000)]
    spark.createDataFrame(items, "id bigint, text string, embedding array<float>").write.parquet(f"{tmp_path}/knowledge_items.parquet")
    got, written = shuffled(spark, lambda: replies_consistency(spark, str(tmp_path)).where("consistent").collect())
    assert {(r.episode, r.support) for r in got} == {(i, 1.0) for i in range(5)} and written < 5_000_000


def test_supported_moves_items_once(spark, tmp_path):
    # Items of 60 rare words each; a claim has two of one item's and two of another's, the first five claims three of one's.
    from recallix.plans.state import replies_consistency

    word = lambda i, j: f"w{(i * 60 + j * 7919) % 3001}x"
    texts = [" ".join(word(i, j) for j in range(60)) for i in range(1500)]
    told = [" ".join([word(i, 0), word(i, 1), word(i, 2) if i < 5 else f"own{i}", f"more{i}"]) for i in range(1500)]
    good = {i for i, t in enumerate(told) for k in texts if len(set(t.split()) & set(k.split())) >= 3}
    assert set(range(5)) <= good and len(good) < 1500
    said = json.dumps([{"id": 1, "role": "assistant", "content": "%s", "timestamp": 1.0}])
    spark.createDataFrame([(i, "s", "u", said % t) for i, t in enumerate(told)], "id bigint, session_id string, user_id string, messages string").write.parquet(f"{tmp_path}/episodes.parquet")
    spark.createDataFrame([(i, t, [0.0]) for i, t in enumerate(texts)], "id bigint, text string, embedding array<float>").write.parquet(f"{tmp_path}/knowledge_items.parquet")
    got, written = shuffled(spark, lambda: replies_consistency(spark, str(tmp_path)).collect())
    assert {r.episode: r.support for r in got} == {i: float(i in good) for i in range(1500)} and written < 1_500_000, written


def test_streams(spark, small):
    rows = spark.createDataFrame([("u", 0.4), ("u", 0.4), ("u", 0.4), ("v", 0.1)], "k string, growth double")
    import tempfile

    folder = tempfile.mkdtemp()
    rows.coalesce(1).write.parquet(f"{folder}/in.parquet")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in.parquet")
    got = {r.k: (r.interactions, r.trust) for r in I.run_once(I.running_trust(stream, "k"), "update", folder).collect()}
    assert got == {"u": (3, 1.0), "v": (1, 0.1)}


def test_links_and_folds(spark):
    e = spark.createDataFrame([(1, "Marie Curie"), (2, "Radium")], "id bigint, entity string")
    alias = spark.createDataFrame([(1, "Madame Curie")], "id bigint, alias string")
    asked = spark.createDataFrame([(1, "Marie Curie"), (2, "madame curie"), (3, "Curie, Marie"), (4, "nobody"), (5, "")], "qid bigint, name string")
    assert {tuple(r) for r in S.link_names(e, "id", "entity", alias, asked).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2)}
    facts = spark.createDataFrame([("u", 1, "name", "Ann"), ("u", 2, "name", "Anna"), ("u", 3, "interest", "chess"), ("u", 4, "interest", "Chess"), ("u", 5, "interest", "art"), ("v", 1, "age", "40")], "k string, at int, type string, value string")
    got = {r.k: r for r in P.profile_fold(facts, "k").collect()}
    assert got["u"].name == "Anna" and got["u"].interest == ["chess", "art"] and got["v"].age == "40" and got["v"].interest == []
    f = spark.createDataFrame(TAXONOMY, "s string, r string, o string")
    asked = spark.createDataFrame([(1, "dog", "is_a", "animal"), (2, "dog", "has_property", "fur"), (3, "x", "is_a", "y")], "qid int, s string, r string, o string")
    why = {(w.qid, w.how): w.support for w in Ru.answer_why(f, asked, [Ru.inherited("has_property", "is_a")]).collect()}
    assert why[(1, "proved")] == "2 steps" and (2, "hypothesis") in why and (3, "proved") not in why
    n = spark.createDataFrame([(1, "Ann"), (2, "Ann Lee"), (3, "Bo")], "id bigint, entity string")
    edge = spark.createDataFrame([(1, 1, 3, "knows", 0.9, 0.9)], "rel_id bigint, s bigint, t bigint, r string, w double, c double")
    found = G.search(edge, n, spark.createDataFrame([(7, "ann")], "qid bigint, name string")).orderBy("rank").collect()
    assert [(r.text, r.score) for r in found] == [("Ann knows Bo", 0.9), ("Ann", 0.4), ("Ann Lee", 0.4)]
