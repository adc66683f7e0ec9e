"""Keyed state, safety rules as data, and operators whose keys may be hot, against hand-made and brute-force results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallix.functions import text as X
from recallix.operators import memory as M
from recallix.operators import records as D
from recallix.operators import retrieval as R
from recallix.operators import rules as Ru
from recallix.operators import state as St
from recallix.operators import uncertainty as U
from recallix.plans import state as plans


def test_append_goes_on_from_the_highest_id(spark):
    rows = spark.createDataFrame([(5, "a", 0.5), (9, "b", None)], "id bigint, text string, confidence double")
    new = spark.createDataFrame([(2, "d", 1), (1, "c", 1)], "seq bigint, text string, other int")
    got = [tuple(r) for r in St.append(rows, new, "id", "seq", {"confidence": F.lit(0.9)}).orderBy("id").collect()]
    assert got == [(5, "a", 0.5), (9, "b", None), (10, "c", 0.9), (11, "d", 0.9)]
    assert St.append(rows.limit(0), new, "id", "seq").count() == 2 and St.append(rows, new.limit(0), "id", "seq").count() == 2


def test_merged_maps(spark):
    log = spark.createDataFrame([("u", 1, '{"a": 1, "b": "x"}'), ("u", 2, '{"a": 2}'), ("u", 3, "junk"), ("v", 1, None)], "k string, at bigint, m string")
    assert {tuple(r) for r in St.merged_maps(log, "k", "at", "m").collect()} == {("u", "a", "2"), ("u", "b", "x")}


def test_evolution(spark):
    state = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n int")
    rules = spark.createDataFrame([("one", 1, 1, {"tone": "x", "w": "1"}), ("two", 2, 2, {"tone": "y"})], "name string, order int, least int, effect map<string,string>")
    got = {r.k: (r.fired, r.overrides) for r in St.evolve(state, rules, "k", F.col("n") >= F.col("least")).collect()}
    assert got == {"a": (["one", "two"], {"tone": "y", "w": "1"}), "b": (["one"], {"tone": "x", "w": "1"})}


def test_safety_rules(spark):
    names = [r[0] for r in X.safety_rules(remove=["phone"], blocked=["secret"], add=[("loud", "!!", "warning", None)])]
    assert "phone" not in names and names[-2:] == ["custom_0", "loud"]
    df = spark.createDataFrame([(1, "my SECRET plan"), (2, "wow!! 4111-1111-1111-1111"), (3, None), (4, "")], "id int, t string")
    level = lambda rules: {r.id: r.s.level for r in df.select("id", X.safety(F.col("t"), rules).alias("s")).collect()}
    assert level(X.safety_rules(blocked=["secret"])) == {1: "blocked", 2: "blocked", 3: "safe", 4: "safe"}
    assert level(X.safety_rules(remove=["credit_card"], add=[("loud", "!!", "warning", None)])) == {1: "safe", 2: "warning", 3: "safe", 4: "safe"}
    assert set(level([]).values()) == {"safe"}
    assert level(X.safety_rules(base=[], add=[("long", F.length("t") > 20, "blocked", None)]))[2] == "blocked"


def test_descendants_end_by_themselves(spark):
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(20)] + [("n0", "n20"), ("x", "x")], "child string, parent string")
    got = {(r.ancestor, r.node): r.steps for r in Ru.descendants(chain, itself=True).collect()}
    assert got[("n0", "n20")] == 20 and got[("n20", "n19")] == 20 and got[("x", "x")] == 0 and len(got) == 21 * 21 + 1
    asked = spark.createDataFrame([("n5", "n1"), ("n5", "n5"), ("x", "n1"), ("new", "new"), ("new", "n1")], "name string, ancestor string")
    assert {(r.name, r.ancestor): r.holds for r in St.subclass_tests(chain, asked).collect()} == {("n5", "n1"): True, ("n5", "n5"): True, ("x", "n1"): False, ("new", "new"): True, ("new", "n1"): False}


@pytest.mark.parametrize("base, block", [(50_000, 1000), (20, 7)])
def test_revision_impact_in_shards(spark, base, block):
    rng = random.Random(3)
    snaps = [(t, round(rng.random(), 3)) for t in sorted(rng.sample(range(1000), 200))]
    events = [(f"e{i}", rng.randrange(-5, 1010)) for i in range(40)]
    got = {r.event: r for r in D.revision_impact(spark.createDataFrame(snaps, "at bigint, score double"), spark.createDataFrame(events, "event string, at bigint"), base=base, block=block).collect()}
    for name, at in events:
        before, later = [s for t, s in snaps if t <= at][-3:], [(t, s) for t, s in snaps if t > at]
        mean = sum(before) / len(before) if before else None
        back = next((t for t, s in later if mean is not None and s >= 0.95 * mean), None)
        r = got[name]
        assert (r.before is None) == (mean is None) and (mean is None or r.before == pytest.approx(mean))
        assert r.after == (later[0][1] if later else None) and r.recovered_at == back


def test_counterfactuals_of_a_hot_relation(spark):
    edges = spark.createDataFrame([(i, "r", i + 1000) for i in range(300)], "s bigint, r string, t bigint")
    one, cut = ({tuple(r) for r in D.counterfactual_tests(edges, 1000, base=b).collect()} for b in (50_000, 20))
    assert one == cut and len(one) == 299 and not one & {(i, "r", i + 1000) for i in range(300)}


def test_dense_topk_in_rounds(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 64))
    v[50:60] = v[50]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 64), (1002, [1.0])], "id bigint, vector array<double>").repartition(3)
    ask = spark.createDataFrame([(f"q{i}", v[i].tolist()) for i in range(45, 65)], "qid string, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(f"q{i}", j, n + 1) for i in range(45, 65) for n, j in enumerate(sorted(range(400), key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:7])}
    for how in ({}, {"most": 6, "block": 16}):
        assert {(r.qid, r.id, r["rank"]) for r in R.dense_topk(rows, ask, 7, **how).collect()} == want
    assert R.dense_topk(rows, ask.limit(0), 7).count() == 0 and R.dense_topk(rows.limit(0), ask, 7).count() == 0


def test_limits(spark):
    rows = lambda data, third: spark.createDataFrame(data, f"key int, tier string, {third} bigint")
    got = {(r.key, r.tier): (r.limit_tokens, r.accepted) for r in M.limits_updated(rows([(1, "active", 2000), (1, "archive", 3000), (2, "active", 2000)], "limit_tokens"), rows([(1, "active", 1500)], "tokens"), rows([(1, "active", 1400), (1, "archive", 1000)], "limit_tokens")).collect()}
    assert got == {(1, "active"): (2000, False), (1, "archive"): (1000, True), (2, "active"): (2000, None)}


def test_long_conversation_folds(spark):
    talk = [(1, i, "user", f"message {i} of the talk", 3.0, 5, float(i)) for i in range(4000)] + [(2, 0, "system", "rules", 9.0, 5, None)]
    df = spark.createDataFrame(talk, "episode bigint, pos int, role string, content string, importance double, tokens int, at double").repartition(5)
    got = M.tier_cascade(df, (50, 60, 70)).collect()
    assert len(got) == 4001 and {r.tier for r in got} == {"active", "working", "archive", "dropped"}
    assert [r.pos for r in got if r.episode == 1 and r.tier == "active"][-1] == 3999
    assert {r.episode: r.before for r in M.progressive(df, 60).collect()} == {1: 20_000, 2: 5}
    n = {r.episode: r.queries for r in M.dynamic_weights(df.select("episode", "pos", F.lit(0.8).alias("complexity"), F.lit("code").alias("kind"))).collect()}
    assert n == {1: 4000, 2: 1}


def test_incomplete_answers(spark):
    rows = spark.createDataFrame([("p", "x", "s", None, 0.9, 1), ("p", "y", "s", "t", 0.3, 2), ("q", "z", None, None, 0.9, 3), ("r", "w", "s", None, None, 4)], "k string, a string, f string, g string, c double, id int")
    got = {r.k: (r.answer, r.confidence, r.complete) for r in U.incomplete_answer(rows, ["k"], "a", ["f", "g"], "c", "id").collect()}
    assert got == {"p": ("y", 0.3, True), "q": ("Unknown", 0.1, False), "r": ("w", 0.2, False)}


def test_strategies(spark, small):
    plans.STRATEGIES["own"] = lambda spark, folder: spark.createDataFrame([("q", 1, 1)], "qid string, id bigint, rank int")
    assert plans.search("own", spark, small).count() == 1
    del plans.STRATEGIES["own"]
    with pytest.raises(ValueError):
        plans.search("own", spark, small)


def test_memory_round_trip(spark):
    df = spark.createDataFrame([(1, 0, "user", 'say "hi"\n', 3.0, 2, None)], "episode bigint, pos int, role string, content string, importance double, tokens int, at double")
    saved = St.save_memory(df, "episode")
    assert [tuple(r) for r in St.restore_memory(saved, "episode").collect()] == [tuple(r) for r in df.collect()]
    assert St.restore_memory(saved.withColumn("line", F.lit("junk")), "episode").count() == 0


def test_schemas(spark):
    from recallix.sources.schema import SCHEMAS, conform, empty

    assert all(empty(spark, n).count() == 0 for n in SCHEMAS)
    rows = spark.createDataFrame([("7", "x", "high"), ("no", None, "0.5")], "id string, text string, confidence string").withColumn("extra", F.lit(1))
    got = conform(rows, "knowledge_items", {"source": "here"})
    assert got.dtypes == empty(spark, "knowledge_items").dtypes
    assert [tuple(r)[:5] for r in got.collect()] == [(7, "x", None, None, "here"), (None, None, 0.5, None, "here")]


def test_profiled_runs(spark):
    from recallix.operators.profiles import aggregate_runs, profiled

    runs = []

    @profiled(runs, "walk")
    def f(x):
        return 1 / x

    assert f(2) == 0.5
    with pytest.raises(ZeroDivisionError):
        f(0)
    assert aggregate_runs(spark.createDataFrame(runs, "kind string, at double, took double"), "kind", "took").first().n == 2


def test_events_reach_their_handlers(spark, tmp_path):
    from recallix.streaming.ingest import emit

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, kind string").write.parquet(str(tmp_path / "in"))
    got, bad = [], lambda batch: 1 / 0
    stream = spark.readStream.schema("id int, kind string").parquet(str(tmp_path / "in"))
    failed = emit(stream, "kind", {"a": [bad, lambda batch: got.extend(r.id for r in batch.collect())], "b": []}, str(tmp_path / "state"))
    assert sorted(got) == [1, 3] and failed["a"] >= 1 and failed["b"] == 0
