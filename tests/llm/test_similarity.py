"""Similar vectors and near-duplicates against brute force; name variants on written cases."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallix.functions.similarity import common_subsequence, ratio
from recallix.llm.name_variants import Reader, likeness, name_variants
from recallix.llm.near_duplicates import _labels, group_pairs, near_duplicates, word_table
from recallix.llm.similar_vectors import _matcher, _spreader, cut_code, learn_rotation, similar_vectors


def brute(v, ids, k=5, least=0.85):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(v)):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-round(s[i, j], 6), ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order if s[i, j] >= least}
    return out


@pytest.mark.parametrize("load", [1_000_000, 50])
def test_vectors(spark, load):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 64))
    v = np.concatenate([base, base[:200] + rng.normal(0, 0.35, (200, 64)), base[:60] + rng.normal(0, 0.2, (60, 64)), base[:3].repeat(9, 0)]).astype("f4")
    v *= rng.uniform(0.1, 5, (len(v), 1)).astype("f4")
    v[-27:] = np.repeat(v[:3], 9, 0)  # exact copies
    ids = [f"v{i:04}" for i in range(len(v))]
    rows = [("a", i, list(map(float, x))) for i, x in zip(ids, v)]
    rows += rows[5:8]  # repeated rows
    rows += [("a", "null", None), ("a", "short", [1.0] * 63), ("a", "zero", [0.0] * 64), ("a", "nan", [float("nan")] * 64), ("b", "v0001", list(map(float, v[1]))), (None, "x", list(map(float, v[1])))]
    df = spark.createDataFrame(rows, "src string, id string, embedding array<double>").withColumn("key", F.lit(1))
    got = {(r.id_a, r.id_b) for r in similar_vectors(df, load=load).where("src = 'a'").collect()}
    want = brute(v.astype("f8"), ids)
    assert len(got & want) >= 0.97 * len(want)
    cos = lambda a, b: float(np.dot(v[ids.index(a)], v[ids.index(b)]) / np.linalg.norm(v[ids.index(a)]) / np.linalg.norm(v[ids.index(b)]))
    assert all(cos(a, b) >= 0.849 and a < b for a, b in got)
    assert similar_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("low, high", [(0.85, 0.87), (0.87, 0.90), (0.90, 0.97)])
def test_recall_by_band(spark, low, high):
    # Pairs of one band of similarity and no others, among many more vectors than the rotation is fitted to.
    rng = np.random.default_rng(8)
    x, y = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (rng.standard_normal((3000, 64)) for _ in range(2)))
    cosine = rng.uniform(low, high, (3000, 1))
    y -= (x * y).sum(1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [("a", f"{n}{i:04}", v.tolist()) for n, m in (("x", x), ("y", y)) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "src string, id string, embedding array<double>")
    want = {(f"x{i:04}", f"y{i:04}") for i in range(3000) if cosine[i] >= 0.8501}
    got, cut = ({(r.id_a, r.id_b) for r in similar_vectors(df, sample=1500, **k).collect()} for k in ({}, {"load": 500}))
    assert got == cut and len(got & want) >= 0.98 * len(want)


@pytest.mark.parametrize("n, load, radius", [(1000, 10**6, 30), (1000, 90, 30), (1000, 90, 12), (10**6, 10**6, 33)])
def test_probing_misses_no_code(n, load, radius):
    # Every pair within the radius comes out exactly once, whatever the cut and the regions.
    rng = np.random.default_rng(4)
    c = rng.integers(0, 2**63, (300, 2), dtype="u8") * np.uint64(2) + np.uint64(1)
    flips = np.array([sum(1 << int(b) for b in rng.choice(128, rng.integers(0, radius + 3), replace=False)) for _ in range(300)], dtype=object)
    c = np.concatenate([c, c ^ np.array([[int(f) & (2**64 - 1), int(f) >> 64] for f in flips], "u8")])
    cut = cut_code(radius, n, load)
    assert sum(t + 1 for t in cut.limits) > radius and sum(cut.widths) == 128
    batch = pa.RecordBatch.from_arrays([pa.array(["s"] * 600), pa.array([str(i) for i in range(600)]), pa.array(c[:, 0].copy().view("i8")), pa.array(c[:, 1].copy().view("i8"))], names=["src", "id", "c1", "c2"])
    rows = pa.Table.from_batches(list(_spreader(cut)(iter([batch])))).sort_by([("spot", "ascending")])
    got = [tuple(sorted((int(a), int(b)))) for out in _matcher(cut, radius)(iter(rows.to_batches(max_chunksize=1000))) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())]
    far = np.bitwise_count(c[:, None] ^ c[None]).astype("i8").sum(2)
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(600) for j in range(i + 1, 600) if far[i, j] <= radius}


def test_rotation_is_orthogonal():
    c, p = learn_rotation(np.random.default_rng(0).standard_normal((500, 16)), 32)
    assert np.allclose(p[:, :16].T @ p[:, :16], np.eye(16), atol=1e-4) and c.shape == (16,)


def words_of(rng, n):
    return [rng.choice(["the", "of", "and", "to", "a"]) if rng.random() < 0.4 else f"w{rng.randrange(4000)}" for _ in range(n)]


def test_near_duplicates(spark):
    rng = random.Random(6)
    rows = []
    for g in range(120):
        base = words_of(rng, rng.randrange(8, 30))
        for _ in range(rng.choice([1, 1, 2, 3, 5])):
            w = [x for x in base if rng.random() > 0.12]
            w.insert(rng.randrange(len(w) + 1), f"new{rng.randrange(10**6)}")
            rng.shuffle(w)
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else ", ".join(w))
    rows += ["", "too few words", rows[0], rows[0], None]
    data = [("s", i, t) for i, t in enumerate(rows)] + [("t", 0, rows[0]), ("s", None, rows[0])]
    df = spark.createDataFrame(data, "src string, id bigint, text string").withColumn("group", F.lit("x")).withColumn("words", F.lit("y"))
    import re

    sets = {i: set(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in enumerate(rows)}
    sets = {i: s for i, s in sets.items() if len(s) >= 6}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {("s", i, j) for i in sets for j in sets if i < j and find(i) == find(j)}
    groups = near_duplicates(df)
    assert {tuple(r) for r in group_pairs(groups).collect()} == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_common_words_only(spark):
    # No rare word leads anywhere: the labels have to go deep.
    rng = random.Random(1)
    vocabulary = [f"c{i}" for i in range(40)]
    rows = [("s", i, " ".join(rng.sample(vocabulary, 12))) for i in range(300)]
    rows += [("s", 1000 + i, rows[i][2] + " extra") for i in range(30)]
    got = {(r.id_a, r.id_b) for r in group_pairs(near_duplicates(spark.createDataFrame(rows, "src string, id bigint, text string"), leaf=8)).collect()}
    assert sum((i, 1000 + i) in got for i in range(30)) >= 27


def test_common_words_recall(spark):
    # Pairs of exactly 0.6 whose words are all common, with labels of several words.
    rng = random.Random(3)
    vocabulary = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = rng.sample(vocabulary, 15)
        rows += [("s", 2 * i, " ".join(w[:12])), ("s", 2 * i + 1, " ".join(w[:9] + w[12:]))]
    got = {r.id: r.group for r in near_duplicates(spark.createDataFrame(rows, "src string, id bigint, text string"), leaf=1).collect()}
    assert sum(2 * i in got and got[2 * i] == got.get(2 * i + 1) for i in range(400)) >= 392


def test_comparisons_do_not_grow():
    # Words that occur together, ten times as many records: the regions and what is compared in them stay the same.
    def per_record(n):
        rng = np.random.default_rng(1)
        topics = rng.permutation(200_000).reshape(-1, 20)[: n // 50]
        lists = [sorted({f"w{x}" for x in rng.choice(topics[rng.integers(len(topics))], 8, replace=False)} | {f"f{x}" for x in (rng.zipf(1.3, 4) % 100_000)}) for _ in range(n)]
        count = {}
        for x in lists:
            for w in x:
                count[w] = count.get(w, 0) + 1
        often = sorted((int(pd.util.hash_array(np.array([w], dtype=object), categorize=False)[0]), c) for w, c in count.items() if c > 48)

        class Table:
            value = np.array([h for h, _ in often], "u8"), np.array([c for _, c in often], "f8")

        batch = pa.RecordBatch.from_arrays([pa.array(["s"] * n), pa.array(np.arange(n)), pa.array(lists)], names=["src", "id", "words"])
        keys = np.concatenate([out["key"].to_numpy() for out in _labels(Table, n, 48, 192, 0.6, 0.99, 4, 5)(iter([batch]))])
        sizes = np.unique(keys, return_counts=True)[1].astype("f8")
        return (sizes * (sizes - 1) / 2).sum() / n, sizes.max()

    (small, most), (large, most10) = per_record(3_000), per_record(30_000)
    assert large <= 3 * small + 50 and most10 <= 3 * most + 200


def test_word_table(spark):
    counts = spark.createDataFrame([(f"w{i}", i) for i in range(1, 201)], "w string, count bigint")
    assert [(leaf, len(h)) for leaf, h, _ in (word_table(counts, 48, m) for m in (1000, 152, 151, 100, 10))] == [(48, 152), (48, 152), (64, 136), (128, 72), (256, 0)]


@pytest.mark.parametrize("how", [{}, {"block": 3000, "every": 1}, {"most_common": 5}])
def test_hot_group(spark, how):
    # Each member has a word of its own: nothing rare is shared, and the shared words are in every member.
    shared = " ".join(f"c{i}" for i in range(11))
    rng = random.Random(4)
    rows = [("s", i, f"{shared} own{i}") for i in range(6000)]
    rows += [("s", 10_000 + i, " ".join(f"w{rng.randrange(4000)}" for _ in range(12))) for i in range(3000)]
    groups = near_duplicates(spark.createDataFrame(rows, "src string, id bigint, text string"), **how)
    assert sorted(tuple(r) for r in groups.where("id < 10000").collect()) == [("s", i, 0) for i in range(6000)]


def test_hot_region_of_long_records(spark):
    # Half of 400 words each: the sketches are too small to show how much two of them differ.
    rng = random.Random(7)
    vocabulary = [f"c{i}" for i in range(400)]
    texts = [rng.sample(vocabulary, 200) for _ in range(200)]
    rows = [("s", i, " ".join(w)) for i, w in enumerate(texts)] + [("s", 1000 + i, " ".join(texts[i][:196])) for i in range(30)]
    groups = near_duplicates(spark.createDataFrame(rows, "src string, id bigint, text string"), block=40, every=1)
    assert {(r.id_a, r.id_b) for r in group_pairs(groups).collect()} == {(i, 1000 + i) for i in range(30)}


GIVEN = [("Isabella", "Bella"), ("Ernestine", "Erna"), ("Harriet", "Hattie"), ("Augusta", "Gussie"), ("Gertrude", "Trudi"), ("Theodore", "Theo"), ("Theodora", "Dora"), ("Anthony", "Tony")]
SAME = [["Isabella Tokhekafalbus", "Bella Tokhekafalbus", "Tokhekafalbus, Isabella", "ISABELLA TOKHEKAFALBUS", "Isabella M. Tokhekafálbus", "Isabela Tokhekafalbus", "isabella_tokhekafalbus", "IsabellaTokhekafalbus", "I. Tokhekafalbus", "Dr. Isabella Tokhekafablus"], ["Harriet Somrijejakror", "H. Somrijejakror"], ["Augusta Somrijejakror", "Augu. Somrijejakror"], ["Anthony Somrijejakror"], ["Ernestine Pudnigevemtus", "Erna Pudnigevemtus"], ["Theodore Pudnigevemtus"]]
FIRMS = [["Metpelilakden Services AG", "Metpelilakden Services", "The Metpelilakden Services AG", "Services Metpelilakden", "Metpelilakden Svcs AG"], ["Metpelilakden Museum Ltd", "Metpelilakden Musuem Ltd", "Metpelilakden Limited"], ["Hasfujesavgen Insurance GmbH", "Hasfu-jesavgen Insurance G.m.b.H.", "Hasfujesavgen Ins."]]


def test_names(spark):
    rows, want, i = [], set(), 0
    for kind, groups in (("Person", SAME), ("company", FIRMS)):
        for g in groups:
            ids = list(range(i, i + len(g)))
            i += len(g)
            rows += [(j, t, kind if j % 4 else None) for j, t in zip(ids, g)]
            want |= {(a, b) for a in ids for b in ids if a < b}
    rows += [(500, "Port Tokhekafalbus", "place"), (501, "Tokhekafalbus theory", None), (502, None, "Person"), (503, "", "Person"), (None, "Isabella Tokhekafalbus", "Person"), (504, "Tokhekafalbus X37", None), (505, "…", None)]
    df = spark.createDataFrame(rows, "id bigint, entity string, entity_type string").withColumn("name", F.lit("x"))
    names = spark.createDataFrame(GIVEN, "given string, short_form string")
    groups = name_variants(df, names).withColumn("src", F.lit(""))
    assert {(r.id_a, r.id_b) for r in group_pairs(groups).collect()} == want
    assert name_variants(df.limit(0), names).count() == 0 and name_variants(df, names.limit(0)).count() >= 0


def test_common_surname(spark):
    given = [f"A{a}{b}{c}ora" for a in "bdfgklmn" for b in "aeiou" for c in "bcdfghklmnpr"][:450]
    rows = [(i, f"{g} Tokhekafalbus", "person") for i, g in enumerate(given)] + [(1000 + i, f"{g} Tokhekafallbus", "person") for i, g in enumerate(given)]
    rows += [(5000, "Metpelilakden AG", "company"), (5001, "Metpelilakden Museum AG", "company")] + [(6000 + i, f"Metpelilakden{a}{b} Museum Ltd", "company") for i, (a, b) in enumerate((a, b) for a in "abcd" for b in "efgh")]
    df = spark.createDataFrame(rows, "id bigint, entity string, entity_type string")
    got = {r.id: r.group for r in name_variants(df, spark.createDataFrame([(g, g) for g in given], "given string, short_form string"), most=5).collect()}
    assert all(got.get(i) == i and got.get(1000 + i) == i for i in range(450)) and got[5001] == 5000


def test_one_long_ending(spark):
    # Some thousand surnames of one ending, one letter put in early, all with one given name: one large block.
    rng = random.Random(7)
    stems = sorted({"".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(2000)})[:1500]
    rows = [(2 * i, f"Isabella {s}bergerhausen".title(), "person") for i, s in enumerate(stems)] + [(2 * i + 1, f"Isabella {s[:2]}x{s[2:]}bergerhausen".title(), "person") for i, s in enumerate(stems)]
    got = {r.id: r.group for r in name_variants(spark.createDataFrame(rows, "id bigint, entity string, entity_type string"), spark.createDataFrame(GIVEN, "given string, short_form string")).collect()}
    assert all(2 * i in got and got[2 * i] == got.get(2 * i + 1) for i in range(len(stems)))


def test_short_surnames(spark):
    pairs = [("Wolf", "Wolff"), ("Smith", "Smithe"), ("Miller", "Muller"), ("Hartmann", "Hardmann"), ("Tokhekafalbus", "Tokrekafilbus")]
    rows = [(10 * i + j, f"Isabella {x}", "person") for i, p in enumerate(pairs) for j, x in enumerate(p)]
    df = spark.createDataFrame(rows, "id bigint, entity string, entity_type string")
    got = {(r.id, r.group) for r in name_variants(df, spark.createDataFrame(GIVEN, "given string, short_form string")).collect()}
    assert got == {(10 * i + j, 10 * i) for i in range(len(pairs)) for j in (0, 1)}


def test_likeness_of_many():
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 70))) for _ in range(200)]
    for x in names[:40]:
        if len(x) <= 64:
            assert np.allclose(likeness(x, names), [ratio(x, y) for y in names])
    assert len(likeness("abc", [])) == 0


def test_readings():
    r = Reader(GIVEN)
    assert r.read("Theodora Hospuhadorsen", "person")[2] == "theodora" and r.read("Theodore Hospuhadorsen", "person")[2] == "theodore"
    assert r.read("Kekdek Fair 1981", None) is None and r.read("Rurkegepiljus Medal", "Award") is None
    assert common_subsequence("abcde", "acxe") == 3 and ratio("", "a") == 0
