"""Intervals, histories, instants and components against brute force, with hot keys split and defined cases."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from recallix.operators.components import components
from recallix.operators.history import is_deletion, state_history
from recallix.operators.instants import estimate_zones, parse, to_instants
from recallix.operators.intervals import micros_to_utc_text, periods_and_gaps, utc_text_to_micros


def merged(rows):
    out = set()
    for key in {r[0] for r in rows}:
        spans = sorted((-10**18 if s is None else s, 10**18 if e is None else e) for k, s, e in rows if k == key and (s is None or e is None or e > s))
        done = []
        for s, e in spans:
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        show = lambda x: None if abs(x) == 10**18 else x
        out |= {(key, "period", show(s), show(e)) for s, e in done}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(done, done[1:])}
    return out


@pytest.mark.parametrize("base", [4, 50_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_periods(spark, seed, base):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        s = rng.randrange(2000)
        rows.append((rng.choice(["hot", "hot", "hot", "a", None]), None if rng.random() < 0.01 else s, None if rng.random() < 0.01 else s + rng.choice([-3, 0, 1, 2, 5, 9, 400 if rng.random() < 0.05 else 3])))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "kind string, s bigint, e bigint").withColumn("starts", F.lit("clash"))
    got = periods_and_gaps(df, ["kind"], "s", "e", base)
    assert got.columns == ["kind", "kind_", "starts", "ends"]
    assert {tuple(r) for r in got.collect()} == merged(rows) and got.count() == len(merged(rows))


def test_periods_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], "k string, s bigint, e bigint"), ["k"], "s", "e").count() == 0


def test_bound_texts(spark):
    texts = ["2021-03-04", "2021-03-04T10:15", "2021-03-04 10:15:00", "2021-03-04T10:15:00.5", "2021-03-04T10:15:00+02:00", "soon", "", None, "2021-02-30"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(micros_to_utc_text(utc_text_to_micros(F.col("t")))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[0] for r in rows] == ["2021-03-04T00:00:00", "2021-03-04T10:15:00", "2021-03-04T10:15:00", "2021-03-04T10:15:00.5", "2021-03-04T08:15:00", None, None, None, None]


def history(rows):
    out = set()
    for key in {r[1] for r in rows if r[1] is not None}:
        by = {}
        for i, k, t, v, state, kind in rows:
            if k == key and t is not None:
                by.setdefault(t, []).append((-1 if v is None else v, i, v, state, kind == "Deleted"))
        seen, open_ = sorted(by), None
        for t in seen:
            _, _, v, state, gone = max(by[t], key=lambda x: x[:2])
            if open_ and (gone or open_[1] != state):
                out.add((key, open_[0], open_[2], round(t * 1000)))
                open_ = None
            if not gone and open_ is None:
                open_ = (v, state, round(t * 1000))
        if open_:
            out.add((key, open_[0], open_[2], -1))
    return out


@pytest.mark.parametrize("base", [5, 50_000])
@pytest.mark.parametrize("span", [30, 4000])
def test_history(spark, base, span):
    rng = random.Random(base + span)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.02 else float(rng.randrange(span)), rng.choice([1, 2, 3, None]), rng.choice(["x", "x", "x", "y", None]), rng.choice(["update"] * 9 + ["Deleted"])) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, t double, v int, state string, kind string").withColumn("valid_from_ms", F.lit(1))
    got = state_history(df, "k", "t", "v", "id", ["state"], is_deletion("kind"), base)
    assert {tuple(r) for r in got.collect()} == history(rows) and got.count() == len(history(rows))


def test_long_runs_across_words_and_chunks(spark):
    df = spark.range(140_000).select("id", F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.lit(1).alias("v"), F.when(F.col("id") == 70_001, "b").otherwise("a").alias("s"))
    got = state_history(df, "k", "t", "v", "id", ["s"], F.lit(False)).orderBy("valid_from_ms").collect()
    assert [(r.valid_from_ms, r.valid_until_ms) for r in got] == [(0, 70_001_000), (70_001_000, 70_002_000), (70_002_000, -1)]


def us(*a, tz="UTC"):
    return round(datetime(*a, tzinfo=ZoneInfo(tz)).timestamp() * 1e6)


TIMES = [
    ("2020-01-02T03:04:05.123456Z", "b", us(2020, 1, 2, 3, 4, 5, 123456)), ("20200102T030405Z", None, us(2020, 1, 2, 3, 4, 5)), ("1577934245", "b", 1577934245_000000), ("1577934245123", "b", 1577934245_123000), ("1577934245.5", "b", 1577934245_500000),
    ("2020-06-02T03:04:05", "b", us(2020, 6, 2, 3, 4, 5, tz="Europe/Berlin")), ("2020-06-02", "b", us(2020, 6, 2, tz="Europe/Berlin")), ("02.06.20 03:04:05", "b", us(2020, 6, 2, 3, 4, 5, tz="Europe/Berlin")), ("6/2/2020 3:04:05 PM", "n", us(2020, 6, 2, 15, 4, 5, tz="America/New_York")), ("6/2/20 12:04:05 AM", "n", us(2020, 6, 2, 0, 4, 5, tz="America/New_York")),
    ("5 Jan 2020 11:00", "n", us(2020, 1, 5, 11, tz="America/New_York")), ("Jan 5, 2020 9:34 PM", "n", us(2020, 1, 5, 21, 34, tz="America/New_York")), ("Fri, 17 Jan 2020 10:31:26 -0500", "b", us(2020, 1, 17, 15, 31, 26)), ("2020-01-11 01:14:06 +0530", "b", us(2020, 1, 10, 19, 44, 6)), ("2020-01-20 04:46:12 PST", "b", us(2020, 1, 20, 12, 46, 12)), ("2020-01-20 04:46:12 CEST", "n", us(2020, 1, 20, 2, 46, 12)),
    ("2020-06-02 03:04", "nowhere", us(2020, 6, 2, 3, 4)), ("2020-06-02 03:04", None, us(2020, 6, 2, 3, 4)), ("2020/06/02 03:04:05", "y", us(2020, 6, 2, 3, 4, 5, tz="Asia/Tokyo")),
    ("2020-10-25 02:30:00", "b", us(2020, 10, 25, 0, 30)), ("2020-03-29 02:30:00", "b", us(2020, 3, 29, 1, 30)),
    ("unknown", "b", None), ("", "b", None), (None, "b", None), ("31/02/2022 10:00", "b", None), ("2023-13-45", "b", None), ("0000-00-00 00:00:00", "b", None), ("2020-01-02 25:00", "b", None), ("-", "b", None), ("x" * 50_000, "b", None),
]


def test_instants(spark):
    profiles = spark.createDataFrame([("b", "Europe/Berlin", "dmy"), ("n", "America/New_York", "mdy"), ("y", "Asia/Tokyo", "ymd"), ("bad", "No/Where", "ymd"), (None, "UTC", "ymd")], "source string, zone_name string, date_order string")
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(TIMES)], "i bigint, t string, source string").withColumn("zone_name", F.lit("clash"))
    for zone in ("UTC", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = {r.i: r.utc_us for r in to_instants(df, "t", "source", "i", profiles).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == {i: want for i, (_, _, want) in enumerate(TIMES)}
    assert to_instants(df.limit(0), "t", "source", "i", profiles).count() == 0


def test_zones_are_estimated_from_the_order_of_arrival(spark):
    rng, rows, at = random.Random(4), [], datetime(2021, 1, 1, tzinfo=timezone.utc)
    for i in range(6000):
        at += timedelta(minutes=rng.randrange(5, 120))
        source = rng.choice(["clock", "tokyo", "berlin"])
        zone = {"tokyo": "Asia/Tokyo", "berlin": "Europe/Berlin"}.get(source)
        rows.append((i, at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S") if zone else at.strftime("%Y-%m-%dT%H:%M:%SZ"), source))
    df = spark.createDataFrame(rows, "i bigint, t string, source string")
    parsed = parse(df.withColumn("o", F.lit("ymd")), "t", "o")
    best = {r.source: r.zone for r in estimate_zones(parsed, "source", "i", ["UTC", "Asia/Tokyo", "Europe/Berlin", "Europe/London"]).collect()}
    assert best == {"tokyo": "Asia/Tokyo", "berlin": "Europe/Berlin"}
    profiles = spark.createDataFrame([("other", "Asia/Tokyo", "ymd"), ("more", "Europe/Berlin", "ymd")], "source string, zone_name string, date_order string")
    got = {r.i: r.utc_us for r in to_instants(df, "t", "source", "i", profiles).collect()}
    i, t, _ = next(r for r in rows if r[2] == "tokyo")
    assert got[i] == round(datetime.fromisoformat(t).replace(tzinfo=ZoneInfo("Asia/Tokyo")).timestamp() * 1e6)


def test_undeclared_sources_are_utc_whatever_their_order(spark, tmp_path):
    from recallix.plans.general import p6_found

    rng, rows, at = random.Random(4), [], datetime(2021, 1, 1, tzinfo=timezone.utc)
    for i in range(6000):
        at += timedelta(minutes=rng.randrange(5, 120))
        source = rng.choice(["clock", "tokyo"])
        rows.append((i, at.astimezone(ZoneInfo("Asia/Tokyo")).strftime("%Y-%m-%d %H:%M:%S") if source == "tokyo" else at.strftime("%Y-%m-%dT%H:%M:%SZ"), source))
    save = lambda df, name: df.write.parquet(str(tmp_path / f"{name}.parquet"))
    facts = spark.createDataFrame(rows, "id bigint, timestamp string, source string")
    save(facts, "fact_triples")
    save(facts.limit(0).select("id", F.col("timestamp").alias("temporal_start"), F.col("source").alias("provenance")), "graph_entities")
    save(facts.limit(0).select("id", F.col("timestamp").alias("start_time"), F.col("source").alias("metadata")), "episodes")
    save(spark.createDataFrame([("other", "Asia/Tokyo", "ymd"), ("more", "Europe/Berlin", "ymd")], "source string, zone_name string, date_order string"), "source_profiles")
    got = {r.row_id: r.utc_us for r in p6_found(spark, str(tmp_path)).collect()}
    assert len(got) == 6000
    assert all(got[i] == round(datetime.fromisoformat(t).replace(tzinfo=timezone.utc).timestamp() * 1e6) for i, t, s in rows if s == "tokyo")


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_hot_keys_are_ranked_and_summed_in_shards(spark):
    from recallix.operators.hot import running_totals, sequenced
    from recallix.operators.profiles import sessionise
    from recallix.operators.temporal import overlap_counts, timeline

    rng = random.Random(8)
    rows = [(i, rng.choice(["hot"] * 4 + ["a", None]), rng.randrange(200), rng.randrange(1, 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id bigint, k string, t bigint, n bigint").withColumn("z", F.col("t") + F.col("n"))
    for f in (lambda b: sequenced(df, ["k"], "t", "event_id", b), lambda b: running_totals(df, ["k"], "t", {"sum": "n"}, b), lambda b: sessionise(df, "k", "t", 2, base=b), lambda b: timeline(df, ["k"], "t", "event_id", b)):
        assert sorted(map(str, f(20).collect())) == sorted(map(str, f(10**6).collect()))
    got = {r.event_id: r.overlaps for r in overlap_counts(df.where("k is not null"), ["k"], "event_id", "t", "z", 20).collect()}
    assert got == {i: sum(1 for j, k2, t2, n2 in rows if j != i and k2 == k and t < t2 + n2 and t2 < t + n) for i, k, t, n in rows if k}
    first = {r.event_id: r for r in sequenced(df, ["k"], "t", "event_id", 20).collect()}
    for k in ("hot", "a", None):
        own = sorted((t, i) for i, k2, t, _ in rows if k2 == k)
        assert [first[i].place for _, i in own] == list(range(1, len(own) + 1))
        assert [first[i].before for _, i in own] == [None] + [t for t, _ in own[:-1]]
