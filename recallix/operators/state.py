"""Users, personas, boundaries, classes, reasoning logs, caches and memory dumps as keyed state.

Every upsert appends to a change log, every read takes the last row of a key; see store.py for the generic forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallix.operators.hot import sequenced
from recallix.operators.rules import descendants
from recallix.operators.store import delete_keys, last_wins


def append(rows: DataFrame, new: DataFrame, key: str, order: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """rows with new ones added: their ids go on from the highest, in the order of `order` (bigint, unique).

    Columns new lacks take their default, else null; its other columns are left out.
    """
    last = rows.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    added = new.withColumns({c: v for c, v in (defaults or {}).items() if c not in new.columns})
    added = sequenced(added.withColumn("__one", F.lit(0)), ["__one"], order, order).withColumn(key, F.col("place") + F.lit(last))
    types = dict(rows.dtypes)
    return rows.unionByName(added.select(*[F.col(c).cast(t).alias(c) if c in added.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]))


def merged_maps(log: DataFrame, key: str, at: str, json: str) -> DataFrame:
    """(key, name, value): the JSON objects of a log merged for each key, the last value of each name winning."""
    entries = log.select(key, at, F.explode(F.from_json(json, "map<string,string>")).alias("name", "value"))
    return last_wins(entries, [key, "name"], [at], [])[[key, "name", "value"]]


def listed(rows: DataFrame, order: str, tie: str) -> DataFrame:
    """All rows with `place`, their place in the order of a bigint; numbered in shards, so no task sorts them all."""
    return sequenced(rows.withColumn("__one", F.lit(0)), ["__one"], order, tie).drop("__one", "before", "after")


def boundaries(log: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """(key, boundary, at): each boundary of a key once, whatever its case, as first said."""
    return log.groupBy(key, F.lower(F.trim(text)).alias("low")).agg(F.min_by(text, at).alias("boundary"), F.min(at).alias("at")).where("low <> ''").select(key, "boundary", "at")


def relationship_context(stage: Column, trust: Column, comfort: Column, rapport: Column, interactions: Column) -> Column:
    """A relationship in words, shares as whole percentages."""
    percent = lambda c: F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))
    return F.concat_ws("\n", F.concat(F.lit("Relationship stage: "), F.initcap(F.translate(stage, "_", " "))), F.concat(F.lit("Trust level: "), percent(trust)), F.concat(F.lit("Comfort level: "), percent(comfort)), F.concat(F.lit("Rapport: "), percent(rapport)), F.concat(F.lit("Interactions: "), interactions.cast("string")))


def evolve(state: DataFrame, rules: DataFrame, key: str, met: Column) -> DataFrame:
    """(key, fired, overrides): the rules (name, order, effect: map) whose trigger a state meets; later effects win.

    met is over the columns of state and rules; rules is a small table of a persona's definition.
    """
    hit = state.crossJoin(F.broadcast(rules)).where(met)  # a few rules each
    fired = hit.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "name"))), lambda x: x["name"]).alias("fired"))
    effects = last_wins(hit.select(key, "order", F.explode("effect").alias("__k", "__v")), [key, "__k"], ["order"], [])
    return fired.join(effects.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias("overrides")), key, "left")


# --- ontology ----------------------------------------------------------------------------------------------


def subclass_tests(parents: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (name, ancestor) with `holds`: whether name is ancestor or, over any number of steps, a subclass of it."""
    closure = descendants(parents, itself=True).select(F.col("node").alias("name"), "ancestor", F.lit(True).alias("holds"))
    out = asked.join(closure, ["name", "ancestor"], "left")
    return out.withColumn("holds", F.coalesce("holds", F.col("name") == F.col("ancestor"), F.lit(False)))


def suggest_names(seen: DataFrame, name: str, known: DataFrame, shown: Column) -> DataFrame:
    """(suggestion, n): names as `shown` that aren't among the known ones (name), and how often they were seen."""
    new = seen.where(F.col(name).isNotNull()).select(shown.alias("suggestion")).groupBy("suggestion").agg(F.count(F.lit(1)).alias("n"))
    return new.join(known.select(F.col("name").alias("suggestion")).distinct(), "suggestion", "left_anti")


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns a change names (not null) in place of their own; changes has one row a key."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


# --- reasoning ---------------------------------------------------------------------------------------------


def reasoning_header(steps: DataFrame, key: list[str], at: str, kind: str, good: list[str]) -> DataFrame:
    """(key, started, ended, steps, kinds, success): a session's header, closed by its last step."""
    last = F.struct(at, kind)
    return steps.groupBy(*key).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("steps"), F.count_distinct(kind).alias("kinds"), F.max(last)[kind].isin(good).alias("success"))


def cleared(sessions: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Headers, steps or paths without those of the sessions that are gone."""
    return delete_keys(sessions, gone, *key)


def cache_put(runs: DataFrame, key: Column, result: str, at: str) -> DataFrame:
    """(key, hits, result): how often each pattern was put, and its last result."""
    return runs.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("hits"), F.max_by(result, at).alias("result"))


def cache_get(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, ...) with `hit` and `result`."""
    return asked.join(cache.select("key", "result", F.lit(True).alias("hit")), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


# --- memory dumps ------------------------------------------------------------------------------------------

DUMP = "struct<pos: int, role: string, content: string, importance: double, tokens: int, at: double>"


def save_memory(messages: DataFrame, key: str) -> DataFrame:
    """(key, line): messages of conversations as lines of JSON, one each, so a conversation may be of any length."""
    return messages.select(key, F.to_json(F.struct("pos", "role", "content", "importance", "tokens", "at")).alias("line"))


def restore_memory(lines: DataFrame, key: str) -> DataFrame:
    """The messages of saved lines; lines that aren't JSON are left out."""
    return lines.select(key, F.from_json("line", DUMP).alias("m")).where("m.pos is not null").select(key, "m.*")
