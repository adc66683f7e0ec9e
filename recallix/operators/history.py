"""The history of changing entities: each state with the time for which it held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallix.operators.hot import hot_bounds, join_keys, shard_of, with_cuts

#: Spellings of a deletion, lower-cased.
DELETION = r"^(del|deletes?|deleted|deletion|remove[ds]?|removal|removed|drop|dropped|erased?|purged?|tombstone)$"

#: Bits of a word of the presence bitmaps (at most), and words of a chunk.
WORD, CHUNK = 64, 1024


def _fold(runs: DataFrame, within: list[str]) -> DataFrame:
    """Joins runs of one state whose bits follow each other."""
    w = Window.partitionBy(*within).orderBy("__a")
    marked = runs.withColumn("__new", F.when(F.col("__a") == F.lag("__z").over(w) + 1, 0).otherwise(1))
    numbered = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda f, c, by, n: f(c, by).alias(n)
    return numbered.groupBy(*within, "__run").agg(F.min("__a").alias("__first"), F.max("__z").alias("__last"), at(F.min_by, "__from", "__a", "__from"), at(F.min_by, "__version", "__a", "__version"), at(F.max_by, "__until", "__z", "__until")).drop("__run").withColumnsRenamed({"__first": "__a", "__last": "__z"})


def state_history(df: DataFrame, key: str, time: str, version: str, row_id: str, state: list[str], deleted: Column, base: int = 50_000, word: int = WORD, chunk: int = CHUNK) -> DataFrame:
    """For each key the states with version, valid_from_ms and valid_until_ms (-1: it still holds).

    time is in epoch seconds; of rows with one key and time the highest version counts, then the highest row id.
    A state holds until the next time at which another state or a deletion is noted; equal states in a row
    without deletion between are one, with the version of its first row. Null equals null in a state.

    Presence bitmaps: the distinct times of a key are its snapshots, numbered in order; for each hash of key and
    state one bit is set for each snapshot that shows it, in words of `word` bits, 64 at most (bit_or, aggregated before the shuffle).
    Runs of set bits are the validity intervals; a deletion or another state leaves a hole. Runs that touch a
    word's edge are joined within chunks of `chunk` words, then those at a chunk's edge. Keys with more than about
    `base` snapshots are numbered in time shards with the counts of the shards before as offsets.

    Defined cases: rows without key or time are left out; a null version counts as lowest and comes out as null;
    repeated rows change nothing; an empty table gives no rows; other columns play no part.
    """
    seconds = F.col(time).cast("double")
    text = F.to_json(F.struct(*[(F.col(c) + F.lit(0.0) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)).alias(f"c{i}") for i, c in enumerate(state)]), {"ignoreNullFields": "false"})
    rows = df.where(F.col(key).isNotNull() & seconds.isNotNull() & ~F.isnan(seconds)).select(F.col(key).alias("__k"), seconds.alias("__t"), F.struct(F.col(version).cast("long").alias("v"), F.col(row_id).cast("long").alias("i"), F.coalesce(deleted, F.lit(False)).alias("d"), F.xxhash64(text).alias("h")).alias("__row"))
    rows = rows.groupBy("__k", "__t").agg(F.max("__row").alias("__row"))
    bounds = hot_bounds(rows.select("__k", F.floor(F.col("__t") * 1000).alias("__o")), ["__k"], "__o", base)
    rows = with_cuts(rows, ["__k"], bounds).withColumn("__shard", shard_of(F.floor(F.col("__t") * 1000))).drop("__cuts")
    w = Window.partitionBy("__k", "__shard").orderBy("__t")
    ms = F.round(F.col("__t") * 1000).cast("long")
    seen = rows.select("__k", "__shard", "__row", ms.alias("__from"), (F.row_number().over(w) - 1).cast("long").alias("__i"), F.lead(ms).over(w).alias("__until"))
    if bounds is not None:
        hot = rows.join(F.broadcast(bounds.select("__k")), "__k", "left_semi")
        shards = hot.groupBy("__k", "__shard").agg(F.count(F.lit(1)).alias("__n"), F.min(ms).alias("__first"))
        order = Window.partitionBy("__k").orderBy("__shard")
        shards = shards.select("__k", "__shard", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.lead("__first").over(order).alias("__next"))
        seen = join_keys(seen, shards, ["__k", "__shard"], "left", small=True)  # at most `limit` keys with `most` shards each
        seen = seen.select("__k", "__row", "__from", (F.col("__i") + F.coalesce("__before", F.lit(0))).alias("__i"), F.coalesce("__until", "__next").alias("__until"))
    held = seen.where(~F.col("__row.d")).select("__k", F.col("__row.h").alias("__h"), F.expr(f"__i div {word}").alias("__word"), (F.col("__i") % word).cast("int").alias("__bit"), "__from", F.coalesce("__until", F.lit(-1)).alias("__until"), F.col("__row.v").alias("__version"))
    words = held.groupBy("__k", "__h", "__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__mask"), F.map_from_entries(F.collect_list(F.struct("__bit", F.struct(F.col("__from").alias("f"), F.col("__until").alias("u"), F.col("__version").alias("v"))))).alias("__at"))
    bits = F.expr("""filter(sequence(0, 63), b -> getbit(__mask, b) = 1 and (b = 0 or getbit(__mask, b - 1) = 0))""")
    ends = F.expr(f"""filter(sequence(0, 63), b -> getbit(__mask, b) = 1 and (b = {word - 1} or getbit(__mask, b + 1) = 0))""")
    runs = words.select("__k", "__h", "__word", "__at", F.explode(F.arrays_zip(bits.alias("a"), ends.alias("z"))).alias("__r"))
    runs = runs.select("__k", "__h", (F.col("__word") * word + F.col("__r.a")).alias("__a"), (F.col("__word") * word + F.col("__r.z")).alias("__z"), F.expr("__at[__r.a].f").alias("__from"), F.expr("__at[__r.a].v").alias("__version"), F.expr("__at[__r.z].u").alias("__until"))

    def at_edge(size: int) -> Column:
        return ((F.col("__a") % size == 0) & (F.col("__a") > 0)) | (F.col("__z") % size == size - 1)

    width = word * chunk
    edge = _fold(runs.where(at_edge(word)).withColumn("__chunk", F.expr(f"__a div {width}")), ["__k", "__h", "__chunk"]).drop("__chunk")
    far = _fold(edge.where(at_edge(width)), ["__k", "__h"])
    out = runs.where(~at_edge(word)).unionByName(edge.where(~at_edge(width))).unionByName(far)
    return out.select(F.col("__k").alias(key), F.col("__version").alias(version if version != key else "version_"), F.col("__from").alias("valid_from_ms"), F.col("__until").alias("valid_until_ms"))


def is_deletion(change_type: str) -> Column:
    """True where the text names a deletion in any spelling."""
    return F.coalesce(F.lower(F.trim(F.col(change_type))).rlike(DELETION), F.lit(False))
