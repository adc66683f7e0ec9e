"""Structured Streaming: event-time windows with late data, and keyed state over a message stream.

Batch and stream share their expressions, so a stream over finished input gives what the batch gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallix.functions import text as X
from recallix.session import shared_folder
from recallix.sources.tables import utc


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table of a folder as a stream; times without a zone become UTC timestamps for watermarks."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumns({f.name: utc(F.col(f.name)) for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(starts, kind, n): events of each kind in tumbling windows; rows later than the watermark are dropped."""
    kept = events.withWatermark(at, late)
    return kept.groupBy(F.window(at, size), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("starts"), kind, "n")


def session_counts(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, starts, ends, n): event-time sessions closed by a gap."""
    kept = events.withWatermark(at, late)
    return kept.groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), "n")


def ingest(messages: DataFrame) -> DataFrame:
    """Messages with what is worked out as they come: safety, category, importance, tokens, complexity."""
    text = F.col("content")
    return messages.withColumns({"safety": X.safety(text), "category": X.categories(text), "importance": X.message_importance(F.col("role"), text), "tokens": X.token_estimate(text), "complexity": X.query_complexity(text), "personal": X.contains_personal_fact(text)})


def running_trust(messages: DataFrame, key: str) -> DataFrame:
    """(key, interactions, trust): per-key state kept across micro-batches, emitted at each update.

    messages has the key and `growth`, what a message adds to the trust, which stays within 1.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, trust = state.get if state.exists else (0, 0.0)
        for b in batches:
            n += len(b)
            trust = min(1.0, trust + float(b["growth"].sum()))
        state.update((n, trust))
        yield pd.DataFrame({key: [k[0]], "interactions": [n], "trust": [trust]})

    kind = dict(messages.dtypes)[key]
    return messages.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, interactions bigint, trust double", "interactions bigint, trust double", "update", GroupStateTimeout.NoTimeout)


def emit(stream: DataFrame, kind: str, handlers: dict[str, list[Callable[[DataFrame], None]]], folder: str | None = None) -> dict[str, int]:
    """Runs a stream over what is there and gives each batch to the handlers of each event type in column `kind`.

    A handler that fails keeps no other from its events; the number of failures of each type is returned. A batch is
    given again if its writing fails in between, so handlers must bear repetition.
    """
    failed = dict.fromkeys(handlers, 0)
    place = f"{(folder or shared_folder(stream.sparkSession)).rstrip('/')}/emit-{stream.sparkSession.range(1).select(F.uuid()).first()[0]}"

    def give(batch: DataFrame, number: int) -> None:
        for name, some in handlers.items():
            for handler in some:
                try:
                    handler(batch.where(F.col(kind) == name))
                except Exception:  # noqa: BLE001 - whatever a handler does
                    failed[name] += 1

    stream.writeStream.option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(give).start().awaitTermination()
    return failed


def run_once(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there, and returns what it wrote, with the number of its `batch`.

    Files and checkpoints go to `folder`: by default beneath spark.checkpoint.dir, on a cluster a shared folder.
    """
    spark = stream.sparkSession
    base = folder or shared_folder(spark)
    place = f"{base.rstrip('/')}/stream-{spark.range(1).select(F.uuid()).first()[0]}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{place}/out")
    if mode == "complete":  # each batch has the whole result
        out = out.where(F.col("batch") == (out.agg(F.max("batch")).first()[0] or 0))
    return out
