"""Schemas of the tables as DDL, and rows brought into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "fact_triples": "id bigint, subject string, predicate string, object string, confidence double, timestamp string, source string, embedding array<float>",
    "temporal_facts": "id bigint, subject string, predicate string, object string, valid_from string, valid_until string, confidence double, source string, superseded_by bigint, created_at string, metadata string",
    "knowledge_items": "id bigint, text string, confidence double, timestamp double, source string, embedding array<float>",
    "graph_entities": "id bigint, entity string, entity_type string, metadata string, embedding array<float>, timestamp double, provenance string, confidence double, temporal_start string, temporal_end string, extraction_method string, version int, last_updated double",
    "relationship_versions": "id bigint, relationship_id bigint, source_id bigint, target_id bigint, relation_type string, weight double, metadata string, provenance string, confidence double, temporal_start string, temporal_end string, extraction_method string, version int, timestamp double, change_type string, changed_by string",
    "vector_embeddings": "id string, text string, type string, embedding array<float>, metadata string",
    "episodes": "id bigint, session_id string, user_id string, title string, summary string, messages string, emotions string, topics string, start_time string, end_time string, metadata string, importance double",
}


def schema(name: str) -> T.StructType:
    """The schema of a table as a type."""
    return T.StructType.fromDDL(SCHEMAS[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    """The table without rows."""
    return spark.createDataFrame([], schema(name))


def conform(rows: DataFrame, name: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """rows with exactly the columns of a table, in its types; what they lack is its default, else null.

    A value that doesn't fit its type becomes null.
    """
    have, given = set(rows.columns), defaults or {}

    def column(f: T.StructField):
        kind = f.dataType.simpleString()
        value = F.col(f.name).try_cast(kind) if f.name in have else F.lit(given.get(f.name)).cast(kind)
        return value.alias(f.name)

    return rows.select(*[column(f) for f in schema(name).fields])
