"""The messages of episodes, a row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "array<struct<id: int, role: string, content: string, timestamp: double>>"


def messages(episodes: DataFrame) -> DataFrame:
    """(episode, user_id, session_id, pos, role, content, at) of each message; arrays that aren't JSON have none."""
    parsed = episodes.select(F.col("id").alias("episode"), "user_id", "session_id", F.posexplode(F.from_json("messages", SCHEMA)).alias("pos", "m"))
    return parsed.where("m.content is not null").select("episode", "user_id", "session_id", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"), F.col("m.timestamp").alias("at"))
