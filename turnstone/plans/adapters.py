"""The given tables as sessions, turns, calls and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: The fixed clock of all queries: 2024-01-31 00:00 UTC.
AS_OF = 1_706_659_200
AS_OF_TS = "TIMESTAMP'2024-01-31 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "role", "text")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: a user is a session, the order is (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("session_id"), F.row_number().over(w).alias("seq"), F.col("event_type").alias("name"), (F.col("event_type") == "error").alias("is_error"), F.col("event_id").alias("call_id"), "ts", "value", F.col("props").alias("input_json"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("project"), (F.col("label") % 2 == 0).alias("has_errors"), (F.lit(AS_OF) - F.col("vec_id") * 37 % 90 * 86400).alias("start_ts"), F.col("vec_id").alias("tool_count"))


def queries(pts: DataFrame) -> DataFrame:
    """The stated query set: every point whose id is divisible by 50."""
    return pts.filter(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "vec", "project")
