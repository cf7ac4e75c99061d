"""Record types of the engine as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import with_ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, ts, event_type, k, event_id): a user is a session, ``error`` a failed result, ``purchase`` a message."""
    e = table(spark, sf_dir, "events")
    e = e.select("user_id", "event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return with_ordinal(e, "user_id", "ts", "event_id")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, host, pattern, struggle) of every event, by day in Los Angeles."""
    e = table(spark, sf_dir, "events")
    day = F.convert_timezone(F.lit("UTC"), F.lit("America/Los_Angeles"), F.col("ts").cast("timestamp_ntz")).cast("date")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(day.alias("day"), (F.col("user_id") % 3).alias("host"), (k % 5).alias("pattern"), (F.col("event_type") == "error").cast("long").alias("struggle"), "user_id")


TRIAL_ORDER = ["l_orderkey", "l_partkey", "l_linenumber", "weight", "tokens", "l_discount", "l_tax", "l_shipdate"]


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, task, reward, weight, tokens, total order): a return flag is a job, a supplier a task."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_returnflag").alias("job"), F.col("l_suppkey").alias("task"), (F.col("l_linestatus") == "F").cast("double").alias("reward"),
        F.col("l_quantity").alias("weight"), F.col("l_extendedprice").alias("tokens"), "l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_tax", "l_shipdate",
    )


def exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, area, tree, churn, ts): a part is a task, its brand an area, its first shipping the time."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    first = line.groupBy(F.col("l_partkey").alias("task")).agg(F.min("l_shipdate").alias("ts"))
    tasks = part.select(F.col("p_partkey").alias("task"), F.col("p_brand").alias("area"), F.col("p_type").alias("tree"), F.col("p_size").cast("double").alias("churn"))
    return tasks.join(first, "task", "left")
