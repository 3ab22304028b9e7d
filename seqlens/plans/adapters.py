"""Driver tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events(table(spark, sf_dir, "events"))


def user_events(rows: DataFrame, *others: str) -> DataFrame:
    """Each user's events as a trajectory: clicks and sign-ups are commands or edits, views reads, purchases tests. Other columns as
    they are."""
    df = rows.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kind = (
        F.when((F.col("event_type") == "signup") & (F.col("k") < 50), "file_edit")
        .when(F.col("event_type").isin("signup", "click"), "bash_call")
        .when(F.col("event_type") == "view", "file_read")
        .when(F.col("event_type") == "error", "error_reveal")
        .otherwise("test_run")
    )
    k = lambda n: (F.col("k") % n).cast("string")
    df = df.withColumn("type", kind).withColumn("step", step.cast("int"))
    cmd = F.when(F.col("event_type") == "click", F.concat(F.lit("cmd_"), k(10))).otherwise("ls")
    return df.select(
        F.col("user_id").alias("task_id"),
        "step",
        "type",
        F.when(F.col("type") == "bash_call", cmd).alias("command"),
        F.when(F.col("type").isin("file_read", "file_edit"), F.concat(F.lit("p"), k(30))).alias("path"),
        F.when(F.col("type") == "error_reveal", F.concat(F.lit("E"), k(5))).alias("error_type"),
        F.when(F.col("type") == "test_run", F.when(F.col("value") < 35, "fail").otherwise("pass")).alias("outcome"),
        F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("string").alias("reason"),
        *others,
    )
