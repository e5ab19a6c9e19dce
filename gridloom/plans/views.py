"""Point views over the test tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE = "floor(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 6e7)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"), (F.col("user_id") * F.lit(1e3)).alias("x"), F.expr(MINUTE).cast("double").alias("y"), F.col("value").cast("double").alias("v"))


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    v = F.when(F.col("id") % 97 == 0, F.lit(float("nan"))).when(F.col("id") % 89 == 0, F.lit(None).cast("double")).when(F.col("id") % 83 == 0, F.lit(float("inf"))).otherwise(F.col("v"))
    return e.withColumn("v", v)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * F.lit(1e2)).alias("x"), (F.col("l_suppkey") * F.lit(1e3)).alias("y"), F.col("l_extendedprice").cast("double").alias("v"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.get("embedding", F.lit(k)).cast("double") * F.lit(1e5)
    return table(spark, sf_dir, "embeddings").select(at(0).alias("x"), at(1).alias("y"), F.col("label").cast("double").alias("v"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919 % 36000) / F.lit(1e2) - F.lit(1.8e2)).alias("lon"), ((k * 104729 % 16000) / F.lit(1e2) - F.lit(8e1)).alias("lat"), F.col("c_acctbal").cast("double").alias("v"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("x") - F.lit(7e4)) / F.lit(1e4), (F.col("y") - F.lit(2e4)) / F.lit(1e4)
    return events(spark, sf_dir).select("id", "x", "y", (F.lit(1e1) + a * a + b * b).alias("v"))


SQL = {
    "p_evt": "SELECT event_id AS id, user_id * 1e3 AS x, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 6e7) * 1e0 AS y, value * 1e0 AS v FROM events",
    "p_dirty": "SELECT id, x, y, CASE WHEN id % 97 = 0 THEN 'nan'::DOUBLE WHEN id % 89 = 0 THEN NULL WHEN id % 83 = 0 THEN 'inf'::DOUBLE ELSE v END AS v FROM p_evt",
    "p_li": "SELECT l_partkey * 1e2 AS x, l_suppkey * 1e3 AS y, l_extendedprice * 1e0 AS v FROM lineitem",
    "p_emb": "SELECT embedding[1]::DOUBLE * 1e5 AS x, embedding[2]::DOUBLE * 1e5 AS y, label * 1e0 AS v FROM embeddings",
    "p_geo": "SELECT c_custkey AS id, (c_custkey * 7919 % 36000) / 1e2 - 1.8e2 AS lon, (c_custkey * 104729 % 16000) / 1e2 - 8e1 AS lat, c_acctbal * 1e0 AS v FROM customer",
    "p_field": "SELECT id, x, y, 1e1 + ((x - 7e4) / 1e4) * ((x - 7e4) / 1e4) + ((y - 2e4) / 1e4) * ((y - 2e4) / 1e4) AS v FROM p_evt",
}


def with_views(body: str, *names: str) -> str:
    """A statement whose common table expressions begin with the named views."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body
