"""The driver's Parquet tables as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.col("role").alias("source"), F.lit("en").alias("lang"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as short documents with a date and a rank."""
    t = table(spark, sf_dir, "orders")
    return t.select(F.col("o_orderkey").alias("doc_id"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("text"), F.date_format("o_orderdate", "yyyyMMdd000000").cast("bigint").alias("ansi_date"), F.col("o_custkey").alias("rank"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    return t.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
