"""The two tables of each linkage query, from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linkage import Linkage


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blank(value: str, key: str, *moduli: int):
    """The value, missing in rows whose key one of the moduli divides."""
    hit = F.lit(False)
    for m in moduli:
        hit = hit | (F.col(key) % m == 0)
    return F.when(~hit, F.col(value).cast("double"))


def _cube(c: str):
    """Third powers: of three different ones none lies in the middle, so only equal nations tie."""
    return F.col(c).cast("double") * F.col(c) * F.col(c)


def accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[tuple[str, str, str]]]:
    """Customers to suppliers by balance and nation, under names that differ; some cells and some whole rows are missing."""
    target = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name", _blank("c_acctbal", "c_custkey", 11, 19).alias("c_acctbal"), _blank("c_nationkey", "c_custkey", 13, 19).alias("c_nationkey"))
    supplemental = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", _blank("s_acctbal", "s_suppkey", 17).alias("s_acctbal"), F.col("s_nationkey").cast("double").alias("s_nationkey"))
    return target, supplemental, [("balance", "c_acctbal", "s_acctbal"), ("nation", "c_nationkey", "s_nationkey")]


def nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[tuple[str, str, str]]]:
    """Customers to suppliers by nation alone: many ties."""
    target = read(spark, sf_dir, "customer").select("c_custkey", _blank("c_nationkey", "c_custkey", 23).alias("c_nationkey")).withColumn("c_nationkey", _cube("c_nationkey"))
    supplemental = read(spark, sf_dir, "supplier").select("s_suppkey", _cube("s_nationkey").alias("s_nationkey"))
    return target, supplemental, [("nation", "c_nationkey", "s_nationkey")]


def overlap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[tuple[str, str, str]]]:
    """All customers, with balances known to the hundred, to all customers by balance and nation: who finds itself again?"""
    table = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    rough = (F.floor(F.col("c_acctbal").cast("double") / 100) * 100).cast("double") + 0.3333  # between cents, so that no two balances are equally far
    return table.withColumn("c_acctbal", rough), table, [("balance", "c_acctbal", "c_acctbal"), ("nation", "c_nationkey", "c_nationkey")]


def profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[tuple[str, str, str]]]:
    """Order profiles of customers to line profiles of suppliers: scales that differ."""
    target = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.round(F.max("o_totalprice"), 2).alias("largest"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("lines"), F.round(F.max("l_extendedprice"), 2).alias("largest_line"))
    return target, lines, [("count", "orders", "lines"), ("largest", "largest", "largest_line")]


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[tuple[str, str, str]]]:
    """Embeddings with even ids to those with odd ids, over all 64 dimensions."""
    table = read(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(f"d{k}") for k in range(64)))
    return table.filter("vec_id % 2 = 0"), table.filter("vec_id % 2 = 1"), [(f"d{k}", f"d{k}", f"d{k}") for k in range(64)]


FIXTURES = {"accounts": (accounts, "c_custkey", "s_suppkey"), "nations": (nations, "c_custkey", "s_suppkey"), "overlap": (overlap, "c_custkey", "c_custkey"), "profiles": (profiles, "o_custkey", "l_suppkey"), "vectors": (vectors, "vec_id", "vec_id")}


def linkage(spark: SparkSession, sf_dir: str, name: str, metric: str = "euclidean") -> Linkage:
    make, target_index, supplemental_index = FIXTURES[name]
    target, supplemental, features = make(spark, sf_dir)
    return Linkage(target, supplemental, features, target_index, supplemental_index, metric=metric)
