"""The supplied tables as images, layers and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import grid

ORDERS_W, PART_W = 150, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells coloured by order priority."""
    return grid.grid(table(spark, sf_dir, "orders"), "o_orderkey", ORDERS_W, F.col("o_orderpriority"))


def part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells labelled by brand; alpha is 36 times what p_size is over a multiple of 7, and cells without any are transparent."""
    parts = table(spark, sf_dir, "part").withColumn("a", F.col("p_size") % 7 * 36).where("a >= 1")
    return grid.grid(parts, "p_partkey", PART_W, F.col("p_brand"), F.col("p_size").alias("size"), F.col("p_partkey").alias("key"))


def part_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells where p_size is 20 at least."""
    return grid.grid(table(spark, sf_dir, "part").where("p_size >= 20"), "p_partkey", PART_W, F.lit(1)).select("x", "y")


ORDERS_SQL = f"SELECT CAST(o_orderkey % {ORDERS_W} AS INT) AS x, CAST(o_orderkey // {ORDERS_W} AS INT) AS y, o_orderpriority AS color FROM orders"
PART_SQL = f"SELECT CAST(p_partkey % {PART_W} AS INT) AS x, CAST(p_partkey // {PART_W} AS INT) AS y, p_brand AS color, p_size AS size, p_partkey AS key FROM part WHERE p_size % 7 <> 0"
MASK_SQL = f"SELECT CAST(p_partkey % {PART_W} AS INT) AS x, CAST(p_partkey // {PART_W} AS INT) AS y FROM part WHERE p_size >= 20"
