"""Tables, bindings of operators to them, and logs."""

from __future__ import annotations

import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item): brands by order."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()


def part_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item): parts by order; few pairs come up twice."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")).distinct()


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): customers point to the suppliers of their orders; suppliers are dead ends."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


def user_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): from each event's user to the next event's.

    Events follow each other within their hour; the last of an hour leads to the
    first of the next hour that has any. Only the latter step, over one row an
    hour, is in one task.
    """
    ev = table(spark, sf_dir, "events").withColumn("h", F.date_trunc("hour", "ts"))
    within = ev.select(F.col("user_id").alias("src"), F.expr("lead(user_id) over (partition by h order by ts, event_id)").alias("dst"))
    hours = ev.groupBy("h").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("src"))
    across = hours.select("src", F.expr("lead(first) over (order by h)").alias("dst"))
    return ev.select(F.col("user_id").alias("id")).distinct(), within.unionByName(across).where("dst is not null").distinct()


def points(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, dims).alias("p"))


# ---------------------------------------------------------------- logs


def append_log(runs: DataFrame, path: str) -> None:
    """Adds measured rows, with the machine, to a JSON log."""
    machine = F.struct(F.lit(platform.platform()).alias("platform"), F.lit(platform.processor()).alias("processor"), F.lit(platform.python_version()).alias("python"))
    runs.withColumn("machine", machine).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log; no rows if there is none yet."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
