"""Ranks over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.plans.storage import materialize


def global_rank(rows: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """rows with their rank from 1 in the order of all rows, which should have no ties.

    Rows are dealt by ranges of the order and stored with their range's number; each range ranks its
    own rows and adds the sizes of the ranges before it.
    """
    held = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # one row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return held.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
