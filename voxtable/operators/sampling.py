"""Weighted sampling by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.functions.text import hash_uniform
from voxtable.operators.ranking import global_rank
from voxtable.operators.splits import ranked


def source_weights(rows: DataFrame, source: str, subset: dict[str, float]) -> DataFrame:
    """(source, n, ratio, weight, n_samples): weight = wanted share over the source's ratio of all rows.

    n_samples is the same for all: the rounded sum of n times the wanted share. A source without a
    share is an error.
    """
    share = F.element_at(F.create_map(*[F.lit(x) for pair in subset.items() for x in pair]), F.col(source))
    counts = rows.groupBy(source).agg(F.count("*").alias("n")).withColumn("share", F.coalesce(share, F.raise_error(F.concat(F.lit("no share for source "), F.col(source))).cast("double")))
    every = Window.partitionBy(F.lit(0))  # one row for each source
    totals = counts.withColumns({"total": F.sum("n").over(every), "n_samples": F.bround(F.sum(F.col("n") * F.col("share")).over(every)).cast("long")})
    return totals.select(source, "n", (F.col("n") / F.col("total")).alias("ratio"), (F.col("share") / (F.col("n") / F.col("total"))).alias("weight"), "n_samples")


def sampling_key(weight: Column, seed: object, epoch: int, *ids: Column) -> Column:
    """Keys whose smallest form a weighted sample without replacement."""
    return -F.log(F.greatest(hash_uniform(f"{seed}|{epoch}", *ids), F.lit(1e-300))) / weight


def weighted_sample(rows: DataFrame, key: str, source: str, subset: dict[str, float], seed: object, epoch: int) -> DataFrame:
    """The sample of an epoch: the n_samples rows with the smallest keys, rounded so that engines agree."""
    weights = source_weights(rows, source, subset)
    n = weights.agg(F.max("n_samples")).first()[0] or 0
    keyed = rows.join(F.broadcast(weights.select(source, "weight")), source).withColumn("sample_key", F.round(sampling_key(F.col("weight"), seed, epoch, F.col(key)), 9))
    return global_rank(keyed.drop("weight"), [F.col("sample_key"), F.col(key)], "_rn").filter(F.col("_rn") <= n).drop("_rn")


def exact_sample(rows: DataFrame, key: str, source: str, subset: dict[str, float], seed: object, epoch: int) -> DataFrame:
    """Each source's rounded share exactly: its first rows in the hash order."""
    share = F.element_at(F.create_map(*[F.lit(x) for pair in subset.items() for x in pair]), F.col(source))
    return ranked(rows, key, f"{seed}|{epoch}", [source]).filter(F.col("rn") <= F.bround(F.col("n") * share)).drop("rn", "n")
