"""Batches of utterances and token sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.functions.text import hash_order
from voxtable.operators.ranking import global_rank
from voxtable.operators.splits import ranked
from voxtable.plans.storage import materialize


def fixed_batches(rows: DataFrame, file: str, order: str, size: int) -> DataFrame:
    """rows with batch: ``size`` consecutive rows of a file, the last batch may be short."""
    place = F.row_number().over(Window.partitionBy(file).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("int"))


def length_boundaries(rows: DataFrame, length: str, buckets: int = 30) -> list[float]:
    """Upper bounds of ``buckets`` buckets of about equal numbers of rows: the lengths at those ranks, exactly.

    Rows are counted by length; the distinct lengths are dealt by ranges, each of which adds up its own counts and
    those of the ranges before it. Equal bounds become one; the last is the greatest length. Null lengths don't
    count, and an empty table has no bounds.
    """
    counts = rows.select(F.col(length).alias("v")).dropna().groupBy("v").agg(F.count("*").alias("n"))
    held = materialize(counts.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "lengths")
    total = held.agg(F.sum("n")).first()[0]
    if not total:
        return []
    wanted = sorted({math.ceil(i / buckets * total) for i in range(1, buckets)} | {total})
    over = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("range").agg(F.sum("n").alias("size")).select("range", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("before"))  # one row for each range
    own = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    to = held.withColumn("to", F.sum("n").over(own)).join(F.broadcast(starts), "range").withColumn("to", F.col("to") + F.col("before"))
    met = to.filter(F.exists(F.array(*map(F.lit, wanted)), lambda r: (r > F.col("to") - F.col("n")) & (r <= F.col("to"))))
    return sorted(float(r["v"]) for r in met.select("v").collect())  # a row for each bucket at most


def bucket_batches(rows: DataFrame, key: str, length: str, boundaries: list[float], capacity: float, seed: object, epoch: int, drop_last: bool = False, max_examples: int | None = None) -> DataFrame:
    """rows with bucket and batch: rows of similar length, as many as fit into capacity at the bucket's bound, and at
    most ``max_examples``.

    Rows beyond the last boundary share a bucket of batches of one. Order within a bucket is by hash of the key, which
    must tell rows apart: the rows of a weighted sample need a key of their own for each draw.
    """
    bucket = F.size(F.filter(F.array(*map(F.lit, boundaries)), lambda b: b < F.col(length)))
    limits = [max(1, int(capacity // b)) if b else 1 for b in boundaries] + [1]
    if max_examples is not None:
        limits = [min(n, max_examples) for n in limits]
    held = ranked(rows.withColumn("bucket", bucket), key, f"{seed}|{epoch}", ["bucket"])
    limit = F.array(*map(F.lit, limits))[F.col("bucket")]
    out = held.withColumn("batch", F.floor((F.col("rn") - 1) / limit).cast("long"))
    if drop_last:
        out = out.filter((F.col("batch") + 1) * limit <= F.col("n"))
    return out.drop("rn", "n")


def batch_padding(batches: DataFrame, length: str) -> DataFrame:
    """Per batch: rows, frames, padding up to its longest row, and padding in percent of the frames."""
    frames, padding = F.sum(length), F.count("*") * F.max(length) - F.sum(length)
    return batches.groupBy("bucket", "batch").agg(F.count("*").alias("rows"), frames.alias("frames"), padding.alias("padding"), F.when(frames > 0, 100 * padding / frames).alias("padding_percent"))


def bucket_statistics(batches: DataFrame, length: str, capacity: float) -> DataFrame:
    """Per bucket: rows, the batches that its length would fill, and its range of lengths in percent of their mean."""
    total, n = F.sum(length), F.count("*")
    return batches.groupBy("bucket").agg(n.alias("rows"), F.floor(total / capacity).alias("full_batches"), F.when(total > 0, 100 * (F.max(length) - F.min(length)) / (total / n)).otherwise(0.0).alias("pad_factor"))


def batch_order(batches: DataFrame, length: str, training: bool, seed: object = 0) -> DataFrame:
    """(bucket, batch, place): ascending by longest row for evaluation, by hash for training."""
    per = batches.groupBy("bucket", "batch").agg(F.max(length).alias("longest"))
    key = [hash_order(seed, F.col("bucket"), F.col("batch")), F.col("bucket"), F.col("batch")] if training else [F.col("longest"), F.col("bucket"), F.col("batch")]
    return global_rank(per, key, "place")


def within_tokens(rows: DataFrame, tokens: str, least: int = 2, most: int | None = None) -> DataFrame:
    """Rows with at least ``least`` and at most ``most`` tokens; null sequences go."""
    n = F.size(tokens)
    return rows.filter(F.col(tokens).isNotNull() & (n >= least) & (F.lit(most is None) | (n <= (most or 0))))


def add_marks(tokens: Column, bos: int | None = None, eos: int | None = None) -> Column:
    parts = ([F.array(F.lit(bos))] if bos is not None else []) + [tokens] + ([F.array(F.lit(eos))] if eos is not None else [])
    return F.concat(*parts)


def pad(tokens: Column, longest: Column, value: int = 0) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(value), longest - F.size(tokens)))


def unpad(tokens: Column, share: Column) -> Column:
    """Undo pad, from the length relative to the longest sequence."""
    return F.slice(tokens, 1, F.round(share * F.size(tokens)).cast("int"))


def collapse_frames(frames: DataFrame, blank: str, group: str = "utt_id", order: str = "frame", token: str = "token") -> DataFrame:
    """(group, tokens): repeated tokens of consecutive frames become one and blanks go."""
    before = F.lag(token).over(Window.partitionBy(group).orderBy(order))
    kept = frames.withColumn("_before", before).filter((F.col(token) != blank) & ~F.col(token).eqNullSafe(F.col("_before")))
    tokens = kept.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, token))), lambda x: x[token]).alias("tokens"))
    return frames.select(group).distinct().join(tokens, group, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
