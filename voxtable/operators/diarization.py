"""Diarization error rate by a sweep over elementary intervals, and small-cluster reassignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from voxtable.plans.storage import materialize


REF, HYP, COLLAR, UEM = range(4)


def _changes(turns: DataFrame, side: int) -> DataFrame:
    """(rec_id, t, side, speaker, d): where a turn starts and where it ends; turns without both are left out."""
    held = turns.select("rec_id", "start", "end", F.col("speaker").cast("string").alias("speaker")).dropna(subset=["rec_id", "start", "end"])
    ends = [F.struct(F.col(c).cast("double").alias("t"), F.lit(d).cast("byte").alias("d")) for c, d in (("start", 1), ("end", -1))]
    return held.select("rec_id", F.explode(F.array(*ends)).alias("e"), "speaker").select("rec_id", "e.t", F.lit(side).cast("byte").alias("side"), "speaker", "e.d")


def _swept(skip_overlap: bool, only_uem: bool):
    """The sweep over changes in the order of their recordings and times: it holds who is active, and a batch of rows."""
    def sweep(batches):
        rec, last, active = None, None, ({}, {}, {}, {})
        for batch in batches:
            out = []
            for r, t, side, speaker, d in zip(batch["rec_id"], batch["t"], batch["side"], batch["speaker"], batch["d"]):
                if r != rec:
                    rec, last, active = r, t, ({}, {}, {}, {})
                if t != last:
                    refs, hyps = (sorted(k for k, n in active[x].items() if n > 0) for x in (REF, HYP))
                    scored = (refs or hyps) and not (skip_overlap and len(refs) > 1)
                    if scored and not any(n > 0 for n in active[COLLAR].values()) and (not only_uem or any(n > 0 for n in active[UEM].values())):
                        out.append((r, t - last, refs, hyps))
                    last = t
                if speaker is not None:
                    known = active[side]
                    n = known.pop(speaker, 0) + d
                    if n:
                        known[speaker] = n
            yield pd.DataFrame(out, columns=["rec_id", "duration", "refs", "hyps"])

    return sweep


def intervals(ref: DataFrame, hyp: DataFrame, collar: float = 0.0, skip_overlap: bool = False, uem: DataFrame | None = None) -> DataFrame:
    """(rec_id, duration, refs, hyps) of the elementary intervals that are scored.

    Every boundary is a change of +1 or -1 for its speaker. Behind one shuffle a task reads its recordings' changes
    in the order of time and gives the interval between each two times with those who are active there. One
    recording isn't split over tasks. collar is the whole width around a reference boundary.
    """
    changes = _changes(ref, REF).unionByName(_changes(hyp, HYP))
    if collar:
        edges = ref.dropna(subset=["start", "end"]).select("rec_id", F.explode(F.array("start", "end")).alias("c"))
        changes = changes.unionByName(_changes(edges.select("rec_id", F.lit("").alias("speaker"), (F.col("c") - collar / 2).alias("start"), (F.col("c") + collar / 2).alias("end")), COLLAR))
    if uem is not None:
        changes = changes.unionByName(_changes(uem.select("rec_id", F.lit("").alias("speaker"), "start", "end"), UEM))
    kind = StructType().add("rec_id", ref.schema["rec_id"].dataType).add("duration", DoubleType()).add("refs", ArrayType(StringType())).add("hyps", ArrayType(StringType()))
    return changes.repartition("rec_id").sortWithinPartitions("rec_id", "t").mapInPandas(_swept(skip_overlap, uem is not None), kind)


def greedy_mapping(cut: DataFrame) -> DataFrame:
    """(rec_id, pairs): reference and hypothesis speakers matched one to one, longest common time first."""
    common = cut.select("rec_id", "duration", F.explode("refs").alias("ref"), "hyps").select("rec_id", "duration", "ref", F.explode("hyps").alias("hyp"))
    common = common.groupBy("rec_id", "ref", "hyp").agg(F.round(F.sum("duration"), 9).alias("d"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "ref", "hyp")))
    kind = "array<struct<ref:string,hyp:string>>"

    def step(done: Column, x: Column) -> Column:
        used = F.exists(done, lambda p: (p["ref"] == x["ref"]) | (p["hyp"] == x["hyp"]))
        return F.when(used, done).otherwise(F.concat(done, F.array(F.struct(x["ref"].alias("ref"), x["hyp"].alias("hyp")))))

    return common.groupBy("rec_id").agg(F.aggregate(ranked, F.array().cast(kind), step).alias("pairs"))


def diarization_errors(ref: DataFrame, hyp: DataFrame, collar: float = 0.0, skip_overlap: bool = False, uem: DataFrame | None = None) -> DataFrame:
    """Per recording: total reference time, miss, false alarm and confusion, in seconds."""
    cut = materialize(intervals(ref, hyp, collar, skip_overlap, uem), "intervals")  # read twice
    joined = cut.join(greedy_mapping(cut), "rec_id", "left")
    right = F.size(F.filter(F.coalesce("pairs", F.array().cast("array<struct<ref:string,hyp:string>>")), lambda p: F.array_contains("refs", p["ref"]) & F.array_contains("hyps", p["hyp"])))
    r, h, d = F.size("refs"), F.size("hyps"), F.col("duration")
    return joined.groupBy("rec_id").agg(
        F.sum(d * r).alias("total"), F.sum(d * F.greatest(r - h, F.lit(0))).alias("miss"), F.sum(d * F.greatest(h - r, F.lit(0))).alias("false_alarm"), F.sum(d * (F.least(r, h) - right)).alias("confusion")
    )


def error_rate(errors: DataFrame) -> DataFrame:
    """One row: the sums over recordings and the rate."""
    sums = errors.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("total", "miss", "false_alarm", "confusion")])
    return sums.withColumn("der", F.when(F.col("total") > 0, (F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.col("total")))


def report_lines(errors: DataFrame) -> DataFrame:
    """(rank, value): one text line for each recording and, first, one for all together, with rates in percent."""
    rate = F.when(F.col("total") > 0, 100 * (F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.col("total"))
    sums = errors.rollup("rec_id").agg(*[F.sum(c).alias(c) for c in ("total", "miss", "false_alarm", "confusion")], F.grouping("rec_id").alias("all"))
    name = F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("rec_id").cast("string"))
    line = F.concat(name, F.coalesce(F.format_string(" DER %.2f%%", rate), F.lit(" no speech")))
    return sums.select((1 - F.col("all")).cast("int").alias("rank"), line.alias("value"))


#: Numbers in the centroids that may be broadcast: 8 MB as doubles.
BROADCAST_NUMBERS = 1_000_000
SALTS = 64


def reassign_small_clusters(vectors: DataFrame, least: int = 12, group: str = "rec_id", cluster: str = "cluster", vector: str = "embedding") -> DataFrame:
    """vectors with new_cluster: members of clusters smaller than ``least`` go to the large cluster of
    their group with the nearest centroid by cosine distance; they stay where no large one exists.

    Centroids are broadcast where they are few by count. Beyond it, each small vector goes to one of
    SALTS parts of its group and the group's centroids to all of them, so that a large group is no one task.
    """
    parts = vectors.select(group, cluster, F.posexplode(vector).alias("i", "x"))
    sizes = vectors.groupBy(group, cluster).agg(F.count("*").alias("members"))
    means = parts.groupBy(group, cluster, "i").agg(F.avg("x").alias("x")).groupBy(group, cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))
    large = materialize(sizes.filter(F.col("members") >= least).join(means, [group, cluster]).select(group, F.col(cluster).alias("_to"), "centroid"), "centroids")
    small = vectors.join(sizes.filter(F.col("members") < least), [group, cluster])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    v, c = F.col(vector), F.col("centroid")
    distance = 1 - dot(v, c) / F.sqrt(dot(v, v) * dot(c, c))
    key = [x for x in vectors.columns if x not in (group, cluster, vector)]
    if (large.agg(F.sum(F.size("centroid"))).first()[0] or 0) <= BROADCAST_NUMBERS:
        met = small.join(F.broadcast(large), group)
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = small.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).join(large.withColumn("_salt", salt), [group, "_salt"])
    moved = met.groupBy(group, cluster, *key).agg(F.min_by("_to", F.struct(F.round(distance, 9), F.col("_to"))).alias("new_cluster"))
    return vectors.drop(vector).join(moved, [group, cluster, *key], "left").withColumn("new_cluster", F.coalesce("new_cluster", cluster))
