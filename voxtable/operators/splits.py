"""Splits, folds and their checks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from voxtable.functions.text import hash_order
from voxtable.operators.graphs import connected_components, star_ties
from voxtable.operators.ranking import global_rank
from voxtable.plans.storage import cleaned, forget, materialize

NAMES = ("train", "dev", "test")


def _ratios(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")


def ranked(rows: DataFrame, key: str, seed: object, group: list[str] | None = None, buckets: int = 4096) -> DataFrame:
    """rows with rn, the rank of their hash within a group (or all rows), and the group's size n.

    Ranks are found inside ranges of the hash (4096 at most) and moved by the sizes of the ranges before, so
    that no task ranks a whole table: hashes are even, so a range has about its share of the distinct keys.
    """
    group = group or []
    held = rows.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 3), 16, 10).cast("int") * buckets / 4096).cast("int"))
    counts = held.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    starts = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_c").over(over)})
    within = held.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key)))
    names = {c: f"_s{c}" for c in [*group, "_b"]}
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    joined = within.join(starts.drop("_c").withColumnsRenamed(names), same)
    return joined.withColumn("rn", F.col("_rank") + F.col("_before")).drop("_h", "_b", "_rank", "_before", *names.values())


def ratio_split(rows: DataFrame, key: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: object = 12354) -> DataFrame:
    """rows with split: the first int(ratio * n) of the hash order are train, the next dev, the rest test."""
    _ratios(ratios)
    n, rn = F.col("n"), F.col("rn")
    train, dev = F.floor(n * ratios[0]), F.floor(n * ratios[1])
    rest = F.lit("test" if ratios[2] > 0 else "dev" if ratios[1] > 0 else "train")
    return ranked(rows, key, seed).withColumn("split", F.when(rn <= train, "train").when(rn <= train + dev, "dev").otherwise(rest)).drop("n", "rn")


def recording_components(mentions: DataFrame) -> DataFrame:
    """(rec_id, component) from (rec_id, speaker): recordings linked by common speakers.

    Each recording of a speaker is tied to the speaker's least one, so there are fewer ties than mentions, and none
    for speakers of one recording. A component is named by its least recording, as text. Null ends are left out.
    Ids that are whole numbers become text only in the ties, which are fewer: mentions are then grouped by fixed-width rows.
    """
    whole = isinstance(mentions.schema["rec_id"].dataType, IntegralType)
    held = mentions.select(F.col("rec_id") if whole else F.col("rec_id").cast("string").alias("rec_id"), "speaker").dropna()
    ties, least = star_ties(held, "speaker", "rec_id")
    found = connected_components(ties.select(F.col("u").cast("string"), F.col("v").cast("string")), "u", "v")
    forget(least)
    tied = found.filter("node <> component").withColumnRenamed("node", "rec_id")
    return held.select("rec_id").distinct().select(F.col("rec_id").cast("string")).join(tied, "rec_id", "left").select("rec_id", F.coalesce("component", "rec_id").alias("component"))


def deal(room: list[int], size: int, items: int) -> list[int]:
    """How many of equal items go to each bin, if each goes to the bin with the most room left, the first of
    those on a tie. That picks the greatest values of the falling series room - k * size of all bins, so
    the value of the last pick is searched for instead of making the picks one by one."""
    def above(v: int) -> list[int]:
        return [max(0, -((v - r) // size)) if r > v else 0 for r in room]

    low, high = min(room) - size * items - 1, max(room)  # above(low) is enough, above(high) is nothing
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(above(mid)) >= items else (low, mid)
    out = above(high)
    for k, r in enumerate(room):
        if sum(out) < items and r >= high and (r - high) % size == 0:
            out[k] += 1
    return out


def plan_bins(sizes: list[tuple[int, int]], targets: list[int]) -> tuple[list[tuple[int, int, int, int]], int]:
    """(size, rank_from, rank_to, bin) for components given as (size, how many), largest first, and the objective.

    The last three components are placed one by one: as long as there are three at all, a bin that is
    still empty gets one before they run out.
    """
    total = sum(n for _, n in sizes)
    room, used, out, left = list(targets), [0] * len(targets), [], total
    for size, n in sorted(sizes, reverse=True):
        rank = 0
        many = min(n, max(left - 3, 0))
        for k, c in enumerate(deal(room, size, many) if many else []):
            if c:
                out.append((size, rank, rank + c, k))
                rank, used[k], room[k] = rank + c, used[k] + c, room[k] - c * size
        left -= many
        for _ in range(n - many):
            empty = [k for k, u in enumerate(used) if not u]
            among = empty if total >= 3 and left <= len(empty) else range(len(room))
            k = max(among, key=lambda k: (room[k], -k))
            out.append((size, rank, rank + 1, k))
            rank, used[k], room[k], left = rank + 1, used[k] + 1, room[k] - size, left - 1
    return out, sum(r * r for r in room)


def least_objective(targets: list[int], total: int, largest: int) -> int:
    """What no assignment of ``total`` recordings can get below, if one component has ``largest`` of them: the sum of
    the squared rooms left, were all else divisible. plan_bins is optimal wherever it reaches this."""
    def even(room: int, bins: int) -> int:
        q, r = divmod(room, bins)
        return (bins - r) * q * q + r * (q + 1) * (q + 1)

    room, bins = sum(targets) - total, len(targets)
    best = []
    for target in targets:
        own = target - largest
        # the bin with the largest component has at most its own room
        best.append(even(room, bins) if bins == 1 or own >= -(-room // bins) else own * own + even(room - own, bins - 1))
    return max(min(best), even(room, bins))


def stratified_split(recordings: DataFrame, components: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: object = 12354) -> DataFrame:
    """(rec_id, component, category, split, objective, bound): whole components go to one split, category by
    category. The objective is the category's; it can't be less than bound, so the gap is at most their difference.

    A component's category is its most frequent one. Largest first, components go to the split with the
    largest remaining target; with three or more components no split stays empty. The plan is made over
    counts of equal sizes, of which a category of n recordings has at most sqrt(2n); components take
    their places by joining on their rank, in hash order, among those of their category and size.
    """
    _ratios(ratios)
    sized = recordings.join(components, "rec_id").groupBy("component").agg(F.count("*").alias("size"), F.mode("category", True).alias("category"))
    sized = materialize(sized, "components")
    counts: dict[str | None, list[tuple[int, int]]] = {}
    with cleaned(recordings.sparkSession):
        for r in sized.groupBy("category", "size").agg(F.count("*").alias("n")).collect():
            counts.setdefault(r["category"], []).append((r["size"], r["n"]))
    runs = []
    for category, sizes in counts.items():
        recs = sum(size * n for size, n in sizes)
        plan, objective = plan_bins(sizes, [math.ceil(recs * r) for r in ratios])
        bound = least_objective([math.ceil(recs * r) for r in ratios], recs, max(s for s, _ in sizes))
        runs += [(category, size, low, high, NAMES[k], float(objective), float(bound)) for size, low, high, k in plan]
    spark = recordings.sparkSession
    plan = F.broadcast(spark.createDataFrame(runs, "category string, size long, low long, high long, split string, objective double, bound double"))  # bounded by the numbers of sizes
    placed = ranked(sized, "component", seed, ["category", "size"]).alias("c").join(
        plan.alias("p"), F.col("c.category").eqNullSafe(F.col("p.category")) & (F.col("c.size") == F.col("p.size")) & (F.col("rn") > F.col("low")) & (F.col("rn") <= F.col("high"))
    )
    placed = materialize(placed.select("component", "c.category", "split", "objective", "bound"), "placed")  # ranking's shuffle files go before the last join
    forget(sized)
    return components.join(placed, "component").select("rec_id", "component", "category", "split", "objective", "bound")


def document_split(documents: DataFrame, key: str, subset: float = 1.0, ratios: tuple[float, float, float] = (0.9, 0.05, 0.05), seed: object = 0) -> DataFrame:
    """documents with split, over the first int(subset * n) of them in the hash order."""
    kept = ranked(documents, key, f"{seed}|subset").filter(F.col("rn") <= F.floor(F.col("n") * subset)).drop("rn", "n") if subset < 1 else documents
    return ratio_split(kept, key, ratios, seed)


def of_split(utterances: DataFrame, splits: DataFrame, key: str, split: str | None = None) -> DataFrame:
    """The utterances that a split lists: those of one split, or those of any, with the split's name."""
    if split is not None:
        return utterances.join(splits.filter(F.col("split") == split).select(key), key, "left_semi")
    return utterances.join(splits.select(key, "split").distinct(), key)


def attach_split(segments: DataFrame, splits: DataFrame, key: str = "rec_id") -> DataFrame:
    """Segments with the split of their recording; recordings without one go."""
    return segments.join(splits.select(key, "split"), key)


def ids_by_speaker(utterances: DataFrame, speaker: str = "speaker", key: str = "utt_id", group: list[str] | None = None) -> DataFrame:
    """(speaker, [group], ids): a speaker's utterance ids in order, within a recording where ``group`` names one.
    A speaker's ids are one array, so group by recording where a speaker may have very many."""
    return utterances.groupBy(speaker, *(group or [])).agg(F.array_sort(F.collect_list(key)).alias("ids"))


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys (recordings or speakers) that more than one split has; empty for a clean split."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def describe_split(recordings: DataFrame) -> DataFrame:
    """Per split and, as TOTAL, over all: recordings, total and mean duration, mentions of speakers, most speakers, categories with counts.
    recordings: split, category, duration, nb_speakers."""
    per = recordings.groupBy("split", "category").agg(F.count("*").alias("n"), F.sum("duration").alias("d"), F.sum("nb_speakers").alias("s"), F.max("nb_speakers").alias("m"))
    both = per.unionByName(per.groupBy("category").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("s").alias("s"), F.max("m").alias("m")).withColumn("split", F.lit("TOTAL")))
    return both.groupBy("split").agg(
        F.sum("n").alias("recordings"), F.sum("d").alias("duration"), (F.sum("d") / F.sum("n")).alias("mean_duration"), F.sum("s").alias("speakers"), F.max("m").alias("most_speakers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "n"))), lambda x: F.concat_ws(":", x["category"], x["n"].cast("string"))), ",").alias("categories"),
    )


def kfold(rows: DataFrame, key: str, k: int, seed: object = 0) -> DataFrame:
    """(fold, key, role): in each fold one part is test; part sizes differ by one at most, the first are larger."""
    part = ranked(rows.select(key), key, seed)
    small, extra = F.floor(F.col("n") / k), F.col("n") % k
    index = F.col("rn") - 1
    fold = F.when(index < extra * (small + 1), F.floor(index / (small + 1))).otherwise(extra + F.floor((index - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    owned = part.select(key, fold.cast("int").alias("own"))
    return owned.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"), key, "own").select("fold", key, F.when(F.col("fold") == F.col("own"), "test").otherwise("train").alias("role"))


def leave_one_out(rows: DataFrame, key: str, speaker: str, most: int = 1000) -> DataFrame:
    """(fold, key, role): one fold for each speaker, whose rows are test. Every row is in every fold by
    definition; the speakers are taken in blocks of ``most``, each of which makes its folds in one pass over rows."""
    known = materialize(global_rank(rows.select(F.col(speaker).alias("fold")).distinct(), [F.col("fold")]), "speakers")
    kind = f"array<{rows.schema[speaker].dataType.simpleString()}>"

    def block(low: int) -> DataFrame:
        names = [r["fold"] for r in known.filter(F.col("rn").between(low + 1, low + most)).orderBy("rn").collect()]
        return rows.select(F.explode(F.array(*map(F.lit, names)).cast(kind)).alias("fold"), key, F.col(speaker).alias("_who"))

    every = reduce(DataFrame.unionAll, map(block, range(0, max(known.count(), 1), most)))
    return every.select("fold", key, F.when(F.col("fold") == F.col("_who"), "test").otherwise("train").alias("role"))
