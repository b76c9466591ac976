"""Joins of utterances and speaker turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.plans.storage import materialize


def role_speakers(metadata: DataFrame) -> DataFrame:
    """(rec_id, role, speaker) from (rec_id, doctor, patients joined by -): the doctor, each numbered
    patient, and the first patient under two further names."""
    patients = metadata.select("rec_id", F.posexplode(F.split("patients", "-")).alias("i", "speaker"))
    first = patients.filter("i = 0")
    numbered = patients.select("rec_id", F.concat(F.lit("patient_"), (F.col("i") + 1).cast("string")).alias("role"), "speaker")
    named = [first.select("rec_id", F.lit(role).alias("role"), "speaker") for role in ("patient", "appelant")]
    doctor = metadata.select("rec_id", F.lit("medecin").alias("role"), F.col("doctor").alias("speaker"))
    return doctor.unionByName(numbered).unionByName(named[0]).unionByName(named[1])


def named_turns(turns: DataFrame, names: DataFrame) -> DataFrame:
    """turns (rec_id, role, ...) with their speaker from names (rec_id, role, speaker); a role without a name is an error."""
    held = turns.join(names, ["rec_id", "role"], "left")
    return held.withColumn("speaker", F.coalesce("speaker", F.raise_error(F.concat(F.lit("no speaker for role "), F.coalesce("role", F.lit("null")), F.lit(" in "), F.col("rec_id").cast("string"))).cast("string")))


def must_overlap(found: DataFrame) -> DataFrame:
    """The result of first_overlap, where an utterance without a speaker is an error."""
    return found.withColumn("speaker", F.coalesce("speaker", F.raise_error(F.concat(F.lit("no speaker overlaps utterance "), F.col("utt_id").cast("string"))).cast("string")))


def first_overlap(utterances: DataFrame, turns: DataFrame, width: float = 30.0) -> DataFrame:
    """utterances (rec_id, utt_id, start, end) with the speaker of the first turn (rec_id, turn_no,
    start, end, speaker) that overlaps, bounds included; null where none does.

    Both sides are dealt to the time bins they touch, so that the range join is an equi-join on
    (rec_id, bin); a pair that meets in several bins doesn't change a minimum. Of turns with equal
    bounds the first gives the place and the last the speaker.
    """
    def bins(df: DataFrame) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / width).cast("long")
        return df.withColumn("bin", F.explode(F.sequence(at("start"), F.greatest(at("start"), at("end")))))

    distinct = turns.groupBy("rec_id", "start", "end").agg(F.min("turn_no").alias("turn_no"), F.max_by("speaker", "turn_no").alias("speaker"))
    right = bins(distinct).select("rec_id", "bin", F.col("start").alias("s"), F.col("end").alias("e"), "turn_no", "speaker")
    pairs = bins(utterances).join(right, ["rec_id", "bin"]).filter((F.col("s") <= F.col("end")) & (F.col("e") >= F.col("start")))
    found = pairs.groupBy("rec_id", "utt_id").agg(F.min_by("speaker", "turn_no").alias("speaker"))
    return utterances.join(found, ["rec_id", "utt_id"], "left")


def zip_lines(left: DataFrame, right: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """Lines of two equally long texts side by side; unequal lengths are an error."""
    sides = left.select(key, F.split(text, "\n", -1).alias("a")).join(right.select(key, F.split(text, "\n", -1).alias("b")), key)
    same: Column = F.assert_true(F.size("a") == F.size("b"), "line counts differ")
    return sides.select(key, F.when(same.isNull(), F.arrays_zip("a", "b")).alias("z")).select(key, F.posexplode("z").alias("line", "z")).select(key, "line", F.col("z.a").alias("left"), F.col("z.b").alias("right"))


#: Rows with the same key from which on a key counts as hot, and tasks that its rows are dealt to.
HOT, PARTS = 100_000, 64


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], hot: int = HOT) -> DataFrame:
    """left.join(right, keys, "left") for a right side whose keys are unique. Rows of left with a key that at least
    ``hot`` rows have are dealt to PARTS tasks by a hash of the columns ``by``, and the right side's row for it goes
    to each of them. Null keys meet nothing; tables without hot keys are joined as they are."""
    busy = left.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= hot)
    table = materialize(busy.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot")), "hot")
    if table.isEmpty():
        return left.join(right, keys, "left")
    on = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    drop = [f"_hot_{k}" for k in keys] + ["_hot"]
    dealt = left.join(table, on, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int")).otherwise(-1)).drop(*drop)
    copies = right.join(table, on, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(-1))))).drop(*drop)
    return dealt.join(copies, [*keys, "_part"], "left").drop("_part")
