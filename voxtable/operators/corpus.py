"""Recordings, manifests and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without(recordings: DataFrame, excluded: DataFrame, key: str = "rec_id") -> DataFrame:
    return recordings.join(excluded, key, "left_anti")


def category_of(name: Column) -> Column:
    """The second part of a clip's file name."""
    return F.element_at(F.split(name, "_"), 2)


#: Fixed value: the category of clips that preparation leaves out.
DROPPED = ("REPAS",)


def kept_categories(clips: DataFrame, name: str, dropped: tuple[str, ...] = DROPPED) -> DataFrame:
    """Clips whose name has none of the dropped categories; names without a category stay."""
    return clips.filter(~F.coalesce(category_of(F.col(name)).isin(*dropped), F.lit(False)))


def first_samples(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order, where a data set is limited to so many samples."""
    return rows.orderBy(*order).limit(n)


MISSING = "<NA>"


def has_text(text: Column, exact: bool = False) -> Column:
    """Whether an utterance has a text: not null and, as written, not <NA>; unless exact, <NA> or nothing
    between white space doesn't count either."""
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.coalesce(text != MISSING if exact else ~stripped.isin(MISSING, ""), F.lit(False))


def long_enough(duration: Column, least: float = 0.01) -> Column:
    """Whether a duration is known and at least ``least`` seconds."""
    return F.coalesce(duration >= least, F.lit(False))


def known_roles(turns: DataFrame, role: str = "speaker", unknown: str = "inintelligible") -> DataFrame:
    """Turns but for those that nobody could be named for."""
    return turns.filter(F.coalesce(F.col(role) != unknown, F.lit(True)))


def least_speakers(segments: DataFrame, least: int = 2) -> DataFrame:
    """(rec_id, speakers) of recordings with fewer than ``least`` distinct speakers: those that a corpus mustn't have."""
    return segments.groupBy("rec_id").agg(F.countDistinct("speaker").alias("speakers")).filter(F.col("speakers") < least)


def recording_summary(segments: DataFrame, least_speakers: int = 2) -> DataFrame:
    """Per recording (rec_id, category, duration, nb_speakers) and, with rec_id TOTAL, over all that are left.

    segments: rec_id, category, speaker, duration. Recordings with fewer speakers are left out.
    """
    # speakers are counted once per recording first, so the total counts distinct ones over a small table
    per_speaker = segments.groupBy("rec_id", "category", "speaker").agg(F.sum("duration").alias("duration"))
    many = per_speaker.groupBy("rec_id").agg(F.countDistinct("speaker").alias("n")).filter(F.col("n") >= least_speakers)
    kept = per_speaker.join(many, "rec_id", "left_semi")
    sets = kept.groupingSets([["rec_id", "category"], []], "rec_id", "category").agg(F.sum("duration").alias("duration"), F.countDistinct("speaker").cast("int").alias("nb_speakers"), F.grouping_id().alias("level"))
    return sets.select(F.when(F.col("level") == 0, F.col("rec_id").cast("string")).otherwise("TOTAL").alias("rec_id"), "category", "duration", "nb_speakers")


def sample_offsets(start_ms: Column, end_ms: Column, rate: int) -> list[Column]:
    """start and stop in samples and the duration in seconds that they leave."""
    at = lambda ms: (ms / 1000 * rate).cast("long")
    return [at(start_ms).alias("start"), at(end_ms).alias("stop"), ((at(end_ms) - at(start_ms)) / rate).alias("duration")]


MANIFEST = ["ID", "text", "source", "duration", "start", "stop", "wav_file", "n_tokens"]


def utterance_id(source: str, *parts: Column | str) -> Column:
    """Ids of a source's utterances: its name and the parts, joined by _; null where a part is."""
    return F.concat(F.lit(source), *[x for p in parts for x in (F.lit("_"), (F.col(p) if isinstance(p, str) else p).cast("string"))])


def clip_id(path: Column) -> Column:
    """The part of a clip's file name behind its last _, without extension."""
    return F.element_at(F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "_"), -1)


def manifest(rows: DataFrame, source: str | Column, text: Column, utterance: Column, **columns: Column) -> DataFrame:
    """Manifest rows of a source, or of those that a column names; columns that a source doesn't have are null, and -1
    offsets stand for whole files."""
    types = {"duration": "double", "start": "long", "stop": "long", "wav_file": "string", "n_tokens": "int"}
    extra = [columns[c].cast(t).alias(c) if c in columns else F.lit(-1 if c in ("start", "stop") else None).cast(t).alias(c) for c, t in types.items()]
    return rows.select(utterance.alias("ID"), text.alias("text"), F.lit(source).alias("source"), *extra)


def assemble(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Give manifest rows of (source, split) the split of the assembled corpus; pairs without a rule go.

    The rules are a short fixed table, so they become one CASE expression and no join.
    """
    split = F.coalesce(*[F.when((F.col("source") == source) & (F.col("split") == old), F.lit(new)) for source, old, new in rules])
    return parts.withColumn("split", split).filter("split is not null")
