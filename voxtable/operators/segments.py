"""Rebuilding, merging and checking timed speech segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.functions.text import unescape

ORDER = ["turn", "pos"]
#: Tags in a turn.
TAGS = ("Turn", "Sync", "Who", "Event", "Comment")
#: What stands in a tag behind its name; quoted values may hold any sign but their quote.
ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: Comments, literal text, tags and text, in the order in which they are tried.
MARKUP = rf"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[/?!]?\w+{ATTRIBUTES}>|[^<]+"


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, or null; the same name inside another value isn't taken for it."""
    value = lambda group: F.regexp_extract(tag, rf"""(?s)(?:^<\w+|["'])\s+{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", group)
    return F.nullif(F.concat(value(1), value(2)), F.lit(""))


def markup(files: DataFrame) -> DataFrame:
    """(rec_id, at, part, tag) of files (rec_id, value): every piece of markup and text in order, without comments;
    tag is the name that an opening tag has, and null for other pieces."""
    parts = files.select("rec_id", F.posexplode(F.regexp_extract_all("value", F.lit(MARKUP), F.lit(0))).alias("at", "part"))
    return parts.filter(~F.col("part").startswith("<!--")).withColumn("tag", F.nullif(F.regexp_extract("part", r"^<(\w+)", 1), F.lit("")))


def trs_tokens(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags with their trailing text, and the speaker table, of annotation files (rec_id, value)."""
    parts = markup(files)
    heads = parts.filter("tag = 'Speaker'")
    speakers = heads.select("rec_id", attribute(F.col("part"), "id").alias("speaker_id"), unescape(attribute(F.col("part"), "name")).alias("speaker"))
    so_far = Window.partitionBy("rec_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    turns = parts.withColumn("turn", F.sum(F.when(F.col("tag") == "Turn", 1).otherwise(0)).over(so_far).cast("int") - 1).filter("turn >= 0")
    own = Window.partitionBy("rec_id", "turn").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("tag").isNotNull() & ~F.col("part").endswith("/>")
    ends = F.col("part").rlike(r"^</\w")
    placed = turns.withColumns(
        {
            "depth": F.sum(F.when(opens, 1).when(ends, -1).otherwise(0)).over(own), "pos": F.sum(F.col("tag").isNotNull().cast("int")).over(own).cast("int") - 1,
            "closed": F.max(F.col("part").rlike(r"^</Turn\b")).over(own),
        }
    ).filter("not closed")
    literal = F.col("part").startswith("<![CDATA[")
    # text in a turn itself is spoken; what stands inside another tag isn't
    spoken = F.when(literal & (F.col("depth") == 1), F.expr("substring(part, 10, length(part) - 12)")).when(~F.col("part").startswith("<") & (F.col("depth") == 1), unescape(F.col("part")))
    held = placed.withColumn("spoken", spoken).groupBy("rec_id", "turn", "pos").agg(
        F.max(F.when(F.col("tag").isNotNull(), F.struct("tag", "part"))).alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("spoken").isNotNull(), F.struct("at", "spoken")))), lambda x: x["spoken"]), "").alias("text")
    )
    head = F.col("head.part")
    tokens = held.select(
        "rec_id", "turn", "pos", "head.tag", attribute(head, "time").cast("double").alias("time"), attribute(head, "nb").cast("int").alias("nb"), F.split(attribute(head, "speaker"), " ").alias("speakers"),
        attribute(head, "startTime").cast("double").alias("turn_start"), attribute(head, "endTime").cast("double").alias("turn_end"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"),
    )
    return tokens, speakers


def markup_errors(tokens: DataFrame) -> DataFrame:
    """(rec_id, turn, pos, reason): tags that annotation files mustn't have, and text in a turn of several
    speakers before any Who. Such turns are quarantined: rebuild leaves them out."""
    before = Window.partitionBy("rec_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = tokens.withColumns({"_who": F.last("nb", True).over(before), "_speakers": F.max("speakers").over(Window.partitionBy("rec_id", "turn"))})
    reason = F.when(~F.col("tag").isin(*TAGS), F.concat(F.lit("unknown tag "), "tag")).when((F.size("_speakers") > 1) & F.col("_who").isNull() & (F.col("text") != ""), F.lit("text before Who"))
    return seen.withColumn("reason", reason).filter("reason is not null").select("rec_id", *ORDER, "reason")


def rebuild(tokens: DataFrame, speakers: DataFrame) -> DataFrame:
    """Segments (rec_id, turn, pos, speaker, start, end, text, overlap) from tags in order.

    The time is that of the last Sync, the end that of the next, the speaker the last Who's. Turns
    without speaker, with a repeated speaker, with a Who beyond their speakers, or that markup_errors
    lists are left out, and so are segments that end no later than they start.
    """
    turn = Window.partitionBy("rec_id", "turn")
    before = turn.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    after = turn.orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    told = tokens.withColumns(
        {
            "speakers": F.max("speakers").over(turn), "turn_end": F.max("turn_end").over(turn), "most": F.max("nb").over(turn),
            "start": F.coalesce(F.last("time", True).over(before), F.max("turn_start").over(turn)),
            "named": F.last("nb", True).over(before), "end": F.first("time", True).over(after),
        }
    ).withColumns({"end": F.coalesce("end", "turn_end"), "who": F.coalesce("named", F.lit(1))})
    odd = ~F.col("tag").isin(*TAGS) | ((F.size("speakers") > 1) & F.col("named").isNull() & (F.col("text") != ""))
    told = told.withColumn("odd", F.max(odd).over(turn))
    good = told.filter(~F.coalesce("odd", F.lit(False)) & F.col("speakers").isNotNull() & (F.size(F.array_distinct("speakers")) == F.size("speakers")) & (F.coalesce("most", F.lit(1)) <= F.size("speakers")) & (F.col("text") != ""))
    placed = good.withColumns({"speaker_id": F.col("speakers")[F.col("who") - 1], "overlap": F.size("speakers") > 1})
    ordered = turn.orderBy("pos")
    change = ~(F.col("speaker_id").eqNullSafe(F.lag("speaker_id").over(ordered)) & F.col("start").eqNullSafe(F.lag("start").over(ordered)))
    islands = placed.withColumn("change", change.cast("int")).withColumn("island", F.sum("change").over(before))
    joined = islands.groupBy("rec_id", "turn", "island").agg(
        F.min("pos").alias("pos"), F.first("speaker_id").alias("speaker_id"), F.first("start").alias("start"), F.first("end").alias("end"), F.first("overlap").alias("overlap"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    named = joined.join(speakers, ["rec_id", "speaker_id"], "left").filter("end > start")
    return named.select("rec_id", "turn", "pos", "speaker", "start", "end", "text", "overlap")


MERGED = ["rec_id", "turn", "pos", "speaker", "start", "end", "text", "overlap"]


def merge(segments: DataFrame, max_length: float = 10.0, across_overlap: bool = False) -> DataFrame:
    """Join segments that follow each other without a gap, as long as the whole is no longer than max_length.

    Segments join only within one speaker and one overlap flag; with across_overlap only within one
    speaker, and joined segments count as overlapping. The cap depends on where a merged segment began, so
    each speaker's segments are read in order, in one pass behind one shuffle. A task holds no more than the
    segment that is being merged and a batch of rows, however long a run without gaps is. Null times end a
    merged segment; null texts are left out of its text; the rows of null keys form keys of their own.
    """
    keys = ["rec_id", "speaker"] + ([] if across_overlap else ["overlap"])
    order = ["start", "turn", "pos"] if across_overlap else ["turn", "pos", "start"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged, kind = None, None
        for batch in batches:
            kind, done = batch.schema, []
            for rec_id, turn, pos, speaker, start, end, text, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                key = (rec_id, speaker) if across_overlap else (rec_id, speaker, overlap)
                follows = merged is not None and merged["key"] == key and None not in (merged["end"], merged["start"], start, end)
                if follows and merged["end"] == start and end - merged["start"] <= max_length:
                    merged["end"], merged["overlap"] = end, across_overlap or overlap
                    merged["texts"].append(text)
                    continue
                if merged is not None:
                    done.append(merged)
                merged = {"key": key, "rec_id": rec_id, "turn": turn, "pos": pos, "speaker": speaker, "start": start, "end": end, "texts": [text], "overlap": overlap}
            yield _merged_rows(done, kind)
        if merged is not None:
            yield _merged_rows([merged], kind)

    held = segments.select(*MERGED)
    return held.repartition(*keys).sortWithinPartitions(*keys, *order, "end", "text").mapInArrow(fold, held.schema)


def _merged_rows(rows: list[dict], kind: pa.Schema) -> pa.RecordBatch:
    for r in rows:
        r["text"] = " ".join(t for t in r["texts"] if t is not None)
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kind], schema=kind)


def violations(segments: DataFrame, max_length: float = 10.0, merged: bool = True) -> DataFrame:
    """Segments without end, that end too early, that start before the last one of their recording, or
    that touch the last one of their speaker though they should have been merged."""
    rec = Window.partitionBy("rec_id").orderBy(*ORDER)
    own = Window.partitionBy("rec_id", "speaker").orderBy(*ORDER)
    seen = segments.withColumns({"_before": F.lag("start").over(rec), "_end": F.lag("end").over(own), "_start": F.lag("start").over(own), "_overlap": F.lag("overlap").over(own)})
    touching = F.lit(merged) & (F.col("_end") >= F.col("start")) & ~F.col("overlap") & ~F.col("_overlap") & (F.col("end") - F.col("_start") <= max_length)
    reason = F.when(F.col("end").isNull(), "no end").when(F.col("start") >= F.col("end"), "no length").when(F.col("start") < F.col("_before"), "order").when(touching, "unmerged")
    return seen.withColumn("reason", reason).filter("reason is not null").select("rec_id", *ORDER, "reason")


def from_turns(turns: DataFrame, rate: float = 10.0) -> DataFrame:
    """Segments of plain conversations (conv_id, turn, role, text), where a character takes 1/rate seconds."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("text")).over(before)
    return turns.select(
        F.col("conv_id").cast("string").alias("rec_id"), F.col("turn").cast("int").alias("turn"), F.lit(0).alias("pos"), F.col("role").alias("speaker"),
        ((end - F.length("text")) / rate).alias("start"), (end / rate).alias("end"), "text", F.lit(False).alias("overlap"),
    )
