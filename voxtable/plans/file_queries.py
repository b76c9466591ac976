"""Queries over files that Spark writes from the given tables, named as recordings are, and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxtable.functions import text as X
from voxtable.operators import corpus, segments, subtitles
from voxtable.plans.queries import QUERIES, SEGMENTS, SQL, query, sentences, table, trs_files
from voxtable.plans.storage import work_folder
from voxtable.sources import readers, writers


def _folder(spark, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _tasks(spark) -> int:
    """Tasks that read a folder of small files: the partitions that the session deals its tables to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_NAME = "'Rec é. ' || rec_id || ' + 1%'"


@query(f"SELECT {_NAME} AS name, 'Rec_e__' || rec_id || '_+_1%' AS rec_id, speaker, round(\"start\", 6) AS \"start\", round(\"end\", 6) AS \"end\" FROM {SEGMENTS}")
def q_named_rttm(spark, sf_dir):
    """One .rttm file for each conversation, under a name with a space, an accent and signs, read back twice written."""
    s = segments.from_turns(table(spark, sf_dir, "conversations"))
    lines = s.select(F.concat(F.lit("Rec é. "), "rec_id", F.lit(" + 1%")).alias("name"), "turn", writers.rttm_line().alias("value"))
    path = _folder(spark, "rttm")
    for _ in range(2):
        writers.write_named(lines, path, "name", ["turn"], ".rttm")
    turns = readers.rttm_turns(readers.whole_files(spark, path, "*.rttm", tasks=_tasks(spark)))
    return turns.select("name", X.recording_id("name").alias("rec_id"), "speaker", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(f"SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY turn) AS BIGINT) AS number, CAST(round(\"start\" * 1000) AS BIGINT) AS start_ms, CAST(round(\"end\" * 1000) AS BIGINT) AS end_ms, regexp_replace(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM {SEGMENTS} WHERE turn % 3 <> 1 AND trim(text) <> ''")
def q_named_srt(spark, sf_dir):
    """One .srt file for each conversation without its overlapping turns (every third), read back with texts."""
    s = segments.from_turns(table(spark, sf_dir, "conversations")).filter("trim(text) <> ''")
    s = s.withColumns({"overlap": F.col("turn") % 3 == 1, "text": F.regexp_replace("text", r"\s*\n\s*", " ")})
    path = _folder(spark, "srt")
    writers.write_named(writers.srt_blocks(s), path, "rec_id", ["number"], ".srt")
    items = readers.srt_items(readers.whole_files(spark, path, "*.srt", tasks=_tasks(spark)))
    return items.select(F.col("name").alias("rec_id"), (F.col("pos") + 1).cast("long").alias("number"), "start_ms", "end_ms", "text")


@query(f"""SELECT printf('record-%03d', CAST(rec_id AS INTEGER)) AS rec_id, upper(speaker) AS speaker, "start", "end", regexp_replace(text, '^\\s+|\\s+$', '', 'g') || ' fin' AS text FROM {SEGMENTS}
WHERE text <> '' AND turn % 5 <> 2 AND turn % 5 <> 3""")
def q_trs_folders(spark, sf_dir):
    """Segments of annotation files in record-* folders. Of five turns, one names a speaker that it lacks and one
    has no length: both go. Comments and values with signs change nothing."""
    files = trs_files(spark, sf_dir).withColumn("value", F.regexp_replace("value", '<Event desc="b"/>', '<!-- <Turn> --><Event desc="a > b </Turn>"/>'))
    s = segments.from_turns(table(spark, sf_dir, "conversations")).select(F.col("rec_id").alias("of"), "turn", F.col("start").cast("string").alias("s"), F.col("end").cast("string").alias("e")).filter("turn % 5 in (2, 3)")
    # the turns of a file, by where they start and end
    odd = s.groupBy("of").agg(F.collect_list(F.struct(F.when(F.col("turn") % 5 == 2, F.format_string('startTime="%s" endTime="%s"><Sync', "s", "e")).otherwise(F.format_string('startTime="%s" endTime="%s"', "s", "e")).alias("old"), F.when(F.col("turn") % 5 == 2, F.format_string('startTime="%s" endTime="%s"><Who nb="4"/><Sync', "s", "e")).otherwise(F.format_string('startTime="%s" endTime="%s"', "s", "s")).alias("new"))).alias("edits"))
    edited = files.join(odd, files["rec_id"] == odd["of"], "left").select("rec_id", F.aggregate(F.coalesce("edits", F.array().cast("array<struct<old:string,new:string>>")), F.col("value"), lambda v, x: F.replace(v, x["old"], x["new"])).alias("value"))
    path = _folder(spark, "trs")
    writers.write_named(edited.select(F.concat(F.lit("record-"), F.lpad("rec_id", F.greatest(F.length("rec_id"), F.lit(2)), "0"), F.lit(" été/a b")).alias("key"), "value"), path, "key", ["value"], ".trs")
    tokens, names = segments.trs_tokens(readers.annotation_files(spark, path))
    return segments.rebuild(tokens, names).select("rec_id", "speaker", "start", "end", "text")


@query("""SELECT conv_id AS rec_id, count(DISTINCT role) AS speakers FROM conversations WHERE turn % 4 = 0 AND conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING min(length(text)) < 40)
GROUP BY conv_id HAVING count(DISTINCT role) < 2""")
def q_excluded_recordings(spark, sf_dir):
    """Recordings with one speaker left in every fourth turn, where those with a very short turn are excluded first."""
    c = table(spark, sf_dir, "conversations")
    short = c.groupBy("conv_id").agg(F.min(F.length("text")).alias("least")).filter("least < 40").select("conv_id")
    kept = corpus.without(c.filter("turn % 4 = 0"), short, "conv_id")
    return corpus.least_speakers(kept.select(F.col("conv_id").alias("rec_id"), F.col("role").alias("speaker")), 2)


@query("""SELECT 'Clip é ' || conv_id || '_' || turn AS name, CASE turn % 4 WHEN 3 THEN 'other' ELSE 'RIFF' END AS format, CASE WHEN turn % 4 < 3 THEN CAST(8000 + 1000 * (turn % 4) AS BIGINT) END AS rate,
CASE WHEN turn % 4 < 3 THEN CAST(strlen(text) // 2 AS BIGINT) END AS frames, CASE WHEN turn % 4 < 3 THEN strlen(text) // 2 / CAST(8000 + 1000 * (turn % 4) AS DOUBLE) END AS duration FROM conversations""")
def q_wave_headers(spark, sf_dir):
    """Headers of one audio file for each turn, whose samples are the bytes of its text. Where turn % 4 is 1, data comes
    behind another chunk; where it is 3, the file is no audio. Only the headers are read."""
    little = lambda n, size: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)]))
    text, rate = F.encode("text", "UTF-8"), 8000 + 1000 * (F.col("turn") % 4)
    plain = lambda s: F.encode(F.lit(s), "UTF-8")
    form = F.concat(plain("fmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(F.lit(1), 2), little(rate, 4), little(2 * rate, 4), little(F.lit(2), 2), little(F.lit(16), 2))
    other = F.when(F.col("turn") % 4 == 1, F.concat(plain("LIST"), little(F.length(text), 4), text, F.when(F.length(text) % 2 == 1, plain("\0")).otherwise(plain("")))).otherwise(plain(""))
    audio = F.concat(plain("RIFF"), little(F.length(form) + F.length(other) + F.length(text) + 12, 4), plain("WAVE"), form, other, plain("data"), little(F.length(text), 4), text)
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("Clip é "), "conv_id", F.lit("_"), "turn", F.lit(".wav")).alias("name"), F.when(F.col("turn") % 4 == 3, text).otherwise(audio).alias("value"))
    path = _folder(spark, "wave")
    writers.write_bytes(c, path, "name", "value")
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    return readers.wave_headers(spark, path, "*.wav", problems=True).select(name.alias("name"), "format", "rate", "frames", "duration")


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) - 1 AS INTEGER) AS line, text FROM ({SQL["q_clean_sentences"]})""")
def q_named_texts(spark, sf_dir):
    """One .txt file of cleaned sentences for each document, read back by lines."""
    path = _folder(spark, "texts")
    writers.write_named(subtitles.clean_sentences(sentences(spark, sf_dir)), path, "doc_id", ["sent_no"], ".txt", "text")
    return readers.lines(readers.whole_files(spark, path, "*.txt", tasks=_tasks(spark))).select("name", "line", F.col("value").alias("text"))


@query(f"""SELECT CAST(row_number() OVER (ORDER BY n, "rank", value) AS BIGINT) AS line, value FROM ({SQL["q_arpa"]})""")
def q_named_arpa(spark, sf_dir):
    """The lines of an ARPA file in one file of that name, in order, read back with their places from 1."""
    path = _folder(spark, "arpa")
    writers.write_named(QUERIES["q_arpa"](spark, sf_dir).withColumn("key", F.lit("model")), path, "key", ["n", "rank", "value"], ".arpa")
    lines = readers.lines(readers.whole_files(spark, path, "*.arpa"))
    return lines.select((F.col("line") + 1).cast("long").alias("line"), "value")
