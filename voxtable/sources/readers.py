"""Readers of corpus files. All of them scan with Spark, so paths may be in any store that Spark reads."""

from __future__ import annotations

import struct
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.functions.text import unescape
from voxtable.operators.segments import ATTRIBUTES


def whole_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, tasks: int | None = None) -> DataFrame:
    """(path, name, value): one row per text file. Spark counts a file as 4 MB at least, so very many small ones take a
    task for every few; with ``tasks`` at most so many read them all, each file still in one."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # Spark gives paths percent-encoded; a plus sign in a name stands for itself
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    files = reader.text(path, wholetext=True).select(place.alias("path"), "value")
    files = files.coalesce(tasks) if tasks else files
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), "value")


def lines(files: DataFrame, key: str = "name") -> DataFrame:
    """(key, line, value) with the line's index counted over all lines."""
    text = F.regexp_replace("value", r"\n$", "")
    return files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "value"))


def annotation_files(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, value) of the .trs files in record-* folders; rec_id is record-NNN."""
    files = whole_files(spark, path, "*.trs")
    number = F.regexp_extract("path", r"record-0*(\d+)[^/]*/", 1)
    return files.select(F.when(number != "", F.format_string("record-%03d", number.cast("int"))).otherwise(F.col("name")).alias("rec_id"), "value")


def subtitle_sentences(files: DataFrame, key: str = "name") -> DataFrame:
    """(key, sent_no, text) from subtitle XML: the w children of each s but for its last child, by spaces."""
    body = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    sentences = files.select(key, F.posexplode(F.regexp_extract_all(body, F.lit(rf"(?s)<s\b{ATTRIBUTES}>(.*?)</s>"), F.lit(1))).alias("sent_no", "s"))
    children = F.regexp_extract_all("s", F.lit(rf"(?s)<\w+\b{ATTRIBUTES}(?<=/)>|<(\w+)\b{ATTRIBUTES}>.*?</\1>"), F.lit(0))
    held = F.filter(F.slice(children, 1, F.greatest(F.size(children) - 1, F.lit(0))), lambda c: c.rlike(r"^<w\b"))
    return sentences.select(key, "sent_no", unescape(F.array_join(F.transform(held, lambda c: F.regexp_extract(c, rf"(?s)^<\w+{ATTRIBUTES}>([^<]*)<", 1)), " ")).alias("text"))


def clip_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, sentence) from a tab-separated file with a header: its second and third columns."""
    table = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    return table.select(F.col(f"`{table.columns[1]}`").alias("path"), F.col(f"`{table.columns[2]}`").alias("sentence"))


def _milliseconds(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, r"(\d+):(\d+):(\d+)[,.](\d+)", i).cast("long")
    return part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4)


def srt_items(files: DataFrame, key: str = "name") -> DataFrame:
    """(key, pos, start_ms, end_ms, text): the blocks of subtitle files; fields may lack zero padding."""
    blocks = files.select(key, F.posexplode(F.filter(F.split("value", r"\r?\n[ \t]*(?:\r?\n)+"), lambda b: b.contains("-->"))).alias("pos", "b"))
    times = F.regexp_extract("b", r"([\d:,.]+) *--> *([\d:,.]+)", 0)
    return blocks.select(key, "pos", _milliseconds(F.split(times, "-->")[0]).alias("start_ms"), _milliseconds(F.split(times, "-->")[1]).alias("end_ms"), F.regexp_replace(F.regexp_replace("b", r"(?s)^.*?-->[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("text"))


def rttm_turns(files: DataFrame, key: str = "name", kind: str | None = "SPEAKER") -> DataFrame:
    """(key, line, rec_id, start, end, speaker) in file order; <NA> stays a string."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines(files, key).filter(F.size(part) >= 8).select(key, "line", part.alias("p"))
    if kind:
        rows = rows.filter(F.col("p")[0] == kind)
    start, length = F.col("p")[3].cast("double"), F.col("p")[4].cast("double")
    return rows.select(key, "line", F.col("p")[1].alias("rec_id"), start.alias("start"), (start + length).alias("end"), F.col("p")[7].alias("speaker"))


def uem_extents(spark: SparkSession, path: str) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(part) == 4).select(part[0].alias("rec_id"), part[1].alias("channel"), part[2].cast("double").alias("start"), part[3].cast("double").alias("end"))


def speaker_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, doctor, patients) from a file with a header."""
    table = spark.read.csv(path, header=True)
    return table.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(table.columns, ("rec_id", "doctor", "patients"))])


MANIFEST_SCHEMA = "ID string, duration double, start long, stop long, wav_file string, text string, source string"


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """Manifest rows; text such as NA stays literal. A value that isn't there is null, a quoted empty one is empty."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="\uffffnull", emptyValue="", quote='"', escape='"', charToEscapeQuoteEscaping='"', multiLine=True, enforceSchema=False)


HEADERS = "path string, format string, rate long, channels long, frames long, duration double, bytes_read long"
NO_FORMAT = "no format or data"


def wave_headers(spark: SparkSession, path: str, glob: str = "*", problems: bool = False) -> DataFrame:
    """(path, rate, frames, duration) of RIFF and RF64 files from their fmt and data chunks, wherever those stand.

    Spark lists the files; tasks go from chunk to chunk and read each one's first bytes only, so files of any size
    cost a few hundred bytes (bytes_read in the result of ``wave_chunks``). Spark lists no empty files. A file without both chunks is an error;
    other kinds of files are left out. With ``problems`` no file is an error or left out: the result has the
    columns of wave_chunks for all. Paths must be in a store that pyarrow.fs can open.
    """
    read = wave_chunks(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length"))
    if problems:
        return read
    whole = F.when(F.col("format") == NO_FORMAT, F.raise_error(F.concat(F.lit("no format or data in "), "path")).cast("long")).otherwise(F.col("frames"))
    return read.filter("format != 'other'").select("path", "rate", whole.alias("frames"), "duration")


def wave_chunks(files: DataFrame) -> DataFrame:
    """path, format (RIFF, RF64, 'no format or data', or other), rate, channels, frames, duration and bytes_read of
    listed files (path, length). Lengths and rates that a file doesn't give are null. A data chunk whose size was
    never filled in, or that goes past the end of the file, ends with the file."""
    def read(batches):
        for batch in batches:
            yield pd.DataFrame([(p, *chunk_walk(p, int(n))) for p, n in zip(batch["path"], batch["length"])], columns=HEADERS.replace(",", "").split()[::2])

    # a listing is small beside the files, and one task may have listed them all
    return files.select("path", "length").repartition("path").mapInPandas(read, HEADERS)


def chunk_walk(path: str, length: int) -> tuple:
    """format, rate, channels, frames, duration and the number of bytes read of one file."""
    store, place = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    rate = channels = align = size = wide = None
    at, seen = 12, 0
    with store.open_input_file(place) as f:
        def part(start: int, n: int) -> bytes:
            nonlocal seen
            held = f.read_at(n, start)
            seen += len(held)
            return held

        head = part(0, 12) if length >= 12 else b""
        kind = head[:4].decode("latin-1")
        if kind not in ("RIFF", "RF64") or head[8:] != b"WAVE":
            return "other", None, None, None, None, seen
        while at + 8 <= length and (rate is None or size is None):
            name, n = struct.unpack("<4sI", part(at, 8))
            body = at + 8
            if name == b"ds64" and n >= 24 and body + 24 <= length:
                wide = struct.unpack("<Q", part(body + 8, 8))[0]
            elif name == b"fmt " and n >= 16 and body + 16 <= length:
                channels, rate, align = struct.unpack("<HI4xH", part(body + 2, 12))
            elif name == b"data":
                n = wide if n == 0xFFFFFFFF and wide is not None else n
                size = min(n, length - body)
            at = body + n + n % 2
    if not rate or not align or size is None:
        return NO_FORMAT, rate, channels, None, None, seen
    frames = size // align
    return kind, rate, channels, frames, frames / rate, seen
