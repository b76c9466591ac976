"""Lines and files of corpus formats."""

from __future__ import annotations

import uuid
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.functions.text import srt_time
from voxtable.plans.storage import forget, materialize


def rttm_line() -> Column:
    return F.concat_ws(" ", F.lit("SPEAKER"), "rec_id", F.lit("0"), F.format_string("%.6f", "start"), F.format_string("%.6f", F.col("end") - F.col("start")), F.lit("<NA> <NA>"), "speaker", F.lit("<NA> <NA>"))


def uem_line() -> Column:
    return F.format_string("%s 1 %.6f %.6f", "rec_id", "start", "end")


def uem_extents(recordings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(rec_id, start, end) from (rec_id, duration), where overrides (rec_id, start, end) replace what they give."""
    base = recordings.select("rec_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    if overrides is None:
        return base
    o = overrides.select("rec_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return base.join(o, "rec_id", "left").select("rec_id", F.coalesce("_s", "start").alias("start"), F.coalesce("_e", "end").alias("end"))


def srt_blocks(segments: DataFrame, ignore_overlap: bool = True) -> DataFrame:
    """(rec_id, number, value): numbered blocks; kept segments count from 1 in each recording."""
    kept = segments.filter("not overlap") if ignore_overlap else segments
    number = F.row_number().over(Window.partitionBy("rec_id").orderBy("turn", "pos"))
    out = kept.withColumn("number", number)
    return out.select("rec_id", "number", F.concat(F.col("number").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), "text", F.lit("\n")).alias("value"))


def write_by_recording(rows: DataFrame, path: str, keys: list[str], order: list[str], value: str = "value") -> None:
    """Text files with one folder per key; a recording's lines are in order in one file."""
    rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, value).write.partitionBy(*keys).mode("ignore").text(path)


def write_manifest(rows: DataFrame, path: str, columns: list[str], mode: str = "ignore") -> None:
    """Manifest files by split, quoted where needed; an existing folder is left as it is. Values keep their white space
    and zero bytes, and an empty one is quoted, so that ``readers.manifest`` tells it from a null."""
    rows.select("split", *columns).write.partitionBy("split").mode(mode).csv(path, header=True, quote='"', escape='"', charToEscapeQuoteEscaping='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def list_lines(splits: DataFrame, key: str = "rec_id", debug: int | None = None) -> DataFrame:
    """Recording ids by split; with debug, the first few of each."""
    if debug is None:
        return splits.select("split", F.col(key).alias("value"))
    rank = F.row_number().over(Window.partitionBy("split").orderBy(key))
    return splits.withColumn("_r", rank).filter(F.col("_r") <= debug).select("split", F.col(key).alias("value"))


def best_parameters(best: DataFrame) -> DataFrame:
    return best.select("study", F.to_json("params").alias("value"))


def write_lines(rows: DataFrame, path: str, value: str = "value", order: list[str] | None = None, mode: str = "ignore") -> None:
    """Text files of one line a row. With ``order`` the files' names follow that order, and so do the lines in each."""
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    held.select(value).write.mode(mode).text(path)


def language_model_lines(manifest: DataFrame) -> DataFrame:
    """The texts of a manifest, one for each line of a language model's corpus; nulls go."""
    return manifest.filter("text is not null").select(F.col("text").alias("value"))


def write_summary(summary: DataFrame, path: str, mode: str = "ignore") -> None:
    """Recordings in order with their total at the end, as one CSV file: there is one row for each recording."""
    last = (F.col("rec_id") == "TOTAL").cast("int")
    summary.repartition(1).sortWithinPartitions(last, "rec_id").write.mode(mode).csv(path, header=True)


def write_named(rows: DataFrame, path: str, key: str, order: list[str], extension: str, value: str = "value") -> None:
    """One text file for each key, ``path/<key><extension>``, with the key's lines in order; a key may name folders.

    Tasks write the files aside, each attempt into a folder of its own; once all are written, tasks move those of
    the attempts that succeeded to their names, where a file that exists is kept. A failed write leaves no named file
    behind, a repeated one no second. Null keys are an error, and null values empty lines. The path must be in a
    store that pyarrow.fs can open, which all executors share. Both steps keep all of the session's shuffle partitions,
    as the work goes by the number of files, which bytes don't tell.
    """
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = quote((path if "://" in path else f"file://{path}").rstrip("/"), safe="/:@")
    aside = f"_writing-{uuid.uuid4().hex}"

    def write(batches):
        store, root = fs.FileSystem.from_uri(place)
        folder, names, out = f"{root}/{aside}/{uuid.uuid4().hex}", [], None
        store.create_dir(folder, recursive=True)
        for batch in batches:
            done = len(names)
            for k, v in zip(batch["name"], batch["value"]):
                if not names or names[-1] != k:
                    if out:
                        out.close()
                    out = store.open_output_stream(f"{folder}/{len(names)}")
                    names.append(k)
                out.write(f"{'' if v is None else v}\n".encode())
            if len(names) > done:  # a batch may go on with the file of the one before, and Arrow takes no empty string columns
                yield pd.DataFrame({"name": names[done:], "part": [f"{folder}/{i}" for i in range(done, len(names))]})
        if out:
            out.close()

    def move(batches):
        store, root = fs.FileSystem.from_uri(place)
        made = set()
        for batch in batches:
            for name, part in zip(batch["name"], batch["part"]):
                target = f"{root}/{name}{extension}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                if store.get_file_info(target).type == fs.FileType.NotFound:
                    store.move(part, target)
            yield pd.DataFrame({"n": [len(batch)]})

    named = F.when(F.col(key).isNull(), F.raise_error(F.lit("a file needs a name")).cast("string")).otherwise(F.col(key).cast("string"))
    held = rows.select(named.alias("name"), *[F.col(c).alias(f"_{c}") for c in order], F.col(value).cast("string").alias("value")).repartition(parallel, "name").sortWithinPartitions("name", *[f"_{c}" for c in order])
    store, root = fs.FileSystem.from_uri(place)
    store.create_dir(root, recursive=True)
    try:
        parts = materialize(held.select("name", "value").mapInPandas(write, "name string, part string"), "named")
        parts.repartition(parallel, "name").mapInPandas(move, "n long").agg(F.sum("n")).collect()
        forget(parts)
    finally:
        if store.get_file_info(f"{root}/{aside}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{aside}")


def write_bytes(rows: DataFrame, path: str, name: str, value: str) -> int:
    """One file of bytes for each row, ``path/<name>``, written by the tasks; the number of files. Names must be
    unique. A file appears under its name when it is whole, so a repeated task replaces it by the same one.
    The path must be in a store that pyarrow.fs can open, which all executors share."""
    path = path if "://" in path else f"file://{path}"

    def write(batches):
        store, root = fs.FileSystem.from_uri(quote(path, safe="/:@"))
        for batch in batches:
            for n, v in zip(batch["name"], batch["value"]):
                place = f"{root}/{n}"
                aside = f"{place}.{uuid.uuid4().hex}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(aside) as out:
                    out.write(v)
                store.move(aside, place)
            yield pd.DataFrame({"n": [len(batch)]})

    done = rows.select(F.col(name).alias("name"), F.col(value).cast("binary").alias("value")).mapInPandas(write, "n long")
    return done.agg(F.sum("n")).first()[0] or 0
