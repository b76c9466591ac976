"""Cleaning subtitle documents, sentence by sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.functions.text import replace_all

#: Signs of English and of broken encoding, and words of medical texts.
ENGLISH, BROKEN, MEDICAL = " and ", "Ã © ", "médecin|docteur"
#: Parts of sentences that aren't speech, and stricter ones for a file's beginning and end.
BLACKLIST = ["soustitr", "sous titr", " by ", "*", "--", "subs.fr", "sub-way", "seriessub", "titles", "free.fr", "hotmail.", "{", "}", " \\ ", " - - 0", "bitrate", "file size"]
HEAD_TAIL = ["titr", "traduct", "adaptrip", "sub", "@", " at "]
HEAD_TAIL_LENGTH = 20
#: Repairs of punctuation and of common mistakes, in order.
REPAIRS = [(r"' ", "'"), (r" \.\.\.", "..."), (r" \. ?$", "."), (r"(?U) \. (?=\w)", ". "), (r" , ?$", ","), (r"(?U) , (?=\w)", ", "), (r"^ ?- ?", ""), (r"(?U)\bLL\b", "IL"), (r"(?U)\bLl\b", "Il")]


def repair(sentence: Column) -> Column:
    return replace_all(sentence, REPAIRS)


def _listed(text: Column, parts: list[str]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for p in parts:
        out = out | low.contains(p)
    return out


#: Fixed value: films from before this year have no spoken subtitles.
MIN_YEAR = 1935


def film_files(files: DataFrame, path: str = "path", least_year: int = MIN_YEAR) -> DataFrame:
    """files with year and film, from .../year/film/file, of years from least_year on: the last file of each film."""
    parts = F.split(path, "/")
    held = files.withColumns({"year": F.try_element_at(parts, F.lit(-3)).try_cast("int"), "film": F.try_element_at(parts, F.lit(-2))}).filter(F.col("year") >= least_year)
    return latest_files(held, ["year", "film"], path)


def latest_files(files: DataFrame, group: list[str], name: str) -> DataFrame:
    """The row with the last name of each group, by a hash aggregation."""
    rest = [c for c in files.columns if c not in group]
    return files.groupBy(*group).agg(F.max_by(F.struct(*rest), name).alias("row")).select(*group, "row.*")


def clean_sentences(sentences: DataFrame, medical_only: bool = False) -> DataFrame:
    """(doc_id, sent_no, text) with unwanted documents and sentences removed and the rest repaired.

    Documents with more than two English-looking or any badly encoded sentence go. Then go the first
    and last sentence, those without a letter, those with a blacklisted part, those among the first
    20 left, then among the last 20 left, with a part of the stricter list, and documents with fewer
    than two sentences left. All windows share one shuffle by document.
    """
    doc = Window.partitionBy("doc_id")
    up, down = doc.orderBy("sent_no"), doc.orderBy(F.desc("sent_no"))
    flagged = sentences.withColumns(
        {
            "_english": F.sum(F.col("text").contains(ENGLISH).cast("int")).over(doc),
            "_broken": F.max(F.col("text").contains(BROKEN).cast("int")).over(doc),
            "_medical": F.max(F.lower("text").rlike(MEDICAL).cast("int")).over(doc),
            "_first": F.min("sent_no").over(doc),
            "_last": F.max("sent_no").over(doc),
        }
    )
    kept = flagged.filter((F.col("_english") <= 2) & (F.col("_broken") == 0) & (F.col("sent_no") > F.col("_first")) & (F.col("sent_no") < F.col("_last")))
    if medical_only:
        kept = kept.filter("_medical = 1")
    kept = kept.filter(F.col("text").rlike("[a-zA-Z]") & ~_listed(F.col("text"), BLACKLIST)).select("doc_id", "sent_no", "text")
    strict = _listed(F.col("text"), HEAD_TAIL)
    kept = kept.withColumn("_rank", F.row_number().over(up)).filter((F.col("_rank") > HEAD_TAIL_LENGTH) | ~strict)
    kept = kept.withColumn("_rank", F.row_number().over(down)).filter((F.col("_rank") > HEAD_TAIL_LENGTH) | ~strict)
    kept = kept.withColumn("_left", F.count("*").over(doc)).filter("_left >= 2")
    return kept.select("doc_id", "sent_no", repair(F.col("text")).alias("text"))
