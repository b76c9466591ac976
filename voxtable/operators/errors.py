"""Word and character error rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.text import wer_words

#: Rows of the table of distances that are held as the bits of two integers at a time.
BLOCK = 4096


def edit_distance(a, b, block: int = BLOCK) -> int:
    """The least number of insertions, deletions and replacements between two sequences.

    Equal ends go first. The table of distances is then walked in blocks of rows (Myers 1999, Hyyrö 2003): a column
    of a block is two integers whose bits say where the distance rises and falls, so a step takes a few operations on
    ``block`` rows. Between blocks only the steps along a row are kept, so memory grows with the length.
    """
    low, least = 0, min(len(a), len(b))
    while low < least and a[low] == b[low]:
        low += 1
    end = 0
    while end < least - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = sorted((a[low : len(a) - end], b[low : len(b) - end]), key=len)
    if not len(a):
        return len(b)
    steps = [1] * len(a)
    for start in range(0, len(b), block):
        rows = b[start : start + block]
        places: dict = {}
        for i, x in enumerate(rows):
            places[x] = places.get(x, 0) | 1 << i
        every, last = (1 << len(rows)) - 1, len(rows) - 1
        rises, falls = every, 0
        for j, x in enumerate(a):
            above, same = steps[j], places.get(x, 0)
            diagonal = same | falls
            if above < 0:
                same |= 1
            level = ((same & rises) + rises) ^ rises | same
            up, down = falls | ~(level | rises) & every, rises & level
            steps[j] = (up >> last & 1) - (down >> last & 1)
            up, down = up << 1 | (above > 0), down << 1 | (above < 0)
            rises, falls = (down | ~(diagonal | up)) & every, up & diagonal & every
    return len(b) + sum(steps)


def _distances(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    pairs = [(r.tolist(), h.tolist()) for r, h in zip(ref, hyp)]
    return pd.DataFrame({"word_errors": [edit_distance(h, r) for r, h in pairs], "char_errors": [edit_distance("_".join(h), "_".join(r)) for r, h in pairs]})


def pair_errors(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """pairs with word and character distances and reference lengths. Words count as in wer_words; the
    characters of a text include one mark between words. Null texts count as empty; texts may have any length."""
    r, h = (wer_words(F.coalesce(F.col(c), F.lit(""))) for c in (ref, hyp))
    out = pairs.withColumns({"_r": r, "_h": h}).withColumn("_d", F.pandas_udf(_distances, "word_errors long, char_errors long")("_r", "_h"))
    chars = F.length(F.array_join("_r", "_")).cast("long")
    return out.withColumns({"word_errors": F.col("_d.word_errors"), "words": F.size("_r").cast("long"), "char_errors": F.col("_d.char_errors"), "chars": chars}).drop("_r", "_h", "_d")


def error_rates(pairs: DataFrame, by: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """WER and CER in percent for each group and, with null keys, for all rows together (one rollup)."""
    rate = lambda e, n: F.when(F.sum(n) > 0, 100 * F.sum(e) / F.sum(n))
    sums = pair_errors(pairs, ref, hyp).rollup(*by) if by else pair_errors(pairs, ref, hyp).groupBy()
    return sums.agg(F.sum("word_errors").alias("word_errors"), F.sum("words").alias("words"), rate("word_errors", "words").alias("wer"), F.sum("char_errors").alias("char_errors"), F.sum("chars").alias("chars"), rate("char_errors", "chars").alias("cer"))


def report_lines(rates: DataFrame, key: str, dataset: str = "", model: str = "") -> DataFrame:
    """(rank, value): a report's lines: the data set, the model, both rates over all, then a line for each group."""
    total, group = F.col(key).isNull(), F.col(key).cast("string")
    head = F.array(
        F.struct(F.lit(0).alias("rank"), F.lit(f"DATASET: {dataset}").alias("value")), F.struct(F.lit(1).alias("rank"), F.lit(f"MODEL: {model}").alias("value")),
        F.struct(F.lit(2).alias("rank"), F.format_string("WER: %.1f%%", "wer").alias("value")), F.struct(F.lit(3).alias("rank"), F.format_string("CER: %.1f%%", "cer").alias("value")),
    )
    line = F.array(F.struct(F.lit(4).alias("rank"), F.format_string("%s WER: %.1f%%   CER: %.1f%%", group, "wer", "cer").alias("value")))
    return rates.select(F.explode(F.when(total, head).otherwise(line)).alias("x")).select("x.rank", "x.value")


def example_errors(pairs: DataFrame, examples: DataFrame, key: str, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Word and character errors, and the word error rate in percent, of each pair in a fixed example set (key)."""
    held = pair_errors(pairs.join(examples.select(key), key, "left_semi"), ref, hyp)
    return held.withColumn("wer", F.when(F.col("words") > 0, 100 * F.col("word_errors") / F.col("words")))


def joined_texts(rows: DataFrame, group: str, order: str, *texts: str) -> DataFrame:
    """The texts of each group in order, with a blank line between them."""
    def joined(text: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias(text)

    return rows.groupBy(group).agg(*map(joined, texts))


def zip_texts(files: DataFrame, key: str, *texts: str) -> DataFrame:
    """Undo joined_texts: every second line of each text, zipped by position (null where one is shorter)."""
    parts = [F.filter(F.split(t, "\n", -1), lambda _, i: i % 2 == 0).alias(t) for t in texts]
    zipped = files.select(key, F.posexplode(F.arrays_zip(*parts)).alias("pos", "z"))
    return zipped.select(key, "pos", *[F.col(f"z.{t}").alias(t) for t in texts])
