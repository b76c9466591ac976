"""License scans: lines compared with licence notices by the Dice coefficient of their word bigrams.

A line of m distinct bigrams can only reach a coefficient t with a notice of k bigrams when m lies
in [k * t / (2 - t), k * (2 - t) / t]; only such lines are taken apart, and only shared bigrams are
counted. The notices are a fixed list, so their bigram table is small by construction.

Notices that wrap over lines or stand in a line with other text are found in windows of consecutive
words, whatever line ends they cross: a window of at most k * (2 - t) / t bigrams is compared like a line.
Only texts that have one of a notice's anchor words are taken apart, since without them too few of its bigrams
are left for t. A window that touches a matched line doesn't count; of windows that overlap the best one
does, under the number of its first line.

The coefficient alone takes another version, a sibling of the same family or a denial for the notice, as they
differ in a word or two. So a passage must have exactly the notice's telling words: version numbers (zeros aside),
words that set a family's licences apart, and negations. Behind a negation nothing counts: it may be one of the two words
before a window, or of the last two of the line before a line. Nor does a window whose last number goes on (2 of 2.1).

Defined results: null and empty texts have no lines; a line of one word has no bigrams and never matches; very
long texts are compared line by line and window by window, whole; of equal coefficients the notice that is listed
first wins, then the earlier window, then the shorter; rows with a null id are scanned like others; repeated
rows count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from voxtable.plans.storage import materialize

#: Notices by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words that deny a licence.
NEGATIONS = ["no", "nor", "not", "never", "neither", "isn", "aren", "wasn"]
#: Words that tell licences of a family apart.
FAMILY = ["affero", "lesser", "library", "nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike"]
WORD = r"[a-z0-9]+"
THRESHOLD = 0.8
#: A folded line of which one of the last two words is a negation.
DENIED = rf"(^|[^a-z0-9])({'|'.join(NEGATIONS)})([^a-z0-9]+[a-z0-9]+)?[^a-z0-9]*$"


def telling(words: Column) -> Column:
    """The telling words, sorted and joined: numbers but zero (2 of v2, too), and words of NEGATIONS and FAMILY."""
    plain = F.transform(words, lambda w: F.regexp_replace(w, r"^v(\d+)$", "$1"))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(plain, lambda w: w.isin(NEGATIONS + FAMILY) | (w.rlike(r"^\d+$") & (w != "0"))))), " ")


def bigrams(line: Column) -> Column:
    words = F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))
    return F.when(F.size(words) > 1, F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))


def notices(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(notice_no, license, bigrams, k) of the fixed list or of others, which must be few."""
    rows = [(i, name, text) for i, (name, text) in enumerate(texts or NOTICES)]
    told = telling(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    return spark.createDataFrame(rows, "notice_no int, license string, text string").select("notice_no", "license", told.alias("told"), bigrams(F.col("text")).alias("bigrams")).withColumn("k", F.size("bigrams"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, texts: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, license, dice): for each line that reaches the threshold its best licence, and
    each notice found in a window of words, under its first line."""
    known = notices(docs.sparkSession, texts)
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    bounds = known.agg(F.min("k"), F.max("k")).first()
    each = F.split(text_col, "\n", -1)
    pairs = F.zip_with(each, F.concat(F.array(F.lit("")), each), lambda line, before: F.struct(line.alias("line"), before.alias("before")))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.posexplode(pairs).alias("line_no", "pair")).select("doc_id", "row", "line_no", "pair.*")
    # like a window, a line without an anchor word has too few of any notice's bigrams
    lines = lines.filter(F.col("line").isNotNull() & has_anchor(F.lower("line"), known.collect(), threshold) & ~F.lower("before").rlike(DENIED)).drop("before")
    sized = lines.withColumn("bigrams", bigrams(F.col("line"))).withColumn("m", F.size("bigrams")).filter((F.col("m") >= low * bounds[0]) & (F.col("m") <= high * bounds[1]))
    sized = sized.withColumn("told", telling(F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0))))
    shared = known.select("notice_no", "license", "told", "k", F.explode("bigrams").alias("bigram"))
    parts = sized.select("doc_id", "row", "line_no", "m", "told", F.explode("bigrams").alias("bigram"))
    met = parts.join(F.broadcast(shared), ["bigram", "told"]).drop("told").filter((F.col("m") >= low * F.col("k")) & (F.col("m") <= high * F.col("k")))
    dice = met.distinct().groupBy("doc_id", "row", "line_no", "notice_no", "license", "m", "k").count().withColumn("dice", 2 * F.col("count") / (F.col("m") + F.col("k"))).filter(F.col("dice") >= threshold)
    best = dice.groupBy("doc_id", "row", "line_no").agg(F.max_by("license", F.struct("dice", -F.col("notice_no"))).alias("license"), F.max("dice").alias("dice"))
    best = materialize(best, "licences")
    taken = best.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("line_no").alias("taken"))
    found = windows(docs, known, threshold, id_col, text_col).join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    found = found.filter(F.col("taken").isNull() | ~F.arrays_overlap(F.sequence("line_no", "last_line"), F.col("taken")))
    kinds = "array<struct<rank:double,notice_no:int,at:int,end:int,line_no:int,license:string,dice:double>>"
    ranked = F.collect_set(F.struct((-F.col("dice")).alias("rank"), "notice_no", "at", "end", "line_no", "license", "dice"))
    apart = lambda a, x: ~F.exists(a, lambda y: (y["at"] < x["end"]) & (x["at"] < y["end"]))
    picked = F.aggregate(F.array_sort(ranked), F.array().cast(kinds), lambda a, x: F.when(apart(a, x), F.concat(a, F.array(x))).otherwise(a))
    inside = found.groupBy("doc_id", "row").agg(picked.alias("picked")).select("doc_id", F.explode("picked").alias("p")).select("doc_id", "p.line_no", "p.license", "p.dice")
    return best.select("doc_id", "line_no", "license", "dice").unionByName(inside).withColumn("dice", F.round("dice", 6))


def anchors(bigrams: list[str], threshold: float) -> set[str]:
    """Long words of a notice without which a window has too few of its bigrams: those needed are k * t / (2 - t)."""
    k, left, out = len(bigrams), list(bigrams), set()
    for word in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (-len(w), w)):
        if len(left) < k * threshold / (2 - threshold) - 1e-9:
            break
        out.add(word)
        left = [b for b in left if word not in b.split()]
    return out


def has_anchor(text: Column, fixed: list[Row], threshold: float) -> Column:
    """Whether a folded text has an anchor word of any notice of the fixed list."""
    words = sorted({w for r in fixed for w in anchors(r["bigrams"], threshold)})
    return reduce(lambda found, w: found | text.contains(w), words, F.lit(False))


def windows(docs: DataFrame, known: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, notice_no, license, at, end, line_no, last_line, dice): from each place of a notice's bigram the
    window of words with the greatest coefficient of those with its telling words, if it reaches the threshold. Each is
    found within its row."""
    widest = (2 - threshold) / threshold
    fixed = known.collect()  # a fixed list
    text = F.lower(text_col)
    shared = known.select("notice_no", "license", "told", "k", F.col("bigrams").alias("notice"), F.explode("bigrams").alias("bigram"))
    every = sorted({b for r in fixed for b in r["bigrams"]})
    most = max(int(r["k"] * widest + 1e-9) for r in fixed)
    let = lambda x, use: F.element_at(F.transform(F.array(x), use), 1)
    by_line = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))

    def pairs_of(words: Column) -> Column:
        return F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))

    def hits_of(pairs: Column, lines: Column) -> Column:
        known_at = F.filter(F.transform(pairs, lambda b, i: F.struct(i.alias("at"), b.alias("bigram"))), lambda x: x["bigram"].isin(every))
        return F.transform(known_at, lambda x: F.struct(x["at"].alias("at"), x["bigram"].alias("bigram"), F.filter(F.slice(pairs, x["at"] + 1, most + 1), lambda b: b.isNotNull()).alias("pairs"), F.concat_ws(" ", F.get(pairs, x["at"] - 2), F.get(pairs, x["at"] - 1)).alias("before"), F.slice(lines, x["at"] + 1, most + 1).alias("lines")))

    def in_lines(by_line: Column) -> Column:
        lines = F.flatten(F.transform(by_line, lambda w, i: F.array_repeat(i, F.size(w))))
        return let(pairs_of(F.flatten(by_line)), lambda pairs: let(lines, lambda n: hits_of(pairs, n)))

    cut = docs.filter(has_anchor(text, fixed, threshold)).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.explode(let(by_line, in_lines)).alias("hit")).select("doc_id", "row", "hit.*")
    longest = F.floor(F.col("k") * widest + 1e-9).cast("int")
    hits = cut.filter(~F.col("before").rlike(rf"(^| )({'|'.join(NEGATIONS)})( |$)")).join(F.broadcast(shared), "bigram")
    hits = hits.select("doc_id", "row", "notice_no", "license", "told", "k", "notice", "at", "pairs", F.slice("pairs", F.lit(1), longest).alias("tail"), "lines")
    hits = hits.filter(F.size(F.array_intersect("tail", "notice")) >= F.col("k") / widest - 1e-9)

    def measured(n: Column) -> Column:
        window = F.slice("tail", F.lit(1), n)
        both = F.size(F.array_intersect(window, F.col("notice")))
        same = telling(F.flatten(F.transform(window, lambda b: F.split(b, " ")))) == F.col("told")
        goes_on = F.coalesce(F.get("pairs", n).rlike(r"^v?\d+ [1-9]\d?$"), F.lit(False))
        return F.struct(F.when(same & ~goes_on, 2 * both / (F.size(F.array_distinct(window)) + F.col("k"))).otherwise(0.0).alias("dice"), (-n).alias("n"))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("tail")), measured))
    hits = hits.withColumn("best", best).filter(F.col("best.dice") >= threshold)
    return hits.select("doc_id", "row", "notice_no", "license", "at", (F.col("at") - F.col("best.n") + 1).alias("end"), F.element_at("lines", 1).alias("line_no"), F.element_at("lines", 1 - F.col("best.n")).alias("last_line"), F.col("best.dice").alias("dice"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same over DuckDB's documents view."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(NOTICES))
    split = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    kept = ", ".join(f"'{w}'" for w in NEGATIONS + FAMILY)
    told = rf"list_sort(list_distinct(list_filter(list_transform(w, lambda x: regexp_replace(x, '^v([0-9]+)$', '\1')), lambda x: x IN ({kept}) OR (regexp_matches(x, '^[0-9]+$') AND x <> '0'))))"
    return f"""
    WITH notice AS (SELECT i, license, {split} AS b, {told} AS told FROM (SELECT i, license, regexp_extract_all(lower(t), '{WORD}') AS w FROM (VALUES {quoted}) v(i, license, t))),
    line AS (SELECT doc_id, text, line_no - 1 AS line_no, {split} AS b, {told} AS told FROM (
        SELECT doc_id, text, line_no, regexp_extract_all(lower(l), '{WORD}') AS w FROM (SELECT *, coalesce(lag(l) OVER (PARTITION BY doc_id, text ORDER BY line_no), '') AS before FROM (
            SELECT DISTINCT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)) WHERE NOT regexp_matches(lower(before), '{DENIED}'))),
    dice AS (SELECT doc_id, text, line_no, i, license, 2.0 * len(list_intersect(line.b, notice.b)) / (len(line.b) + len(notice.b)) AS dice
        FROM line JOIN notice ON line.told = notice.told AND len(line.b) * (2 - {threshold}) + 1e-9 >= len(notice.b) * {threshold} AND len(line.b) * {threshold} <= len(notice.b) * (2 - {threshold}) + 1e-9)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, license, round(dice, 6) AS dice
    FROM dice WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, text, line_no ORDER BY dice DESC, i) = 1"""
