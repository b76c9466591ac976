"""Benchmark decontamination by a distributed positional inverted index of the training texts.

1. One pass over the texts stores the index: a posting (doc_id, key, term, pos) for every place of a
   term of the test set, and one for each text's end, whose place is the number of words.
2. The postings' counts say which of a test window's terms are rarest. The rarest term's postings, moved
   by its place in the window, are where the window may start.
3. These starts are intersected with the second rarest term's moved postings, and then with those of the
   other terms, read only for the rows that are left. A start that is in all lists is an exact match.
4. A proximity match has all terms of a window, as often as the window has them, in any order within its
   length and a slop. Postings of its terms around the rarest one are gathered and counted.

Only DataFrame functions are used. Tables about the test set are broadcast up to a size that is checked.
Beyond it each term or text is dealt to parts, to each of which the test set's rows go, so that a frequent
term or a long text is no single task's work. Joins of postings with postings are by (key, pos, term).

Defined results: null and empty texts have no words; very long texts are indexed like others, posting by
posting; repeated rows get a row each; rows with a null id are searched like others; an item without
words is never found; an item shorter than a window is one window; of equally rare terms the first in the
window leads; an empty table gives no rows, and an empty test set no hits; other columns, whatever their
names, are ignored (contamination) or kept (drop_contaminated).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.names import broadcast_if_small, fresh, meet_test_set
from voxtable.plans.storage import materialize

#: A word before folding: what the folded text has between ASCII characters other than a-z and 0-9.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Stands for a text's end; no word has a space.
END = " "
#: Rows and characters of tables about the test set that may be broadcast, and of keys of matching rows.
TERM_ROWS, TERM_CHARACTERS, WINDOW_ROWS, KEY_ROWS = 200_000, 4_000_000, 50_000, 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold(text: Column) -> Column:
    """A-Z to lower case, and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def row_key(id_col: str, text_col: str) -> Column:
    """What tells a row from rows with another id or text."""
    return F.xxhash64(id_col, text_col)


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, n, terms) and the items that each stands in (window_id, item)."""
    item = items.select(F.col(id_col).cast("string").alias("item"), words(fold(F.col(text_col))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    each = item.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("terms"))
    each = materialize(each.select(F.xxhash64("terms").alias("window_id"), "terms", "item"), "windows")
    return each.groupBy("window_id").agg(F.size(F.first("terms")).alias("n"), F.first("terms").alias("terms")), materialize(each.select("window_id", "item").distinct(), "members")


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (doc_id, key, term, pos) of ``terms`` (word) in one pass; term is a hash, 0 at a text's end.

    Words meet the terms in full lower case first, which can only join more to a term, as that is quicker
    than to fold every word.
    """
    ends = docs.sparkSession.createDataFrame([(END,)], "word string")
    named = terms.select("word").distinct().union(ends).select("word", F.lower("word").alias("low"), F.when(F.col("word") == END, F.lit(0)).otherwise(F.xxhash64("word")).cast("long").alias("term"))
    named = materialize(named, "terms")
    source = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.concat(words(F.col(text_col)), F.array(F.lit(END))).alias("w"))
    tokens = source.select("doc_id", "key", F.posexplode("w").alias("pos", "token")).withColumn("low", F.lower("token"))
    met = meet_test_set(tokens, named, "low", TERM_ROWS, TERM_CHARACTERS, "word", by=("key", "pos")).filter((F.col("token") == F.col("word")) | (fold(F.col("token")) == F.col("word")))
    return materialize(met.select("doc_id", "key", "term", "pos"), "postings")


def ordered_windows(window: DataFrame, index: DataFrame) -> DataFrame:
    """(window_id, n, ordered): each window's terms as (df, at, term), rarest first; windows with a term that never occurs go."""
    df = index.filter("term <> 0").groupBy("term").agg(F.count("*").alias("df"))
    terms = window.select("window_id", "n", F.posexplode("terms").alias("at", "word")).select("window_id", "n", "at", F.xxhash64("word").alias("term"))
    known = terms.join(df, "term", "left").groupBy("window_id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "term"))).alias("ordered"))
    return materialize(known.filter(F.col("ordered")[0]["df"] > 0), "ordered")


def _anchored(index: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, pos, window_id, n, at, second): postings of rarest terms with the windows that they lead; at is the
    term's place in the window, second the next term (at, term)."""
    lead = plan.select("window_id", "n", F.col("ordered")[0]["at"].alias("at"), F.col("ordered")[0]["term"].alias("term"), F.get("ordered", F.lit(1)).alias("second"))
    return meet_test_set(index.filter("term <> 0").select("key", "term", "pos"), lead, "term", WINDOW_ROWS, by=("key", "pos")).drop("term")


def _seconds(index: DataFrame, plan: DataFrame) -> DataFrame:
    """The postings (key, pos, term) of the second rarest terms."""
    terms = materialize(plan.filter("n > 1").select(F.col("ordered")[1]["term"].alias("term")).distinct(), "seconds")
    return meet_test_set(index.select("key", "pos", "term"), terms, "term", TERM_ROWS, how="left_semi", by=("key", "pos"))


def _of_rows(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The postings (key, pos, term) of the rows whose keys ``rows`` has."""
    keys = materialize(rows.select("key").distinct(), "keys")
    return meet_test_set(index.filter("term <> 0").select("key", "pos", "term"), keys, "key", KEY_ROWS, how="left_semi", by=("pos",))


def of_windows(found: DataFrame, table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """found with what a stored table says of its windows; a window may be found in any share of the texts."""
    return meet_test_set(found, table, "window_id", WINDOW_ROWS, by=by)


def exact_matches(index: DataFrame, known: DataFrame) -> DataFrame:
    """Stored table (key, start, n, window_id) of all places where a window occurs."""
    starts = _anchored(index, known).withColumn("start", F.col("pos") - F.col("at")).filter("start >= 0").select("key", "start", "window_id", "n", "second")
    second = starts.filter("n > 1").select("key", "start", "window_id", "n", (F.col("start") + F.col("second.at")).alias("pos"), F.col("second.term").alias("term"))
    met = second.join(_seconds(index, known), ["key", "pos", "term"], "left_semi").select("key", "start", "window_id", "n")
    met = materialize(met.unionByName(starts.filter("n = 1").drop("second")).distinct(), "candidates")
    # the other terms' lists are only read for rows that still have a start
    longer = met.filter("n > 2")
    rest = of_windows(longer, known.select("window_id", "ordered"), ("key", "start")).select("key", "start", "window_id", "n", F.explode(F.slice("ordered", F.lit(3), F.col("n") - 2)).alias("t"))
    rest = rest.select("key", "start", "window_id", "n", (F.col("start") + F.col("t.at")).alias("pos"), F.col("t.term").alias("term"))
    there = rest.join(_of_rows(index, longer), ["key", "pos", "term"], "left_semi").groupBy("key", "start", "window_id", "n").count().filter("count = n - 2")
    return materialize(there.drop("count").unionByName(met.filter("n <= 2")), "matches")


def near_matches(index: DataFrame, known: DataFrame, slop: int) -> DataFrame:
    """Stored table (key, pos, window_id): places of a window's rarest term in a stretch of n + slop words that
    has all terms of the window as often as the window has them, in any order.

    The second rarest term must be near the rarest; what is left meets the other postings around it. Both
    joins are by (key, part, term), where parts are stretches of the text, so none is by text or term alone.
    """
    plan = known.select("window_id", "ordered")
    widest = (known.agg(F.max("n")).first()[0] or WINDOW) + slop
    far = F.col("n") - 1 + slop
    part = lambda c: F.floor(c / F.lit(widest)).cast("int")
    parts = F.explode(F.sequence(part(F.greatest(F.col("p") - far, F.lit(0))), part(F.col("p") + far)))
    parted = lambda lists: lists.withColumn("part", part(F.col("pos"))).distinct()
    within = F.abs(F.col("r.pos") - F.col("l.p")) <= F.col("l.n") - 1 + slop

    def meet(left: DataFrame, lists: DataFrame, how: str) -> DataFrame:
        keys = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "term", "part")]
        return left.alias("l").join(parted(lists).alias("r"), keys[0] & keys[1] & keys[2] & within, how)

    anchor = _anchored(index, known).withColumnRenamed("pos", "p")
    first = anchor.filter("n > 1").select("key", "p", "window_id", "n", F.col("second.term").alias("term"), parts.alias("part"))
    near = materialize(meet(first, _seconds(index, known), "left_semi").select("key", "p", "window_id", "n").distinct(), "near_candidates")
    wanted = of_windows(near, plan, ("key", "p")).select("key", "p", "window_id", "n", F.explode(F.array_distinct(F.transform("ordered", lambda t: t["term"]))).alias("term")).withColumn("part", parts)
    found = meet(wanted, _of_rows(index, near), "inner").select("l.key", "l.p", "l.window_id", "l.n", "r.pos", "l.term")
    # at most 2 * (n + slop) places around one posting
    around = of_windows(found.groupBy("key", "p", "window_id", "n").agg(F.collect_set(F.struct("pos", "term")).alias("places")), plan, ("key", "p"))

    def complete(s: Column) -> Column:
        inside = F.transform(F.filter("places", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + F.col("n") + slop)), lambda x: x["term"])
        has = lambda term: F.size(F.filter(inside, lambda y: y == term)) >= F.size(F.filter("ordered", lambda t: t["term"] == term))
        covers = (s["pos"] <= F.col("p")) & (F.col("p") < s["pos"] + F.col("n") + slop)
        return covers & F.forall(F.transform("ordered", lambda t: t["term"]), has)

    out = around.filter(F.exists("places", complete)).select("key", F.col("p").alias("pos"), "window_id")
    return materialize(out.unionByName(anchor.filter("n = 1").select("key", F.col("p").alias("pos"), "window_id")).distinct(), "near")


def _indexed(docs: DataFrame, items: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index of docs for the items' terms, the windows in order of their terms' counts, and the windows' items."""
    window, members = windows(items, size)
    window = materialize(window, "distinct_windows")
    index = build_index(docs, window.select(F.explode("terms").alias("word")), id_col, text_col)
    return index, ordered_windows(window, index), members


def find(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, item, pos): exact matches by their start or, with a slop, proximity matches by their rarest term."""
    index, known, members = _indexed(docs, items, size, id_col, text_col)
    found = exact_matches(index, known).withColumnRenamed("start", "pos") if slop is None else near_matches(index, known, slop)
    ids = index.filter("term = 0").select("doc_id", "key").distinct()
    return of_windows(found, members, ("key", "pos")).select("key", "item", "pos").distinct().join(ids, "key").select("doc_id", "key", "item", "pos")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_words, n_hit, hit_items (sorted as strings) and, with a slop, n_near (items with
    proximity matches) for every row of docs."""
    index, known, members = _indexed(docs, items, size, id_col, text_col)
    exact = exact_matches(index, known)
    places = exact.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    found = of_windows(exact.select("key", "window_id").distinct(), members, ("key",)).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("hit_items"))
    base = index.filter("term = 0").select("doc_id", "key", F.col("pos").cast("long").alias("n_words"))
    out = base.join(places.join(found, "key"), "key", "left")
    near = [F.lit(None).cast("long").alias("n_near")]
    if slop is not None:
        pairs = of_windows(near_matches(index, known, slop).select("key", "window_id").distinct(), members, ("key",))
        out = out.join(pairs.groupBy("key").agg(F.countDistinct("item").alias("n_near")), "key", "left")
        near = [F.coalesce("n_near", F.lit(0)).alias("n_near")]
    return out.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"), *near)


def digests(docs: DataFrame, items: DataFrame, slop: int = 2) -> DataFrame:
    return contamination(docs, items, slop=slop).select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without the rows that hold a window of an item."""
    index, known, _ = _indexed(docs, items, size, id_col, text_col)
    name = fresh(docs.columns, "key")
    hit = materialize(exact_matches(index, known).select(F.col("key").alias(name)).distinct(), "contaminated")
    return docs.join(broadcast_if_small(hit, KEY_ROWS), row_key(id_col, text_col) == F.col(name), "left_anti")
