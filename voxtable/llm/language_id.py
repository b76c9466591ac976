"""Language identification by interpolated Kneser-Ney character models.

Word counts per language over all training rows are gathered by Spark; character n-gram counts come
from distinct words times their counts. Continuation counts, context sums and the interpolated
probabilities of every language are joins and aggregations on the n-gram table, order by order.

The probabilities of all languages stand side by side in rows that are found through sorted arrays of
n-gram hashes, which go to the tasks as long as the model's size, which is counted, allows it. A larger
model stays a table: the distinct words of the texts meet it by joins, and the texts meet the words'
scores. Both ways give the same entropies.

A text's language is the one with the lowest cross-entropy per character. The score is a softmax over
the entropies whose temperature, like the entropy beyond which a text counts as ``rejected``, is
calibrated on all training rows. A rejected text still has the language that is nearest.

Words are runs of letters, in lower case, between boundary marks, so word scores can be kept in a
bounded cache and every letter of every text counts.

Defined results: null texts and texts without a letter are ``und`` with score 0; without training
rows every text is ``und``; of languages with equal entropies the first in the alphabet is taken; very long
texts count whole; repeated rows get a row each; rows with a null id or lang are scored like others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.batches import map_batches
from voxtable.llm.names import spread_join
from voxtable.llm.toxicity import in_training
from voxtable.plans.storage import materialize

WORD = re.compile(r"[^\W\d_]+")
ORDER = 4
DISCOUNT = 0.75
#: Probabilities (n-grams times languages) that may go to the driver and the tasks: 32 MB. Beyond it joins score.
ARRAY_NUMBERS = 8_000_000
_CACHE_ENTRIES = 150_000
_FLUSH_WORDS = 200_000
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    grams: DataFrame | None = None  # gram, logs: natural log probabilities by language
    contexts: DataFrame | None = None  # gram, back: log weights of the shorter context by language
    arrays: Arrays | None = None
    floor: float = -12.0
    temperature: float = 0.1
    reject: float = math.inf


@dataclass
class Arrays:
    """For each order, the sorted hashes of n-grams and of contexts, and their rows."""

    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    languages: list[str]
    floor: float


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case. The pattern also takes numerals other than digits, which aren't letters."""
    found = WORD.findall((text or "").lower())
    if text is None or text.isascii():
        return found
    return [p for w in found for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


_M = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k code points that end at each place from k - 1 on (k = 0: one constant each)."""
    n = max(len(codes) - k + 1, 0)
    out = np.full(n, k + 1, np.uint64)
    for j in range(k):
        out = (out ^ codes[j : j + n]) * _M
        out ^= out >> np.uint64(31)
    return out


def _marked(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words between boundary marks, each place's word, and its place in the word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    return _codes("".join(f" {w} " for w in words)), owner, np.arange(len(owner)) - starts[owner]


def word_counts(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over all rows. Counts are pre-aggregated in each task before they are shuffled."""
    source = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            langs = [k for k, c in counts.items() for _ in c]
            words = [w for c in counts.values() for w in c]
            out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())], ["lang", "word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[lang].update(words_of(text.as_py()))
            if sum(map(len, counts.values())) > _FLUSH_WORDS:
                yield flush()
        yield flush()

    return map_batches(source, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows, put together from smaller ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def ngram_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) for orders 1 to order of words between boundary marks (a space on each side).

    Each word gives its n-grams once with its count, in tasks that pre-aggregate; the words grow with
    the corpus, the n-grams with the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            langs, words, times = (batch.column(i) for i in range(3))
            words, lang = words.to_pylist(), langs.dictionary_encode()
            lang_of, times = lang.indices.to_numpy().astype(np.uint64), times.to_numpy()
            if not words:
                continue
            text = "".join(f" {w} " for w in words)
            codes, owner, place = _marked(words)
            for k in range(1, order + 1):
                ends = np.flatnonzero(place >= max(k - 1, 1))
                keys = _gram_hashes(codes, k)[ends - k + 1] ^ (lang_of[owner[ends]] * _M)
                _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                n = np.bincount(inverse, weights=times[owner[ends]]).astype(np.int64)
                at = ends[first]
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(owner[at])), pa.array([text[i - k + 1 : i + 1] for i in at.tolist()], pa.string()), pa.array(n)], ["lang", "gram", "n"]
                )

    return map_batches(words, run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, order: int = ORDER, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows (text, lang): counts and calibration cover all of them."""
    model = estimate(materialize(ngram_counts(word_counts(rows, text_col, lang_col), order), "ngrams"), order)
    if model.languages:
        usable = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
        known = score(usable, model, "lang", "text").filter("entropies is not null").select(F.col("doc_id").alias("lang"), "entropies")
        calibrate(model, known)
    return model


def probabilities(counts: DataFrame, languages: list[str], order: int) -> tuple[DataFrame, DataFrame, int]:
    """(lang, gram, p) and (lang, gram, weight), and the number of letters, from counts (lang, gram, n).

    Below the highest order, and but for n-grams at a word's start, counts are numbers of left neighbours.
    Every language has a row for each n-gram that any language has: what it lacks it takes from the shorter
    context. Each order takes the one below it by an equi-join on the n-gram without its first character.
    """
    every = F.explode(F.array(*map(F.lit, languages))).alias("lang")
    sized = counts.withColumn("k", F.length("gram"))
    tail, head = F.substring("gram", 2, order), lambda k: F.substring("gram", 1, k - 1)
    left = sized.filter("k > 1").groupBy("lang", tail.alias("gram")).agg(F.count("*").alias("left"))
    own = (F.col("k") == order) | ((F.col("k") > 1) & F.col("gram").startswith(" "))
    adjusted = sized.join(left, ["lang", "gram"], "left").select("lang", "gram", "k", F.when(own, F.col("n")).otherwise(F.coalesce("left", F.lit(0))).cast("double").alias("a"))
    adjusted = materialize(adjusted, "adjusted")
    letters = adjusted.filter("k = 1").select("gram").distinct().count()
    lower, p, weights = None, [], []
    for k in range(1, order + 1):
        mine = adjusted.filter(F.col("k") == k)
        sums = mine.groupBy("lang", head(k).alias("h")).agg(F.sum("a").alias("total"), F.sum((F.col("a") > 0).cast("double")).alias("kinds")).filter("total > 0")
        sums = materialize(sums.select("lang", "h", "total", (DISCOUNT * F.col("kinds") / F.col("total")).alias("weight")), "contexts")
        here = mine.select("gram").distinct().select("gram", every).withColumn("h", head(k))
        held = here.join(mine.select("lang", "gram", "a"), ["lang", "gram"], "left").join(sums, ["lang", "h"], "left")
        spent = F.coalesce(F.greatest(F.col("a") - DISCOUNT, F.lit(0.0)) / F.col("total"), F.lit(0.0))
        if lower is None:
            held = held.withColumn("q", F.lit(1.0 / (letters + 1)))
        else:
            held = held.withColumn("tail", tail).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q")), ["lang", "tail"])
        lower = materialize(held.select("lang", "gram", (spent + F.coalesce("weight", F.lit(1.0)) * F.col("q")).alias("p")), "probabilities")
        p.append(lower)
        contexts = sums.select("h").distinct().select(F.col("h").alias("gram"), every)
        weights.append(contexts.join(sums.select("lang", F.col("h").alias("gram"), "weight"), ["lang", "gram"], "left").select("lang", "gram", F.coalesce("weight", F.lit(1.0)).alias("weight")))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(p), union(weights), letters


def estimate(counts: DataFrame, order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney models of the languages in stored counts (lang, gram, n)."""
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not languages:
        return Model([])
    p, weights, letters = probabilities(counts, languages, order)

    def rows(values: DataFrame, value: str, name: str) -> DataFrame:
        each = F.struct("lang", F.log(F.greatest(value, F.lit(1e-9))).cast("float").alias("x"))
        return materialize(values.groupBy("gram").agg(F.transform(F.array_sort(F.collect_list(each)), lambda v: v["x"]).alias(name)), name)

    model = Model(languages, rows(p, "p", "logs"), rows(weights, "weight", "back"), floor=math.log(1 / (letters + 1)))
    if (model.grams.count() + model.contexts.count()) * len(languages) <= ARRAY_NUMBERS:
        model.arrays = sorted_arrays(model, order)
    return model


def sorted_arrays(model: Model, order: int) -> Arrays:
    """The model's rows by the sorted hashes of their n-grams; its size has been counted before."""
    def parts(table: DataFrame, value: str, lengths: range) -> tuple[list[np.ndarray], list[np.ndarray]]:
        held = table.toPandas()
        size = held["gram"].str.len().to_numpy()
        keys, values = [], []
        for k in lengths:
            mine = held[size == k]
            hashes = _table_hashes(mine["gram"].tolist(), k)
            at = np.argsort(hashes)
            keys.append(hashes[at])
            values.append(np.array(mine[value].tolist(), np.float32).reshape(-1, len(model.languages))[at])
        return keys, values

    return Arrays(*parts(model.grams, "logs", range(1, order + 1)), *parts(model.contexts, "back", range(order)), model.languages, model.floor)


def _table_hashes(grams, k: int) -> np.ndarray:
    return _gram_hashes(_codes("".join(grams)), k)[:: max(k, 1)] if k else _gram_hashes(np.empty(0, np.uint64), 0)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Row of each key in a sorted array of hashes, -1 where it isn't there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Scorer:
    def __init__(self, model: Arrays):
        self.model, self.cache = model, {}
        self.size = 0
        self.matrix = np.zeros((0, len(model.languages) + 1), np.float32)

    def _words(self, words: list[str]) -> np.ndarray:
        """Rows of the words' summed log probabilities, with the end marks, and numbers of characters."""
        m = self.model
        codes, owner, place = _marked(words)
        ends = np.flatnonzero(place >= 1)
        spent = np.zeros((len(ends), len(m.languages)), np.float32)
        open_ = np.ones(len(ends), bool)
        for k in range(len(m.hashes), 0, -1):
            todo = np.flatnonzero(open_ & (place[ends] >= k - 1))
            if not len(todo):
                continue
            at = _find(m.hashes[k - 1], _gram_hashes(codes, k)[ends[todo] - k + 1])
            hit = at >= 0
            spent[todo[hit]] += m.logs[k - 1][at[hit]]
            open_[todo[hit]] = False
            miss = todo[~hit]
            at = _find(m.contexts[k - 1], _gram_hashes(codes, k - 1)[ends[miss] - k + 1])
            spent[miss[at >= 0]] += m.back[k - 1][at[at >= 0]]
        spent[open_] += m.floor
        out = np.zeros((len(words), len(m.languages) + 1), np.float32)
        firsts = np.flatnonzero(np.diff(owner[ends], prepend=-1))
        out[:, :-1] = np.add.reduceat(spent, firsts, axis=0)
        out[:, -1] = np.bincount(owner[ends], minlength=len(words))
        return out

    def learn(self, texts: list[str | None]) -> list[list[str]]:
        """The texts' words, after their rows have been put into the cache for all texts at once."""
        found = [words_of(t) for t in texts]
        if len(self.cache) > _CACHE_ENTRIES:
            self.cache.clear()
            self.size = 0
        missing = list({w for words in found for w in words}.difference(self.cache))
        if missing:
            need = self.size + len(missing)
            if need > len(self.matrix):
                grown = np.zeros((need + need // 2, len(self.model.languages) + 1), np.float32)
                grown[: self.size] = self.matrix[: self.size]
                self.matrix = grown
            for at in range(0, len(missing), 20_000):
                part = missing[at : at + 20_000]
                self.matrix[self.size : self.size + len(part)] = self._words(part)
                self.cache.update(zip(part, range(self.size, self.size + len(part))))
                self.size += len(part)
        return found

    def entropies(self, words: list[str]) -> np.ndarray | None:
        """Cross-entropy per character, for each language; None without letters."""
        if not words:
            return None
        at = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        total = self.matrix[at].sum(axis=0, dtype=np.float64)
        return -total[:-1] / total[-1]


def calibrate(model: Model, rows: DataFrame) -> None:
    """Temperature with the greatest likelihood, over all rows (lang, entropies); rejection beyond the worst
    entropies of right answers. One row of sums comes to the driver."""
    temperatures = [0.02 * 1.3**i for i in range(20)]
    least = F.array_min("entropies")
    held = rows.withColumn("truth", F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang"))).filter("truth > 0")
    held = held.select("truth", least.alias("least"), F.transform("entropies", lambda e: e - least).alias("away"), (F.array_position("entropies", least) == F.col("truth")).alias("right"))

    def loss(t: float) -> Column:
        return F.avg(F.log(F.aggregate("away", F.lit(0.0), lambda s, x: s + F.exp(-x / t))) + F.element_at("away", F.col("truth").cast("int")) / t)

    right = F.when(F.col("right"), F.col("least"))
    found = held.agg(*[loss(t).alias(f"loss{i}") for i, t in enumerate(temperatures)], F.max(right).alias("worst"), F.stddev_pop(right).alias("spread")).first()
    if found["loss0"] is None:
        return
    model.temperature = temperatures[min(range(len(temperatures)), key=lambda i: found[f"loss{i}"])]
    if found["worst"] is not None:
        # far outside what known languages show: ten spreads beyond their worst
        model.reject = found["worst"] + max(10 * found["spread"], 1.0)


def _by_arrays(source: DataFrame, arrays: Arrays) -> DataFrame:
    """source (doc_id, text) to (doc_id, entropies): the sorted arrays go to the tasks."""
    id_type = source.schema["doc_id"].dataType.simpleString()
    sent = source.sparkSession.sparkContext.broadcast(arrays)  # at most ARRAY_NUMBERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 200):
                found += map(scorer.entropies, scorer.learn(batch.column(1).slice(at, 200).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if e is None else e.tolist() for e in found], pa.list_(pa.float64()))], ["doc_id", "entropies"])

    return map_batches(source, run, f"doc_id {id_type}, entropies array<double>")


def _by_joins(source: DataFrame, model: Model, order: int) -> DataFrame:
    """The same for a model of any size: distinct words meet the n-gram tables, and texts meet their words."""
    size = len(model.languages)
    keyed = materialize(source.withColumn("row", F.xxhash64("doc_id", "text")), "texts")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = Counter(words_of(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(counts), pa.int64()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["row", "word", "n"])

    tokens = materialize(map_batches(keyed.select("row", "text").distinct(), split, "row long, word string, n long"), "tokens")
    marked = tokens.select("word").distinct().select("word", F.concat(F.lit(" "), "word", F.lit(" ")).alias("marked"))
    ends = marked.select("word", "marked", F.explode(F.sequence(F.lit(2), F.length("marked"))).alias("end")).select("word", "marked", "end", F.explode(F.sequence(F.lit(1), F.least("end", F.lit(order)))).alias("k"))
    part = lambda length: F.substring(F.col("marked"), F.col("end") - F.col("k") + 1, length)
    asked = ends.select("word", "end", "k", part(F.col("k")).alias("gram"), part(F.col("k") - 1).alias("context"))
    # short n-grams stand in nearly every word, and frequent words in nearly every text
    asked = materialize(asked, "asked")
    met = spread_join(spread_join(asked, model.grams, ["gram"], "word"), model.contexts.withColumnRenamed("gram", "context"), ["context"], "word")
    place = met.groupBy("word", "end").agg(F.max(F.when(F.col("logs").isNotNull(), F.struct("k", "logs"))).alias("best"), F.collect_list(F.when(F.col("back").isNotNull(), F.struct("k", "back"))).alias("weights"))
    known = F.coalesce(F.col("best.k"), F.lit(0))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    first = F.coalesce(F.col("best.logs").cast("array<double>"), F.array_repeat(F.lit(model.floor), size))
    logs = F.aggregate(F.filter("weights", lambda w: w["k"] > known), first, lambda a, w: add(a, w["back"].cast("array<double>")))
    words = place.withColumn("x", logs).groupBy("word").agg(F.array(*[F.sum(F.col("x")[j]) for j in range(size)]).alias("x"), F.count("*").alias("chars"))
    sums = spread_join(tokens, materialize(words, "words"), ["word"], "row").groupBy("row").agg(F.array(*[F.sum(F.col("n") * F.col("x")[j]) for j in range(size)]).alias("x"), F.sum(F.col("n") * F.col("chars")).alias("chars"))
    return keyed.select("doc_id", "row").join(sums, "row", "left").select("doc_id", F.transform("x", lambda v: -v / F.col("chars")).alias("entropies"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, lang_pred, score, rejected, and the entropies by language (null without letters)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not model.languages:
        found = source.select("doc_id", F.lit(None).cast("array<double>").alias("entropies"))
    else:
        found = _by_arrays(source, model.arrays) if model.arrays else _by_joins(source, model, order)
    least = F.array_min("entropies")
    odds = F.aggregate("entropies", F.lit(0.0), lambda s, e: s + F.exp(-(e - least) / F.lit(float(model.temperature))))
    names = F.array(*map(F.lit, model.languages)).cast("array<string>")
    return found.select(
        "doc_id", F.coalesce(F.get(names, F.array_position("entropies", least).cast("int") - 1), F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1 / odds, F.lit(0.0)).alias("score"),
        F.coalesce(least > F.lit(float(model.reject)), F.lit(True)).alias("rejected"), "entropies",
    )


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of docs, learning only from the other rows."""
    model = train(docs.filter(in_training("doc_id")))
    return score(docs, model).select("doc_id", F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
