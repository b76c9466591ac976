"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Token scores are log-odds ratios between toxic and other training texts. A token's counts are the
distinct neighbours it was seen behind, so that copied passages count once. The Dirichlet prior of a
token is the class share of its prefix, whose own prior is the share of a shorter prefix, down to
the share of all tokens: unseen and rare forms take after their stems. A drift is taken off every
score, and a linear-time scan finds all maximal-scoring segments of a text. A segment of score S in
a text of n tokens has lambda * S - ln(K * n) as its score in extreme-value units; a text's best
segment and the number of significant ones give its probability by a logistic fit on held-back
training rows.

Only labels of training rows are read, from a bounded sample (max_rows); all texts are scored whole.

Defined results: null and empty texts, and those without letters, get the score of a text without
toxic tokens; a table without toxic labels gives every text the smoothed share of toxic rows; very long
texts are scored whole; equal scores are equal probabilities; rows with a null id are scored like others and
never learned from; of several labels of an id the greatest counts; repeated rows get a row each; an
empty table gives no rows; other columns, whatever their names, are ignored (predictions) or kept (filter_clean).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.batches import map_batches
from voxtable.plans.storage import materialize

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
PRIOR = 4.0
DRIFT = 0.7
LOWEST, HIGHEST = -3.0, 6.0
SIGNIFICANT = 2.3  # natural log units above chance: one text in ten without toxic passages
_CACHE_ENTRIES = 300_000
_FLUSH = 50_000
SEGMENTS = "array<struct<start: int, end: int, score: double>>"


class Nodes:
    """Counts by node as sorted 64-bit hashes: a few bytes for each, in every task."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        keys = np.fromiter(map(_hash, counts), np.uint64, len(counts))
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], np.array([*counts.values()], np.int32).reshape(-1, 2)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two nodes share a hash")

    def get(self, node: str, default: tuple[int, int]) -> tuple[int, int]:
        return tuple(self.find([node])[0].tolist())

    def find(self, nodes: list[str]) -> np.ndarray:
        """A row (toxic, other) for each node, zeros for unknown ones."""
        if not len(self.keys):
            return np.zeros((len(nodes), 2), np.int32)
        asked = np.fromiter(map(_hash, nodes), np.uint64, len(nodes))
        at = np.minimum(self.keys.searchsorted(asked), len(self.keys) - 1)
        return self.counts[at] * (self.keys[at] == asked)[:, None]


def _hash(node: str) -> int:
    return xxhash.xxh3_64_intdigest(node.encode())


@dataclass
class Model:
    share: float = 0.0
    counts: dict[str, tuple[int, int]] | Nodes = field(default_factory=dict)  # "=word" or "prefix" -> toxic, other
    rate: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def odds(self, token: str) -> float:
        """Log-odds of a token against the share of toxic tokens, less the drift."""
        share = self.share
        for node in [*(token[:k] for k in PREFIXES if k < len(token)), "=" + token]:
            toxic, other = self.counts.get(node, (0, 0))
            share = (toxic + PRIOR * share) / (toxic + other + PRIOR)
        value = math.log(share / (1 - share)) - math.log(self.share / (1 - self.share))
        return min(max(value, LOWEST), HIGHEST) - DRIFT


def all_odds(model: Model, tokens: list[str]) -> list[float]:
    """model.odds of each token, read from the nodes together."""
    if not isinstance(model.counts, Nodes):
        return list(map(model.odds, tokens))
    share = np.full(len(tokens), model.share)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    for k in [*PREFIXES, None]:
        own = np.flatnonzero(lengths > k) if k else np.arange(len(tokens))
        found = model.counts.find([tokens[i][:k] if k else "=" + tokens[i] for i in own.tolist()])
        share[own] = (found[:, 0] + PRIOR * share[own]) / (found.sum(axis=1) + PRIOR)
    values = np.log(share / (1 - share)) - math.log(model.share / (1 - model.share))
    return (np.clip(values, LOWEST, HIGHEST) - DRIFT).tolist()


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, in time linear in the scores.

    Each candidate keeps a link to the nearest earlier candidate with a lower sum before it.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    low: list[float] = []
    high: list[float] = []
    place: list[tuple[int, int]] = []
    link: list[int] = []
    for i in np.flatnonzero(scores > 0).tolist():
        before, after, start = float(sums[i]), float(sums[i + 1]), i
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= before:
                j = link[j]
            if j < 0 or high[j] >= after:
                break
            before, start = low[j], place[j][0]
            del low[j:], high[j:], place[j:], link[j:]
        low.append(before)
        high.append(after)
        place.append((start, i + 1))
        link.append(j)
    return [(s, e, h - b) for (s, e), h, b in zip(place, high, low)]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def token_scores(self, text: str) -> np.ndarray:
        tokens = WORD.findall(text.lower())
        cache = self.cache
        if len(cache) > _CACHE_ENTRIES:
            cache.clear()
        new = [w for w in set(tokens) if w not in cache]
        if new:
            cache.update(zip(new, all_odds(self.model, new)))
        return np.fromiter(map(cache.__getitem__, tokens), np.float64, len(tokens))

    def passages(self, text: str) -> tuple[int, float, list[tuple[int, int, float]]]:
        """Number of tokens, the best segment in extreme-value units, and the significant segments."""
        scores = self.token_scores(text)
        n = len(scores)
        found = segments(scores) if n else []
        chance = self.model.log_k + math.log(max(n, 1))
        scaled = [(s, e, self.model.rate * x - chance) for s, e, x in found]
        best = max((x for _, _, x in scaled), default=-chance)
        return n, best, [x for x in scaled if x[2] >= SIGNIFICANT]

    def probability(self, best: float, significant: int) -> float:
        a, b, c = self.model.weights
        return 1 / (1 + math.exp(-min(max(a + b * _squash(best) + c * math.log1p(significant), -30), 30)))


def _squash(best: float) -> float:
    return min(max(best, -5.0), 15.0) / 5


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit from a bounded sample of rows (text, 0/1 label); see sample_labels, whose rows alone bound it:
    all words and prefixes of the sample count, and none is left out of the model.

    Two thirds of the rows, by a hash of the text, give token counts; the others calibrate.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).filter("text is not null and label is not null").distinct()
    rows = materialize(rows, "labelled")
    part = F.pmod(F.xxhash64("text"), F.lit(3))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(seen: set) -> pa.RecordBatch:
            columns = list(zip(*seen)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["token", "label", "context"])

        seen: set[tuple[str, int, int]] = set()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                tokens = WORD.findall(text.as_py().lower())
                seen.update((w, label, zlib.crc32(p.encode())) for p, w in zip(["", *tokens], tokens))
                if len(seen) > _FLUSH:
                    yield made(seen)
                    seen = set()
        yield made(seen)

    pairs = map_batches(rows.filter(part < 2), contexts, "token string, label int, context long").distinct()
    tokens = pairs.groupBy("token").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
    tokens = materialize(tokens, "tokens")
    lengths = F.filter(F.array(*map(F.lit, PREFIXES)), lambda k: k < F.length("token"))
    names = F.concat(F.array(F.concat(F.lit("="), "token")), F.transform(lengths, lambda k: F.substring(F.col("token"), 1, k)))
    nodes = tokens.select(F.explode(names).alias("node"), "toxic", "other").groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = {r["node"]: (r["toxic"], r["other"]) for r in materialize(nodes, "nodes").toLocalIterator()}
    totals = tokens.agg(F.sum("toxic"), F.sum("other")).first()
    n_toxic, n_other = totals[0] or 0, totals[1] or 0
    model = Model(share=(n_toxic + 1) / (n_toxic + n_other + 2), counts=counts)
    model.rate = _rate(model, n_other)
    model.counts = Nodes(counts)
    del counts
    scored = map_batches(rows.filter(part == 2), _features(model), "label int, n int, best double, significant int")
    held = scored.collect()
    calm = [r for r in held if not r["label"] and r["n"]]
    if calm:  # the mean of a Gumbel variable fixes K
        model.log_k = float(np.mean([r["best"] for r in calm])) - 0.5772
    held = map_batches(rows.filter(part == 2), _features(model), "label int, n int, best double, significant int").collect() if calm else held
    model.weights = _logistic([(_squash(r["best"]), math.log1p(r["significant"]), r["label"]) for r in held])
    return model


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = [(label, *((x := scorer.passages(text.as_py()))[:2]), len(x[2])) for text, label in zip(batch.column(0), batch.column(1).to_pylist())]
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int32()))], ["label", "n", "best", "significant"])

    return run


def _rate(model: Model, n_other: int) -> float:
    """lambda: the positive root of the mean of exp(lambda * score) over tokens of other texts, being 1.
    One toxic token is added to them, so that there is a root where none was seen."""
    scores = [(model.odds(node[1:]), other) for node, (_, other) in model.counts.items() if node[0] == "=" and other]
    values = np.array([HIGHEST - DRIFT, *(s for s, _ in scores)])
    weights = np.array([1.0, *(w for _, w in scores)])
    rest = max(n_other - weights[1:].sum(), 0)  # tokens seen once score about the drift
    low, high = 0.05, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        total = (weights * np.exp(mid * values)).sum() + rest * math.exp(-mid * DRIFT)
        low, high = (mid, high) if total < weights.sum() + rest else (low, mid)
    return low


def _logistic(rows: list[tuple[float, float, int]], ridge: float = 0.02) -> tuple[float, float, float]:
    if not rows or len({y for *_, y in rows}) < 2:
        share = (sum(y for *_, y in rows) + 0.5) / (len(rows) + 10)
        return math.log(share / (1 - share)), 0.0, 0.0
    x = np.array([[1.0, a, b] for a, b, _ in rows])
    y = np.array([r[2] for r in rows], float)
    w = np.zeros(3)
    penalty = ridge * np.diag([0.0, 1.0, 1.0])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + v @ penalty @ v / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(3), x.T @ (p - y) + penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """docs' id, toxicity (0 to 1), and the significant passages as places in the text with their scores."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            out, passages = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                _, best, found = scorer.passages(text)
                out.append(scorer.probability(best, len(found)))
                places = [m.span() for m in WORD.finditer(text.lower())] if found and spans else []
                passages.append([{"start": places[s][0], "end": places[e - 1][1], "score": x} for s, e, x in found] if places else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return map_batches(source, run, f"doc_id {id_type}, score double, passages {SEGMENTS}")


def in_training(id_col: str):
    """True for ids that may be learned from: crc32 of the id as text isn't divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def sample_labels(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Training rows (text, label): at most about max_rows labels, chosen by a hash of their id, meet docs
    by a broadcast of that bounded sample, so texts aren't shuffled."""
    usable = labels.filter(F.col(label_col).isNotNull() & in_training(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label"))
    keep = min(1.0, max_rows / max(usable.count(), 1))
    chosen = usable.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(keep * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("text_id") == F.col("label_id")).select("text", F.col("label").alias(label_col))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) and passages for every row of docs."""
    model = train(sample_labels(docs, labels))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def filter_clean(docs: DataFrame, model: Model, cut_off: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under cut_off."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            keep = []
            for text in batch.column(at):
                _, best, found = scorer.passages(text.as_py() or "")
                keep.append(scorer.probability(best, len(found)) < cut_off)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)
