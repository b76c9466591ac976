"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line with a word becomes a vector of surface features (length, shares of symbols, bars, digits
and capitals, closing punctuation, repetition of an earlier line, repeated words). The chain has two
labels. It is fitted by gradient ascent on the exact log-likelihood, where the lines of a labelled
document carry its quality label, and decoded by Viterbi. A document is kept when the share of its
characters in content lines reaches a cut-off, calibrated on the labelled rows, and it passes the
base rules (50 words, at most half of them in repeated three-word windows).

Only a bounded sample of labels is used to fit (max_rows); all texts are counted and decoded whole.

Defined results: null and empty texts have no words, fail the base rules and aren't kept; without
labels of both kinds every document that passes the base rules is kept; very long texts are read whole;
of equally good labels of the last line content is taken, and of earlier lines boilerplate; rows with a null id are assessed like others; of several labels of an
id the least counts; repeated rows get a row each; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.batches import map_batches

#: White space between words, counted symbols, base cut-offs.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
CHUNK = 64  # lines in a training chain; longer documents are cut into several
FEATURES = 11


@dataclass
class Model:
    emit: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))  # content against boilerplate
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    least_share: float = 0.0


def line_features(lines: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each line, none of which may be blank."""
    out = np.empty((len(lines), FEATURES))
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = max(len(line), 1)
        signs = len(line) - len(line.translate(None, SYMBOLS))
        capitals = sum(65 <= w[0] <= 90 for w in words)
        out[i] = (
            1.0,
            math.log1p(len(words)) / 4,
            min(signs / n * 5, 1.0),
            min(line.count(b"|") / len(words), 1.0),
            (len(line) - len(line.translate(None, b"0123456789"))) / n,
            capitals / len(words),
            float(line.rstrip()[-1:] in b".!?"),
            float(line in seen),
            1 - len(set(words)) / len(words),
            float(len(words) <= 3),
            min(sum(w.startswith((b"http", b"www", b"<")) for w in words) / len(words), 1.0),
        )
        seen.add(line)
    return out


def text_lines(text: bytes) -> list[bytes]:
    """Lines between newlines that have a word."""
    return [x for x in text.split(b"\n") if x.strip()]


def viterbi(features: np.ndarray, model: Model) -> np.ndarray:
    """The best labels (1: content) of a document's lines."""
    gain = (features @ model.emit).tolist()
    (a00, a01), (a10, a11) = model.move.tolist()
    back, s0, s1 = [], 0.0, gain[0]
    for g in gain[1:]:
        from0, from1 = (s1 + a10 > s0 + a00), (s1 + a11 > s0 + a01)
        back.append((from0, from1))
        s0, s1 = (s1 + a10 if from0 else s0 + a00), (s1 + a11 if from1 else s0 + a01) + g
    now = int(s1 >= s0)
    out = [now]
    for step in reversed(back):
        now = int(step[now])
        out.append(now)
    return np.array(out[::-1])


def content_share(text: bytes, model: Model) -> float:
    """Share of the bytes of lines with words that lie in content lines; 0 without such lines."""
    lines = text_lines(text)
    if not lines:
        return 0.0
    size = np.fromiter(map(len, lines), float, len(lines))
    return float(size @ viterbi(line_features(lines), model) / size.sum())


def fit_chain(chains: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-3) -> Model:
    """Maximum likelihood by Adam on exact forward-backward gradients; all lines of a chain have its label."""
    longest = max(map(len, chains))
    x = np.zeros((len(chains), longest, FEATURES))
    mask = np.zeros((len(chains), longest))
    for i, c in enumerate(chains):
        x[i, : len(c)], mask[i, : len(c)] = c, 1
    y = labels[:, None] * mask
    pairs = mask[:, 1:]
    seen = np.array([[((1 - labels)[:, None] * pairs).sum(), 0.0], [0.0, (labels[:, None] * pairs).sum()]])
    total = mask.sum()
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        emit, move = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        score = np.stack([np.zeros_like(mask), x @ emit], axis=2)
        forward = np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for k in range(1, longest):
            step = np.logaddexp(forward[:, k - 1, 0, None] + move[0], forward[:, k - 1, 1, None] + move[1]) + score[:, k]
            forward[:, k] = np.where(mask[:, k, None] > 0, step, forward[:, k - 1])
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        backward = np.zeros_like(score)
        both = np.zeros((2, 2))
        for k in range(longest - 1, 0, -1):
            ahead = score[:, k] + backward[:, k]
            joint = forward[:, k - 1, :, None] + move + ahead[:, None, :] - norm[:, None, None]
            both += (np.exp(np.minimum(joint, 0)) * mask[:, k, None, None]).sum(axis=0)
            step = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
            backward[:, k - 1] = np.where(mask[:, k, None] > 0, step, 0)
        p = np.exp(np.minimum(forward[..., 1] + backward[..., 1] - norm[:, None], 0)) * mask
        grad = np.concatenate([np.einsum("ij,ijk->k", y - p, x), (seen - both).ravel()]) / total - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit from a bounded sample of rows (text, 0/1 label); feature vectors come to the driver, texts don't."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).filter("text is not null and label is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(label, lines) for text, label in zip(batch.column(0), batch.column(1).to_pylist()) if (lines := text_lines(text.as_py().encode()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([line_features(x[1]).astype("<f4").tobytes() for x in out], pa.binary()), pa.array([np.fromiter(map(len, x[1]), "<i4", len(x[1])).tobytes() for x in out], pa.binary())],
                ["label", "features", "sizes"],
            )

    held = [(r[0], np.frombuffer(r[1], "<f4").reshape(-1, FEATURES).astype(float), np.frombuffer(r[2], "<i4")) for r in map_batches(rows, run, "label int, features binary, sizes binary").toLocalIterator()]
    if len({label for label, *_ in held}) < 2:
        return Model()
    chains = [(label, x[at : at + CHUNK]) for label, x, _ in held for at in range(0, len(x), CHUNK)]
    model = fit_chain([x for _, x in chains], np.array([label for label, _ in chains], float))
    shares = np.array([size @ viterbi(x, model) / size.sum() for _, x, size in held])
    truth = np.array([label for label, *_ in held])
    cuts = np.linspace(0.05, 0.95, 19)
    right = [((shares >= c) == truth).sum() for c in cuts]
    best = [c for c, r in zip(cuts, right) if r == max(right)]
    model.least_share = float(best[len(best) // 2])
    return model


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    blank = len(data) - len(data.translate(None, SPACE))
    lines = text_lines(data)
    n = len(words)
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, inverse, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + n - 2] |= twice
        repeated = int(covered.sum())
    return n, len(text) - blank, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


def assess(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts, base_failed, content_share and kept for every row of docs."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shares = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                counts.append(base_counts(text))
                shares.append(content_share(text.encode("utf-8", "surrogatepass"), model))
            columns = list(zip(*counts)) or [()] * 5
            failed = [c[0] < LEAST_WORDS or 100 * c[4] > MOST_REPEATED * c[0] for c in counts]
            kept = [not f and s >= model.least_share for f, s in zip(failed, shares)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed, pa.bool_()), pa.array(shares, pa.float64()), pa.array(kept, pa.bool_())],
                ["doc_id", *names, "base_failed", "content_share", "kept"],
            )

    longs = ", ".join(f"{c} long" for c in names)
    return map_batches(source, run, f"doc_id {id_type}, {longs}, base_failed boolean, content_share double, kept boolean")


def sample_labels(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """At most about max_rows labels, chosen by a hash of their id, with their texts; the bounded side is broadcast."""
    usable = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("label"))
    keep = min(1.0, max_rows / max(usable.count(), 1))
    chosen = usable.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(keep * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("text_id") == F.col("label_id")).select("text", F.col("label").alias(label_col))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The assessment of docs by a model that is fitted to the quality labels."""
    return assess(docs, train(sample_labels(docs, labels)))
