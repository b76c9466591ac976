"""How many n-grams a corpus has, and how many are left after pruning, without a table of them.

Tasks count the n-grams of slices of texts, in Arrow, so that frequent ones are moved once for each slice, and deal
them to buckets by a fingerprint of 96 bits instead of their words; each bucket is then counted by itself. Buckets grow
in number with the texts, not in size. Two n-grams among n share a fingerprint with a chance of n * n / 2 ** 97 (for a
billion, 6e-12). Orders go one after the other, so that the shuffle files of only one lie on disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.operators.ngrams import BOS, EOS, thresholds
from voxtable.plans.storage import cleaned, materialize, settings

#: Bytes of text whose n-grams are counted at once in a task; a longer text is a slice of its own.
SLICE = 32 << 20

#: Bytes of text for each bucket, which has one n-gram for about seven of them at most.
BUCKET = 8 << 20

#: Bytes of n-grams that a task hands on at once.
BATCH = 4 << 20

#: Rows of an Arrow batch: texts are large.
ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

#: Odd factors by which a fingerprint's two parts are multiplied before the next word is added.
HIGH, LOW = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x85EBCA6B)

#: Another one that mixes the bits which all n-grams of a bucket share with the rest.
MIX = np.uint64(0xD6E8FEB86659FD93)

#: Keys of the two hashes of a word (SipHash).
KEYS = "voxtable: high 1", "voxtable: low 02"


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Array]:
    """The texts in arrays of at most so many bytes, or of one text."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, before + most - size, "right")), start + (not held))
            if stop > start:
                held.append(batch.column(0).slice(start, stop - start))
                size += int(ends[stop - 1]) - before
            if stop < len(ends):
                yield pa.concat_arrays(held)
                held, size = [], 0
            start = stop
    if held:
        yield pa.concat_arrays(held)


def _marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints (high, low) of the words, with marks, of all texts in turn, and where each text begins and ends."""
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    coded = pc.dictionary_encode(parts.flatten())
    kind = pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()
    words = np.append(coded.dictionary.cast(kind).to_numpy(zero_copy_only=False), np.array([BOS.encode(), EOS.encode()], object))
    high, low = (pd.util.hash_array(words, hash_key=k, categorize=False) for k in KEYS)
    lengths = np.diff(parts.offsets.to_numpy()) + 2
    ends = np.cumsum(lengths) - 1
    begins = ends - lengths + 1
    at = np.empty(int(ends[-1]) + 1, np.int32)
    inside = np.ones(len(at), bool)
    inside[begins] = inside[ends] = False
    at[inside] = coded.indices.to_numpy()
    at[begins], at[ends] = len(words) - 2, len(words) - 1
    return high[at], low.astype(np.uint32)[at], begins, ends


def _order(high: np.ndarray) -> np.ndarray:
    """Places by ascending ``high``, as far as its first bits tell (41 of them for 8 million values): the last bits
    hold the place, as numbers are sorted several times faster than their places."""
    bits = np.uint64(max(1, (len(high) - 1).bit_length()))
    keyed = high >> bits << bits | np.arange(len(high), dtype=np.uint64)
    keyed.sort()
    return (keyed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _starts(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where runs of equal fingerprints start."""
    return np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))


def _grams(highs: np.ndarray, lows: np.ndarray, begins: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, raw) of the n-grams, by their first bits; a fingerprint may stand in more than one row."""
    size = max(len(highs) - n + 1, 0)
    high, low = highs[:size], lows[:size]
    for k in range(1, n):
        high, low = high * HIGH + highs[k : k + size], low * LOW + lows[k : k + size]
    whole = np.ones(size, bool)
    for k in range(n - 1):  # those that start k words before a text's end
        cut = ends - k
        cut = cut[(cut >= begins) & (cut < size)]
        whole[cut] = False
    high, low = high[whole], low[whole]
    if not len(high):
        return high, low, np.zeros(0, np.uint32)
    order = _order(high)
    high, low = high[order], low[order]
    starts = _starts(high, low)
    return high[starts], low[starts], np.diff(np.append(starts, len(high))).astype(np.uint32)


def _dealt(orders: list[int], buckets: int, most: int):
    """A task's slices as rows (n, bucket, high, low, raw), with all n-grams of a slice that go to a bucket in one row."""
    width = -(-(1 << 64) // buckets)
    edges = np.array([k * width for k in range(1, buckets)], np.uint64)

    def rows(texts: pa.Array) -> Iterator[pa.RecordBatch]:
        marked = _marked(texts)
        for n in orders:
            columns = _grams(*marked, n)
            # rows are ordered by their first bits only, so buckets are told by what the bits say
            of = np.searchsorted(edges, columns[0], "right").astype(np.int32)
            if np.any(of[1:] < of[:-1]):
                again = np.argsort(of, kind="stable")
                of, columns = of[again], tuple(c[again] for c in columns)
            cuts = np.searchsorted(of, np.arange(buckets + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            few = max(1, len(full) * BATCH // (16 * len(of) + 1))
            for own in (full[i : i + few] for i in range(0, len(full), few)):
                bytes_of = [pa.array([c[cuts[b] : cuts[b + 1]].tobytes() for b in own], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n, np.int32)), pa.array(own.astype(np.int32)), *bytes_of], ["n", "bucket", "high", "low", "raw"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _slices(batches, most):
            yield from rows(texts)  # its arrays go before the next slice's are made
        pa.default_memory_pool().release_unused()

    return deal


def _left(limits: list[int]):
    """The n-grams of a bucket that are over their order's limit, and the sum of their counts."""

    def count(table: pa.Table) -> pa.Table:
        high, low, raw = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]]) for c, t in (("high", "<u8"), ("low", "<u4"), ("raw", "<u4")))
        n = table["n"][0].as_py()
        mixed = high * MIX
        order = _order(mixed)
        bits = np.uint64(max(1, (len(high) - 1).bit_length()))
        first = mixed[order] >> bits
        starts = _starts(high[order], low[order])
        if len(starts) > 1 + np.count_nonzero(first[1:] != first[:-1]):  # different ones with equal first bits may be mixed
            order = np.lexsort((low, high))
            starts = _starts(high[order], low[order])
        total = np.add.reduceat(raw[order].astype(np.int64), starts)
        total = total[total > limits[n - 1]]
        return pa.table({"n": pa.array([n], pa.int32()), "grams": [len(total)], "total": [int(total.sum())]})

    return count


def totals(texts: DataFrame, order: int, prune_from: int = 0, text: str = "text") -> DataFrame:
    """(n, grams, total): the n-grams of orders 1 to order that pruning leaves, and the sum of their counts.

    Words stand between single spaces or line ends, so two spaces have an empty word between them; an empty text is its two marks, a
    null one is none. The result is that of ``ngrams.prune`` over ``ngrams.ngram_counts``: single words all stay, and an
    order without n-grams has no row. It is stored, a row for each order.
    """
    held = texts.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    with cleaned(texts.sparkSession):
        size = held.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    buckets = -(-max(size, 1) // BUCKET)
    limits = [0, *thresholds(order, prune_from)[1:]]
    out = []
    for orders in [[n for n in (1, 2) if n <= order], *[[n] for n in range(3, order + 1)]]:
        dealt = held.mapInArrow(_dealt(orders, buckets, SLICE), "n int, bucket int, high binary, low binary, raw binary")
        left = dealt.repartitionById(buckets, F.col("bucket")).groupBy("n", "bucket").applyInArrow(_left(limits), "n int, grams long, total long")
        with settings(texts.sparkSession, ROWS):
            out.append(materialize(left.groupBy("n").agg(F.sum("grams").alias("grams"), F.sum("total").alias("total")).filter("grams > 0"), "totals"))
    return reduce(DataFrame.unionByName, out)
