"""Alignment of the tokens of two tokenizers by pointer jumping.

Both encode a space and the text. Every token points to the farthest-right token that overlaps its bytes:
itself, if none reaches farther, or for a token of the second tokenizer the one of the first that ends with it.
Successors are doubled for all tokens of a block at once until nothing changes; each token then points to the
terminal token of its component, which labels its group. Groups end where tokens of both end.

Neither tokenizer joins characters over a single space between others, so texts are cut there, and each
distinct part of a task is encoded and aligned once. Where the second vocabulary has a piece with a space
behind other characters, texts stay whole.

A pair of ids counts once for each document that holds it linked. Counts go to the tasks as sorted arrays while
they have at most ``max_pairs`` rows; beyond, they are joined, with the rows of frequent pairs spread over tasks.

Defined results: null and empty texts, and those whose tokens' bytes differ from a space and the text, have no
tokens: counts of 0 and an empty digest; very long texts are aligned whole; special tokens' strings are plain text;
rows with a null id are aligned like others; repeated rows get a row each and count as documents of their own;
ids that tie for the highest count are all best; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.batches import map_batches
from voxtable.llm.names import spread_join
from voxtable.llm.packing import Encoder
from voxtable.plans.storage import materialize

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_SPACE = "▁"
#: Bounds on what a task holds: distinct parts, the length of a part that is kept, and characters in a block.
_PARTS, _PART_LENGTH, _BLOCK = 300_000, 64, 1_000_000
#: Parts that are encoded in one call.
_CALL = 2_000


class Pair:
    """Both tokenizers, the bytes of their tokens, and the decimal forms of their ids."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str):
        import sentencepiece

        self.first = Encoder(ranks_path, pattern).encoding
        first = {i: b for b, i in self.first._mergeable_ranks.items()}
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes = [[first.get(i, b"") for i in range(max(first) + 1)], [bytes.fromhex(_BYTE.fullmatch(p)[1]) if self.second.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]]
        self.lengths = [np.array(list(map(len, table)), np.int64) for table in self.bytes]
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.size = len(pieces)
        #: Decimal ids with what follows them, inside a group and at its end.
        self.names = [b"%d%b" % (i, c) for table, ends in zip(self.bytes, (b",|", b",;")) for i in range(len(table)) for c in (ends[:1], ends[1:])]

    def encode(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for a space and each part, or None where the tokens' bytes are others. Parts that neither
        have a space at an end nor the second tokenizer's sign for one are encoded together."""
        if len(parts) == 1:
            a, b = self.first.encode_ordinary(" " + parts[0]), self.second.encode(parts[0])
            same = b"".join(map(self.bytes[0].__getitem__, a)) == b" " + parts[0].encode() == b"".join(map(self.bytes[1].__getitem__, b))
            return [(np.array(a, np.int64), np.array(b, np.int64)) if same else None]
        whole = self.encode([" ".join(parts)])[0]
        if whole is None:
            half = len(parts) // 2
            return self.encode(parts[:half]) + self.encode(parts[half:])
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        at = [np.concatenate([[0], np.searchsorted(np.cumsum(lengths[ids]), ends, "right")]).tolist() for ids, lengths in zip(whole, self.lengths)]
        return [(whole[0][a:b], whole[1][c:d]) for a, b, c, d in zip(at[0], at[0][1:], at[1], at[1][1:])]


def groups(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The group of every token, the first tokenizer's and then the second's; both end at the same byte."""
    n = len(a_end)
    over_a, over_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    own = np.arange(n)
    succ = np.concatenate([np.where(b_end[over_a] > a_end, n + over_a, own), over_b]) if n else own
    while True:
        farther = succ[succ]
        if np.array_equal(farther, succ):
            break
        succ = farther
    return np.unique(succ, return_inverse=True)[1]


class Parts:
    """Aligned parts by their strings: counts, digest text, and linked pairs of ids."""

    def __init__(self, pair: Pair):
        self.pair, self.place = pair, {}
        self.texts: list[bytes | None] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.links, self.link_at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, keys: list[str]) -> None:
        """Encode and align new parts; a key with a space before it is encoded by itself."""
        plain = [k for k in keys if k[:1] != " " and _SPACE not in k]
        odd = [k for k in keys if k[:1] == " " or _SPACE in k]
        found = [x for at in range(0, len(plain), _CALL) for x in self.pair.encode(plain[at : at + _CALL])] + [self.pair.encode([k.removeprefix(" ")])[0] for k in odd]
        first = len(self.texts)
        self.place.update(zip(plain + odd, range(first, first + len(keys))))
        n_a, n_b = (np.array([len(x[side]) if x else 0 for x in found], np.int64) for side in (0, 1))
        ids = [np.concatenate([np.zeros(0, np.int64), *[x[side] for x in found if x]]) for side in (0, 1)]
        a_end, b_end = (np.cumsum(self.pair.lengths[side][ids[side]]) for side in (0, 1))
        part_end = np.concatenate([[0], a_end])[np.cumsum(n_a)]
        label = groups(a_end, b_end)
        sides = np.repeat([0, 1], [len(a_end), len(b_end)])
        last = np.concatenate([np.isin(a_end, b_end), np.isin(b_end, a_end)])
        order = np.argsort(label * 2 + sides, kind="stable")
        names = list(map(self.pair.names.__getitem__, (2 * (np.concatenate(ids) + sides * len(self.pair.bytes[0])) + last)[order].tolist()))
        ends = np.union1d(a_end, b_end)
        links = ids[0][np.searchsorted(a_end, ends)] * self.pair.size + ids[1][np.searchsorted(b_end, ends)]
        link_at, group_at = np.searchsorted(ends, part_end, "right"), np.searchsorted(a_end[last[: len(a_end)]], part_end, "right")
        name_at = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        self.texts += [b"".join(names[i:j]) if x else None for x, i, j in zip(found, name_at, name_at[1:])]
        self.counts = np.concatenate([self.counts, np.column_stack([n_a, n_b, np.diff(group_at, prepend=0), np.diff(link_at, prepend=0)])])
        self.links, self.link_at = np.concatenate([self.links, links]), np.concatenate([self.link_at, self.link_at[-1] + link_at])

    def linked(self, kinds: np.ndarray) -> np.ndarray:
        """The pairs of the parts at these places, one part after another."""
        n = self.counts[kinds, 3]
        return self.links[np.repeat(self.link_at[kinds] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def align(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): the document's distinct linked pairs,
    as first id times the second vocabulary's size plus second id, and how often each is linked."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(ranks_path, pattern, pieces_path)
        known = Parts(pair)

        def cut(text: str) -> list[str]:
            """The keys of the text's parts; those with a space at an end get one before them."""
            if not pair.cuts:
                return [" " + text]
            parts = text.split(" ")
            if any(p[:1].isspace() or p[-1:].isspace() or not p for p in set(parts) if p not in known.place):
                parts = [" " + p if p[:1].isspace() or p[-1:].isspace() else p for p in _CUT.split(text)]
            return parts

        def block(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            nonlocal known
            if len(known.place) > _PARTS:
                known = Parts(pair)
            parts = [cut(t) if t else [] for t in texts]
            known.add(sorted(p for p in set().union(*parts) if p not in known.place))
            at = [list(map(known.place.__getitem__, p)) for p in parts]
            whole = [not p or None not in map(known.texts.__getitem__, p) for p in at]
            at = [p if ok else [] for p, ok in zip(at, whole)]
            digests = [hashlib.sha256(b"".join(map(known.texts.__getitem__, p))[:-1]).hexdigest() if p else "" for p in at]
            n = len(texts)
            doc = np.repeat(np.arange(n), list(map(len, at)))
            kept, times = np.unique(doc * len(known.texts) + np.array([k for p in at for k in p], np.int64), return_counts=True)
            doc, kinds = np.divmod(kept, max(len(known.texts), 1))
            counts = [np.bincount(doc, known.counts[kinds, k] * times, n).astype(np.int64) for k in range(4)]
            span = len(pair.bytes[0]) * pair.size
            kept, place = np.unique(np.repeat(doc, known.counts[kinds, 3]) * span + known.linked(kinds), return_inverse=True)
            times = np.bincount(place, np.repeat(times, known.counts[kinds, 3])).astype(np.int32)
            ends = pa.array(np.searchsorted(kept, np.arange(n + 1) * span), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (kept % span, times)]
            for key in [k for k in set().union(*parts) if len(k) > _PART_LENGTH]:  # they hardly come again
                known.texts[known.place.pop(key)] = b""
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, counts), pa.array(digests, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        for batch in batches:
            texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
            while at < len(texts):
                end, held = at + 1, len(texts[at])
                while end < len(texts) and held + len(texts[end]) <= _BLOCK:
                    held += len(texts[end])
                    end += 1
                yield block(batch.column(0).slice(at, end - at), texts[at:end])
                at = end

    return map_batches(source, run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """Rows (pair, n, best): the documents that hold the pair linked, and whether no pair of its first id has more."""
    counts = materialize(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair_counts")
    first = F.floor(F.col("pair") / second_size)
    most = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    # at most a row for each id of the first vocabulary
    return counts.withColumn("first", first).join(F.broadcast(most), "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_digests(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, max_pairs: int = 4_000_000) -> DataFrame:
    """For each row of docs: counts of tokens, groups and links, the links whose pair is a best one of its first id,
    the sum of the links' counts, and the digest of the groups."""
    import sentencepiece

    spark = docs.sparkSession
    size = sentencepiece.SentencePieceProcessor(model_file=pieces_path).get_piece_size()
    rows = materialize(align(docs, ranks_path, pattern, pieces_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(rows, size), "counts")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if counts.count() > max_pairs:
        linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times").withColumnRenamed("pairs", "pair")
        met = spread_join(linked, counts, ["pair"], "row").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        return rows.join(met, "row", "left").select(*columns, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    held = counts.toArrow()  # at most max_pairs rows of three numbers
    order = np.argsort(pairs := held["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((pairs[order], held["n"].to_numpy()[order], held["best"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            linked, times = batch.column(5), batch.column(6)
            times, at = times.flatten().to_numpy(), np.searchsorted(pairs, linked.flatten().to_numpy())
            ends = np.cumsum(linked.value_lengths().to_numpy())
            totals = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (times * best[at], times * n[at])] if len(at) else [np.zeros(len(ends), np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(5)], *[pa.array(x, pa.int64()) for x in totals], batch.column(7)], [*columns, "n_best", "count_sum", "groups_sha256"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows.select(*columns, "pairs", "times", "groups_sha256"), run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
