"""Edit-aware token counts: a stored segment tree of pre-token counts for each document.

A text is cut at the spaces where the tokenizer always starts a pre-token. Runs of such chunks are
the leaves of a binary tree whose nodes hold sums of characters and tokens. build_trees makes the trees
once, as a table with each text and its leaves' sums, from which a tree is put together without encoding.
edit_trees reads that table: an edit goes down the tree to the leaves that it touches; those are encoded
again together with a neighbour where the edit took away the safe cut between them, and only the sums
above them are renewed. Its result is a table of trees again, for the next edits.

Defined results: null text counts as empty; places beyond the text's end are moved to its end;
edits apply to the text at once, where one that begins inside another starts at that one's end, and of
edits at the same place the shorter comes first; null edits are no edits; the special token's string counts
as that token, as in packing; very long texts are trees of more leaves; rows with a null id are counted
like others; repeated rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.batches import map_batches
from voxtable.llm.packing import SPECIAL, Encoder
from voxtable.plans.storage import materialize

#: Places before a space where a pre-token always starts: one of the space's neighbours isn't white space. A
#: space before the special token belongs to the white space before it.
_CUT = re.compile(r"(?<=\S)(?= )|(?= (?!" + re.escape(SPECIAL) + r")\S)")
LEAF_CHUNKS = 64


class SegmentTree:
    """Leaves of consecutive text with sums of characters and tokens above them."""

    def __init__(self, text: str, count: Callable[[str], int], chars: list[int] | None = None, tokens: list[int] | None = None):
        self.count = count
        if chars is None or tokens is None:
            chunks = [c for c in _CUT.split(text) if c]
            self.leaves = ["".join(chunks[i : i + LEAF_CHUNKS]) for i in range(0, len(chunks), LEAF_CHUNKS)] or [""]
            tokens = [count(leaf) if leaf else 0 for leaf in self.leaves]
        else:
            ends = [0, *accumulate(chars)]
            self.leaves = [text[i:j] for i, j in zip(ends, ends[1:])]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        self.chars[self.size : self.size + len(self.leaves)] = map(len, self.leaves)
        self.tokens[self.size : self.size + len(self.leaves)] = tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.reencoded = 0

    def stored(self) -> tuple[str, list[int], list[int]]:
        """The text, and its leaves' characters and tokens."""
        n = len(self.leaves)
        return "".join(self.leaves), self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end), and the place in it."""
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.size, at

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        self.chars[node] = len(text)
        self.tokens[node] = self.count(text) if text else 0
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _near(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.leaves) and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.leaves) else None

    @staticmethod
    def _safe(left: str, right: str) -> bool:
        """Whether a pre-token always starts between two texts that aren't empty."""
        return right[0] == " " and (not left[-1].isspace() or (len(right) > 1 and not right[1].isspace() and not right.startswith(SPECIAL, 1)))

    def replace(self, start: int, end: int, text: str) -> None:
        """Replace the characters [start, end) of the current text."""
        first, at = self._leaf(start)
        last, to = self._leaf(max(end - 1, start))
        tail = self.leaves[last][to + (end > start) :]
        new = self.leaves[first][:at] + text + tail
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, "")
        while new and (right := self._near(last, 1)) is not None and not (self._safe(new, self.leaves[right]) and len(self.leaves[right]) > 1):
            new += self.leaves[right]
            self._set(right, "")
        while new and (left := self._near(first, -1)) is not None and not (self._safe(self.leaves[left], new) and len(new) > 1):
            new = self.leaves[left] + new
            self._set(first, "")
            first = left
        if not new and (left := self._near(first, -1)) is not None and (right := self._near(last, 1)) is not None and not (self._safe(self.leaves[left], self.leaves[right]) and len(self.leaves[right]) > 1):
            self._set(first, "")
            self.replace(self._start(right), self._start(right), "")
            return
        self.reencoded += len(new)
        self._set(first, new)

    def _start(self, leaf: int) -> int:
        return sum(map(len, self.leaves[:leaf]))


def apart(edits: list[dict], length: int) -> list[tuple[int, int, str]]:
    """Edits in order, inside the text and without overlaps."""
    out, reached = [], 0
    for e in sorted(edits, key=lambda e: (e["start"] or 0, e["end"] or 0)):
        start = min(max(e["start"] or 0, reached, 0), length)
        end = min(max(e["end"] or 0, start), length)
        out.append((start, end, e["replacement"] or ""))
        reached = end
    return out


TREE = "text string, chars array<int>, tokens array<int>"


def _counter(ranks_path: str, pattern: str) -> Callable[[str], int]:
    encoder = Encoder(ranks_path, pattern)
    return lambda part: len(encoder.encode(part)) // 4


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, chars, tokens): each text with its leaves' characters and tokens; to be stored for edits."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(ranks_path, pattern)
        for batch in batches:
            made = [SegmentTree(text.as_py() or "", count).stored() for text in batch.column(1)]
            columns = list(zip(*made)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.int32()))], ["doc_id", "text", "chars", "tokens"])

    return map_batches(source, run, f"doc_id {id_type}, {TREE}")


def edit_trees(trees: DataFrame, ranks_path: str, pattern: str, edits: Column | str = "edits") -> DataFrame:
    """Trees (doc_id, text, chars, tokens) after their edits, with n_tokens before them, n_tokens_edited, n_edits
    and n_reencoded (characters encoded again).

    edits: array<struct<start, end, replacement>> in code points of the tree's text, end exclusive.
    """
    source = trees.select("doc_id", "text", "chars", "tokens", (F.col(edits) if isinstance(edits, str) else edits).alias("edits"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    names = ["n_tokens", "n_tokens_edited", "n_edits", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text, chars, tokens, given in zip(*(batch.column(i) for i in range(1, 5))):
                text, given = text.as_py(), [e for e in given.as_py() or [] if e]
                tree = SegmentTree(text, count, chars.as_py(), tokens.as_py())
                before = tree.total
                for start, end, new in reversed(apart(given, len(text))):
                    tree.replace(start, end, new)
                rows.append((*tree.stored(), before, tree.total, len(given), tree.reencoded))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "text", "chars", "tokens", *names])

    return map_batches(source, run, f"doc_id {id_type}, {TREE}, " + ", ".join(f"{n} long" for n in names))


def edit_counts(docs: DataFrame, ranks_path: str, pattern: str, edits: Callable[[str, str], Column] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_edits and n_reencoded of documents whose trees are built, stored and
    edited once; edits(id column, text column) gives each document's edits."""
    trees = materialize(build_trees(docs, ranks_path, pattern), "trees")
    return edit_trees(trees, ranks_path, pattern, (edits or spread_edits)("doc_id", "text")).select("doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_reencoded")


def spread_edits(id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> Column:
    """n edits per document at places that follow from its id: up to 12 characters give way to a marker."""
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    def edit(k: int) -> Column:
        start = F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), size + 1).cast("int")
        return F.struct(start.alias("start"), F.least(start + 4 * (k + 1), size).cast("int").alias("end"), F.lit(f" edit {k}" if k else "").alias("replacement"))

    return F.array(*map(edit, range(n)))
