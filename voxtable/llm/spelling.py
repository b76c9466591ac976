"""Spelling variants: words that a single edit turns into a much more frequent word.

A single edit leaves a word's first half or its last half as it is, so near words share a block: the length of
the shorter one, a half, and that half's characters. Blocks with more words than a tile are dealt to tiles by a
hash, and each pair of tiles is a cell of its own. Inside cells, padded matrices of code points are compared
tile by tile: common prefix and common suffix, counted for all pairs of two tiles at once, reach the longer
length less one exactly where one edit lies between two words. Only each word's number of near words and its
best one leave a cell.

Defined results: null and empty texts have no words; very long texts and words are taken whole; a null id counts
as an empty string in the hash; repeated rows count again; of near words with the same count the first in
code-point order is the form; words of the same count are no form of each other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.batches import map_batches
from voxtable.llm.names import spread_join
from voxtable.plans.storage import forget, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
#: Words of a tile that Spark deals out, words of a tile that numpy compares at once, and code points of a task's matrix.
_TILE, _DENSE, _HELD = 1_024, 128, 2_000_000
_CELL = ["short", "half", "part", "i", "j"]


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word, n): runs of letters, one in ``every`` documents and runs losing a character by their hash."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_length)
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % every == 0, less).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _blocks(words: DataFrame) -> DataFrame:
    """Each word in the blocks of both halves, as the shorter or equal one and as the longer one."""
    length = F.length("word")

    def halves(short: Column) -> list[Column]:
        half = F.floor(short / 2).cast("int")
        return [F.struct(short.cast("int").alias("short"), F.lit(k).alias("half"), part.alias("part")) for k, part in enumerate((F.substring(F.col("word"), F.lit(1), half), F.right(F.col("word"), short - half)))]

    return words.select("word", "n", F.explode(F.array(*halves(length), *halves(length - 1))).alias("x")).filter("x.short > 0").select("word", "n", "x.*")


def _cells(words: DataFrame, tile: int) -> DataFrame:
    """Blocks as cells of at most about two tiles: (short, half, part, i, j) with each word's tile."""
    blocks = _blocks(words)
    large = blocks.groupBy("short", "half", "part").agg(F.count("*").alias("size")).filter(F.col("size") > tile)
    large = large.select(*[F.col(c).alias(f"large_{c}") for c in _CELL[:3]], F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
    met = blocks.join(large, [F.col(c) == F.col(f"large_{c}") for c in _CELL[:3]], "left")
    met = met.withColumn("tile", F.when(F.col("tiles").isNotNull(), F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")).otherwise(0))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda u: F.struct(F.least("tile", u).alias("i"), F.greatest("tile", u).alias("j")))
    return met.select(*_CELL[:3], F.explode(pairs).alias("x"), "tile", "word", "n").select(*_CELL[:3], "x.i", "x.j", "tile", "word", "n")


def _matrices(words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points plus one, padded with 0 behind the words and before them."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4") + 1
    kind = np.uint16 if codes.max(initial=0) < 1 << 16 else np.uint32
    row, width = np.repeat(np.arange(len(words)), lengths), int(lengths.max(initial=0))
    col = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = (np.zeros((width, len(words)), kind) for _ in (0, 1))
    left[col, row] = codes
    right[np.repeat(lengths, lengths) - 1 - col, row] = codes
    return left, right


def near_pairs(words: list[str], cell: np.ndarray, tile: np.ndarray, cross: np.ndarray, short: np.ndarray, last_half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of words of one cell with one edit between them, each pair once. ``cell`` doesn't fall; a cell
    that crosses two tiles compares words of different tiles; pairs with the same first half aren't met behind the last."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    left, right = _matrices(words, lengths)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]

    def common(matrix: np.ndarray, x: slice, y: slice, asked: np.ndarray) -> np.ndarray:
        run, n = asked.copy(), np.zeros(asked.shape, np.int32)
        for line in matrix:
            run &= line[x, None] == line[None, y]
            if not run.any():
                break
            n += run
        return n

    for a in range(0, len(words), _DENSE):
        x = slice(a, min(a + _DENSE, len(words)))
        for b in range(a, len(words), _DENSE):
            if cell[b] > cell[x.stop - 1]:
                break
            y = slice(b, min(b + _DENSE, len(words)))
            asked = (cell[x, None] == cell[None, y]) & (np.arange(x.start, x.stop)[:, None] < np.arange(y.start, y.stop)) & (~cross[x, None] | (tile[x, None] != tile[None, y]))
            asked &= np.minimum(lengths[x, None], lengths[None, y]) == short[x, None]
            if not asked.any():
                continue
            prefix = common(left, x, y, asked)
            near = asked & (prefix + common(right, x, y, asked) >= np.maximum(lengths[x, None], lengths[None, y]) - 1)
            near &= ~last_half[x, None] | (prefix < short[x, None] // 2)
            i, j = np.nonzero(near)
            found.append((i + a, j + b))
    return tuple(map(np.concatenate, zip(*found)))


def near_words(words: DataFrame, tile: int = _TILE) -> DataFrame:
    """Rows (word, n_near, best): for each word (word, n) with near words their number, and the one of largest n."""
    # a few hundred thousand code points to a task, whatever a cell's size
    cells = _cells(words, tile)
    dealt = cells.repartition(*[F.col(c) for c in _CELL]).sortWithinPartitions(*_CELL)

    def summed(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in _CELL]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0) if len(rows) else []
        texts, n = rows["word"].to_pylist(), rows["n"].to_numpy()
        whole = [rows[c].to_numpy() for c in ("tile", "short", "half", "i", "j")]
        a, b = near_pairs(texts, np.cumsum(np.concatenate([[0], new])).astype(np.int64)[: len(rows)], whole[0], whole[3] != whole[4], whole[1], whole[2] == 1)
        known = {w: k for k, w in enumerate(sorted(set(texts)))}
        place, names = np.fromiter(map(known.__getitem__, texts), np.int64, len(texts)), list(known)
        word, other, count = np.concatenate([place[a], place[b]]), np.concatenate([place[b], place[a]]), np.concatenate([n[b], n[a]])
        order = np.lexsort((other, -count, word))
        word, other, count = word[order], other[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in word[first]], pa.string()), pa.array(np.diff(np.append(first, len(word))), pa.int64()), pa.array(count[first], pa.int64()), pa.array([names[k] for k in other[first]], pa.string())], ["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch) * (batch["short"][-1].as_py() + 1)
            if size < _HELD:
                continue
            rows = pa.Table.from_batches(held)
            last = rows.slice(len(rows) - 1).select(_CELL).to_pylist()[0]
            same = np.all([rows[c].to_numpy(zero_copy_only=False) == last[c] for c in _CELL], axis=0)
            open_from = len(rows) - int(same.sum())
            if open_from:  # the last cell may go on
                yield summed(rows.slice(0, open_from))
                held = rows.slice(open_from).combine_chunks().to_batches()
                size = (len(rows) - open_from) * (last["short"] + 1)
        yield summed(pa.Table.from_batches(held)) if held else summed(pa.table({c: pa.array([], pa.string() if c in ("part", "word") else pa.int64()) for c in [*_CELL, "tile", "word", "n"]}))

    near = map_batches(dealt, run, "word string, n_near long, best_n long, best string")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last by doubling; counts rise along them, so they end."""
    jump = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = materialize(spread_join(jump, onward, ["root"], "word").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(jump)
        jump = farther
        if jump.filter("moved").isEmpty():
            return jump.select("word", "root")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199, tile: int = _TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs."""
    words = materialize(word_counts(docs, least_length, least_count, every), "words")
    near = near_words(words, tile)
    held = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = materialize(held.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")), "variants")
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """DuckDB SQL: the hash by half bytes, near words by patterns with one character out."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return f"""
WITH run AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
coded AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM run),
hashed AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(x), 2), lambda i: [CAST(strpos('0123456789ABCDEF', x[i]) * 16 - 17 + strpos('0123456789ABCDEF', x[i + 1]) AS BIGINT), 0]))),
    lambda c, b: xor(xor(c, b) >> 4, ({table})[(xor(c, b) & 15) + 1])), 4294967295) AS h FROM coded),
word AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, word[:i - 1] AS a, word[i + 1:] AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y USING (i, a, b) WHERE x.word <> y.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN word w ON w.word = c.a || c.b UNION SELECT w.word, c.word, c.n FROM cut c JOIN word w ON w.word = c.a || c.b),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
form AS (SELECT b.word, min(o.other) AS form, any_value(b.most) AS form_n FROM best b JOIN word w USING (word) JOIN near o ON o.word = b.word AND o.n = b.most WHERE b.most >= 5 * w.n GROUP BY b.word),
step(word, root) AS (SELECT word, form FROM form),
chain AS (SELECT * FROM (WITH RECURSIVE walk(word, root, depth) AS (SELECT word, root, 0 FROM step UNION ALL SELECT k.word, s.root, depth + 1 FROM walk k JOIN step s ON s.word = k.root) SELECT word, arg_max(root, depth) AS root FROM walk GROUP BY word))
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM word w LEFT JOIN best USING (word) LEFT JOIN form USING (word) LEFT JOIN chain USING (word)
"""
