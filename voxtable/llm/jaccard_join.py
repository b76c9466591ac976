"""N-gram Jaccard self-join of documents by a MinHash LSH forest with exact verification.

1. Every document gets the set of its word five-grams, a hash of that set and a MinHash signature.
   Documents with equal sets are one text; only one copy of each text goes on.
2. The signature is cut into the labels of several prefix trees (tries). Rows (tree, label) whose prefix
   at the least useful depth is theirs alone have no partner and leave first. What is left is searched
   from the full label upwards. At each depth the rows of a trie node, in the order of their labels,
   are tied where their signatures agree nearly enough. Only nodes that hold several groups of tied texts
   are looked at again. In the end tied texts form candidate groups, by connected components.
3. After each depth a text is done when the chance that a partner at the threshold has met it, or one of
   its group, reaches the target recall. Groups of many variants occupy many nodes and are done at long
   prefixes; the prefixes of the others are shortened further, until none is left.
4. All pairs of a group are compared exactly, by counting common five-grams. Groups and nodes of any
   size are cut into tiles (pairs of blocks of bounded size), so no task holds a whole hot group and
   no pair becomes a row: a tile returns one row for each of its texts. As every link is counted, a group
   of n different texts takes n * n / 2 comparisons.

Defined results: documents without words (null and empty texts) have no links and are classes of
their own; a text of one to four words has one gram, the whole text; very long texts count whole; repeated
rows count as copies; of equal ids or ties the least comes first; rows with a null id are compared like
others and come last among the ids of a class; an empty table gives no rows; other columns, whatever
their names, are ignored (jaccard_classes) or kept (keep_one).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.batches import map_batches
from voxtable.llm.names import broadcast_if_small, fresh
from voxtable.operators.graphs import connected_components
from voxtable.plans.storage import materialize

WORD = re.compile(r"\w+")
TREES, DEPTH, STEP = 16, 8, 2
#: Texts, and grams, in a block of a tile.
BLOCK, BLOCK_GRAMS = 512, 1 << 19
#: Candidate ids that may be broadcast; beyond it the texts are fetched by a shuffled join.
BROADCAST_ROWS = 500_000
_CACHE_ENTRIES = 150_000
_M = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams, and MinHash signatures of them."""

    def __init__(self, n: int = 5, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        self.n, self.cache = n, {}
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, trees * depth, dtype=np.uint64)

    def grams(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > _CACHE_ENTRIES:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * _M + h[k : len(h) - n + 1 + k]
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 2**64 - 1, np.uint64)
        for at in range(0, len(grams), 1024):
            np.minimum(least, (grams[at : at + 1024, None] * self.a + self.b).min(axis=0), out=least)
        return (least >> np.uint64(32)).astype(">u4")


def recall_at(depth: int, threshold: float, nodes: int = TREES, others: int = 0, slack: float = 0.2) -> float:
    """The chance to meet a partner at the threshold in one of ``nodes`` trie nodes at a depth, or in one of
    ``others`` nodes that texts like it are in; those may be less like the partner, by ``slack``."""
    return 1 - (1 - threshold**depth) ** nodes * (1 - max(threshold - slack, 0.0) ** depth) ** others


def least_depth(threshold: float, recall: float) -> int:
    """The depth to which the prefix of a text without a group has to be shortened."""
    return max((d for d in range(1, DEPTH + 1) if recall_at(d, threshold) >= recall), default=1)


def row_key(id_col: str, text_col: str) -> Column:
    """What tells a row from rows with another id or text."""
    return F.xxhash64(id_col, text_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """doc_id, key (of the row's id and text), set_hash (null without words), n_grams, signature (big-endian
    unsigned 32-bit values)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            sets, sizes, signatures = [], [], []
            for text in batch.column(1):
                grams = shingler.grams(text.as_py())
                sizes.append(len(grams))
                sets.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                signatures.append(shingler.signature(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())], ["doc_id", "key", "set_hash", "n_grams", "signature"])

    return map_batches(source, run, f"doc_id {id_type}, key long, set_hash binary, n_grams int, signature binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first ``keys`` columns, across batches, from rows sorted by them."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if held:
                    yield held
                key, held = row[:keys], []
            held.append(row)
    if held:
        yield held


def _roots(names: list[bytes], near: np.ndarray) -> list[int]:
    """Index of the least name that each row is tied to, directly or through others."""
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        a, b = find(i), find(j)
        if a != b:
            a, b = (a, b) if names[a] <= names[b] else (b, a)
            root[b] = a
    return [find(i) for i in range(len(names))]


def _tiled(rows: DataFrame, blocks: Column, member: str) -> DataFrame:
    """Give each member of a group the tiles that it belongs to: pairs (ti, tj) of the group's blocks."""
    return (
        rows.withColumn("blocks", F.greatest(F.ceil(blocks).cast("int"), F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")})
        .drop("other", "blocks")
    )


def _ties(tiles: DataFrame, least_agreement: float) -> DataFrame:
    """Edges (src, dst) between texts of a node whose signatures agree in enough places. tiles: node, ti, tj,
    label, set_hash, sketch. Rows of a tile come in the order of their labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src: list[bytes] = []
        dst: list[bytes] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], ["src", "dst"])

        for rows in _groups(batches, 3):
            names = [r[4] for r in rows]
            bytes_ = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
            near = np.zeros((len(rows), len(rows)), bool)
            for i in range(len(rows) - 1):
                near[i, i + 1 :] = (bytes_[i + 1 :] == bytes_[i]).mean(axis=1) >= least_agreement
            for i, r in enumerate(_roots(names, near)):
                if r != i:
                    src.append(names[i])
                    dst.append(names[r])
            if len(src) > 50_000:
                yield made()
                src, dst = [], []
        yield made()

    key = ["node", "ti", "tj"]
    return map_batches(tiles.select(*key, "label", "set_hash", "sketch").repartition(*key).sortWithinPartitions(*key, "label"), run, "src binary, dst binary")


def candidate_groups(texts: DataFrame, threshold: float, recall: float, least_agreement: float) -> DataFrame:
    """(set_hash, component) of the texts that may have a partner at the threshold.

    texts: set_hash, signature. least_agreement lies well under the threshold: the share of equal
    places has a standard deviation of about 0.035 at the threshold.
    """
    width, floor = 4 * DEPTH, least_depth(threshold, recall)
    node = lambda depth: F.xxhash64("tree", F.substring("label", 1, 4 * depth))
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = texts.select("set_hash", "signature", tree.alias("tree")).select("set_hash", "tree", F.substring("signature", F.col("tree") * width + 1, F.lit(width)).alias("label"))
    # rows that share their shortest useful prefix with another text
    shared = rows.groupBy(node(floor).alias("node")).agg(F.count("*").alias("members")).filter("members > 1").select("node")
    tries = materialize(rows.withColumn("node", node(floor)).join(shared, "node").drop("node"), "tries")
    # the low byte of each of the 128 values is enough to estimate agreement
    low = F.unhex(F.regexp_replace(F.hex("signature"), "......(..)", "$1"))
    sketches = materialize(texts.join(tries.select("set_hash").distinct(), "set_hash", "left_semi").select("set_hash", low.alias("sketch")), "sketches")
    ties, group, done = None, None, None
    for depth in sorted({floor, *range(DEPTH, floor, -STEP)}, reverse=True):
        active = tries.select("set_hash", "label", node(depth).alias("node"), F.col("set_hash").alias("root"))
        if group is not None:
            active = active.drop("root").join(group, "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))
            active = active.join(broadcast_if_small(done, BROADCAST_ROWS), "root", "left_anti")
        # nodes with several groups; of nodes with the same members one is enough
        nodes = active.groupBy("node").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("set_hash")).alias("who"), F.min("set_hash").alias("first"), F.min("root").alias("a"), F.max("root").alias("b"))
        nodes = materialize(nodes.filter("members > 1 and a <> b").groupBy("members", "who", "first").agg(F.min("node").alias("node")).select("node", "members"), "nodes")
        met = active.join(broadcast_if_small(nodes, BROADCAST_ROWS), "node").join(sketches, "set_hash").select("node", "members", "label", "set_hash", "sketch")
        new = materialize(_ties(_tiled(met, F.col("members") / BLOCK, "set_hash"), least_agreement), "ties")
        ties = new if ties is None else ties.unionByName(new)
        if depth > floor:
            # texts tied to the same least text are a group for now; their distinct nodes, beyond those that any
            # text has, are further chances to be met
            group = materialize(ties.groupBy(F.col("src").alias("set_hash")).agg(F.min("dst").alias("root")), "groups")
            places = tries.select("set_hash", node(depth).alias("node")).join(group, "set_hash").select("root", "node").distinct().groupBy("root").agg(F.count("*").alias("nodes"))
            missed = F.lit(1 - recall_at(depth, threshold)) * F.pow(F.lit(1 - max(threshold - 0.2, 0.0) ** depth), F.greatest(F.col("nodes") - TREES, F.lit(0)))
            done = materialize(places.filter(1 - missed >= recall).select("root"), "done")
    return connected_components(ties, "src", "dst").select(F.col("node").alias("set_hash"), "component")


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Symmetric matrix of the pairs with Jaccard similarity of threshold or more, found exactly."""
    sizes = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    return common >= threshold * (sizes[:, None] + sizes - common) - 1e-9


def verified_links(docs: DataFrame, groups: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """Rows (set_hash, root, text_links, doc_links) for the texts of each tile of each candidate group.

    groups (stored): key, set_hash, copies, component, blocks. The texts come from docs by the row's key.
    """
    source = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    wanted = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    texts = source.join(wanted, "key").select("component", "blocks", "set_hash", "copies", "text")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            sets = [shingler.grams(text.as_py()).tobytes() for text in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], ["component", "blocks", "set_hash", "copies", "grams"])

    sets = map_batches(texts, load, "component binary, blocks double, set_hash binary, copies long, grams binary")
    tiles = _tiled(sets, F.col("blocks"), "set_hash").select("component", "ti", "tj", "set_hash", "block", "copies", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            one = {r[3]: r for r in rows}  # a repeated row carries the same text
            rows = list(one.values())
            if len(rows) < 2:
                continue
            near = similar([np.frombuffer(r[6], np.uint64) for r in rows], threshold)
            np.fill_diagonal(near, False)
            block = np.array([r[4] for r in rows])
            if rows[0][1] != rows[0][2]:  # pairs within a block belong to the tile of that block
                near &= block[:, None] != block
            names = [r[3] for r in rows]
            root = _roots(names, near)
            copies = np.array([r[5] for r in rows], np.int64)
            hit = np.flatnonzero(near.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in hit], pa.binary()), pa.array([names[root[i]] for i in hit], pa.binary()), pa.array(near.sum(axis=1)[hit], pa.int64()), pa.array((near @ copies)[hit], pa.int64())],
                ["set_hash", "root", "text_links", "doc_links"],
            )

    key = ["component", "ti", "tj"]
    return map_batches(tiles.repartition(*key).sortWithinPartitions(*key), run, "set_hash binary, root binary, text_links long, doc_links long")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), n_links (other documents at the
    threshold or above, copies included), n_text_links (other texts at the threshold or above), key (of
    its id and text) and first_key (the key of the row that comes first in its class, null without words)."""
    prints = materialize(fingerprints(docs, id_col, text_col, n), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    texts = prints.filter("set_hash is not null").groupBy("set_hash").agg(least.alias("first"), F.count("*").alias("copies"), F.min("signature").alias("signature"), F.min("n_grams").alias("n_grams"))
    texts = materialize(texts, "texts")
    groups = candidate_groups(texts.select("set_hash", "signature"), threshold, recall, threshold - 0.17)
    held = materialize(texts.drop("signature").join(groups, "set_hash"), "grouped")
    # groups of several blocks: they have BLOCK texts or long ones, so there are few of them
    sizes = held.groupBy("component").agg(F.greatest(F.count("*") / BLOCK, F.sum("n_grams") / BLOCK_GRAMS).alias("blocks")).filter("blocks > 1")
    sizes = broadcast_if_small(materialize(sizes, "sizes"), BROADCAST_ROWS)
    wanted = held.join(sizes, "component", "left").select(F.col("first.key").alias("key"), "set_hash", "copies", "component", F.coalesce("blocks", F.lit(1.0)).alias("blocks"))
    links = materialize(verified_links(docs, materialize(wanted, "wanted"), threshold, id_col, text_col, n), "links")
    roots = connected_components(links, "set_hash", "root").select(F.col("node").alias("set_hash"), F.col("component").alias("root"))
    counts = links.groupBy("set_hash").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    rooted = texts.select("set_hash", "first", "copies").join(roots, "set_hash", "left").join(counts, "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("first_of_class"))
    per_text = rooted.join(classes, "root").select("set_hash", "first_of_class", "copies", "text_links", "doc_links")
    return prints.select("doc_id", "key", "set_hash").join(per_text, "set_hash", "left").select(
        "doc_id",
        F.coalesce("first_of_class.doc_id", "doc_id").alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("doc_links", F.lit(0))).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
        "key",
        F.col("first_of_class.key").alias("first_key"),
    )


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, with one row of each class; rows without words all stay.

    classes (stored) is the result of jaccard_classes. Rows are told apart by id and text, so repeated and
    null ids with other texts are no harm; of rows with the same id and text one stays.
    """
    key, mark = fresh(docs.columns, "key"), row_key(id_col, text_col)
    dropped = materialize(classes.filter("first_key <> key").select(F.col("key").alias(key)).distinct(), "dropped")
    right = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    kept = docs.join(right, mark == F.col(key), "left_anti")
    repeated = classes.filter("first_key = key").groupBy("key").count().filter("count > 1").select(F.col("key").alias(key))
    repeated = materialize(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, mark == F.col(key), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, mark == F.col(key), "left_anti").unionByName(once)
