"""Best-fit packing of tokenised documents into fixed-length sequences.

The plan is made over the histogram of piece lengths (at most ``capacity`` counts), never over
documents. Best-fit decreasing on counts yields runs of equal sequences; a run says that the pieces
of one length with ranks in [rank_from, rank_to) go to consecutive sequences at one offset. Pieces
take their slots by joining on their rank within their length.

Defined results: null text counts as empty; an empty text is one piece holding the end token alone;
repeated rows are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.llm.batches import map_batches
from voxtable.plans.storage import materialize

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: Salts that stored pieces take by their place, more than any number of buckets that they are dealt to.
SALTS = 1 << 30


class Encoder:
    """Ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

    ranks_path holds the vocabulary of the tokenizer file as ranks, which are its ids, and pattern cuts
    pre-tokens. The special token's string stands for its id, as it does by default in the tokenizer file.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:  # a vocabulary file that every node has
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        parts = [np.asarray(self.encoding.encode_ordinary(part), dtype="<u4").tobytes() for part in text.split(SPECIAL)]
        return np.asarray([SPECIAL_ID], dtype="<u4").tobytes().join(parts)


def tokenize_pieces(
    docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit bytes.

    A document longer than ``capacity`` is cut into full pieces behind a first piece that takes the
    remainder; others stay whole. ranks_path must exist on every node.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        for batch in batches:
            rows: list[int] = []
            cols: tuple[list, list, list, list] = ([], [], [], [])
            held = 0

            def flush():
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

            for row, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                at = 0
                for piece in range((n + capacity - 1) // capacity):
                    size = (n - 1) % capacity + 1 if piece == 0 else capacity
                    rows.append(row)
                    for col, value in zip(cols, (piece, at, size, ids[4 * at : 4 * (at + size)])):
                        col.append(value)
                    at += size
                held += len(ids)
                if held > 8_000_000:
                    yield flush()
                    rows, cols, held = [], ([], [], [], []), 0
            if rows:
                yield flush()

    return map_batches(source, pieces, f"doc_id {id_type}, piece int, start long, length long, ids binary")


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank_from, rank_to, first_sequence, offset) runs.

    Sequences with the same contents so far are one group (count, room left); a length goes to the
    group with the least sufficient room, as many per sequence as fit, which is what best-fit does
    piece by piece. Work and result depend on the number of distinct lengths, not on the pieces.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, how many)]
    runs, next_sequence = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit into {capacity}")
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                room = capacity
                per = room // length
                first, many = next_sequence, max(1, left // per)
                next_sequence += many
            else:
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room]
            per = min(room // length, left)
            use = min(many, left // per)
            if use < many:
                groups[room].append((first + use, many - use))
            for k in range(per):
                runs.append((length, rank, rank + use, first, capacity - room + k * length))
                rank += use
            left -= per * use
            if room - per * length:
                groups[room - per * length].append((first, use))
    return runs


def pack(pieces: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length", salt_col: str | None = None) -> DataFrame:
    """Add sequence_id and offset to every row of ``pieces`` (any table with a length column).

    ``pieces`` is read twice, so it should be a stored table. The histogram has at most ``capacity``
    rows and the plan a few thousand: both are bounded by capacity, whatever the number of pieces.
    Ranks are dealt by (length, bucket), so that a length with most of the rows spreads over tasks, and equal
    rows do too where ``salt_col`` names a stored column that isn't made from the content (see salted).
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(F.col(length_col).cast("long")).count().collect()}
    runs = plan_runs(histogram, capacity)
    total = sum(histogram.values())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, total // 200_000 + 1)
    by = F.col(salt_col) if salt_col else F.xxhash64(*pieces.columns)
    bucketed = pieces.withColumn("_bucket", F.pmod(by, F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(length_col, "_bucket").count()
    before = Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(length_col).alias("_length"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inner = Window.partitionBy(length_col, "_bucket").orderBy(*order)
    ranked = (
        bucketed.withColumn("_rank", F.row_number().over(inner) - 1)
        .join(starts, (F.col(length_col) == F.col("_length")) & (F.col("_bucket") == F.col("_at")))
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .drop("_length", "_at", "_before", "_bucket")
    )
    schema = "length long, runs array<struct<rank_from: long, rank_to: long, first: long, at: long>>"
    by_length: dict[int, list] = defaultdict(list)
    for length, *run in runs:
        by_length[length].append(tuple(run))
    plan = spark.createDataFrame([(k, sorted(v)) for k, v in by_length.items()] or [], schema)
    slots = F.broadcast(plan.select(F.col("length").alias("_length"), "runs"))
    slot = F.filter("runs", lambda r: (r["rank_from"] <= F.col("_rank")) & (F.col("_rank") < r["rank_to"]))[0]
    return (
        ranked.join(slots, F.col(length_col).cast("long") == F.col("_length"))
        .withColumn("_slot", slot)
        .withColumns({"sequence_id": F.col("_slot.first") + F.col("_rank") - F.col("_slot.rank_from"), "offset": F.col("_slot.at")})
        .drop("_slot", "_rank", "_length", "runs")
    )


def salted(pieces: DataFrame, name: str = "_salt") -> DataFrame:
    """pieces with a number below SALTS by each row's place among them, to be stored with them."""
    return pieces.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack documents: pieces with their ids, sequence_id and offset."""
    pieces = materialize(salted(tokenize_pieces(docs, ranks_path, pattern, capacity, end_id)), "pieces")
    return pack(pieces, capacity, salt_col="_salt").drop("_salt")


def piece_digests(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The packing of documents with a checksum for the ids, which are dropped as soon as they are summed."""
    pieces = tokenize_pieces(docs, ranks_path, pattern, capacity, end_id)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialize(salted(slim), "pieces"), capacity, salt_col="_salt").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame, end_id: int = 2) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), one row each, at most capacity ids long."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
