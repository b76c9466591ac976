"""Arrow batches of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows in a batch at most: texts are large, and a batch is held twice by the JVM and once by Python.
ROWS = 1_000


def give_back() -> None:
    """Return memory that this process no longer uses to the system: Arrow's, and the C library's where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow over small batches; a task gives its memory back when it ends, as the worker process
    lives on beside those of other stages. The session's batch size is lowered where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    now = int(conf.get(key))
    if now <= 0 or now > ROWS:
        conf.set(key, str(ROWS))

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(released, schema)
