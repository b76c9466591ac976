"""Cutting lineage through the storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voxtable-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/voxtable-{spark.sparkContext.applicationId}"


#: With it Spark deletes a job's shuffle files when the job ends, rather than when the driver happens to collect them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings, changed for the actions inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cleaned(spark: SparkSession):
    """Shuffle files of the actions inside go with each action's end."""
    return settings(spark, {CLEANUP: "true"})


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later jobs start from
    files that survive the loss of an executor, and never repeat the work that made them. Shuffle files of the
    write go with its end. The options are the writer's."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def forget(table: DataFrame) -> None:
    """Delete the files of a table that materialize returned; no later plan may read it."""
    if path := getattr(table, "_stored_at", None):
        _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once no result that is still to be computed needs them."""
    _delete(spark, work_folder(spark))
