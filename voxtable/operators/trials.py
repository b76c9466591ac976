"""Trials: best and running values, and cut-off sweeps."""

from __future__ import annotations

from itertools import count, product
from time import time
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_trial(trials: DataFrame, by: str = "study") -> DataFrame:
    """Per study the parameters with the least value; ties go to the earliest trial."""
    least = F.struct("value", "trial")
    return trials.groupBy(by).agg(F.min_by("trial", least).alias("trial"), F.min_by("params", least).alias("params"), F.min("value").alias("value"))


def running_best(trials: DataFrame, by: str = "study") -> DataFrame:
    before = Window.partitionBy(by).orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best", F.min("value").over(before))


def sweep(scored: DataFrame, name: str, cuts: list[float], score: str, truth: str) -> DataFrame:
    """Errors of the rule score >= cut for every cut, in one pass: a conditional sum for each cut, no join."""
    wrong = [F.sum(((F.col(score) >= c) != (F.col(truth) == 1)).cast("long")).alias(f"e{i}") for i, c in enumerate(cuts)]
    one = scored.agg(F.count("*").alias("n"), *wrong)
    rows = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(float(c)).alias(name), F.col(f"e{i}").alias("errors")) for i, c in enumerate(cuts)])
    return one.select("n", F.explode(rows).alias("r")).select("r.trial", f"r.{name}", "r.errors", (F.col("r.errors") / F.col("n")).alias("value"))


TRIAL = "study string, trial int, params map<string,double>, value double"


def grid(ranges: dict[str, list[float]], first: dict[str, float] | None = None) -> list[dict[str, float]]:
    """All combinations of the parameters' values, behind a first one with default values."""
    every = [dict(zip(ranges, values)) for values in product(*ranges.values())]
    return ([first] if first else []) + [p for p in every if p != first]


def steps(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... up to high."""
    return [round(low + i * step, 10) for i in range(int((high - low) / step + 1e-9) + 1)]


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The trials of a store; none where there is no store yet."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return spark.createDataFrame([], TRIAL)
    return spark.read.schema(TRIAL).option("recursiveFileLookup", True).parquet(path)


def claim(spark: SparkSession, path: str, study: str, number: int, lease: float) -> bool:
    """Whether this caller, and no other, may run a trial now.

    A claim is a file that only one caller can create. One that is older than ``lease`` seconds may be taken over,
    by creating the next of its trial: its driver is taken to be lost.
    """
    folder = f"{path.rstrip('/')}/_claims/{quote(study, safe='')}"
    for attempt in count():
        files, place = _files(spark, f"{folder}/{number}-{attempt}")
        if files.createNewFile(place):
            return True
        following = _files(spark, f"{folder}/{number}-{attempt + 1}")[1]
        if not files.exists(following) and time() - files.getFileStatus(place).getModificationTime() / 1000 < lease:
            return False
    return False


def resume(spark: SparkSession, path: str, study: str, trials: list[dict[str, float]], run, lease: float = 86400.0) -> DataFrame:
    """Run those of the trials that the store at ``path`` lacks, and return the study's trials.

    run(params) gives the value. Each trial is stored in a folder of its own when it is done, so a study that was
    stopped goes on where it was: a trial whose driver was lost, once its claim is older than ``lease`` seconds;
    one whose run fails, at once. Several drivers may share a study: each runs the trials that it can claim, and
    gets those that are done by then. The store's create must be exclusive, as in HDFS. Trials are jobs of their
    own, which may use the whole cluster.
    """
    done = {r[0] for r in read_store(spark, path).filter(F.col("study") == study).select("trial").distinct().collect()}
    for number, params in enumerate(trials):
        place = f"{path.rstrip('/')}/{quote(study, safe='')}-{number}"
        if number in done or not claim(spark, path, study, number, lease):
            continue
        files, kept = _files(spark, f"{place}/_SUCCESS")
        if files.exists(kept):  # done elsewhere since
            continue
        try:
            row = (study, number, {k: float(v) for k, v in params.items()}, float(run(params)))
            spark.createDataFrame([row], TRIAL).coalesce(1).write.mode("overwrite").parquet(place)
        except BaseException:
            release(spark, path, study, number)
            raise
    return read_store(spark, path).filter(F.col("study") == study)


def release(spark: SparkSession, path: str, study: str, number: int) -> None:
    """Give up the claims on a trial that failed."""
    files, folder = _files(spark, f"{path.rstrip('/')}/_claims/{quote(study, safe='')}")
    for held in files.listStatus(folder):
        if held.getPath().getName().startswith(f"{number}-"):
            files.delete(held.getPath(), False)
