"""Column names and broadcasts that are safe for any table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(columns: Iterable[str], name: str) -> str:
    """name, with underscores before it until none of the columns has it; Spark compares names without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def broadcast_if_small(table: DataFrame, most_rows: int, most_characters: int = 0, sized: str | None = None) -> DataFrame:
    """A stored table, marked for broadcasting if it has at most most_rows rows and, where the string column
    ``sized`` is named, at most most_characters in it. Otherwise Spark chooses the join."""
    row = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(sized)) if sized else F.lit(0), F.lit(0)).alias("size")).first()
    return F.broadcast(table) if row["n"] <= most_rows and row["size"] <= most_characters else table


def meet_test_set(left: DataFrame, table: DataFrame, key: str, most_rows: int, most_characters: int = 0, sized: str | None = None, how: str = "inner", by: tuple[str, ...] = ()) -> DataFrame:
    """left.join(table, key, how) for a stored table whose rows don't grow with left's: a broadcast up to the given
    size. Beyond it left's rows are dealt to SALTS parts of each key by a hash of the columns ``by``, and every row of
    the table goes to each part, so that a key with any share of left's rows is many tasks' work."""
    row = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(sized)) if sized else F.lit(0), F.lit(0)).alias("size")).first()
    if row["n"] <= most_rows and row["size"] <= most_characters:
        return left.join(F.broadcast(table), key, how)
    salt = fresh([*left.columns, *table.columns], "salt")
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(copies, [key, salt], how).drop(salt)


#: Rows with the same key from which on a key counts as hot, and parts that its rows are dealt to.
HOT, SALTS = 10_000, 32


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """left.join(right, keys, "left") for a right side whose keys are unique: rows of left with a hot key are dealt
    to SALTS tasks by a hash of column ``by``, and the one row of right for it goes to each. Null keys meet nothing."""
    salt, hot, count = (fresh([*left.columns, *right.columns], n) for n in ("salt", "hot", "count"))
    names = {k: fresh([*left.columns, *right.columns], f"hot_{k}") for k in keys}
    busy = left.groupBy(*keys).agg(F.count("*").alias(count)).filter(F.col(count) >= HOT).select(*[F.col(k).alias(n) for k, n in names.items()], F.lit(True).alias(hot))
    same = [F.col(k) == F.col(n) for k, n in names.items()]
    on = same[0]
    for s in same[1:]:
        on = on & s
    # there are at most rows / HOT hot keys; Spark broadcasts them by their measured size or not at all
    dealt = left.join(busy, on, "left").withColumn(salt, F.when(F.col(hot), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(-1)).drop(*names.values(), hot)
    parts = F.when(F.col(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    copies = right.join(busy, on, "left").withColumn(salt, F.explode(parts)).drop(*names.values(), hot)
    return dealt.join(copies, [*keys, salt], "left").drop(salt)
