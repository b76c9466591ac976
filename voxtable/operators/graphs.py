"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.plans.storage import cleaned, forget, materialize

#: Edges of a node from which on it counts as a hub, and parts that a hub's edges are dealt to.
HUB, SALTS = 1_000, 64


def _with_least(edges: DataFrame, hubs: bool) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with the least v of their u as m, and the table (u, m) of the nodes.

    The least is found by an aggregation, whose first half runs before its shuffle. It meets the edges
    by a join on u. Where there are hubs, their edges take a salt from v as well and spread over SALTS
    tasks, to each of which the hub's one row goes. Hubs are at most edges / HUB rows.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    return _met(edges, least, hubs), least.select("u", "m")


def _met(edges: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """(u, v, m): the edges with their u's least v, from least (u, m, degree)."""
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    hub = F.col("degree") >= HUB
    marked = edges.join(least.filter(hub).select(F.col("u").alias("hub")), F.col("u") == F.col("hub"), "left")
    marked = marked.withColumn("salt", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(-1))
    parts = F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    return marked.join(least.select("u", "m", F.explode(parts).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def star_ties(members: DataFrame, group: str, member: str) -> tuple[DataFrame, DataFrame]:
    """(u, v): each member of a group tied to the least one, so that n members take n - 1 ties, and the stored table
    of the groups' least members, which may be forgotten once the ties are stored. Groups of one tie nothing.

    A group's greatest member is tied by the same aggregation, so only groups with others meet their rows again."""
    rows = members.select(F.col(group).alias("u"), F.col(member).alias("v")).dropna()
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"), F.count("*").alias("degree"))
    least = materialize(least.filter("m <> most"), "least")
    with cleaned(members.sparkSession):
        hubs = not least.filter(F.col("degree") >= HUB).isEmpty()
    others = _met(rows, least.filter("degree > 2"), hubs).select("v", "m").filter("v <> m")
    return least.select(F.col("most").alias("u"), F.col("m").alias("v")).union(others.select(F.col("v").alias("u"), F.col("m").alias("v"))), least


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    held, _ = _with_least(_both_ways(edges), hubs)
    return held.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every node and its lower neighbours are tied to the least of those neighbours."""
    held, least = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), hubs)
    return held.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _has_hubs(edges: DataFrame) -> bool:
    with cleaned(edges.sparkSession):
        return not _both_ways(edges).groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= HUB).isEmpty()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node that can be reached. Nodes may have any ordered type.

    Alternating large and small stars end after a logarithmic number of rounds, also on long chains.
    Hubs are looked for wherever there are enough edges for one. Each round is aggregations and joins on the edge table, written to shared storage. Null ends are left out.
    """
    now = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna().filter("u <> v").distinct(), "edges")
    with cleaned(edges.sparkSession):
        mark = (now.count(), None)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        before, old, hubs = mark, now, mark[0] >= HUB and _has_hubs(now)
        large = materialize(_large_star(now, hubs), "edges")  # the small star reads it more than once
        now = materialize(_small_star(large, hubs), "edges")
        forget(large)
        with cleaned(edges.sparkSession):
            mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        forget(old)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
