"""Connected components of a graph by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.llm.common import stored


#: Links a task should hold at least; small graphs run in few tasks.
_PER_TASK = 50_000


def _downhill(pairs: DataFrame, tasks: int) -> DataFrame:
    """Distinct (a, b) with a > b."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct().coalesce(tasks)


def _with_least(pairs: DataFrame, tasks: int) -> DataFrame:
    """``pairs`` with the least ``b`` (or ``a`` itself) of each ``a``.  The least
    is pre-aggregated; the adaptive skew join splits an ``a`` with many links."""
    least = pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return pairs.join(least, "a").coalesce(tasks)


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) of integer nodes: the smallest node
    that each linked node reaches.

    A round links every larger neighbour of a node to its least neighbour (large
    star), then every smaller one (small star), and writes the links, at most
    twice as many as before; a path of n nodes takes about log n rounds.  Rounds
    stop when the links no longer change: then each node hangs on its
    component.
    """
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    before = None
    while True:
        state = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            break
        before, tasks = state, 2 + state[0] // _PER_TASK
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, tasks).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = _with_least(_downhill(large, tasks), tasks)
        small = small.select(F.explode(F.array(*[F.struct(F.col(c).alias("a"), F.col("least").alias("b")) for c in ("a", "b")])).alias("l"))
        links = stored(_downhill(small.select("l.a", "l.b"), tasks), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b")).distinct()
