"""Distributed connected components by repeated contraction.

Each round maps every vertex to the least vertex among itself and its neighbours and contracts the
edges by that map.  Every vertex that is not least in its neighbourhood goes away, so the edges shrink
geometrically and long chains need a logarithmic number of rounds.  No step gathers the neighbours of a
vertex: minima are partial aggregates and maps are joins that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex of ``edges``; component is the least id reachable.

    Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    left = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    left = scratch.table(left, "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to"))
        least = scratch.table(least.withColumn("to", F.least("v", "to")), "map")
        maps.append(least)
        on = lambda side: least.select(F.col("v").alias(side), F.col("to").alias(f"{side}_to"))
        after = left.join(on("a"), "a").join(on("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).where("a < b").distinct()
        gone, left = left, scratch.table(after, "edges")
        scratch.drop(gone)
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("a").alias("component"))
    # every later map is applied to the roots of the one before
    out = maps[-1].select("v", "to")
    for earlier in reversed(maps[:-1]):
        later = out.select(F.col("v").alias("to"), F.col("to").alias("root"))
        out = earlier.join(later, "to", "left").select("v", F.coalesce("root", "to").alias("to"))
    return scratch.table(out.select(F.col("v").alias("id"), F.col("to").alias("component")), "components")
