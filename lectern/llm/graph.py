"""Connected components by repeated contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Scratch, spread_join


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (columns a, b); component is the smallest id reachable.

    Each round maps every node to its smallest neighbour or itself, replaces edge ends by their images and
    drops loops. Every node that stays has no smaller neighbour, so at least half of the nodes with edges go
    in a round; the smallest id of a component is never replaced. The rounds' maps are then composed.
    Hubs are safe: minima combine on the map side, and the edges of heavy nodes are joined where they lie. Self loops
    and repeated edges are allowed; null ends are ignored; no edges give an empty table.
    """
    live = edges.where("a is not null and b is not null")
    live = scratch.write(live.select("a", "b"), "edges")
    maps: list[DataFrame] = []
    while True:
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("to"), F.count("*").alias("m")), "map")
        maps.append(to)
        half = spread_join(live, to.select(F.col("id").alias("a"), F.col("to").alias("x"), "m"), ["a"])
        step = (
            spread_join(half, to.select(F.col("id").alias("b"), F.col("to").alias("y"), "m"), ["b"])
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        live = scratch.write(step, "edges")
        if live.isEmpty():
            break
    found = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = found.select(F.col("id").alias("to"), F.col("to").alias("last"))
        found = earlier.join(later, "to", "left").select("id", F.coalesce("last", "to").alias("to"))
    return found.select("id", F.col("to").alias("component"))
