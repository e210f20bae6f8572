"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wagerlens.llm.common import small_enough, written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _stars(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """Hang each node's larger (or smaller) neighbours on the least node among it and them.

    The least neighbour is a map-side minimum; it is written, so that joining it back is a broadcast when it is
    small and otherwise a join between two exchanges, which adaptive execution can split at a hot node.
    """
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    if not large:
        both = both.filter("v < u")
    least = written(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), count)
    hung = both.join(small_enough(least), "u")
    hung = hung.filter("v > u") if large else hung
    moved = hung.select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("least").alias("v")))
    return written(moved.filter("u <> v").distinct(), count)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b); both of one orderable type.

    Each round halves the depth of what is left of a component, so that rounds grow with the logarithm of its
    diameter. Nulls and loops are not links; repeated edges do not matter; no edges give no rows.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = written(links.distinct())
    before = _digest(current)
    while before[0]:
        # As many edges as there are now, or fewer: steps on few edges take few tasks.
        current = _stars(_stars(current, True, before[0]), False, before[0])
        after = _digest(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
