"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldglass.llm.common import discard, landed


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u").where("v > u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kin = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kin.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from every id that has a link: columns id, component.

    ``links`` has two id columns u and v; direction, repeats and self-links do
    not matter, rows with a null end are no links.  A node's neighbours are never
    gathered: each step takes a minimum per node (combined before the shuffle)
    and joins it back, so a hub is spread like any skewed join.  Every round is
    written to the shared folder.  The rounds needed grow with the logarithm of
    the longest path.  No links give no rows.
    """
    edges = landed(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links"
    )
    seen = _mark(edges)
    while True:
        before, edges = edges, landed(small_star(large_star(edges)), "stars")
        discard(before)
        mark = _mark(edges)
        if mark == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = mark


def _mark(edges: DataFrame) -> tuple:
    """Count and two sums of hashes: equal when the set of edges is."""
    key = F.xxhash64("u", "v")
    return tuple(edges.agg(
        F.count("*"), F.sum(F.pmod(key, F.lit(1 << 40))), F.sum(F.shiftrightunsigned(key, 24))
    ).first())
