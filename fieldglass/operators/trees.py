"""Boosted trees on binned features, fitted for all time-ordered folds at once.

Nothing is fitted in a task: every level of every tree is one aggregate,
(fold, node, feature, bin) -> sums of gradients and curvatures, combined before
the shuffle.  Splits, leaves and margins come from those sums, whose number is
bounded by folds x nodes x features x bins.  A row is kept once per fold it takes
part in; its margin is written after each tree, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.session import land


@dataclass(frozen=True)
class Trees:
    """Fitted trees and the rows they were scored on.

    ``splits``: fold, tree, node, feature (position in the list), bin (rows above
    it go right), gain.  ``leaves``: fold, tree, node, leaf.  ``held_out``: the
    rows of each fold's own period with ``p``.
    """

    splits: DataFrame
    leaves: DataFrame
    held_out: DataFrame


def quantile_bins(df: DataFrame, features: Sequence[str], period: str, before: int, bins: int = 32) -> dict[str, list[float]]:
    """Upper edges of each feature's bins from the rows before a period (approximate quantiles, a small sketch per column)."""
    rows = df.where(F.col(period) < before)
    at = [i / bins for i in range(1, bins)]
    found = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(list(features), at, 1e-4)
    return {f: sorted(set(edges)) for f, edges in zip(features, found)}


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges below a value; a null has the bin -1, so it goes left."""
    number = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < value.cast("double")))
    return F.when(value.isNull(), F.lit(-1)).otherwise(number).cast("long")


def fit_trees(
    df: DataFrame, period: str, features: Sequence[str], target: str, number: int = 20, depth: int = 3, step: float = 0.1,
    penalty: float = 1.0, least_weight: float = 1.0, folds: Sequence[int] | None = None,
) -> Trees:
    """Boosted trees for log loss, one model per fold, trained on all earlier periods.

    ``features`` are whole-number bins (``bin_of``).  ``folds`` defaults to every
    period but the first.  A split needs ``least_weight`` of curvature on both
    sides and a gain above zero; gains are compared on seven digits, ties go to
    the first feature, then the smallest bin.  Rows without period or target are
    left out; null features have the bin -1.  A fold whose training rows are all
    of one class, or none, is refused.
    """
    rows = df.where(F.col(period).isNotNull() & F.col(target).isNotNull())
    if folds is None:
        # One row per period.
        folds = sorted(r[0] for r in rows.select(F.col(period).cast("long")).distinct().collect())[1:]
    bins = F.array(*[F.coalesce(F.col(f).cast("long"), F.lit(-1)) for f in features])
    # Narrow rows: a row's other columns are not needed until the end.
    base = land(rows.select(
        F.col(period).cast("long").alias("period"), F.col(target).cast("double").alias("y"), bins.alias("bins")
    ), "binned")
    uses = F.filter(F.array(*[F.lit(int(f)).cast("long") for f in folds]), lambda f: f >= F.col("period"))
    state = base.select("*", F.explode(uses).alias("fold")).withColumn("train", F.col("period") < F.col("fold"))
    share = state.where("train").groupBy("fold").agg(F.avg("y").alias("m"))
    rate = {r["fold"]: r["m"] for r in share.collect()}  # one row per fold
    for fold in folds:
        if not 0 < rate.get(fold, 0.0) < 1:
            raise ValueError(f"fold {fold} needs earlier rows of both classes")
    state = land(state.join(F.broadcast(share), "fold").select(
        "period", "y", "bins", "fold", "train", F.log(F.col("m") / (1 - F.col("m"))).alias("margin")
    ), "margins")
    splits: list[DataFrame] = []
    leaves: list[DataFrame] = []
    for tree in range(number):
        chance = 1 / (1 + F.exp(-F.col("margin")))
        grown = state.withColumn("g", chance - F.col("y")).withColumn("h", chance * (1 - chance)).withColumn("node", F.lit(1).cast("long"))
        for _ in range(depth):
            best = _small(best_splits(grown.where("train"), len(features), penalty, least_weight), "splits")
            splits.append(best.select("fold", F.lit(tree).cast("long").alias("tree"), "node", "feature", "bin", "gain"))
            right = (F.get("bins", F.col("feature").cast("int")) > F.col("bin")).cast("long")
            moved = F.when(F.col("gain").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right)
            grown = grown.join(F.broadcast(best), ["fold", "node"], "left").select(
                "period", "y", "bins", "fold", "train", "margin", "g", "h", moved.alias("node")
            )
        sums = grown.where("train").groupBy("fold", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        leaf = _small(sums.select("fold", "node", (-step * F.col("g") / (F.col("h") + penalty)).alias("leaf")), "leaves")
        leaves.append(leaf.select("fold", F.lit(tree).cast("long").alias("tree"), "node", "leaf"))
        # A node that only held-out rows reach changes nothing.
        state = land(grown.join(F.broadcast(leaf), ["fold", "node"], "left").select(
            "period", "y", "bins", "fold", "train", (F.col("margin") + F.coalesce("leaf", F.lit(0.0))).alias("margin")
        ), "margins")
    held = state.where("not train").select("fold", F.col("y").alias("__y"), "bins", (1 / (1 + F.exp(-F.col("margin")))).alias("p"))
    return Trees(_all(splits), _all(leaves), held)


def best_splits(rows: DataFrame, features: int, penalty: float, least_weight: float) -> DataFrame:
    """The best split of every (fold, node): feature, bin, gain."""
    items = F.posexplode("bins").alias("feature", "bin")
    sums = rows.select("fold", "node", "g", "h", items).groupBy("fold", "node", "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h")
    )
    # At most as many rows as bins in a window.
    every = Window.partitionBy("fold", "node", "feature")
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = sums.select(
        "fold", "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"),
        F.sum("g").over(every).alias("gt"), F.sum("h").over(every).alias("ht"),
    )
    gl, hl, gt, ht = (F.col(x) for x in ("gl", "hl", "gt", "ht"))
    gain = gl * gl / (hl + penalty) + (gt - gl) * (gt - gl) / (ht - hl + penalty) - gt * gt / (ht + penalty)
    scored = c.where((hl >= least_weight) & (ht - hl >= least_weight)).withColumn("gain", F.round(gain, 7)).where("gain > 0")
    return scored.groupBy("fold", "node").agg(
        F.min_by(F.struct("feature", "bin", "gain"), F.struct(-F.col("gain"), "feature", "bin")).alias("b")
    ).select("fold", "node", "b.*")


def _small(df: DataFrame, label: str) -> DataFrame:
    """A table bounded by folds x nodes, written once so that later plans do not recompute it."""
    return land(df.coalesce(1), label)


def _all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
