"""Isotonic regression of any size by threshold splits and pool-adjacent-violators.

The fit of a stretch of values around a threshold s can be cut where the running
sum of ``w * (y - s)`` is lowest: left of the cut the fit is at most s, right of
it at least s.  With s the mean of the stretch, a running sum that never falls
below zero says that the whole stretch is one block.  So long stretches are cut
in parallel, one pass over all of them per level, until each fits into a task;
there pool-adjacent-violators finishes it.  Stretches never interact again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.session import land

from . import skew
from .asof import asof_join


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Blocks (first, last, value, weight) of the non-decreasing fit of ordered values."""
    blocks: list[list[float]] = []
    for i, (value, weight) in enumerate(zip(y.tolist(), w.tolist(), strict=True)):
        blocks.append([i, i, value * weight, weight])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, total, weight_ = blocks.pop()
            blocks[-1][1] = last
            blocks[-1][2] += total
            blocks[-1][3] += weight_
    return [(int(a), int(b), total / weight, weight) for a, b, total, weight in blocks]


def _solved(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("x", ignore_index=True)
    blocks = pool_adjacent((group["wy"] / group["w"]).to_numpy(), group["w"].to_numpy())
    x = group["x"].to_numpy()
    return pd.DataFrame({
        "low": [x[a] for a, _, _, _ in blocks], "high": [x[b] for _, b, _, _ in blocks],
        "value": [v for *_, v, _ in blocks], "weight": [w for *_, w in blocks],
    })


def fit_isotonic(df: DataFrame, x: str, y: str, weight: str | None = None, most_rows: int | None = None) -> DataFrame:
    """The non-decreasing least-squares fit of y on x as blocks: low, high, value, weight.

    Equal values of x are merged first (map-side combined), so they share a
    value.  Rows with a null take no part; neighbouring stretches of equal fit
    may stay separate blocks.  No rows give no blocks.  ``most_rows`` bounds the
    distinct values one task fits (``skew.PIECE_ROWS``).
    """
    most_rows = most_rows or skew.PIECE_ROWS
    one = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), one.alias("w")).dropna()
    points = rows.groupBy("x").agg(F.sum(F.col("y") * F.col("w")).alias("wy"), F.sum("w").alias("w")).where("w > 0")
    # One order for all levels: pieces along x, each row with the stretch it lies in.
    rows = skew.cut_in_order(points, [], [F.asc("x")]).withColumn("stretch", F.lit(0).cast("bigint"))
    while True:
        sizes = rows.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"), (F.sum("wy") / F.sum("w")).alias("s"))
        # Fewer than rows / most_rows stretches are long.
        long_ = sizes.where(F.col("n") > most_rows)
        cuts = _cuts(rows, long_)
        found = cuts.collect()
        if not found:
            break
        side = F.broadcast(df.sparkSession.createDataFrame(found, cuts.schema))
        moved = F.col("stretch") * 2 + 1 + (F.col("x") > F.col("cut")).cast("bigint")
        # A stretch without a cut is one block already: its number turns negative and it is left alone.
        named = F.when(F.col("cut").isNotNull(), moved).when(F.col("whole"), -F.col("stretch") - 1).otherwise(F.col("stretch"))
        rows = land(rows.join(side, "stretch", "left").select("x", "wy", "w", "__piece", named.alias("stretch")), "stretches")
    whole = rows.where("stretch < 0").groupBy("stretch").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), (F.sum("wy") / F.sum("w")).alias("value"), F.sum("w").alias("weight")
    ).drop("stretch")
    short = rows.where("stretch >= 0").groupBy("stretch").applyInPandas(
        lambda g: _solved(g[["x", "wy", "w"]]), "low double, high double, value double, weight double"
    )
    return land(short.unionByName(whole), "isotonic")


def _cuts(rows: DataFrame, long_: DataFrame) -> DataFrame:
    """For each long stretch: where its running sum is lowest (``cut``), or that it is one block (``whole``)."""
    live = rows.where("stretch >= 0").join(F.broadcast(long_.select("stretch", "s")), "stretch")
    gain = F.col("wy") - F.col("w") * F.col("s")
    live = live.withColumn("gain", gain)
    start = skew.piece_prefix(live, ["stretch"], before=F.sum("gain"))
    live = skew.join_pieces(live, start, ["stretch"])
    inside = Window.partitionBy("stretch", "__piece").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    run = F.col("before") + F.sum("gain").over(inside)
    live = live.withColumn("run", run)
    lowest = live.groupBy("stretch").agg(
        F.min(F.struct("run", "x")).alias("m"), F.max("x").alias("last"), F.sum(F.abs("gain")).alias("size")
    )
    below = (F.col("m.run") < -1e-12 * F.col("size")) & (F.col("m.x") < F.col("last"))
    return lowest.select("stretch", F.when(below, F.col("m.x")).alias("cut"), (~below).alias("whole"))


def apply_isotonic(df: DataFrame, x: str, blocks: DataFrame, name: str = "isotonic") -> DataFrame:
    """Add the fit at every x: straight lines between block ends, flat outside, null for a null x.

    Both neighbours are found by as-of joins that are cut into pieces along x, so
    neither the rows nor the blocks meet in one task.
    """
    ends = blocks.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("__at"), F.col("value").alias("__v"))
    ends = ends.select(F.lit(0).alias("__all"), "__at", (-F.col("__at")).alias("__back"), "__v")
    rows = df.withColumns({"__all": F.lit(0), "__x": F.col(x).cast("double"), "__minus": -F.col(x).cast("double")})
    below = ends.select("__all", "__at", F.col("__at").alias("__x0"), F.col("__v").alias("__v0"))
    above = ends.select("__all", "__back", F.col("__at").alias("__x1"), F.col("__v").alias("__v1"))
    rows = asof_join(rows, below, "__all", "__x", "__at", [], ["__x0", "__v0"], strict=False, hot_rows=0)
    rows = asof_join(rows, above, "__all", "__minus", "__back", [], ["__x1", "__v1"], strict=False, hot_rows=0)
    part = (F.col("__x") - F.col("__x0")) / F.nullif(F.col("__x1") - F.col("__x0"), F.lit(0.0))
    between = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.coalesce(part, F.lit(0.0))
    fitted = F.when(F.col("__v0").isNull(), F.col("__v1")).when(F.col("__v1").isNull(), F.col("__v0")).otherwise(between)
    return rows.withColumn(name, F.when(F.col("__x").isNotNull(), fitted)).select(*df.columns, name)
