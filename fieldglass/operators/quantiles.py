"""Exact order statistics over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import skew
from .skew import names


def running_count(
    counts: DataFrame, by: str | Sequence[str], value: str, count: str, name: str = "__cum",
    descending: bool = False, distributed: bool | None = None,
) -> DataFrame:
    """Running total of ``count`` along distinct values of a key.

    A small input (``skew.is_small``) is summed by one plain window, otherwise
    the values are cut into even pieces.
    """
    by = names(by)
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)
    if distributed is None:
        distributed = not skew.is_small(counts)
    if not distributed:
        plain = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn(name, F.sum(count).over(plain))
    rows = skew.cut_in_order(counts, by, [order])
    rows = skew.join_pieces(rows, skew.piece_prefix(rows, by, __before=F.sum(count)), by)
    inside = Window.partitionBy(*by, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.col("__before") + F.sum(count).over(inside)).drop("__before", "__piece")


def exact_quantiles(
    df: DataFrame,
    by: str | Sequence[str],
    value: str,
    quantiles: dict[str, float],
    weight: str | None = None,
    distributed: bool | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles, one column per entry of ``quantiles``.

    Values are first counted (map-side combined), then placed by running count,
    so a large group's values never meet in one task.  The arithmetic is the same
    whether or not the running count is cut; null groups count like others, and
    groups without a value have no row.
    ``weight`` names a column of counts when the input is already counted.
    """
    by = names(by)
    if distributed is None:
        distributed = not skew.is_small(df)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__c")
    )
    placed = running_count(counts, by, value, "__c", distributed=distributed)
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    if by:
        # Null-safe, so that the null group keeps its quantiles; both sides are exchanged next to the join.
        side = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in by], "__n")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by])
        placed = placed.join(side, same).drop(*[f"__k_{k}" for k in by])
    else:
        placed = placed.withColumn("__n", sizes.scalar())
    picks = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("__n") - 1)
        for tag, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("__cum") - F.col("__c") <= at) & (at < F.col("__cum"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"__{name}_{tag}"))
    wide = placed.groupBy(*by).agg(*picks, F.max("__n").alias("__n"))
    out = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("__n") - 1)
        part = position - F.floor(position)
        low, high = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((low + (high - low) * part).alias(name))
    return wide.select(*by, *out)
