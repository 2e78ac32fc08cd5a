"""Unions, preference, gap filling, sweeps (U1-U5) and chronological folds (M1)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import anti_join
from .skew import names


def union_products(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack aligned tables; absent columns become typed nulls."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefer_primary(
    primary: DataFrame, fallback: DataFrame, key: str | Sequence[str], labels: tuple[str, str] = ("PRIMARY", "FALLBACK")
) -> DataFrame:
    """The primary rows, plus fallback rows of keys the primary lacks."""
    rest = anti_join(fallback, primary, key)
    return primary.withColumn("source_label", F.lit(labels[0])).unionByName(
        rest.withColumn("source_label", F.lit(labels[1]))
    )


def fill_periods(
    df: DataFrame, by: str | Sequence[str], period: str, low: Column, high: Column, step: Column | None = None
) -> DataFrame:
    """U4: one row per key and period between its bounds, absent ones flagged.

    ``df`` has one row per (key, period); ``low`` and ``high`` are aggregates of
    the key.  Each row carries the gap up to its successor, so no second table
    is joined: lengths are bounded by the calendar.
    """
    by = names(by)
    step = F.lit(1) if step is None else step
    along = Window.partitionBy(*by).orderBy(period)
    whole = Window.partitionBy(*by)
    first = F.row_number().over(along) == 1
    follows = F.lead(period).over(along)
    rows = df.withColumn("__lo", low.over(whole)).withColumn("__hi", high.over(whole))
    rows = rows.withColumn("__start", F.when(first, F.col("__lo")).otherwise(F.col(period)))
    rows = rows.withColumn("__next", follows)
    # From this row (or the lower bound) to just before the next row.
    span = F.sequence(F.col("__start"), F.coalesce(F.col("__next"), F.col("__hi")), step)
    filled = rows.withColumn("__p", F.explode(span)).where(
        F.col("__next").isNull() | (F.col("__p") < F.col("__next"))
    )
    here = F.col("__p") == F.col(period)
    return filled.select(
        *by,
        F.col("__p").alias(period),
        *[F.when(here, F.col(c)).alias(c) for c in df.columns if c not in (*by, period)],
        (~here).alias("is_gap"),
    )


def sweep(df: DataFrame, name: str, grid: Sequence[float]) -> DataFrame:
    """Every row with every grid value, as a narrow explode of a literal array."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(g)) for g in grid])))


def expanding_folds(df: DataFrame, period: str, folds: Sequence[int]) -> DataFrame:
    """M1: for each fold, earlier periods train and the fold's period validates.

    The folds are a literal list, so a row is copied only to the folds that use
    it and nothing is joined.
    """
    roles = F.array_compact(F.array(*[
        F.when(F.col(period) < f, F.struct(F.lit(f).cast("long").alias("fold"), F.lit("TRAIN").alias("fold_role")))
        .when(F.col(period) == f, F.struct(F.lit(f).cast("long").alias("fold"), F.lit("VALIDATE").alias("fold_role")))
        for f in folds
    ]))
    return df.withColumn("__f", F.explode(roles)).select(*df.columns, "__f.fold", "__f.fold_role")


def common_sample(
    df: DataFrame, features: Sequence[str], target: str, split: str, allowed: Sequence[str]
) -> DataFrame:
    """M0: allowed splits only, every feature and the target present."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*features, target]])
    return df.where(F.col(split).isin(*allowed) & complete)
