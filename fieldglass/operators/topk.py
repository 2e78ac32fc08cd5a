"""Ordering, extremes and small selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import names


def board_order(df: DataFrame, order: Sequence[tuple[str, str]]) -> DataFrame:
    """Mixed-direction board ordering, nulls last in either direction.

    Sorting is for serving; tables are stored unsorted.
    """
    return df.orderBy(*[F.desc_nulls_last(c) if d == "desc" else F.asc_nulls_last(c) for c, d in order])


def latest_snapshot(df: DataFrame, stamp: str, *ids: str) -> DataFrame:
    """Rows of the single newest (stamp, id); the pair is a scalar subquery.

    Each part is compared by itself, so that a test of a grouping key reaches the scans.
    """
    columns = (stamp, *ids)
    newest = df.agg(F.max(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]))).scalar()
    return df.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(newest[f"k{i}"]) for i, c in enumerate(columns)]))


def top_rows(df: DataFrame, by: str | Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of a key.

    Spark limits each map task to ``k`` rows per key before the exchange, so a
    hot key costs at most ``k`` rows per task.
    """
    window = Window.partitionBy(*names(by)).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") <= k).drop("__rn")


def preferred_in_modal_group(
    df: DataFrame, by: str | Sequence[str], group: Column, liquidity: str, order: Sequence[Column], keep: Sequence[str],
    fresh: Sequence[Column] = (),
) -> DataFrame:
    """T4: pick the most liquid line group of a key, then its preferred row.

    Two aggregates: best row per (key, group), then the group with the greatest
    liquidity; equal groups go to the smaller group value.
    """
    by = names(by)
    best = (
        df.withColumn("__g", group)
        .groupBy(*by, "__g")
        .agg(
            F.max(liquidity).alias("__liquidity"),
            F.max_by(F.struct(*keep), F.struct(*order)).alias("__row"),
        )
    )
    return (
        best.groupBy(*by)
        .agg(F.min_by("__row", F.struct((-F.col("__liquidity")).alias("l"), F.col("__g"))).alias("__row"))
        .select(*by, *[F.col(f"__row.{c}").alias(c) for c in keep])
    )


def next_period(df: DataFrame, stamp: str, period: str, now: Column) -> DataFrame:
    """T5: all rows of the period that holds the earliest future row."""
    future = df.where(F.col(stamp) >= now)
    first = future.agg(F.min(F.struct(F.col(stamp).alias("s"), F.col(period).alias("p")))["p"]).scalar()
    return df.where(F.col(period) == first)


def extremes(df: DataFrame, picks: Mapping[str, tuple[Column, Sequence[str]]], keep: Sequence[str]) -> DataFrame:
    """Named smallest rows, ``{name: (score, ties)}``, in one aggregate."""
    row = F.struct(*keep)
    wide = df.agg(
        *[
            F.min_by(row, F.struct(score.alias("s"), *ties)).alias(name)
            for name, (score, ties) in picks.items()
        ]
    )
    items = F.array(*[F.struct(F.lit(n).alias("pick"), F.col(n).alias("row")) for n in picks])
    return wide.select(F.explode(items).alias("__i")).select(
        "__i.pick", *[F.col(f"__i.row.{c}").alias(c) for c in keep]
    )


def best_parameters(df: DataFrame, metric: str, ties: Sequence[str]) -> DataFrame:
    """The parameter row with the smallest metric."""
    row = F.struct(*df.columns)
    return df.agg(F.min_by(row, F.struct(metric, *ties)).alias("__r")).select("__r.*")


def limit_ordered(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Ordered top-k report (Spark keeps k rows per task)."""
    return df.orderBy(*order).limit(k)
