"""Point-in-time windows.

All order lists must end in a unique key.  Windows that look back a bounded
number of rows run per key; keys above ``hot_rows`` are cut into consecutive
runs of ``CHUNK_ROWS`` rows, each with a halo of the rows it must look back at,
so that the frame is exact and no task holds the whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from . import skew
from .quantiles import running_count
from .skew import HOT_ROWS, names

CHUNK_ROWS = 500_000


def lookback(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str],
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    reach: int,
    position: str = "__position",
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Window columns whose frames reach at most ``reach`` rows back.

    ``columns(window)`` returns the expressions over an ordered window; the
    1-based row number inside the key is available as ``position``.
    """
    by = names(by)
    chunk_rows = max(chunk_rows, reach)
    sort = [F.asc_nulls_first(c) for c in order]
    cold, hot = skew.split_hot(df, by, hot_rows)

    plain = Window.partitionBy(*by).orderBy(*sort)
    cold = cold.withColumn(position, F.row_number().over(plain).cast("long"))
    cold = cold.select("*", *[c.alias(n) for n, c in columns(plain).items()])
    if hot is None:
        return cold

    hot = skew.ordered_rank(hot, by, sort, position)
    zero_based = F.col(position) - 1
    chunk = F.floor(zero_based / chunk_rows)
    last_rows = zero_based % chunk_rows >= chunk_rows - reach
    hot = hot.withColumn("__home", chunk).withColumn(
        "__chunk",
        F.explode(F.when(last_rows, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))),
    )
    pieces = Window.partitionBy(*by, "__chunk").orderBy(F.col(position))
    hot = (
        hot.select("*", *[c.alias(n) for n, c in columns(pieces).items()])
        .where(F.col("__chunk") == F.col("__home"))
        .drop("__chunk", "__home")
    )
    return cold.unionByName(hot)


def rolling_prior(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str],
    metrics: Sequence[str],
    sizes: Sequence[int],
    **tuning,
) -> DataFrame:
    """Trailing means over strictly earlier rows, with history counts."""

    def columns(window: WindowSpec) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for size in sizes:
            frame = window.rowsBetween(-size, -1)
            out[f"games_last_{size}"] = F.count(F.lit(1)).over(frame)
            for metric in metrics:
                out[f"{metric}_last_{size}"] = F.avg(metric).over(frame)
        return out

    out = lookback(df, by, order, columns, max(sizes), **tuning)
    return out.withColumn("games_before", F.col("__position") - 1).drop("__position")


def running_history(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str],
    stamp: str,
    metric: str,
    size: int,
    **tuning,
) -> DataFrame:
    """History up to and including the row: count, lag, mean, day gap."""

    def columns(window: WindowSpec) -> dict[str, Column]:
        before = F.lag(stamp).over(window)
        return {
            f"previous_{stamp}": before,
            f"{metric}_last_{size}": F.avg(metric).over(window.rowsBetween(-(size - 1), 0)),
            "day_gap": F.datediff(F.col(stamp), before).cast("long"),
        }

    out = lookback(df, by, order, columns, size, **tuning)
    return out.withColumnRenamed("__position", "rows_so_far")


def normalise_within(
    df: DataFrame, by: str | Sequence[str], value: str, share: str, total: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """A value's share of its group; null where the group sums to zero."""
    out = skew.attach_totals(df, by, hot_rows, **{total: F.sum(value)})
    return out.withColumn(share, F.col(value) / F.nullif(F.col(total), F.lit(0.0)))


def best_with_consensus(
    df: DataFrame,
    by: str | Sequence[str],
    value: str,
    ties: Sequence[str],
    keep: Sequence[str],
    statistics: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The highest row of a group beside the group's statistics.

    One partial aggregate instead of a window plus a row number, because only
    the best row survives.  A row without a value comes last; equal values go
    to the smallest ``ties``.
    """
    by = names(by)
    rank = F.struct(F.coalesce(-F.col(value), F.lit(float("inf"))).alias("v"), *ties)
    if statistics is None:
        statistics = {
            "offer_count": F.count(F.lit(1)), f"average_{value}": F.avg(value), f"minimum_{value}": F.min(value),
        }
    return (
        df.groupBy(*by)
        .agg(F.min_by(F.struct(*keep, value), rank).alias("__best"), *[c.alias(n) for n, c in statistics.items()])
        .select(*by, *[F.col(f"__best.{k}").alias(f"best_{k}") for k in [*keep, value]], *statistics)
    )


def latest_per_key(df: DataFrame, by: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of a key along ``order``, as a partial aggregate."""
    by = names(by)
    rest = [c for c in df.columns if c not in by]
    return (
        df.groupBy(*by)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def first_per_key(df: DataFrame, by: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of a key along ``order``."""
    by = names(by)
    rest = [c for c in df.columns if c not in by]
    return (
        df.groupBy(*by)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def newest_snapshot(
    df: DataFrame, by: str | Sequence[str], stamp: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All rows of each key's newest snapshot."""
    out = skew.attach_totals(df, by, hot_rows, __newest=F.max(stamp))
    return out.where(F.col(stamp) == F.col("__newest")).drop("__newest")


def global_rank(
    df: DataFrame,
    value: str,
    name: str,
    descending: bool = True,
    ties: Sequence[str] = (),
    distributed: bool | None = None,
) -> DataFrame:
    """W6 over a whole table: ``rank`` with ties, or a dense order with ``ties``.

    A small table is ranked by one window.  Otherwise the order is cut into
    pieces; for ``rank`` only distinct values are ordered and joined back.
    """
    first = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    if distributed is None:
        distributed = not skew.is_small(df)
    if not distributed:
        position = F.row_number() if ties else F.rank()
        return df.withColumn(name, position.over(Window.orderBy(first, *ties)).cast("long"))
    if ties:
        return skew.ordered_rank(df, [], [first, *[F.asc_nulls_first(t) for t in ties]], name)
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    placed = running_count(counts, [], value, "__c", descending=descending, distributed=True)
    placed = placed.select(value, (F.col("__cum") - F.col("__c") + 1).alias(name))
    known = df.agg(F.count(value)).scalar()
    return skew.join_lookup(df, placed, value, "left").withColumn(name, F.coalesce(name, known + 1))


def rank_summary(df: DataFrame, value: str, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """W6 on a summary table whose row count does not grow with the data."""
    order = Window.orderBy(F.desc_nulls_last(value), *ties)
    position = F.row_number() if ties else F.rank()
    return df.withColumn(name, position.over(order).cast("long"))


def max_drawdown(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str],
    value: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Total and largest fall of the running sum below its peak (from 0).

    A key, or a piece of a hot key, is reduced to four numbers - its sum, highest
    and lowest running value and inner fall - which combine exactly.
    """
    by = names(by)
    sort = [F.asc_nulls_first(c) for c in order]
    cold, hot = skew.split_hot(df, by, hot_rows)
    rows = cold.withColumn("__piece", F.lit(0))
    if hot is not None:
        rows = rows.unionByName(skew.cut_in_order(hot, by, sort))
    inside = Window.partitionBy(*by, "__piece").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.sum(value).over(inside))
    rows = rows.withColumn("__fall", F.max("__run").over(inside) - F.col("__run"))
    parts = rows.groupBy(*by, "__piece").agg(
        F.sum(value).alias("__sum"),
        F.max("__run").alias("__high"),
        F.min("__run").alias("__low"),
        F.max("__fall").alias("__fall"),
        F.count(F.lit(1)).alias("__n"),
    )
    earlier = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__start", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    before = F.coalesce(F.max(F.col("__start") + F.col("__high")).over(earlier), F.lit(0))
    parts = parts.withColumn("__peak", F.greatest(before, F.lit(0)))
    deepest = F.greatest(
        F.col("__fall"), F.col("__peak") - (F.col("__start") + F.col("__low")), F.lit(0)
    )
    return parts.groupBy(*by).agg(
        F.sum("__n").alias("row_count"),
        F.sum("__sum").alias("total"),
        F.max(deepest).alias("max_drawdown"),
    )


def decayed_at(
    df: DataFrame, by: str | Sequence[str], day: str, as_of: Column, half_life_days: float, sums: Sequence[str]
) -> DataFrame:
    """W8 read at one later day: decayed sums of all days up to it."""
    age = F.datediff(as_of, F.col(day)).cast("double")
    weight = F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))
    return df.where(age >= 0).groupBy(*names(by)).agg(*[F.sum(F.col(s) * weight).alias(f"prior_{s}") for s in sums])


#: Half-lives per block of W8; 2 to this power times the values must stay finite.
BLOCK_HALF_LIVES = 64


def decayed_prior(
    df: DataFrame,
    by: str | Sequence[str],
    day: str,
    half_life_days: float,
    sums: Sequence[str],
) -> DataFrame:
    """Exponentially decayed sums over strictly earlier days.

    Input is one row per key and day (aggregate first).  The calendar is cut into
    blocks of ``BLOCK_HALF_LIVES`` half-lives.  Inside a block the closed form
    sum(x * 2^o) * 2^-o, with o counted from the block's start, replaces the
    day-by-day recursion; what earlier blocks leave is carried from block to
    block, so no power ever exceeds a block's span, however long the history.
    A window holds one key's days of one block; the carry runs over one number
    per key and block with rows.
    """
    by = names(by)
    age = F.unix_date(F.to_date(day)) / F.lit(float(half_life_days))
    rows = df.withColumn("__b", F.floor(age / BLOCK_HALF_LIVES))
    rows = rows.withColumn("__o", age - F.col("__b") * BLOCK_HALF_LIVES)
    grown = F.pow(F.lit(2.0), F.col("__o"))
    # What a block is worth at its end, which is the start of the next.
    worth = rows.groupBy(*by, "__b").agg(
        *[F.coalesce(F.sum(F.col(s) * F.pow(F.lit(2.0), F.col("__o") - BLOCK_HALF_LIVES)), F.lit(0.0)).alias(s) for s in sums]
    )
    blocks = worth.where("__b IS NOT NULL").groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("__b", *[F.col(s) for s in sums]))).alias("__blocks")
    )
    def step(acc, x):
        # The carry at a block's start: the last block's own carry and worth, halved once per half-life since.
        last = F.get(acc, F.size(acc) - 1)
        idle = F.pow(F.lit(2.0), -(x["__b"] - 1 - last["b"]).cast("double") * BLOCK_HALF_LIVES)
        faded = F.lit(2.0 ** -BLOCK_HALF_LIVES)
        return F.concat(acc, F.array(F.struct(
            x["__b"].alias("b"),
            *[F.coalesce((last[f"c_{s}"] * faded + last[f"w_{s}"]) * idle, F.lit(0.0)).alias(f"c_{s}") for s in sums],
            *[x[s].alias(f"w_{s}") for s in sums],
        )))

    shape = ",".join(["b:bigint", *[f"c_{s}:double" for s in sums], *[f"w_{s}:double" for s in sums]])
    carried = F.aggregate("__blocks", F.array().cast(f"array<struct<{shape}>>"), step)
    carry = blocks.select(*[F.col(k).alias(f"__k_{k}") for k in by], F.explode(carried).alias("__c")).select(
        *[f"__k_{k}" for k in by], F.col("__c.b").alias("__cb"), *[F.col(f"__c.c_{s}").alias(f"__c_{s}") for s in sums]
    )
    same = F.col("__b") == F.col("__cb")
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    earlier = (
        Window.partitionBy(*by, "__b").orderBy(F.unix_date(F.to_date(day))).rangeBetween(Window.unboundedPreceding, -1)
    )
    inside = rows.withColumns({f"__s_{s}": F.sum(F.col(s) * grown).over(earlier) for s in sums})
    shrunk = F.pow(F.lit(2.0), -F.col("__o"))
    return inside.join(carry, same, "left").select(
        *df.columns,
        *[
            ((F.coalesce(F.col(f"__s_{s}"), F.lit(0.0)) + F.coalesce(F.col(f"__c_{s}"), F.lit(0.0))) * shrunk)
            .alias(f"prior_{s}")
            for s in sums
        ],
    )


def shrink_rating(
    entity: DataFrame,
    pooled: DataFrame,
    on: str | Sequence[str],
    count: str,
    total: str,
    squares: str,
    prior_weight: float,
    center: float = 100.0,
    scale: float = 15.0,
    minimum_sd: float = 0.05,
) -> DataFrame:
    """Shrink an entity's decayed mean to the pooled one, as an index.

    ``pooled`` has one row per day (bounded by the calendar) with the same
    decayed columns under the prefix ``pooled_``.
    """
    mean = F.coalesce(F.col(f"pooled_{total}") / F.nullif(F.col(f"pooled_{count}"), F.lit(0.0)), F.lit(0.0))
    spread = F.sqrt(
        F.greatest(
            F.col(f"pooled_{squares}") / F.nullif(F.col(f"pooled_{count}"), F.lit(0.0)) - F.col("pooled_mean") * F.col("pooled_mean"),
            F.lit(0.0),
        )
    )
    out = entity.join(pooled, on, "left").withColumn("pooled_mean", mean)
    out = out.withColumn("pooled_sd", F.greatest(F.coalesce(spread, F.lit(minimum_sd)), F.lit(minimum_sd)))
    raw = F.coalesce(F.col(total) / F.nullif(F.col(count), F.lit(0.0)), F.col("pooled_mean"))
    information = F.col(count) + F.lit(float(prior_weight))
    out = out.withColumn("raw_mean", raw).withColumn(
        "shrunk_mean",
        (F.col(count) * F.col("raw_mean") + F.lit(float(prior_weight)) * F.col("pooled_mean")) / information,
    )
    return out.withColumn(
        "rating_index",
        F.lit(center) + F.lit(scale) * (F.col("shrunk_mean") - F.col("pooled_mean")) / F.col("pooled_sd"),
    ).withColumn("rating_standard_error", F.lit(scale) / F.sqrt(F.greatest(information, F.lit(1.0))))


def trend_class(current: Column, previous: Column, comparable: Column, band: float) -> Column:
    """Direction of a change, in points of ``current - previous``."""
    change = current - previous
    return (
        F.when(previous.isNull(), "NEW")
        .when(~comparable, "MODEL_CHANGED")
        .when(F.abs(change) < band, "UNCHANGED")
        .when(change > 0, "INCREASE")
        .otherwise("DECREASE")
    )


def contributions_long(
    df: DataFrame, keys: Sequence[str], terms: Mapping[str, Column]
) -> DataFrame:
    """One row per feature contribution, ranked by absolute size.

    The features of one row sit in one array, so ranking needs no shuffle.
    """
    items = F.array(
        *[
            F.struct((-F.abs(value)).alias("neg"), F.lit(name).alias("feature_name"), value.alias("contribution"))
            for name, value in terms.items()
        ]
    )
    return (
        df.select(*keys, F.posexplode(F.array_sort(items)).alias("pos", "item"))
        .select(
            *keys,
            F.col("item.feature_name").alias("feature_name"),
            F.col("item.contribution").alias("contribution"),
            (F.col("pos") + 1).cast("long").alias("importance_rank"),
        )
    )
