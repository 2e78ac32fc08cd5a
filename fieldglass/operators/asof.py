"""As-of joins and trailing-N joins.

Left and right rows are stacked and swept once in time order, so no pair of
rows is ever formed.  A hot key is swept piece by piece, each piece starting
from the latest right row of the earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.session import land

from . import skew
from .skew import HOT_ROWS, names


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str | Sequence[str],
    left_ts: str,
    right_ts: str,
    ties: Sequence[str],
    payload: Sequence[str],
    strict: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The latest right row before each left row (at or before, if not strict).

    ``ties`` order right rows of one time; the last wins.  ``payload`` columns of
    the right side are added (``right_ts`` included only if listed); they are
    null where nothing qualifies.  As in SQL a null key or a null time equals
    and precedes nothing: such right rows are dropped, such left rows stay and
    find nothing.
    """
    by = names(by)
    left_cols = [c for c in left.columns if c not in by]
    # Payload that is time or tie anyhow is read from there and not carried twice.
    held = {t: f"__tie{i}" for i, t in enumerate(ties)} | {right_ts: "__rts"}
    carried = [c for c in payload if c not in held]
    side = right.dropna("any", subset=[*by, right_ts]).select(
        *by,
        F.col(right_ts).alias("__ts"),
        F.struct(F.col(right_ts).alias("__rts"), *[F.col(t).alias(f"__tie{i}") for i, t in enumerate(ties)],
                 *([F.struct(*carried).alias("__payload")] if carried else [])).alias("__right"),
    )
    base = left.select(
        *by,
        F.col(left_ts).alias("__ts"),
        F.struct(*left_cols).alias("__left"),
    )
    stacked = base.unionByName(side, allowMissingColumns=True)

    # At one time: left rows first if strict, so they see earlier rows only.
    left_first = F.col("__left").isNull() if strict else F.col("__left").isNotNull()
    along = [F.col("__ts"), left_first.cast("int")]
    best = F.max("__right")

    cold, hot = skew.split_hot(stacked, by, hot_rows)

    def sweep(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("__found", best.over(window)).where(F.col("__left").isNotNull())

    found = sweep(cold, by).select(*by, "__left", "__found")
    if hot is not None:
        # The hash keeps rows of one time apart, so that they can be cut too; rows
        # of one time are then in no order, hence the greater of both candidates.
        hot = skew.cut_in_order(hot, by, [*along, F.xxhash64("__left", "__right")])
        carried = skew.piece_prefix(hot, by, max_right=F.max("__right"))
        hot = skew.join_pieces(sweep(hot, [*by, "__piece"]), carried, by)
        hot = hot.select(*by, "__left", F.greatest("__found", "max_right").alias("__found"))
        found = found.unionByName(hot)

    return found.select(
        *by,
        *[F.col(f"__left.{c}").alias(c) for c in left_cols],
        *[F.col(f"__found.{held[c]}" if c in held else f"__found.__payload.{c}").alias(c) for c in payload],
    )


def latest_before(
    entry: DataFrame,
    candidates: DataFrame,
    by: str | Sequence[str],
    after: str,
    deadline: str,
    candidate_ts: str,
    ties: Sequence[str],
    payload: Sequence[str],
    **tuning,
) -> DataFrame:
    """The latest candidate in ``(after, deadline)``.

    The latest row before the deadline either lies after the entry or nothing
    does, so one strict as-of join at the deadline answers the range question.
    """
    found = asof_join(
        entry, candidates.withColumn("__cts", F.col(candidate_ts)), by, deadline, "__cts",
        ties, [*payload, "__cts"], strict=True, **tuning,
    )
    inside = F.col("__cts") > F.col(after)
    return found.select(
        *entry.columns, *[F.when(inside, F.col(p)).alias(p) for p in payload]
    )


def snapshot_asof(
    spine: DataFrame,
    snapshots: DataFrame,
    by: str | Sequence[str],
    spine_ts: str,
    snapshot_ts: str,
    strict: bool = False,
    how: str = "inner",
    **tuning,
) -> DataFrame:
    """The newest snapshot up to a date, then all rows of that snapshot."""
    by = names(by)
    moments = snapshots.select(*by, F.col(snapshot_ts).alias("__snapshot")).distinct()
    chosen = asof_join(
        spine, moments, by, spine_ts, "__snapshot", [], ["__snapshot"], strict=strict, **tuning
    )
    rows = snapshots.withColumn("__snapshot", F.col(snapshot_ts))
    return chosen.join(rows, [*by, "__snapshot"], how).drop("__snapshot")


def _running_sums(history: DataFrame, by: Sequence[str], day: str, order: Sequence[str], hot_rows: int | None) -> DataFrame:
    """Per history row: its rank in the key and the sums up to it.

    Columns: by, day, __rank, and for count, sum and sum of squares of the values
    (``__x``) what lies in the row's own piece up to it (``__in_*``) and in the
    pieces before (``__at_*``).  Kept apart, differences inside a piece stay exact
    to the digits of a piece, however long the history.
    """
    sort = [F.asc(day), *[F.asc_nulls_first(c) for c in order]]
    x = F.coalesce(F.col("__x"), F.lit(0.0))
    parts = {"n": F.count("__x"), "s": F.sum(x), "q": F.sum(x * x)}
    cold, hot = (None, history) if not by else skew.split_hot(history, by, hot_rows)

    def inside(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        sums = {f"__in_{k}": c.over(window) for k, c in parts.items()}
        return rows.withColumns({"__row": F.count(F.lit(1)).over(window), **sums})

    out = None
    columns = [*by, day, "__rank", *[f"__{side}_{k}" for side in ("in", "at") for k in parts]]
    if cold is not None:
        zero = {f"__at_{k}": F.lit(0).cast("long" if k == "n" else "double") for k in parts}
        out = inside(cold, by).withColumns({"__rank": F.col("__row"), **zero}).select(*columns)
    if hot is not None:
        pieces = skew.cut_in_order(hot, by, [*sort, F.xxhash64(*hot.columns)])
        before = skew.piece_prefix(pieces, by, __before=F.count(F.lit(1)), **{f"__at_{k}": c for k, c in parts.items()})
        rows = skew.join_pieces(inside(pieces, [*by, "__piece"]), before, by)
        rows = rows.withColumn("__rank", F.col("__before") + F.col("__row")).select(*columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def trailing_n(
    targets: DataFrame,
    history: DataFrame,
    day: str,
    order: Sequence[str],
    value: str,
    sizes: Sequence[int],
    by: str | Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Count, mean and sample sd of the last N rows on earlier days.

    Without ``by`` history is pooled over all entities.  Every history row gets
    its rank along (day, order) and running sums; a target needs the sums at the
    last rank before its day and those N ranks earlier, which two equi-joins
    fetch.  The pooled history, and hot keys, are ranked piece by piece.  Rows
    without a value count as rows but not in the moments; history without day or
    key is left out; targets without history get the count 0.
    """
    by = names(by)
    history = history.dropna("any", subset=[*by, day])
    # Values about their (whole) mean: the squares stay small beside the differences, sums of whole numbers exact.
    center = F.coalesce(history.agg(F.round(F.avg(F.col(value).cast("double"))).alias("m")).scalar(), F.lit(0.0))
    rows = history.select(*by, day, *[c for c in order if c not in (*by, day)], (F.col(value).cast("double") - center).alias("__x"))
    sums = land(_running_sums(rows, by, day, order, hot_rows), "running")
    moments = [f"__{side}_{k}" for side in ("in", "at") for k in ("n", "s", "q")]

    # The last row of each key and day: at most one per calendar day in a key.
    keys = by or ["__all"]
    pooled = (lambda df: df) if by else (lambda df: df.withColumn("__all", F.lit(0)))
    last = sums.groupBy(*by, day).agg(F.max(F.struct("__rank", *moments)).alias("__end"))
    wanted = pooled(targets).select(*keys, day).distinct()
    ends = asof_join(wanted, pooled(last), keys, day, day, [], ["__end"], hot_rows=None)

    # N ranks earlier: one row per size, fetched by (key, rank).
    starts = ends.where("__end is not null").select(*by, day, F.col("__end.__rank").alias("__to"), F.explode(F.array(*[F.lit(int(n)) for n in sizes])).alias("__size"))
    starts = starts.withColumn("__rank", F.col("__to") - F.col("__size")).where(F.col("__rank") > 0)
    found = starts.join(sums.drop(day), [*by, "__rank"]).groupBy(*by, day).agg(
        *[F.first(F.when(F.col("__size") == n, F.struct(*moments)), ignorenulls=True).alias(f"__start_{n}") for n in sizes]
    )
    out = ends.drop("__all").join(found, [*by, day], "left")
    for size in sizes:
        end, start = F.col("__end"), F.col(f"__start_{size}")

        def between(k: str, end: Column = end, start: Column = start) -> Column:
            inside = end[f"__in_{k}"] - F.coalesce(start[f"__in_{k}"], F.lit(0))
            return inside + (end[f"__at_{k}"] - F.coalesce(start[f"__at_{k}"], F.lit(0)))

        n, s, q = (between(k) for k in ("n", "s", "q"))
        spread = F.greatest((q - s * s / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
        out = out.withColumns({
            f"count_last_{size}": F.least(F.coalesce(end["__rank"], F.lit(0)), F.lit(size)).cast("long"),
            f"mean_last_{size}": F.when(n > 0, (s + n * center) / F.nullif(n, F.lit(0))),
            f"sd_last_{size}": F.when(n > 1, F.sqrt(spread)),
        })
    features = [f"{k}_last_{size}" for size in sizes for k in ("count", "mean", "sd")]
    return targets.join(out.select(*by, day, *features), [*by, day], "left")
