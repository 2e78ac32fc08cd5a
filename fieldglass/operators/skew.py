"""Keys that hold a large share of all rows.

Every per-key operator here must stay balanced when one key owns, say, a third
of the table.  The building blocks:

* ``hot_keys``      the few keys above a row threshold, counted by one
                    map-side combined job; fewer keys than rows / ``HOT_ROWS``, so
                    broadcasting them is safe at any data size.  Keys beyond
                    the limit are simply handled on the ordinary path.
* ``split_hot``     rows of ordinary keys / rows of hot keys, by broadcast
                    semi and anti joins (no shuffle).
* ``attach_totals`` per-key aggregates beside every row.
* ``join_lookup``   many-to-one join whose left side may be skewed.
* ``cut_in_order``  hot keys as even, consecutive pieces; ``piece_prefix`` and
                    ``join_pieces`` carry running state across them.
* ``ordered_rank``  exact row position inside a key, no single-task sort.

The count job reads only the key columns and is skipped when the tables read are
estimated below ``SMALL_BYTES``, where no key can be a burden.  Without hot keys
the plan is the ordinary one-exchange plan.  Splitting never changes a result,
only where rows are processed.  An expensive input that does have hot keys is
worth a ``session.land`` first, because both halves read it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.session import land

#: Rows of one key that one task handles without help.
HOT_ROWS = 2_000_000
#: Rows of one piece of a hot key.
PIECE_ROWS = 2_000_000
#: Inputs estimated below this are not examined for hot keys.
SMALL_BYTES = 64 * 1024 * 1024


def names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _hot_alias(keys: Sequence[str]) -> list[str]:
    return [f"__hot_{i}" for i in range(len(keys))]


def _same(keys: Sequence[str], aliases: Sequence[str]) -> Column:
    """Null-safe equality, still an equi-join for Catalyst."""
    tests = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, aliases)]
    return reduce(lambda a, b: a & b, tests)


def is_small(df: DataFrame) -> bool:
    """Whether the tables a plan reads are estimated below ``SMALL_BYTES`` in all."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total < SMALL_BYTES


def hot_keys(
    df: DataFrame, by: str | Sequence[str], hot_rows: int | None = HOT_ROWS
) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows; None if there are none.

    All of them: there are fewer than the table's rows divided by ``hot_rows``.

    ``hot_rows=None`` states that groups are bounded and skips the count.
    """
    by = names(by)
    if not by or hot_rows is None or (hot_rows >= HOT_ROWS and is_small(df)):
        return None
    counted = (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > hot_rows)
        .orderBy(F.desc("__n"))
        .select(*[F.col(k).alias(a) for k, a in zip(by, _hot_alias(by))])
    )
    found = counted.collect()  # fewer keys than rows / hot_rows
    return df.sparkSession.createDataFrame(found, counted.schema) if found else None


def split_hot(
    df: DataFrame,
    by: str | Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None)."""
    by = names(by)
    hot = hot_keys(df, by, hot_rows)
    if hot is None:
        return df, None
    test = _same(by, _hot_alias(by))
    side = F.broadcast(hot)
    return df.join(side, test, "left_anti"), df.join(side, test, "left_semi")


def attach_totals(
    df: DataFrame,
    by: str | Sequence[str],
    hot_rows: int = HOT_ROWS,
    **totals: Column,
) -> DataFrame:
    """Add aggregates of each key to all its rows.

    Ordinary keys use one unordered window (a single exchange).  A hot key's
    aggregate is built map-side first and comes back as a broadcast of one row
    per hot key, so its rows never meet in one task.
    """
    by = names(by)
    cold, hot = split_hot(df, by, hot_rows)
    window = Window.partitionBy(*by)
    cold = cold.select("*", *[c.over(window).alias(n) for n, c in totals.items()])
    if hot is None:
        return cold
    aliases = _hot_alias(by)
    # One group per hot key, since `hot` holds only those keys.
    sums = hot.groupBy(*[F.col(k).alias(a) for k, a in zip(by, aliases)]).agg(
        *[c.alias(n) for n, c in totals.items()]
    )
    hot = hot.join(F.broadcast(sums), _same(by, aliases), "inner").drop(*aliases)
    return cold.unionByName(hot)


def join_lookup(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Many-to-one join; ``right`` holds one row per key.

    Left rows of hot keys are tagged in the one scan of the left side and cut into
    salts, to which the few right rows of these keys are copied; all rows then
    meet in one ordinary equi-join, which Spark may itself turn into a broadcast
    when the measured size allows.  ``counted`` has the left rows of each key
    (``__n``) where the caller knows them; the left side is then not counted.
    """
    if how not in ("left", "inner"):
        raise ValueError("join_lookup supports left and inner joins")
    on = names(on)
    salts = salted_keys(left, on, hot_rows) if counted is None else _salts(counted, on, hot_rows)
    if salts is None:
        return left.join(right, on, how)
    few, many = salted(left, salts, on), replicated(right, salts, on)
    return few.join(many, [*on, "__salt"], how).drop("__salt")


def salted_keys(df: DataFrame, by: str | Sequence[str], hot_rows: int | None = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and into how many salts to cut them (``__salts``); None if there are none.

    One map-side combined count; fewer rows than the table's divided by ``hot_rows``.
    """
    by = names(by)
    if not by or hot_rows is None or (hot_rows >= HOT_ROWS and is_small(df)):
        return None
    return _salts(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), by, hot_rows)


def _salts(counted: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame | None:
    hot = counted.where(F.col("__n") > hot_rows).select(
        *[F.col(k).alias(a) for k, a in zip(by, _hot_alias(by))],
        F.ceil(F.col("__n") / F.lit(max(hot_rows, 1))).cast("long").alias("__salts"),
    )
    found = hot.collect()
    return counted.sparkSession.createDataFrame(found, hot.schema) if found else None


def salted(df: DataFrame, salts: DataFrame, by: str | Sequence[str], name: str = "__salt") -> DataFrame:
    """Give the rows of hot keys one of their key's salts, by a hash of the row; others get 0.  The input is read once."""
    by = names(by)
    plain = [c for c, kind in df.dtypes if not any(x in kind for x in ("map<", "variant", "interval"))]
    tagged = df.join(F.broadcast(salts), _same(by, _hot_alias(by)), "left")
    salt = F.coalesce(F.pmod(F.xxhash64(*plain), F.col("__salts")), F.lit(0).cast("long"))
    return tagged.select(*df.columns, salt.alias(name))


def replicated(df: DataFrame, salts: DataFrame, by: str | Sequence[str], name: str = "__salt") -> DataFrame:
    """Copy the rows of hot keys to each of the key's salts; others get 0."""
    by = names(by)
    tagged = df.join(F.broadcast(salts), _same(by, _hot_alias(by)), "left")
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1).cast("long")) - 1)
    return tagged.select(*df.columns, F.explode(every).alias(name))


def cut_in_order(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Cut keys into consecutive pieces of about ``PIECE_ROWS`` rows along ``order``.

    Adds ``__piece``, increasing along (keys, order).  Spark's range partitioner
    samples the full sort key, so pieces stay even whatever the distribution -
    also when one day or one value holds most rows, provided ``order`` ends in a
    (nearly) unique column.  Its boundaries belong to one run, hence the pieces
    are written once and read back by all later steps.
    """
    count = max(1, -(-rows.count() // PIECE_ROWS))
    sort = [F.asc_nulls_first(k) for k in by]
    ranged = rows.repartitionByRange(count, *sort, *order).withColumn("__piece", F.spark_partition_id())
    return land(ranged, "pieces")


def piece_prefix(rows: DataFrame, by: Sequence[str], **parts: Column) -> DataFrame:
    """Per (key, piece): the combination of all *earlier* pieces of the key.

    ``parts`` are aggregates that combine by ``sum``, or by ``max`` where the
    name starts with ``max_``.  The window runs over one row per piece.
    """
    summary = rows.groupBy(*by, "__piece").agg(*[c.alias(n) for n, c in parts.items()])
    earlier = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for name in parts:
        if name.startswith("max_"):
            out.append(F.max(name).over(earlier).alias(name))
        else:
            out.append(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name))
    return summary.select(*by, "__piece", *out)


def join_pieces(rows: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bring per-piece values to the rows.

    There is one summary row per piece and key in it - at most the number of
    pieces plus the number of cut keys - so it is broadcast.
    """
    keys = [*by, "__piece"]
    aliases = [f"__j_{i}" for i in range(len(keys))]
    side = summary.select(
        *[F.col(k).alias(a) for k, a in zip(keys, aliases)],
        *[c for c in summary.columns if c not in keys],
    )
    return rows.join(F.broadcast(side), _same(keys, aliases), "inner").drop(*aliases)


def ordered_rank(
    df: DataFrame, by: str | Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """1-based row position inside a key; a task sorts one piece only."""
    by = names(by)
    rows = cut_in_order(df, by, order)
    rows = join_pieces(rows, piece_prefix(rows, by, __before=F.count(F.lit(1))), by)
    inside = Window.partitionBy(*by, "__piece").orderBy(*order)
    return rows.withColumn(name, F.col("__before") + F.row_number().over(inside)).drop("__before", "__piece")
