"""Joins and row-shape operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.session import land

from . import skew
from .asof import asof_join
from .quantiles import running_count
from .skew import HOT_ROWS, names


def two_sided(df: DataFrame, keep: Sequence[str], sides: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One row per side of a two-sided row, from a single scan.

    ``sides`` maps a side label to its output columns; all sides list the same
    column names.
    """
    entries = [
        F.struct(F.lit(label).alias("side"), *[c.alias(n) for n, c in columns.items()])
        for label, columns in sides.items()
    ]
    first = next(iter(sides.values()))
    return df.select(*keep, F.explode(F.array(*entries)).alias("__s")).select(
        *keep, "__s.side", *[F.col(f"__s.{n}").alias(n) for n in first]
    )


def mirror_sides(
    df: DataFrame, unit: str | Sequence[str], side: str, labels: tuple[str, str], metrics: Mapping[str, Column]
) -> DataFrame:
    """Own and opposing metrics of both sides of a unit.

    One aggregate per unit and side (map-side combined) replaces the self join:
    both sides are pivoted onto the unit row, then read from either end.
    """
    unit = names(unit)
    a, b = labels
    per_side = df.where(F.col(side).isin(a, b)).groupBy(*unit, side).agg(
        *[c.alias(n) for n, c in metrics.items()]
    )
    wide = per_side.groupBy(*unit).agg(
        *[F.max(F.when(F.col(side) == label, F.struct(*metrics))).alias(f"__{i}") for i, label in enumerate(labels)]
    ).where(F.col("__0").isNotNull() & F.col("__1").isNotNull())

    def columns(own: str, other: str) -> dict[str, Column]:
        out = {f"own_{n}": F.col(f"{own}.{n}") for n in metrics}
        out.update({f"opp_{n}": F.col(f"{other}.{n}") for n in metrics})
        return out

    return two_sided(wide, unit, {a: columns("__0", "__1"), b: columns("__1", "__0")})


def mirror_join(
    df: DataFrame, unit: str | Sequence[str], side: str, opponent: str, take: Mapping[str, str]
) -> DataFrame:
    """J2 for rows already at (unit, side) grain: take the opponent's columns.

    A unit has at most two rows (more fail the query), so its first and last row
    by side are all of it: one exchange, no self join.  Columns are null where
    the opponent is absent.
    """
    unit = names(unit)
    whole = Window.partitionBy(*unit)
    row = F.struct(F.col(side).alias("__side"), *take)
    rows = df.withColumns({
        "__low": F.min(row).over(whole), "__high": F.max(row).over(whole), "__n": F.count(F.lit(1)).over(whole),
    })
    other = F.when(F.col("__low.__side") == F.col(opponent), F.col("__low")).when(
        F.col("__high.__side") == F.col(opponent), F.col("__high")
    )
    ok = F.when(F.col("__n") <= 2, F.lit(True)).otherwise(
        F.raise_error(F.lit("a unit has more than two sides")).cast("boolean")
    )
    rows = rows.where(ok).withColumn("__other", other)
    return rows.select(*df.columns, *[F.col(f"__other.{c}").alias(n) for c, n in take.items()])


def complete_left(
    spine: DataFrame, df: DataFrame, on: str | Sequence[str], zeros: Sequence[str], flag: str | None = None
) -> DataFrame:
    """Keep every spine row; absent measures become zero."""
    joined = spine.join(df.withColumn("__present", F.lit(True)), on, "left")
    present = F.coalesce(F.col("__present"), F.lit(False))
    out = joined.select(
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zeros else F.col(c) for c in joined.columns if c != "__present"],
        present.alias(flag or "__flag"),
    )
    return out if flag else out.drop("__flag")


def join_checked(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    validate: str = "m:1",
    how: str = "inner",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Join with a declared cardinality; a violation fails the query.

    A side that must be unique goes through one aggregate per key that counts its
    rows and carries the columns; repeats meet in it (map-side first), a count
    above one raises in the same job, and its exchange is the one the join needs.
    Hot left keys are cut into salts (``hot_rows`` rows each; None leaves them to
    Spark).  Null keys match nothing and may repeat.
    """
    on = names(on)

    def unique(df: DataFrame, label: str) -> DataFrame:
        known = F.lit(True)
        for k in on:
            known = known & F.col(k).isNotNull()
        rest = [c for c in df.columns if c not in on]
        carried = [F.first(F.struct(*rest)).alias("__r")] if rest else []
        one = df.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), *carried)
        message = F.concat(F.lit(f"{label} side is not unique on {', '.join(on)}: "), F.col("__n").cast("string"))
        ok = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        return one.where(ok).select(*on, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)

    if validate not in ("1:1", "m:1"):
        raise ValueError("validate must be '1:1' or 'm:1'")
    nulls = F.lit(False)
    for k in on:
        nulls = nulls | F.col(k).isNull()
    if how in ("inner", "left"):
        right = unique(right, "right")
    else:
        right = unique(right, "right").unionByName(right.where(nulls))
    if validate == "1:1":
        left = unique(left, "left") if how == "inner" else unique(left, "left").unionByName(left.where(nulls))
    if hot_rows is None or how not in ("inner", "left"):
        return left.join(right, on, how)
    return skew.join_lookup(left, right, on, how, hot_rows)


def bridge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    mapped: Sequence[str],
    right_id: str,
    status: str = "bridge_status",
    labels: tuple[str, str, str] = ("UNMAPPED", "UNMATCHED", "MATCHED"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Match on mapped names and date, and say why a row has no match."""
    found = skew.join_lookup(left, right, on, "left", hot_rows)
    unmapped = F.lit(False)
    for name in mapped:
        unmapped = unmapped | F.col(name).isNull()
    return found.withColumn(
        status,
        F.when(unmapped, labels[0]).when(F.col(right_id).isNull(), labels[1]).otherwise(labels[2]),
    )


def join_either(
    left: DataFrame,
    left_keys: Sequence[str],
    right: DataFrame,
    right_keys: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Join where any left key equals any right key, as one equi-join.

    Keys are exploded to (row, distinct non-null key); a pair that meets on
    several keys is kept once by accepting only its smallest shared key, so pairs
    are never shuffled.  A key with more than ``hot_rows`` exploded rows is cut
    into salts on the side where it is hot, and the other side's rows are copied
    to them; where both are hot, each salt of one meets each salt of the other.
    """
    def exploded(df: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
        values = F.array_distinct(F.array_compact(F.array(*[F.col(k).cast("string") for k in keys])))
        return df.withColumn(f"__{tag}", values).withColumn("__key", F.explode(f"__{tag}"))

    a = exploded(left, left_keys, "a")
    b = exploded(right, right_keys, "b")
    on = ["__key"]
    for name, hot, other in (("__salt_a", "a", "b"), ("__salt_b", "b", "a")):
        sides = {"a": a, "b": b}
        salts = skew.salted_keys(sides[hot].select("__key"), "__key", hot_rows)
        if salts is not None:
            sides[hot] = skew.salted(sides[hot], salts, "__key", name)
            sides[other] = skew.replicated(sides[other], salts, "__key", name)
            a, b = sides["a"], sides["b"]
            on.append(name)
    joined = a.join(b, on)
    shared = F.array_min(F.array_intersect("__a", "__b"))
    return joined.where(F.col("__key") == shared).drop(*on, "__a", "__b")


def semi_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows with a partner; the right side is reduced to distinct keys first."""
    on = names(on)
    return left.join(right.select(*on).distinct(), on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows without a partner."""
    on = names(on)
    return left.join(right.select(*on).distinct(), on, "left_anti")


def within_bounds(df: DataFrame, column: Column, source: DataFrame, low: Column, high: Column) -> DataFrame:
    """Keep rows inside bounds read from another table by scalar subqueries."""
    return df.where((column >= source.agg(low).scalar()) & (column <= source.agg(high).scalar()))


def align_distributions(
    a: DataFrame, b: DataFrame, on: Sequence[str], value: str, names_out: tuple[str, str]
) -> DataFrame:
    """Full outer alignment; an outcome absent on one side has share zero."""
    left = a.select(*on, F.col(value).alias(names_out[0]))
    right = b.select(*on, F.col(value).alias(names_out[1]))
    joined = left.join(right, list(on), "full_outer")
    return joined.select(*on, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names_out])


def resolve_id(
    df: DataFrame,
    directory: DataFrame,
    on: str,
    directory_id: str,
    prefix: str,
    name: str = "resolved_id",
    source: str = "id_source",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The directory id, else the source id in its own namespace."""
    found = skew.join_lookup(df, directory.select(on, directory_id), on, "left", hot_rows)
    return found.withColumn(
        name,
        F.coalesce(F.col(directory_id).cast("string"), F.concat(F.lit(prefix + ":"), F.col(on).cast("string"))),
    ).withColumn(
        source,
        F.when(F.col(directory_id).isNotNull(), "DIRECTORY").when(F.col(on).isNotNull(), "NAMESPACED").otherwise("MISSING"),
    )


def dual_role_join(
    df: DataFrame,
    ratings: DataFrame,
    key: str,
    roles: Mapping[str, str],
    take: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One ratings table joined for two roles (``{"home": "home_id", ...}``).

    Adds ``<role>_<column>`` and ``both_available``.
    """
    out = df
    for role, column in roles.items():
        side = ratings.select(F.col(key).alias(column), *[F.col(c).alias(f"{role}_{c}") for c in take])
        out = skew.join_lookup(out, side, column, "left", hot_rows)
    first, second = list(roles)
    return out.withColumn(
        "both_available", F.col(f"{first}_{take[0]}").isNotNull() & F.col(f"{second}_{take[0]}").isNotNull()
    )


def pooled_error(a: Column, b: Column) -> Column:
    """Standard error of a difference of two independent ratings."""
    return F.sqrt(a * a + b * b)


def match_audit(df: DataFrame, other: DataFrame, on: Sequence[str], pairs: Mapping[str, str]) -> DataFrame:
    """Left join with null-propagating equality flags ``<column>_matches``."""
    joined = df.join(other, list(on), "left")
    return joined.select(
        "*", *[(F.col(a) == F.col(b)).alias(f"{a}_matches") for a, b in pairs.items()]
    )


def z_scores(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Population z-scores ``<value>_z`` over a whole table.

    All moments come from one aggregate, read as one scalar subquery.
    """
    moments = df.agg(F.struct(*[
        c for i, v in enumerate(values) for c in (F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"))
    ])).scalar()
    return df.withColumns({
        f"{v}_z": (F.col(v) - moments[f"m{i}"]) / F.nullif(moments[f"s{i}"], F.lit(0.0)) for i, v in enumerate(values)
    })


def compare_ratings(
    a: DataFrame, b: DataFrame, on: str, a_value: str, b_value: str
) -> DataFrame:
    """Z-score gap of two rating sources on their common entities."""
    joined = z_scores(a.select(on, a_value).join(b.select(on, b_value), on), [a_value, b_value])
    return joined.withColumn("z_gap", F.col(f"{a_value}_z") - F.col(f"{b_value}_z"))


def blend(a: DataFrame, b: DataFrame, on: str, value: str, weight: float) -> DataFrame:
    """``weight*a + (1-weight)*b``; an entity on one side only fails the query."""
    left = a.select(on, F.col(value).alias("__a"))
    right = b.select(on, F.col(value).alias("__b"))
    joined = left.join(right, on, "full_outer")
    missing = F.col("__a").isNull() | F.col("__b").isNull()
    mixed = F.lit(weight) * F.col("__a") + F.lit(1.0 - weight) * F.col("__b")
    return joined.select(
        on,
        F.when(missing, F.raise_error(F.lit("sources cover different entities"))).otherwise(mixed).alias(value),
    )


def rank_in_sample(
    rows: DataFrame,
    sample: DataFrame,
    by: str | Sequence[str],
    value: str,
    edges: Sequence[str],
) -> DataFrame:
    """How many sample values of a row's group lie below / up to each edge column.

    Adds ``<edge>_lt``, ``<edge>_le`` and ``sample_size``.  The sample becomes a
    distinct-value count table with running totals; the distinct edges, written
    once, find their places in it by one as-of join, so rows x sample pairs are
    never formed and only group and edge are sorted.  Each edge of a row then looks
    its place up; Spark broadcasts the places where they are few, and edges that
    very many rows share are salted by the counts at hand.
    """
    by = names(by)
    counts = sample.groupBy(*by, F.col(value).alias("__r")).agg(F.count(F.lit(1)).alias("__c"))
    counts = running_count(counts, by, "__r", "__c")
    total = land(counts.groupBy(*by).agg(F.max("__cum").alias("sample_size")), "sizes")
    side = counts.select(
        *by, "__r", F.col("__cum").alias("__upto"), (F.col("__cum") - F.col("__c")).alias("__under"),
        F.col("__r").alias("__at"),
    )
    spots = land(
        rows.select(*by, F.explode(F.array(*edges)).alias("__e")).groupBy(*by, "__e").agg(F.count(F.lit(1)).alias("__n")), "edges"
    )
    found = asof_join(spots, side, by, "__e", "__r", [], ["__upto", "__under", "__at"], strict=False).where("__e IS NOT NULL")
    upto = F.coalesce(F.col("__upto"), F.lit(0))
    # A value equal to the edge is the one just found.
    below = F.when(F.col("__at") == F.col("__e"), F.col("__under")).otherwise(upto)
    places = land(found.dropna("any", subset=by).select(*by, "__e", upto.alias("__le"), below.alias("__lt")), "places")
    out = rows
    for edge in edges:
        looked = skew.join_lookup(
            out.withColumn("__e", F.col(edge).cast(spots.schema["__e"].dataType)), places, [*by, "__e"], "left", counted=spots
        )
        out = looked.select(*out.columns, F.coalesce("__lt", F.lit(0)).alias(f"{edge}_lt"), F.coalesce("__le", F.lit(0)).alias(f"{edge}_le"))
    sized = spots.groupBy(*by).agg(F.ceil(F.sum("__n") / len(edges)).alias("__n"))
    return skew.join_lookup(out, total, by, "left", counted=sized).select(*out.columns, "sample_size")


def empirical_probability(
    offers: DataFrame,
    residuals: DataFrame,
    by: str | Sequence[str],
    threshold: str,
    residual: str,
) -> DataFrame:
    """Share of a mode's residuals above, equal to and below a threshold."""
    out = rank_in_sample(offers, residuals, by, residual, [threshold])
    n = F.nullif(F.col("sample_size"), F.lit(0))
    lt, le = F.col(f"{threshold}_lt"), F.col(f"{threshold}_le")
    return out.select(
        *offers.columns, "sample_size",
        ((F.col("sample_size") - le) / n).alias("share_above"),
        ((le - lt) / n).alias("share_equal"),
        (lt / n).alias("share_below"),
    )
