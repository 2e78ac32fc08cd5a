"""Grouped summaries (A1-A26); all built on map-side combined aggregates."""

from __future__ import annotations

from functools import reduce
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import align_distributions
from .quantiles import exact_quantiles
from .skew import names


def ratio(numerator: Column, denominator: Column) -> Column:
    """Safe ratio: null on a zero denominator."""
    return numerator / F.nullif(denominator.cast("double"), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def agg_where(df: DataFrame, by: str | Sequence[str], specs: Mapping[str, tuple[str, Column, Column]]) -> DataFrame:
    """A1: ``{name: (function, value, condition)}`` with count, sum, avg, min or max."""
    functions = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    return df.groupBy(*names(by)).agg(
        *[functions[fn](F.when(cond, value)).alias(name) for name, (fn, value, cond) in specs.items()]
    )


def rollup_roles(
    df: DataFrame, by: str | Sequence[str], any_of: Mapping[str, Column], distinct: str, smallest: Sequence[str]
) -> DataFrame:
    """A2: role flags, distinct count with a conflict flag, smallest values."""
    return df.groupBy(*names(by)).agg(
        *[F.bool_or(c).alias(n) for n, c in any_of.items()],
        F.countDistinct(distinct).alias(f"{distinct}_count"),
        *[F.min(c).alias(f"min_{c}") for c in smallest],
    ).withColumn("has_conflict", F.col(f"{distinct}_count") > 1)


def top_by(
    df: DataFrame, by: str | Sequence[str], value: Column, ties: Sequence[Column], take: Sequence[str],
    where: Column | None = None, largest: bool = True,
) -> DataFrame:
    """A3: columns of a group's extreme row; ``ties`` break equal values the same way."""
    pick = F.max_by if largest else F.min_by
    row = F.struct(*take)
    best = pick(row if where is None else F.when(where, row), F.struct(value, *ties) if where is None else F.when(where, F.struct(value, *ties)))
    return df.groupBy(*names(by)).agg(best.alias("__b")).select(
        *names(by), *[F.col(f"__b.{c}").alias(c) for c in take]
    )


def pivot_sides(
    df: DataFrame, by: str | Sequence[str], side: str, labels: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """A4: ``<label>_<value>`` columns by conditional max."""
    return df.groupBy(*names(by)).agg(
        *[F.max(F.when(F.col(side) == s, F.col(v))).alias(f"{s.lower()}_{v}") for s in labels for v in values]
    )


def multi_scope(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    scopes: Mapping[str, Column],
    measures: Mapping[str, Column],
) -> DataFrame:
    """A5: grouping sets x sample scopes in one pass.

    A row carries the tags of the scopes it belongs to; absent grouping columns
    read ``ALL``.
    """
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in scopes.items()]))
    dims = list(dict.fromkeys(c for s in sets for c in s))
    tagged = df.withColumn("scope", F.explode(tags))
    grouped = tagged.groupingSets(
        [[F.col("scope"), *[F.col(c) for c in s]] for s in sets], F.col("scope"), *[F.col(c) for c in dims]
    ).agg(*[m.alias(n) for n, m in measures.items()], *[F.grouping(c).alias(f"__g_{c}") for c in dims])
    return grouped.select(
        "scope",
        *[F.when(F.col(f"__g_{c}") == 1, "ALL").otherwise(F.col(c).cast("string")).alias(c) for c in dims],
        *measures,
    )


def weighted_summary(
    df: DataFrame, by: str | Sequence[str], weight: str, metrics: Sequence[str]
) -> DataFrame:
    """Weighted mean, worst fold and population sd per metric."""
    w = F.col(weight)
    out = []
    for m in metrics:
        out += [
            ratio(F.sum(w * F.col(m)), F.sum(w)).alias(f"weighted_{m}"),
            F.max(m).alias(f"worst_{m}"),
            F.stddev_pop(m).alias(f"sd_{m}"),
        ]
    return df.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("fold_count"), F.sum(w).alias("weight_total"), *out)


def versus_baseline(df: DataFrame, candidate: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """``delta_<metric>`` against the baseline candidate of a report table.

    A report has one row per candidate, so an unpartitioned window is bounded
    and the table behind it is computed once.
    """
    whole = Window.partitionBy()
    return df.select("*", *[
        (F.col(m) - F.max(F.when(F.col(candidate) == baseline, F.col(m))).over(whole)).alias(f"delta_{m}") for m in metrics
    ])


def _beside(groups: DataFrame, points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Quantiles beside all groups: the null group too, and nulls for groups without a value."""
    if not by:
        # One row each; the scalar is null if there is no value.
        return groups.select("*", *[points.select(c).scalar().alias(c) for c in points.columns])
    side = points.select(*[F.col(k).alias(f"__k_{k}") for k in by], *[c for c in points.columns if c not in by])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by])
    return groups.join(side, same, "left").drop(*[f"__k_{k}" for k in by])


def dist_summary(
    df: DataFrame, by: str | Sequence[str], value: str,
    quantiles: Mapping[str, float] = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95},
) -> DataFrame:
    """Moments, error sizes and exact percentiles of a signed value."""
    by = names(by)
    x = F.col(value)
    moments = df.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.avg(F.abs(x)).alias("mae"),
        F.sqrt(F.avg(x * x)).alias("rmse"),
    )
    return _beside(moments, exact_quantiles(df, by, value, dict(quantiles)), by)


def calibration_line(df: DataFrame, by: str | Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares line of y on x and the spread ratio of x to y.

    Moments are taken about zero in one pass; no variance in x gives nulls.
    """
    slope = F.regr_slope(y, x)
    return df.groupBy(*names(by)).agg(
        F.regr_count(y, x).alias("n"),
        F.when(F.var_pop(x) > 0, slope).alias("slope"),
        F.when(F.var_pop(x) > 0, F.regr_intercept(y, x)).alias("intercept"),
        ratio(F.stddev_pop(x), F.stddev_pop(y)).alias("sd_ratio"),
    )


def probability_bin(p: Column, bins: int, edge: str = "left") -> Column:
    """Bin number from 0; ``left`` closes bins on the left, ``right`` on the right."""
    if edge == "left":
        return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("long")
    return F.greatest(F.ceil(p * bins) - 1, F.lit(0)).cast("long")


def calibration_bins(
    df: DataFrame, by: str | Sequence[str], p: str, y: str, bins: int = 10, edge: str = "left"
) -> DataFrame:
    """Predicted and observed rate per probability bin."""
    return (
        df.withColumn("bin", probability_bin(F.col(p), bins, edge))
        .groupBy(*names(by), "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(p).alias("mean_probability"),
            F.avg(F.col(y).cast("double")).alias("observed_rate"),
        )
        .withColumn("gap", F.col("observed_rate") - F.col("mean_probability"))
    )


def ece(df: DataFrame, by: str | Sequence[str], p: str, y: str, bins: int = 10, edge: str = "left") -> DataFrame:
    """Expected and maximum calibration error."""
    table = calibration_bins(df, by, p, y, bins, edge)
    return table.groupBy(*names(by)).agg(
        F.sum("n").alias("n"),
        ratio(F.sum(F.col("n") * F.abs("gap")), F.sum("n")).alias("ece"),
        F.max(F.abs("gap")).alias("max_gap"),
    )


def concentration(df: DataFrame, by: str | Sequence[str], value: str, limits: Sequence[float]) -> DataFrame:
    """A10: how strongly a value piles up: counts past limits, median, maximum."""
    by = names(by)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[count_where(F.col(value) >= limit).alias(f"n_ge_{int(limit)}") for limit in limits],
        F.max(value).alias("max_value"),
    )
    return _beside(counts, exact_quantiles(df, by, value, {"median_value": 0.5}), by)


def segment_summary(
    df: DataFrame, topics: Mapping[str, Mapping[str, Column]], measures: Mapping[str, Column]
) -> DataFrame:
    """Overlapping named segments in one scan instead of a union of scans."""
    tags = [
        F.when(test, F.struct(F.lit(topic).alias("topic"), F.lit(segment).alias("segment")))
        for topic, segments in topics.items()
        for segment, test in segments.items()
    ]
    return (
        df.withColumn("__tag", F.explode(F.array_compact(F.array(*tags))))
        .groupBy(F.col("__tag.topic").alias("topic"), F.col("__tag.segment").alias("segment"))
        .agg(*[m.alias(n) for n, m in measures.items()])
    )


def long_features(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide to long: one row per (row, feature)."""
    items = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("feature_value")) for f in features])
    return df.select(*keep, F.explode(items).alias("__f")).select(*keep, "__f.feature_name", "__f.feature_value")


def drift(df: DataFrame, is_holdout: Column, features: Sequence[str]) -> DataFrame:
    """Standardised mean difference development -> holdout per feature."""
    rows = long_features(df.withColumn("__h", is_holdout), ["__h"], features)
    x = F.col("feature_value")
    dev, hold = ~F.col("__h"), F.col("__h")
    return rows.groupBy("feature_name").agg(
        F.avg(F.when(dev, x)).alias("development_mean"),
        F.avg(F.when(hold, x)).alias("holdout_mean"),
        F.stddev_pop(F.when(dev, x)).alias("development_sd"),
    ).withColumn(
        "standardized_difference",
        ratio(F.col("holdout_mean") - F.col("development_mean"), F.col("development_sd")),
    )


def disagreement(df: DataFrame, by: str | Sequence[str], a: str, b: str, y: str) -> DataFrame:
    """How often two probabilities pick different sides, and who is right."""
    pa, pb, hit = F.col(a) >= 0.5, F.col(b) >= 0.5, F.col(y) == 1
    differ = pa != pb
    toward = F.when(hit, F.col(b) - F.col(a)).otherwise(F.col(a) - F.col(b))
    return df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(differ).alias("n_disagree"),
        ratio(count_where(differ), F.count(F.lit(1))).alias("disagreement_rate"),
        count_where(differ & (pa == hit)).alias("first_right"),
        count_where(differ & (pb == hit)).alias("second_right"),
        F.avg(toward).alias("directed_change"),
    )


def extreme_rates(df: DataFrame, by: str | Sequence[str], value: Column, limits: Sequence[float]) -> DataFrame:
    """Count and rate past each limit; a wide aggregate, then a local unpivot."""
    wide = df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"), *[count_where(value >= t).alias(f"__t{i}") for i, t in enumerate(limits)]
    )
    items = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"__t{i}").alias("n_extreme")) for i, t in enumerate(limits)])
    return wide.select(*names(by), "n", F.explode(items).alias("__i")).select(
        *names(by), "n", "__i.threshold", "__i.n_extreme", ratio(F.col("__i.n_extreme"), F.col("n")).alias("extreme_rate")
    )


def records(df: DataFrame, by: str | Sequence[str], own: Column, other: Column) -> DataFrame:
    """Wins, losses, ties and win share (ties half) per entity."""
    grouped = df.groupBy(*names(by)).agg(
        count_where(own > other).alias("wins"),
        count_where(own < other).alias("losses"),
        count_where(own == other).alias("ties"),
    )
    played = F.col("wins") + F.col("losses") + F.col("ties")
    return grouped.withColumn("win_share", ratio(F.col("wins") + F.lit(0.5) * F.col("ties"), played))


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys found more than once."""
    return df.groupBy(*names(key)).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def log_loss(p: Column, y: Column, epsilon: float) -> Column:
    q = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1.0 - epsilon))
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def probability_metrics(
    df: DataFrame, by: str | Sequence[str], p: str, y: str, epsilon: float = 1e-15
) -> DataFrame:
    """Brier score, log loss and accuracy at one half."""
    q, t = F.col(p), F.col(y).cast("double")
    return df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((q - t) * (q - t)).alias("brier"),
        F.avg(log_loss(q, t, epsilon)).alias("log_loss"),
        F.avg(((q >= 0.5) == (t == 1.0)).cast("double")).alias("accuracy"),
    )


def regression_metrics(df: DataFrame, by: str | Sequence[str], prediction: str, y: str) -> DataFrame:
    """MAE, RMSE, bias, R squared."""
    error = F.col(prediction) - F.col(y)
    return df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
        (F.lit(1.0) - ratio(F.avg(error * error), F.var_pop(y))).alias("r2"),
    )


def paired_losses(
    df: DataFrame, unit: Sequence[str], candidate: str, loss: str, base: str, challenger: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Challenger minus base loss per unit; one aggregate, no self join.

    Units covered by only one of the two fail the query.
    """
    wide = df.where(F.col(candidate).isin(base, challenger)).groupBy(*unit, *keep).agg(
        F.max(F.when(F.col(candidate) == base, F.col(loss))).alias("base_loss"),
        F.max(F.when(F.col(candidate) == challenger, F.col(loss))).alias("challenger_loss"),
    )
    missing = F.col("base_loss").isNull() | F.col("challenger_loss").isNull()
    delta = F.when(missing, F.raise_error(F.lit("candidates cover different rows"))).otherwise(
        F.col("challenger_loss") - F.col("base_loss")
    )
    return wide.withColumn("loss_delta", delta)


def paired_compare(
    df: DataFrame, unit: Sequence[str], candidate: str, loss: str, base: str, challenger: str,
    fold: str | None = None, tolerance: float = 1e-12,
) -> DataFrame:
    """Mean delta and win / loss / equal rates, pooled and per fold."""
    pairs = paired_losses(df, unit, candidate, loss, base, challenger, [fold] if fold else [])
    d = F.col("loss_delta")
    one = F.lit(1.0)
    measures = {
        "n": F.count(F.lit(1)),
        "mean_delta": F.avg(d),
        "win_rate": F.avg(F.when(d < -tolerance, one).otherwise(0.0)),
        "loss_rate": F.avg(F.when(d > tolerance, one).otherwise(0.0)),
        "equal_rate": F.avg(F.when(F.abs(d) <= tolerance, one).otherwise(0.0)),
    }
    if fold is None:
        return pairs.agg(*[m.alias(n) for n, m in measures.items()])
    return multi_scope(pairs, [[], [fold]], {"paired": F.lit(True)}, measures).drop("scope")


def shrinkage_sweep(df: DataFrame, by: str | Sequence[str], model_p: str, market_p: str, odds: str, weights: Sequence[float]) -> DataFrame:
    """How many offers stay positive as the model is pulled to the market."""
    wide = []
    for i, w in enumerate(weights):
        p = F.lit(w) * F.col(model_p) + F.lit(1.0 - w) * F.col(market_p)
        ev = p * F.col(odds) - 1.0
        wide += [count_where(ev > 0).alias(f"__c{i}"), F.avg(ev).alias(f"__e{i}")]
    grouped = df.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("n"), *wide)
    items = F.array(*[
        F.struct(F.lit(float(w)).alias("model_weight"), F.col(f"__c{i}").alias("n_positive"), F.col(f"__e{i}").alias("mean_ev"))
        for i, w in enumerate(weights)
    ])
    return grouped.select(*names(by), "n", F.explode(items).alias("__i")).select(
        *names(by), "n", "__i.model_weight", "__i.n_positive", "__i.mean_ev"
    )


def distribution(samples: DataFrame, by: str | Sequence[str], value: str) -> DataFrame:
    """Count and probability of each value of a discrete sample.

    The window runs over distinct values, not over samples.
    """
    by = names(by)
    counts = samples.groupBy(*by, value).agg(F.count(F.lit(1)).alias("sample_count"))
    total = F.sum("sample_count").over(Window.partitionBy(*by))
    return counts.withColumn("probability", F.col("sample_count") / total)


def discrete_distribution(samples: DataFrame, by: str | Sequence[str], value: str) -> DataFrame:
    """Mean, median, p10, p90, mode (lowest on ties), min and max."""
    by = names(by)
    counts = samples.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    x = F.col(value).cast("double")
    base = counts.groupBy(*by).agg(
        F.sum("__c").alias("sample_count"),
        ratio(F.sum(x * F.col("__c")), F.sum("__c")).alias("mean"),
        F.max_by(value, F.struct(F.col("__c"), -F.col(value))).alias("mode"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    points = exact_quantiles(samples, by, value, {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return _beside(base, points, by)


def threshold_probability(dist: DataFrame, by: str | Sequence[str], value: str, limits: Sequence[float]) -> DataFrame:
    """Chance of reaching at least / staying at or below each limit."""
    wide = dist.groupBy(*names(by)).agg(
        *[F.sum(F.when(F.col(value) >= t, F.col("probability")).otherwise(0.0)).alias(f"__a{i}") for i, t in enumerate(limits)],
        *[F.sum(F.when(F.col(value) <= t, F.col("probability")).otherwise(0.0)).alias(f"__b{i}") for i, t in enumerate(limits)],
    )
    items = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"__a{i}").alias("at_least"), F.col(f"__b{i}").alias("at_most"))
        for i, t in enumerate(limits)
    ])
    return wide.select(*names(by), F.explode(items).alias("__i")).select(
        *names(by), "__i.threshold", "__i.at_least", "__i.at_most"
    )


def distribution_distance(a: DataFrame, b: DataFrame, by: str | Sequence[str], value: str) -> DataFrame:
    """Total variation distance of two distributions per entity."""
    by = names(by)
    both = align_distributions(a, b, [*by, value], "probability", ("p_a", "p_b"))
    return both.groupBy(*by).agg((F.sum(F.abs(F.col("p_a") - F.col("p_b"))) / 2.0).alias("distance"))


def expected_vs_actual(df: DataFrame, by: str | Sequence[str], expected: str, actual: str) -> DataFrame:
    """Accuracy of expected totals per candidate."""
    error = F.col(expected) - F.col(actual)
    return df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.corr(expected, actual).alias("correlation"),
        ratio(F.stddev_pop(expected), F.stddev_pop(actual)).alias("dispersion_ratio"),
    )


def expected_totals(df: DataFrame, by: str | Sequence[str], probability: str) -> DataFrame:
    """Expected number of events: the sum of their probabilities."""
    return df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(probability).alias("expected_total")
    )
