"""Contract queries over grouped summaries, metrics and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import aggregates, quality, reshape, skew
from fieldglass.plans.registry import cents, query, rounded


@query("agg_where", """
SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE l_discount >= 0.05) AS discounted_lines,
  CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_tax > 0.02) AS BIGINT) AS taxed_quantity,
  max(l_extendedprice) FILTER (WHERE l_quantity < 10) AS best_small_price,
  round(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_discount >= 0.05) AS BIGINT) / nullif(count(*) FILTER (WHERE l_discount >= 0.05), 0), 3) AS mean_discounted_cents
FROM lineitem GROUP BY ALL
""")
def agg_where(t):
    cheap = F.col("l_discount") >= 0.05
    rows = aggregates.agg_where(t.lineitem, ["l_returnflag", "l_linestatus"], {
        "discounted_lines": ("count", F.lit(1), cheap),
        "taxed_quantity": ("sum", F.col("l_quantity").cast("long"), F.col("l_tax") > 0.02),
        "best_small_price": ("max", F.col("l_extendedprice"), F.col("l_quantity") < 10),
        "__sum": ("sum", cents("l_extendedprice"), cheap),
    })
    return rows.withColumn(
        "mean_discounted_cents", F.round(aggregates.ratio(F.col("__sum"), F.col("discounted_lines")), 3)
    ).drop("__sum")


@query("role_rollup", """
SELECT l_orderkey, bool_or(l_returnflag = 'R') AS has_return, bool_or(l_linestatus = 'O') AS has_open,
  count(DISTINCT l_suppkey) AS l_suppkey_count, min(l_shipdate) AS min_l_shipdate, min(l_partkey) AS min_l_partkey, count(DISTINCT l_suppkey) > 1 AS has_conflict
FROM lineitem GROUP BY l_orderkey
""")
def role_rollup(t):
    return aggregates.rollup_roles(
        t.lineitem, "l_orderkey",
        {"has_return": F.col("l_returnflag") == "R", "has_open": F.col("l_linestatus") == "O"},
        "l_suppkey", ["l_shipdate", "l_partkey"],
    )


@query("arg_max", """
SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_returnflag = 'R') WHERE rn = 1
""")
def arg_max(t):
    return aggregates.top_by(
        t.lineitem, "l_suppkey", F.col("l_extendedprice"), [F.col("l_orderkey"), F.col("l_linenumber")],
        ["l_orderkey", "l_partkey", "l_extendedprice"], where=F.col("l_returnflag") == "R",
    ).where("l_orderkey IS NOT NULL")


@query("grouping_scopes", """
WITH x AS (
  SELECT 'ALL_ROWS' AS scope, * FROM orders UNION ALL SELECT 'LARGE', * FROM orders WHERE o_totalprice >= 250000
)
SELECT scope, CASE WHEN grouping(o_orderpriority) = 1 THEN 'ALL' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN grouping(o_orderstatus) = 1 THEN 'ALL' ELSE o_orderstatus END AS o_orderstatus, count(*) AS order_count,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM x GROUP BY GROUPING SETS ((scope), (scope, o_orderpriority), (scope, o_orderstatus), (scope, o_orderpriority, o_orderstatus))
""")
def grouping_scopes(t):
    rows = t.orders.select("o_orderpriority", "o_orderstatus", "o_totalprice", cents("o_totalprice").alias("c"))
    return aggregates.multi_scope(
        rows,
        [[], ["o_orderpriority"], ["o_orderstatus"], ["o_orderpriority", "o_orderstatus"]],
        {"ALL_ROWS": F.lit(True), "LARGE": F.col("o_totalprice") >= 250000},
        {"order_count": F.count(F.lit(1)), "total_cents": F.sum("c")},
    )


def _estimates(t):
    """Line price against quantity x retail price, by ship year."""
    price = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice", F.year("l_shipdate").cast("long").alias("ship_year"), "l_returnflag")
    rows = skew.join_lookup(lines, price, "l_partkey", "inner")
    return rows.select(
        "ship_year", "l_returnflag", F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("estimate"),
    ).withColumn("residual", F.col("actual") - F.col("estimate"))


_EST = """
WITH e AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS ship_year, l_returnflag, l_extendedprice AS actual, l_quantity * p_retailprice AS estimate,
    l_extendedprice - l_quantity * p_retailprice AS residual FROM lineitem JOIN part ON p_partkey = l_partkey
)"""


@query("dist_summary", _EST + """
SELECT ship_year, count(*) AS n, round(avg(residual), 3) AS mean, round(stddev_samp(residual), 3) AS sd, round(avg(abs(residual)), 3) AS mae,
  round(sqrt(avg(residual * residual)), 3) AS rmse, round(quantile_cont(residual, 0.05), 4) AS p05, round(quantile_cont(residual, 0.25), 4) AS p25,
  round(quantile_cont(residual, 0.5), 4) AS p50, round(quantile_cont(residual, 0.75), 4) AS p75, round(quantile_cont(residual, 0.95), 4) AS p95
FROM e GROUP BY ALL
""")
def dist_summary(t):
    out = aggregates.dist_summary(_estimates(t), "ship_year", "residual")
    digits = {c: 3 for c in ("mean", "sd", "mae", "rmse")} | {c: 4 for c in ("p05", "p25", "p50", "p75", "p95")}
    return out.withColumns({c: rounded(c, d) for c, d in digits.items()})


_GAPS = """
WITH g AS (
  SELECT nullif(l_returnflag, 'R') AS flag,
    CASE WHEN l_returnflag <> 'N' AND l_quantity <= 45 THEN l_extendedprice END AS price FROM lineitem)
"""


def _gaps(t):
    """A null group, and a group whose values are all null."""
    value = F.when((F.col("l_returnflag") != "N") & (F.col("l_quantity") <= 45), F.col("l_extendedprice"))
    return t.lineitem.select(F.expr("nullif(l_returnflag, 'R')").alias("flag"), value.alias("price"))


@query("dist_summary_nulls", _GAPS + """
SELECT flag, count(price) AS n, round(avg(price), 3) AS mean, round(stddev_samp(price), 3) AS sd,
  round(quantile_cont(price, 0.05), 4) AS p05, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.95), 4) AS p95
FROM g GROUP BY flag
""")
def dist_summary_nulls(t):
    out = aggregates.dist_summary(_gaps(t), "flag", "price")
    return out.select("flag", "n", *[rounded(c, 3).alias(c) for c in ("mean", "sd")], *[rounded(c, 4).alias(c) for c in ("p05", "p50", "p95")])


@query("concentration_nulls", _GAPS + """
SELECT flag, count(*) AS n, count(*) FILTER (WHERE price >= 20000) AS n_ge_20000, max(price) AS max_value,
  round(quantile_cont(price, 0.5), 4) AS median_value FROM g GROUP BY flag
""")
def concentration_nulls(t):
    out = aggregates.concentration(_gaps(t), "flag", "price", [20_000])
    return out.withColumn("median_value", rounded("median_value", 4))


@query("calibration_line", _EST + """
SELECT ship_year, count(*) AS n, round(regr_slope(actual, estimate), 6) AS slope, round(regr_intercept(actual, estimate), 3) AS intercept,
  round(stddev_pop(estimate) / stddev_pop(actual), 6) AS sd_ratio FROM e GROUP BY ALL
""")
def calibration_line(t):
    out = aggregates.calibration_line(_estimates(t), "ship_year", "actual", "estimate")
    return out.withColumns({"slope": rounded("slope"), "intercept": rounded("intercept", 3), "sd_ratio": rounded("sd_ratio")})


@query("regression_metrics", _EST + """
SELECT l_returnflag, count(*) AS n, round(avg(abs(estimate - actual)), 3) AS mae, round(sqrt(avg((estimate - actual) * (estimate - actual))), 3) AS rmse,
  round(avg(estimate - actual), 3) AS bias, round(1 - avg((estimate - actual) * (estimate - actual)) / var_pop(actual), 6) AS r2 FROM e GROUP BY ALL
""")
def regression_metrics(t):
    out = aggregates.regression_metrics(_estimates(t), "l_returnflag", "estimate", "actual")
    return out.withColumns({"mae": rounded("mae", 3), "rmse": rounded("rmse", 3), "bias": rounded("bias", 3), "r2": rounded("r2")})


@query("expected_vs_actual", """
WITH p AS (SELECT p_brand, l_partkey, sum(l_quantity * p_retailprice) AS expected, sum(l_extendedprice) AS actual FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT p_brand, count(*) AS n, round(avg(abs(expected - actual)), 2) AS mae, round(sqrt(avg((expected - actual) * (expected - actual))), 2) AS rmse,
  round(corr(expected, actual), 6) AS correlation, round(stddev_pop(expected) / stddev_pop(actual), 6) AS dispersion_ratio FROM p GROUP BY ALL
""")
def expected_vs_actual(t):
    lines = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("actual"))
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    rows = lines.join(parts, "l_partkey").withColumn("expected", F.col("quantity") * F.col("p_retailprice"))
    out = aggregates.expected_vs_actual(rows, "p_brand", "expected", "actual")
    return out.withColumns({"mae": rounded("mae", 2), "rmse": rounded("rmse", 2), "correlation": rounded("correlation"), "dispersion_ratio": rounded("dispersion_ratio")})


@query("weighted_summary", _EST + """, f AS (
  SELECT l_returnflag AS candidate, ship_year, count(*) AS n, avg(abs(residual)) AS mae, avg(residual) AS bias FROM e GROUP BY ALL
), w AS (
  SELECT candidate, count(*) AS fold_count, CAST(sum(n) AS BIGINT) AS weight_total, sum(n * mae) / sum(n) AS weighted_mae, max(mae) AS worst_mae, stddev_pop(mae) AS sd_mae,
    sum(n * bias) / sum(n) AS weighted_bias, max(bias) AS worst_bias, stddev_pop(bias) AS sd_bias FROM f GROUP BY ALL
)
SELECT candidate, fold_count, weight_total, round(weighted_mae, 3) AS weighted_mae, round(worst_mae, 3) AS worst_mae, round(sd_mae, 3) AS sd_mae,
  round(weighted_bias, 3) AS weighted_bias, round(worst_bias, 3) AS worst_bias, round(sd_bias, 3) AS sd_bias,
  round(weighted_mae - (SELECT weighted_mae FROM w WHERE candidate = 'N'), 3) AS delta_weighted_mae FROM w
""")
def weighted_summary(t):
    folds = _estimates(t).groupBy(F.col("l_returnflag").alias("candidate"), "ship_year").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("residual")).alias("mae"), F.avg("residual").alias("bias")
    )
    out = aggregates.weighted_summary(folds, "candidate", "n", ["mae", "bias"])
    out = aggregates.versus_baseline(out, "candidate", "N", ["weighted_mae"])
    numbers = [c for c in out.columns if c not in ("candidate", "fold_count", "weight_total")]
    return out.withColumns({c: rounded(c, 3) for c in numbers})


# -- probability scores ------------------------------------------------------------

def _scored(t):
    """Two simple probabilities of document quality, from its length."""
    rows = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id")
    return rows.select(
        "doc_id", "source", "lang", "n_chars", F.col("quality").cast("long").alias("y"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))).alias("p_a"),
        F.when(F.col("n_chars") > 1000, F.lit(0.7)).otherwise(F.lit(0.3)).alias("p_b"),
    )


_SCORED = """
WITH s AS (
  SELECT d.doc_id, source, lang, n_chars, CAST(quality AS BIGINT) AS y, n_chars / (n_chars + 2000.0::DOUBLE) AS p_a,
    CASE WHEN n_chars > 1000 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS p_b FROM documents d JOIN labels l ON l.doc_id = d.doc_id
)"""


@query("probability_metrics", _SCORED + """
SELECT source, count(*) AS n, round(avg((p_a - y) * (p_a - y)), 6) AS brier,
  round(avg(-(y * ln(least(greatest(p_a, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p_a, 1e-15), 1 - 1e-15)))), 6) AS log_loss,
  round(avg(CASE WHEN (p_a >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM s GROUP BY ALL
""")
def probability_metrics(t):
    out = aggregates.probability_metrics(_scored(t), "source", "p_a", "y")
    return out.withColumns({c: rounded(c) for c in ("brier", "log_loss", "accuracy")})


@query("calibration_bins", _SCORED + """
SELECT CAST(least(floor(p_a * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p_a), 6) AS mean_probability, round(avg(y), 6) AS observed_rate, round(avg(y) - avg(p_a), 6) AS gap
FROM s GROUP BY ALL
""")
def calibration_bins(t):
    out = aggregates.calibration_bins(_scored(t), [], "p_a", "y", 10, "left")
    return out.withColumns({c: rounded(c) for c in ("mean_probability", "observed_rate", "gap")})


@query("ece", _SCORED + """, b AS (
  SELECT source, greatest(ceil(p_a * 10) - 1, 0) AS bin, count(*) AS n, abs(avg(y) - avg(p_a)) AS gap FROM s GROUP BY ALL
)
SELECT source, CAST(sum(n) AS BIGINT) AS n, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS max_gap FROM b GROUP BY ALL
""")
def ece(t):
    out = aggregates.ece(_scored(t), "source", "p_a", "y", 10, "right")
    return out.withColumns({c: rounded(c) for c in ("ece", "max_gap")})


@query("disagreement", _SCORED + """
SELECT lang, count(*) AS n, count(*) FILTER (WHERE (p_a >= 0.5) <> (p_b >= 0.5)) AS n_disagree,
  round(count(*) FILTER (WHERE (p_a >= 0.5) <> (p_b >= 0.5)) / count(*), 6) AS disagreement_rate,
  count(*) FILTER (WHERE (p_a >= 0.5) <> (p_b >= 0.5) AND (p_a >= 0.5) = (y = 1)) AS first_right,
  count(*) FILTER (WHERE (p_a >= 0.5) <> (p_b >= 0.5) AND (p_b >= 0.5) = (y = 1)) AS second_right,
  round(avg(CASE WHEN y = 1 THEN p_b - p_a ELSE p_a - p_b END), 6) AS directed_change FROM s GROUP BY ALL
""")
def disagreement(t):
    out = aggregates.disagreement(_scored(t), "lang", "p_a", "p_b", "y")
    return out.withColumns({c: rounded(c) for c in ("disagreement_rate", "directed_change")})


def _losses(t):
    rows = _scored(t)
    items = F.array(*[
        F.struct(F.lit(name).alias("candidate"), ((F.col(p) - F.col("y")) * (F.col(p) - F.col("y"))).alias("loss"))
        for name, p in (("length", "p_a"), ("step", "p_b"))
    ])
    return rows.select("doc_id", "source", F.explode(items).alias("i")).select("doc_id", "source", "i.candidate", "i.loss")


@query("paired_compare", _SCORED + """, d AS (
  SELECT source, (p_b - y) * (p_b - y) - (p_a - y) * (p_a - y) AS delta FROM s
), u AS (SELECT 'ALL' AS source, delta FROM d UNION ALL SELECT * FROM d)
SELECT source, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(CASE WHEN delta < -1e-12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate,
  round(avg(CASE WHEN delta > 1e-12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS loss_rate, round(avg(CASE WHEN abs(delta) <= 1e-12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS equal_rate
FROM u GROUP BY ALL
""")
def paired_compare(t):
    out = aggregates.paired_compare(_losses(t), ["doc_id"], "candidate", "loss", "length", "step", fold="source")
    return out.withColumns({c: rounded(c) for c in ("mean_delta", "win_rate", "loss_rate", "equal_rate")})


@query("sharpen", _SCORED + """
SELECT doc_id, round(1 / (1 + exp(-1.5 * ln(least(greatest(p_a, 1e-6), 1 - 1e-6) / (1 - least(greatest(p_a, 1e-6), 1 - 1e-6))))), 9) AS sharpened,
  round(1 / (1 + exp(-(ln(p_b / (1 - p_b)) + 50 * ln(10) / 400))), 9) AS shifted FROM s
""")
def sharpen(t):
    return _scored(t).select(
        "doc_id", rounded(scalars.sharpen(F.col("p_a"), 1.5), 9).alias("sharpened"),
        rounded(scalars.shift_by_rating(F.col("p_b"), F.lit(50.0)), 9).alias("shifted"),
    )


@query("blend_sweep", _SCORED + """, g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS weight)
SELECT weight, count(*) AS n, round(avg((weight * p_a + (1 - weight) * p_b - y) * (weight * p_a + (1 - weight) * p_b - y)), 6) AS brier FROM s, g GROUP BY ALL
""")
def blend_sweep(t):
    rows = reshape.sweep(_scored(t), "weight", [0.0, 0.25, 0.5, 0.75, 1.0])
    rows = rows.withColumn("p", F.col("weight") * F.col("p_a") + (1 - F.col("weight")) * F.col("p_b"))
    out = aggregates.probability_metrics(rows, "weight", "p", "y")
    return out.select("weight", "n", rounded("brier").alias("brier"))


# -- distributions ------------------------------------------------------------------

def _lines_per_order(t, status=None):
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("line_count"))
    orders = t.orders if status is None else t.orders.where(F.col("o_orderstatus") == status)
    return orders.select("o_orderkey", "o_orderpriority").join(counts, "o_orderkey")


_LINES = """
WITH c AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, count(*) AS line_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query("discrete_distribution", _LINES + """, m AS (
  SELECT o_orderpriority, line_count AS mode, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, line_count) AS rn FROM c GROUP BY o_orderpriority, line_count
)
SELECT c.o_orderpriority, count(*) AS sample_count, round(avg(line_count), 6) AS mean, any_value(m.mode) AS mode, min(line_count) AS min, max(line_count) AS max,
  quantile_cont(line_count::DOUBLE, 0.1) AS p10, quantile_cont(line_count::DOUBLE, 0.5) AS median, quantile_cont(line_count::DOUBLE, 0.9) AS p90
FROM c JOIN m ON m.o_orderpriority = c.o_orderpriority AND m.rn = 1 GROUP BY c.o_orderpriority
""")
def discrete_distribution(t):
    out = aggregates.discrete_distribution(_lines_per_order(t), "o_orderpriority", "line_count")
    return out.withColumn("mean", rounded("mean"))


@query("threshold_probability", _LINES + """, d AS (
  SELECT o_orderpriority, line_count, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS p FROM c GROUP BY o_orderpriority, line_count
), g AS (SELECT unnest([2.0, 4.0, 6.0])::DOUBLE AS threshold)
SELECT o_orderpriority, threshold, round(sum(CASE WHEN line_count >= threshold THEN p ELSE 0 END), 6) AS at_least, round(sum(CASE WHEN line_count <= threshold THEN p ELSE 0 END), 6) AS at_most
FROM d, g GROUP BY ALL
""")
def threshold_probability(t):
    dist = aggregates.distribution(_lines_per_order(t), "o_orderpriority", "line_count")
    out = aggregates.threshold_probability(dist, "o_orderpriority", "line_count", [2.0, 4.0, 6.0])
    return out.withColumns({c: rounded(c) for c in ("at_least", "at_most")})


@query("dist_distance", _LINES + """, d AS (
  SELECT o_orderstatus, o_orderpriority, line_count, count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS p FROM c GROUP BY o_orderstatus, o_orderpriority, line_count
)
SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 6) AS distance
FROM (SELECT * FROM d WHERE o_orderstatus = 'F') a FULL JOIN (SELECT * FROM d WHERE o_orderstatus = 'O') b
  ON a.o_orderpriority = b.o_orderpriority AND a.line_count = b.line_count GROUP BY ALL
""")
def dist_distance(t):
    a, b = (aggregates.distribution(_lines_per_order(t, s), "o_orderpriority", "line_count") for s in "FO")
    out = aggregates.distribution_distance(a, b, "o_orderpriority", "line_count")
    return out.withColumn("distance", rounded("distance"))


@query("sum_to_one", _LINES + """, d AS (
  SELECT o_orderpriority, line_count, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS p FROM c GROUP BY o_orderpriority, line_count
)
SELECT 'probability_sum' AS check_name, count(*) AS issue_count FROM (SELECT o_orderpriority FROM d GROUP BY ALL HAVING abs(sum(p) - 1) > 1e-6)
""")
def sum_to_one(t):
    dist = aggregates.distribution(_lines_per_order(t), "o_orderpriority", "line_count")
    return quality.sum_check(dist, ["o_orderpriority"], "probability", "probability_sum")


# -- sweeps, drift, segments ----------------------------------------------------------

@query("dispersion_sweep", _EST + """, m AS (SELECT avg(estimate) AS c FROM e WHERE ship_year < 1999), g AS (SELECT unnest([0.8, 0.9, 1.0, 1.1])::DOUBLE AS factor)
SELECT factor, count(*) AS n, round(avg(abs(c + factor * (estimate - c) - actual)), 3) AS mae FROM e, m, g GROUP BY ALL
""")
def dispersion_sweep(t):
    rows = _estimates(t)
    center = rows.where("ship_year < 1999").agg(F.avg("estimate")).scalar()
    rows = reshape.sweep(rows.withColumn("center", center), "factor", [0.8, 0.9, 1.0, 1.1])
    rows = rows.withColumn("rescaled", scalars.rescale(F.col("estimate"), F.col("center"), F.col("factor")))
    return aggregates.regression_metrics(rows, "factor", "rescaled", "actual").select("factor", "n", rounded("mae", 3).alias("mae"))


@query("shrinkage_sweep", """
WITH x AS (SELECT l_returnflag, 0.4 + l_discount AS mp, 0.4 + l_tax AS kp, 1.5 + l_quantity / 50 AS odds FROM lineitem), g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS model_weight)
SELECT l_returnflag, count(*) AS n, model_weight, count(*) FILTER (WHERE (model_weight * mp + (1 - model_weight) * kp) * odds - 1 > 0) AS n_positive,
  round(avg((model_weight * mp + (1 - model_weight) * kp) * odds - 1), 6) AS mean_ev FROM x, g GROUP BY ALL
""")
def shrinkage_sweep(t):
    rows = t.lineitem.select(
        "l_returnflag", (F.lit(0.4) + F.col("l_discount")).alias("mp"), (F.lit(0.4) + F.col("l_tax")).alias("kp"),
        (F.lit(1.5) + F.col("l_quantity") / 50).alias("odds"),
    )
    out = aggregates.shrinkage_sweep(rows, "l_returnflag", "mp", "kp", "odds", [0.0, 0.25, 0.5, 0.75, 1.0])
    return out.withColumn("mean_ev", rounded("mean_ev"))


@query("extreme_rates", _EST + """, g AS (SELECT unnest([5000.0, 20000.0, 50000.0])::DOUBLE AS threshold)
SELECT ship_year, count(*) AS n, threshold, count(*) FILTER (WHERE abs(residual) >= threshold) AS n_extreme, round(count(*) FILTER (WHERE abs(residual) >= threshold) / count(*), 6) AS extreme_rate
FROM e, g GROUP BY ALL
""")
def extreme_rates(t):
    out = aggregates.extreme_rates(_estimates(t), "ship_year", F.abs("residual"), [5000.0, 20000.0, 50000.0])
    return out.withColumn("extreme_rate", rounded("extreme_rate"))


@query("concentration", """
SELECT CASE WHEN l_discount < 0.025 THEN 'LOW' WHEN l_discount < 0.05 THEN 'MEDIUM' WHEN l_discount < 0.10 THEN 'HIGH' ELSE 'VERY_HIGH' END AS bucket, count(*) AS n,
  count(*) FILTER (WHERE l_quantity >= 10) AS n_ge_10, count(*) FILTER (WHERE l_quantity >= 20) AS n_ge_20, max(l_quantity) AS max_value, quantile_cont(l_quantity, 0.5) AS median_value
FROM lineitem GROUP BY ALL
""")
def concentration(t):
    label = scalars.bucket_label(F.col("l_discount"), scalars.PROBABILITY_STEPS, "VERY_HIGH", inclusive=False)
    rows = t.lineitem.select(label.alias("bucket"), "l_quantity")
    return aggregates.concentration(rows, "bucket", "l_quantity", [10, 20])


@query("feature_drift", """
WITH u AS (
  SELECT 'l_quantity' AS feature_name, l_quantity AS x, l_shipdate >= TIMESTAMP '2000-01-01' AS h FROM lineitem UNION ALL
  SELECT 'l_discount', l_discount, l_shipdate >= TIMESTAMP '2000-01-01' FROM lineitem UNION ALL SELECT 'l_tax', l_tax, l_shipdate >= TIMESTAMP '2000-01-01' FROM lineitem
)
SELECT feature_name, round(avg(x) FILTER (WHERE NOT h), 6) AS development_mean, round(avg(x) FILTER (WHERE h), 6) AS holdout_mean, round(stddev_pop(x) FILTER (WHERE NOT h), 6) AS development_sd,
  round((avg(x) FILTER (WHERE h) - avg(x) FILTER (WHERE NOT h)) / stddev_pop(x) FILTER (WHERE NOT h), 6) AS standardized_difference FROM u GROUP BY ALL
""")
def feature_drift(t):
    holdout = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    out = aggregates.drift(t.lineitem, holdout, ["l_quantity", "l_discount", "l_tax"])
    return out.withColumns({c: rounded(c) for c in out.columns if c != "feature_name"})


@query("segment_summary", """
WITH s AS (
  SELECT 'price' AS topic, 'large' AS segment, * FROM orders WHERE o_totalprice >= 300000 UNION ALL SELECT 'price', 'small', * FROM orders WHERE o_totalprice < 100000 UNION ALL
  SELECT 'status', 'final', * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'status', 'open', * FROM orders WHERE o_orderstatus = 'O' UNION ALL
  SELECT 'priority', 'urgent', * FROM orders WHERE o_orderpriority = '1-URGENT'
)
SELECT topic, segment, count(*) AS order_count, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM s GROUP BY ALL
""")
def segment_summary(t):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return aggregates.segment_summary(t.orders, {
        "price": {"large": price >= 300000, "small": price < 100000},
        "status": {"final": status == "F", "open": status == "O"},
        "priority": {"urgent": F.col("o_orderpriority") == "1-URGENT"},
    }, {"order_count": F.count(F.lit(1)), "total_cents": F.sum(cents("o_totalprice"))})


@query("expected_totals", """
SELECT l_partkey, CAST(year(l_shipdate) AS BIGINT) AS ship_year, count(*) AS n, round(sum(l_discount), 6) AS expected_total FROM lineitem GROUP BY ALL
""")
def expected_totals(t):
    rows = t.lineitem.select("l_partkey", F.year("l_shipdate").cast("long").alias("ship_year"), "l_discount")
    out = aggregates.expected_totals(rows, ["l_partkey", "ship_year"], "l_discount")
    return out.withColumn("expected_total", rounded("expected_total"))


# -- settlement and pricing ---------------------------------------------------------------

def _compared(t):
    """A line's price in cents against its part's mean, in whole cents."""
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_quantity", cents("l_extendedprice").alias("price"))
    rows = skew.attach_totals(rows, "l_partkey", part_total=F.sum("price"), part_lines=F.count(F.lit(1)))
    mean = F.floor(F.col("part_total") / F.col("part_lines"))
    american = F.when(F.col("l_quantity") < 26, -(F.lit(95) + F.col("l_quantity") * 5)).otherwise(F.lit(70) + F.col("l_quantity") * 2)
    return rows.withColumn("comparison", F.col("price") - mean).withColumn("american", american.cast("long"))


_COMPARED = """
WITH x AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem
), y AS (
  SELECT *, price - CAST(floor(CAST(sum(price) OVER (PARTITION BY l_partkey) AS BIGINT) / count(*) OVER (PARTITION BY l_partkey)) AS BIGINT) AS comparison,
    CAST(CASE WHEN l_quantity < 26 THEN -(95 + l_quantity * 5) ELSE 70 + l_quantity * 2 END AS BIGINT) AS american FROM x
), z AS (
  SELECT *, CASE WHEN abs(american) >= 100 THEN CASE WHEN american > 0 THEN 1 + american / 100 ELSE 1 + 100 / abs(american) END END AS decimal_odds FROM y
)"""


@query("records", _COMPARED + """
SELECT l_suppkey, count(*) FILTER (WHERE comparison > 0) AS wins, count(*) FILTER (WHERE comparison < 0) AS losses, count(*) FILTER (WHERE comparison = 0) AS ties,
  round((count(*) FILTER (WHERE comparison > 0) + 0.5 * count(*) FILTER (WHERE comparison = 0))::DOUBLE / count(*), 6) AS win_share FROM z GROUP BY ALL
""")
def records(t):
    out = aggregates.records(_compared(t), "l_suppkey", F.col("comparison"), F.lit(0))
    return out.withColumn("win_share", rounded("win_share"))


@query("settle", _COMPARED + """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN comparison > 0 THEN 'WIN' WHEN comparison < 0 THEN 'LOSS' ELSE 'PUSH' END AS settlement,
  round(CASE WHEN comparison > 0 THEN decimal_odds - 1 WHEN comparison < 0 THEN -1 ELSE 0 END, 6) AS profit FROM z
""")
def settle(t):
    odds = scalars.american_to_decimal(F.col("american"))
    columns = scalars.settle_columns(F.col("comparison"), odds)
    return _compared(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", columns["settlement"].alias("settlement"), rounded(columns["profit"]).alias("profit")
    )


@query("odds_convert", """
WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(CASE WHEN l_quantity < 26 THEN -(80 + l_quantity * 5) ELSE 60 + l_quantity * 2 END AS BIGINT) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(a) >= 100 THEN round(CASE WHEN a > 0 THEN 1 + a / 100 ELSE 1 + 100 / abs(a) END, 6) END AS decimal_odds,
  CASE WHEN abs(a) >= 100 THEN round(CASE WHEN a > 0 THEN 100 / (a + 100) ELSE abs(a) / (abs(a) + 100) END, 6) END AS implied_probability,
  round(CASE WHEN a > 0 THEN 1 + a / 100 WHEN a < 0 THEN 1 + 100 / abs(a) END, 6) AS any_decimal_odds FROM p
""")
def odds_convert(t):
    quantity = F.col("l_quantity")
    price = F.when(quantity < 26, -(F.lit(80) + quantity * 5)).otherwise(F.lit(60) + quantity * 2).cast("long")
    return t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey",
        rounded(scalars.american_to_decimal(price)).alias("decimal_odds"),
        rounded(scalars.implied_probability(price)).alias("implied_probability"),
        rounded(scalars.american_to_decimal(price, strict=False)).alias("any_decimal_odds"),
    )


@query("edge_bucket", """
SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount < 0.025 THEN 'LOW' WHEN l_discount < 0.05 THEN 'MEDIUM' WHEN l_discount < 0.10 THEN 'HIGH' ELSE 'VERY_HIGH' END
  ELSE CASE WHEN l_quantity / 12 < 1 THEN 'LOW' WHEN l_quantity / 12 < 2 THEN 'MEDIUM' WHEN l_quantity / 12 < 3 THEN 'HIGH' ELSE 'VERY_HIGH' END END AS bucket, count(*) AS n
FROM lineitem GROUP BY ALL
""")
def edge_bucket(t):
    market = F.when(F.col("l_returnflag") == "R", "h2h").otherwise("totals")
    edge = F.when(F.col("l_returnflag") == "R", F.col("l_discount")).otherwise(F.col("l_quantity") / 12)
    bucket = scalars.edge_bucket(
        market, edge, {"h2h": scalars.PROBABILITY_STEPS, "totals": scalars.POINT_STEPS}, {"h2h": "VERY_HIGH", "totals": "VERY_HIGH"}
    )
    return t.lineitem.groupBy("l_returnflag", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("price_offers", """
WITH x AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_discount * 8 AS w, l_tax / 2 AS u, 1 - l_discount * 8 - l_tax / 2 AS z, 1.5 + l_quantity / 50 AS odds, 0.3 + l_tax AS m FROM lineitem
)
SELECT l_orderkey, l_linenumber, l_partkey, round(w / (w + z) - m, 6) AS edge, CASE WHEN w > 0 THEN round((w + z) / w, 6) END AS fair_odds, round(w * (odds - 1) - z, 6) + 0.0::DOUBLE AS expected_value,
  round(greatest((w * (odds - 1) - z) / ((odds - 1) * (w + z)), 0), 6) AS kelly_fraction, w * (odds - 1) - z > 0 AS is_positive FROM x
""")
def price_offers(t):
    win, push = F.col("l_discount") * 8, F.col("l_tax") / 2
    rows = t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", win.alias("w"), push.alias("u"),
        (F.lit(1.0) - win - push).alias("z"), (F.lit(1.5) + F.col("l_quantity") / 50).alias("odds"), (F.lit(0.3) + F.col("l_tax")).alias("m"),
    )
    out = scalars.price_offers(rows, "w", "u", "z", "odds", "m").drop("w", "u", "z", "odds", "m")
    return out.withColumns({c: rounded(c) for c in ("edge", "fair_odds", "expected_value", "kelly_fraction")})


# -- quality ---------------------------------------------------------------------------------

@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return aggregates.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("profile_nulls", """
WITH u AS (
  SELECT 'user_id' AS column_name, CAST(user_id AS VARCHAR) AS v FROM events UNION ALL SELECT 'event_type', nullif(event_type, 'error') FROM events UNION ALL SELECT 'props', props FROM events
)
SELECT column_name, count(*) AS row_count, count(*) - count(v) AS null_count, count(DISTINCT v) AS distinct_count, min(v) AS min_text, max(v) AS max_text FROM u GROUP BY ALL
""")
def profile_nulls(t):
    rows = t.events.withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return quality.profile_nulls(rows, ["user_id", "event_type", "props"])


@query("quality_report", """
WITH c AS (
  SELECT 'negative_price' AS check_name, count(*) FILTER (WHERE l_extendedprice < 0) AS issue_count FROM lineitem UNION ALL
  SELECT 'discount_domain', count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.08) FROM lineitem UNION ALL
  SELECT 'duplicate_keys', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey HAVING count(*) > 1) UNION ALL
  SELECT 'row_count', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM lineitem UNION ALL
  SELECT 'part_reference', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)
)
SELECT check_name, CAST(issue_count AS BIGINT) AS issue_count, CASE WHEN check_name = 'discount_domain' THEN 'warning' ELSE 'error' END AS severity, CASE WHEN issue_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c
""")
def quality_report(t):
    parts = t.part.where("p_size > 1").select(F.col("p_partkey").alias("l_partkey"))
    return quality.quality_report(t.lineitem, quality.Rules(
        columns=["l_orderkey", "l_linenumber"],
        rows={"negative_price": F.col("l_extendedprice") < 0, "discount_domain": ~F.col("l_discount").between(0, 0.08)},
        key=["l_orderkey", "l_linenumber", "l_partkey"],
        references={"part_reference": (parts, ["l_partkey"])},
        severity={"discount_domain": "warning"},
    ))


@query("recompute_check", """
WITH s AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS total FROM lineitem GROUP BY ALL), j AS (
  SELECT o.o_totalprice AS a, s.total AS b FROM orders o FULL JOIN s ON s.l_orderkey = o.o_orderkey
)
SELECT 'total' AS check_name, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL) OR coalesce(abs(a - b) > 1e-6, false)) AS issue_count FROM j
""")
def recompute_check(t):
    stored = t.orders.select("o_orderkey", F.col("o_totalprice").alias("total"))
    rebuilt = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total")
    )
    return quality.recompute_check(stored, rebuilt, ["o_orderkey"], ["total"], tolerance=1e-6)
