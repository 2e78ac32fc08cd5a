"""Contract queries of the market board, offer values and model diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.plans import odds, serving
from fieldglass.plans.contract_pipelines import _ODDS, odds_tables
from fieldglass.plans.registry import query, rounded

# -- D1: events to games, newest board ------------------------------------------------

#: Teams T0 to T27 have codes; T28 to T30 have none.
_TEAMS = {f"T{i}": f"C{i}" for i in range(28)}

_BRIDGE = """, s AS (
  SELECT 'C' || (o_custkey % 30) AS h, 'C' || (o_custkey % 30 + 1) AS a, CAST(o_orderdate AS DATE) - 1 AS d, CAST(min(o_orderkey) AS VARCHAR) AS gid
  FROM orders WHERE o_custkey % 3 <> 0 GROUP BY ALL
), b AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS sid, o_orderkey AS eid, o_custkey % 30 > 26 AS unmapped, CASE WHEN o_custkey % 30 <= 26 THEN gid END AS gid
  FROM orders LEFT JOIN s ON h = 'C' || (o_custkey % 30) AND a = 'C' || (o_custkey % 30 + 1) AND d = CAST(o_orderdate AS DATE) - 1
)"""


def _schedule(t):
    """One game per pairing and day; a third of the customers' orders have none."""
    team = F.col("o_custkey") % 30
    return t.orders.where("o_custkey % 3 <> 0").groupBy(
        F.concat(F.lit("C"), team.cast("string")).alias("home_team"), F.concat(F.lit("C"), (team + 1).cast("string")).alias("away_team"),
        F.date_sub(F.to_date("o_orderdate"), 1).alias("gameday"),
    ).agg(F.min("o_orderkey").cast("string").alias("game_id")).select(
        "*", F.year("gameday").alias("season"), F.lit("REG").alias("game_type"), F.month("gameday").alias("week"), F.lit("13:00").alias("gametime"),
    )


@query("event_bridge", "WITH " + _BRIDGE.removeprefix(", ") + """
SELECT sid AS snapshot_id, CAST(eid AS VARCHAR) AS odds_event_id, gid AS game_id,
  CASE WHEN unmapped THEN 'UNMAPPED_TEAM' WHEN gid IS NULL THEN 'UNMATCHED_GAME' ELSE 'MATCHED' END AS match_status FROM b
""")
def event_bridge(t):
    _, events, _ = odds_tables(t)
    return odds.event_bridge(events, _schedule(t), _TEAMS).select("snapshot_id", "odds_event_id", "game_id", "match_status")


@query("market_board", _ODDS + _BRIDGE + """
SELECT snapshot_id, CAST(event_id AS VARCHAR) AS odds_event_id, gid AS game_id, market_key, outcome_type, point,
  CASE market_key WHEN 'h2h' THEN 'Moneyline' WHEN 'spreads' THEN 'Spread' ELSE 'Totals' END AS market_name, book AS best_bookmaker_key, round(odds, 6) AS best_decimal_odds
FROM r JOIN b ON b.sid = snapshot_id AND b.eid = event_id
WHERE rn = 1 AND NOT unmapped AND gid IS NOT NULL AND snapshot_id = (SELECT CAST(year(max(o_orderdate)) AS VARCHAR) FROM orders)
""")
def market_board(t):
    snapshots, events, offers = odds_tables(t)
    best = odds.best_odds_by_line(odds.processed_odds(snapshots, events, offers))
    board = odds.market_board(best, odds.event_bridge(events, _schedule(t), _TEAMS))
    return board.select(
        "snapshot_id", "odds_event_id", "game_id", "market_key", "outcome_type", "point", "market_name", "best_bookmaker_key",
        rounded("best_decimal_odds").alias("best_decimal_odds"),
    )


# -- D2: what the offers are worth -----------------------------------------------------

@query("betting_board", """
WITH g AS (
  SELECT o_orderkey AS game, CASE WHEN year(o_orderdate) < 1996 THEN 'A' ELSE 'B' END AS mode, 0.3 + (o_orderkey % 40) / 100 AS p,
    o_orderkey % 13 - 6 + CASE WHEN o_orderkey % 2 = 1 THEN 0.25::DOUBLE ELSE 0 END AS pm, 30.0::DOUBLE + o_custkey % 20 + CASE WHEN o_orderkey % 2 = 1 THEN 0.25::DOUBLE ELSE 0 END AS pt FROM orders
), o AS (
  SELECT g.*, l_orderkey * 10 + l_linenumber AS line_id, CASE l_returnflag WHEN 'R' THEN 'h2h' WHEN 'A' THEN 'spreads' ELSE 'totals' END AS market_key,
    CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'over' ELSE 'under' END WHEN l_linenumber % 2 = 0 THEN 'home' ELSE 'away' END AS side,
    CASE l_returnflag WHEN 'A' THEN CAST(CAST(round(l_discount * 100) AS BIGINT) - 4 AS DOUBLE) WHEN 'N' THEN 35.0::DOUBLE + l_orderkey % 10 * 0.5::DOUBLE END AS point,
    1.5 + l_quantity / 50 AS odds, 0.3 + l_linenumber / 20 AS market FROM lineitem JOIN g ON g.game = l_orderkey
), sr AS (SELECT CASE p_partkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS mode, p_partkey % 41 - 20 + 0.5::DOUBLE AS r, count(*) AS c FROM part GROUP BY ALL),
tr AS (SELECT CASE p_partkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS mode, p_partkey * 7 % 61 - 30 + 0.5::DOUBLE AS r, count(*) AS c FROM part GROUP BY ALL),
q AS (SELECT DISTINCT market_key, mode, side, point, pm, pt FROM o WHERE market_key <> 'h2h'), n AS (
  SELECT q.*, CASE WHEN side = 'home' THEN round_even(pm + r, 0) + point ELSE point - round_even(pm + r, 0) END AS v, c FROM q JOIN sr USING (mode) WHERE market_key = 'spreads'
  UNION ALL SELECT q.*, CASE WHEN side = 'over' THEN r - (point - pt) ELSE point - pt - r END, c FROM q JOIN tr USING (mode) WHERE market_key = 'totals'
), w AS (
  SELECT market_key, mode, side, point, pm, pt, sum(CASE WHEN v > 0 THEN c ELSE 0 END) / sum(c) AS win, sum(CASE WHEN v = 0 THEN c ELSE 0 END) / sum(c) AS push, sum(CASE WHEN v < 0 THEN c ELSE 0 END) / sum(c) AS loss FROM n GROUP BY ALL
), a AS (
  SELECT line_id, market_key, side, point, odds, market, CASE WHEN side = 'home' THEN p ELSE 1 - p END AS win, CAST(0 AS DOUBLE) AS push, 1 - CASE WHEN side = 'home' THEN p ELSE 1 - p END AS loss FROM o WHERE market_key = 'h2h'
  UNION ALL SELECT line_id, market_key, side, point, odds, market, win, push, loss FROM o JOIN w USING (market_key, mode, side, point, pm, pt)
  WHERE market_key = 'spreads' OR (SELECT count(DISTINCT side) FROM o x WHERE x.game = o.game AND x.market_key = 'totals') = 2
)
SELECT CAST(line_id AS VARCHAR) AS snapshot_id, market_key, side AS outcome_type, point, round(win, 9) AS model_probability, round(push, 9) AS push_probability, round(loss, 9) AS loss_probability,
  round(win / (win + loss) - market, 9) + 0.0::DOUBLE AS probability_edge, round((win + loss) / win, 9) AS fair_decimal_odds, round(win * (odds - 1) - loss, 9) + 0.0::DOUBLE AS expected_value_per_unit,
  round(greatest((win * (odds - 1) - loss) / ((odds - 1) * (win + loss)), 0), 9) AS full_kelly_fraction FROM a
""")
def betting_board(t):
    key, odd = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 1, 0.25).otherwise(0.0)
    p = F.lit(0.3) + key % 40 / 100
    predictions = t.orders.select(
        key.cast("string").alias("game_id"), F.lit("m").alias("model_name"), F.lit("1").alias("model_version"), F.col("o_orderdate").alias("prediction_generated_at"),
        F.when(F.year("o_orderdate") < 1996, "A").otherwise("B").alias("prediction_mode"), p.alias("home_win_probability"), (1 - p).alias("away_win_probability"),
        (key % 13 - 6 + odd).alias("predicted_home_margin"), (-(key % 13 - 6 + odd)).alias("predicted_away_margin"), (F.lit(30.0) + F.col("o_custkey") % 20 + odd).alias("predicted_total_points"),
    )
    part = F.col("p_partkey")
    residuals = t.part.select(
        F.when(part % 2 == 0, "A").otherwise("B").alias("prediction_mode"), (part % 41 - 20 + F.lit(0.5)).alias("residual_home_margin"), (part * 7 % 61 - 30 + F.lit(0.5)).alias("residual_total_points"),
    )
    flag, even = F.col("l_returnflag"), F.col("l_linenumber") % 2 == 0
    line = F.lit(35.0) + F.col("l_orderkey") % 10 * F.lit(0.5)
    text = F.lit(None).cast("string")
    board = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("snapshot_id"), F.col("l_shipdate").alias("fetched_at"), F.col("l_orderkey").cast("string").alias("game_id"),
        F.year("l_shipdate").alias("season"), F.lit("REG").alias("game_type"), F.month("l_shipdate").alias("week"), F.to_date("l_shipdate").alias("gameday"), F.col("l_shipdate").alias("commence_time"),
        text.alias("home_team"), text.alias("away_team"), F.when(flag == "R", "h2h").when(flag == "A", "spreads").otherwise("totals").alias("market_key"), text.alias("market_name"),
        F.when(flag == "N", line).alias("market_line"), text.alias("outcome_name"),
        F.when(flag == "N", F.when(even, "over").otherwise("under")).otherwise(F.when(even, "home").otherwise("away")).alias("outcome_type"),
        F.when(flag == "A", (F.round(F.col("l_discount") * 100) - 4).cast("double")).when(flag == "N", line).alias("point"), text.alias("best_bookmaker_key"), text.alias("best_bookmaker_title"),
        F.lit(None).cast("double").alias("best_american_price"), (F.lit(1.5) + F.col("l_quantity") / 50).alias("best_decimal_odds"), F.lit(1).cast("long").alias("bookmaker_count"),
        (F.lit(0.3) + F.col("l_linenumber") / 20).alias("consensus_no_vig_probability"),
    )
    values = odds.moneyline_value(board, predictions), odds.spread_value(board, predictions, residuals), odds.totals_value(board, predictions, residuals)
    numbers = ["model_probability", "push_probability", "loss_probability", "probability_edge", "fair_decimal_odds", "expected_value_per_unit", "full_kelly_fraction"]
    return odds.betting_board(*values, F.current_timestamp()).select("snapshot_id", "market_key", "outcome_type", "point", *[rounded(c, 9).alias(c) for c in numbers])


# -- D12: spread of predictions, model against market --------------------------------------

@query("prediction_spread", """
WITH r AS (SELECT l_returnflag AS layer, CAST(l_quantity AS DOUBLE) AS a, CAST(l_partkey % 37 + l_quantity / 2 AS DOUBLE) AS p FROM lineitem WHERE l_linenumber <> 3 AND l_suppkey % 11 <> 0)
SELECT layer, count(*) AS game_count, round(regr_slope(a, p), 6) AS calibration_slope, round(regr_intercept(a, p), 6) AS calibration_intercept, round(stddev_pop(p) / stddev_pop(a), 6) AS prediction_to_actual_dispersion_ratio,
  round(avg(a), 6) AS actual_mean, round(avg(p), 6) AS prediction_mean, round(stddev_pop(a), 6) AS actual_standard_deviation, round(stddev_pop(p), 6) AS prediction_standard_deviation,
  round(quantile_cont(a, 0.1), 6) AS actual_p10, round(quantile_cont(a, 0.9), 6) AS actual_p90, round(quantile_cont(p, 0.1), 6) AS prediction_p10, round(quantile_cont(p, 0.9), 6) AS prediction_p90
FROM r GROUP BY layer
""")
def prediction_spread(t):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("layer"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("double")).alias("actual"),
        F.when(F.col("l_suppkey") % 11 != 0, (F.col("l_partkey") % 37 + F.col("l_quantity") / 2).cast("double")).alias("predicted"),
    )
    out = serving.dispersion_summary(rows, "layer", "actual", "predicted")
    return out.select("layer", "game_count", *[rounded(c).alias(c) for c in out.columns if c not in ("layer", "game_count")])


@query("market_comparison", """
WITH r AS (SELECT 0.3 + (o_orderkey % 40) / 100 AS m, 0.25 + (o_orderkey % 40) / 200 + (o_custkey % 30) / 100 AS k FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 7 <> 0)
SELECT count(*) AS game_count, round(avg(m), 6) AS model_probability_mean, round(avg(k), 6) AS market_probability_mean, round(stddev_pop(m), 6) AS model_probability_standard_deviation,
  round(stddev_pop(k), 6) AS market_probability_standard_deviation, round(stddev_pop(m) / stddev_pop(k), 6) AS model_to_market_dispersion_ratio, round(regr_intercept(k, m), 6) AS market_on_model_intercept,
  round(regr_slope(k, m), 6) AS market_on_model_slope, round(avg(abs(m - k)), 6) AS mean_absolute_probability_difference, round(min(m), 6) AS model_minimum_probability, round(max(m), 6) AS model_maximum_probability,
  round(min(k), 6) AS market_minimum_probability, round(max(k), 6) AS market_maximum_probability FROM r
""")
def market_comparison(t):
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(
        F.when(F.col("o_orderstatus") == "P", "away").otherwise("home").alias("outcome_type"), (F.lit(0.3) + key % 40 / 100).alias("model_probability"),
        F.when(who % 7 != 0, F.lit(0.25) + key % 40 / 200 + who % 30 / 100).alias("consensus_no_vig_probability"),
    )
    out = serving.market_comparison(rows)
    return out.select("game_count", *[rounded(c).alias(c) for c in out.columns if c != "game_count"])
