"""Contract queries that run whole domain pipelines on the driver's tables.

Orders play the part of games, lines that of plays or offers.  The mappings are
arbitrary but fixed, and the oracles spell the pipelines out in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import skew
from fieldglass.plans import context, form, market_history, odds
from fieldglass.plans.registry import query, rounded
from fieldglass.session import land


def _text(prefix: str, column):
    return F.concat(F.lit(prefix), column.cast("string"))


# -- D1 ---------------------------------------------------------------------

#: Best offers as ``r``.
_ODDS = """
WITH e AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS snapshot_id, o_orderkey AS event_id, 'T' || (o_custkey % 30) AS home, 'T' || (o_custkey % 30 + 1) AS away FROM orders
), o AS (
  SELECT e.*, 'B' || l_suppkey AS book, CASE l_returnflag WHEN 'R' THEN 'h2h' WHEN 'A' THEN 'spreads' ELSE 'totals' END AS market_key,
    CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'over' ELSE 'under' END WHEN l_linenumber % 2 = 0 THEN 'home' ELSE 'away' END AS outcome_type,
    CASE WHEN l_quantity < 26 THEN -(80 + l_quantity * 5) ELSE 60 + l_quantity * 2 END AS price,
    CASE l_returnflag WHEN 'A' THEN CAST(CAST(round(l_discount * 100) AS BIGINT) - 4 AS DOUBLE) WHEN 'N' THEN CAST(40 + CAST(round(l_tax * 100) AS BIGINT) AS DOUBLE) END AS point
  FROM lineitem JOIN e ON e.event_id = l_orderkey
), p AS (
  SELECT *, CASE WHEN price >= 100 THEN 1 + price / 100 WHEN price <= -100 THEN 1 + 100 / abs(price) END AS odds,
    CASE WHEN price >= 100 THEN 100 / (price + 100) WHEN price <= -100 THEN abs(price) / (abs(price) + 100) END AS implied,
    CASE market_key WHEN 'spreads' THEN abs(point) WHEN 'totals' THEN point END AS line FROM o
), n AS (
  SELECT *, implied / nullif(sum(implied) OVER (PARTITION BY snapshot_id, event_id, book, market_key, line), 0) AS fair FROM p
), r AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER g AS books, avg(fair) OVER g AS consensus, avg(odds) OVER g AS mean_odds, max(fair) OVER g - min(fair) OVER g AS dispersion
  FROM n WINDOW g AS (PARTITION BY snapshot_id, event_id, market_key, outcome_type, point), w AS (PARTITION BY snapshot_id, event_id, market_key, outcome_type, point ORDER BY odds DESC NULLS LAST, book)
)
"""


@query("odds_pipeline", _ODDS + """
SELECT snapshot_id, CAST(event_id AS VARCHAR) AS event_id, market_key, outcome_type, point, book AS best_bookmaker_key, round(odds, 6) AS best_decimal_odds, books AS bookmaker_count,
  round(consensus, 6) AS consensus_no_vig_probability, round(dispersion, 6) AS probability_dispersion, round(odds - mean_odds, 6) AS decimal_price_improvement FROM r WHERE rn = 1
""")
def odds_pipeline(t):
    best = odds.best_odds_by_line(odds.processed_odds(*odds_tables(t)))
    keep = ["snapshot_id", "event_id", "market_key", "outcome_type", "point", "best_bookmaker_key", "bookmaker_count"]
    numbers = ["best_decimal_odds", "consensus_no_vig_probability", "probability_dispersion", "decimal_price_improvement"]
    return best.select(*keep, *[rounded(c).alias(c) for c in numbers])


def odds_tables(t):
    """Snapshots, events and offers: orders as events of their year's snapshot, lines as offers."""
    year = F.year("o_orderdate").cast("string")
    events = t.orders.select(
        year.alias("snapshot_id"), F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderdate").alias("commence_time"),
        _text("T", F.col("o_custkey") % 30).alias("home_team"), _text("T", F.col("o_custkey") % 30 + 1).alias("away_team"),
    )
    snapshots = t.orders.groupBy(year.alias("snapshot_id")).agg(F.max("o_orderdate").alias("fetched_at"))
    sides = events.select("snapshot_id", "event_id", F.col("event_id").cast("long").alias("l_orderkey"), "home_team", "away_team")
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    lines = skew.join_lookup(t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"), sides, "l_orderkey", "inner")
    offers = lines.select(
        "snapshot_id", "event_id", _text("B", F.col("l_suppkey")).alias("bookmaker_key"), F.lit(None).cast("string").alias("bookmaker_title"),
        F.lit(None).cast("timestamp").alias("bookmaker_last_update"), scalars.map_codes(flag, {"R": "h2h", "A": "spreads"}, unmapped=F.lit("totals")).alias("market_key"),
        F.when(flag == "N", F.when(F.col("l_linestatus") == "O", "Over").otherwise("Under"))
        .when(F.col("l_linenumber") % 2 == 0, F.col("home_team")).otherwise(F.col("away_team")).alias("outcome_name"),
        F.when(q < 26, -(q * 5 + 80)).otherwise(q * 2 + 60).alias("price"),
        F.when(flag == "A", F.round(F.col("l_discount") * 100) - 4).when(flag == "N", F.round(F.col("l_tax") * 100) + 40).cast("double").alias("point"),
    )
    return snapshots, events, offers


# -- D3, D4 ------------------------------------------------------------------------

def _plays(t, stored: bool = False):
    """Lines as plays of the game that is their order; ``stored`` writes the joined lines for several readers."""
    games = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("int").alias("season"), F.month("o_orderdate").alias("week"), F.to_date("o_orderdate").alias("game_date"),
        _text("H", F.col("o_custkey") % 20).alias("home_team"), _text("A", F.col("o_custkey") % 17).alias("away_team"),
    )
    used = ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_suppkey"]
    lines = skew.join_lookup(t.lineitem.select(*used), games, "l_orderkey", "inner")
    if stored:
        # The dozens of columns of a play follow from these; each reader works out those it needs.
        lines = land(lines, "plays")
    home = F.col("l_linenumber") % 2 == 1
    flag, q = F.col("l_returnflag"), F.col("l_quantity").cast("int")
    one = lambda test: test.cast("int")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("game_id"), "season", F.lit("REG").alias("season_type"), "week", "game_date", "home_team", "away_team",
        F.when(home, F.col("home_team")).otherwise(F.col("away_team")).alias("posteam"), F.when(home, F.col("away_team")).otherwise(F.col("home_team")).alias("defteam"),
        (q % 4 + 1).alias("down"), (q * 2).alias("yardline_100"), (q / 50).alias("wp"), one(flag != "N").alias("qb_dropback"), F.lit(0).alias("qb_scramble"),
        one(flag == "N").alias("rush"), one((flag == "A") & (q % 7 == 0)).alias("sack"), one(q % 11 == 0).alias("interception"), one(q % 13 == 0).alias("fumble_lost"),
        (q - 20).alias("yards_gained"), F.round(F.col("l_discount") * 100 - 5).alias("epa"), one(F.col("l_tax") > 0.04).alias("success"),
        *[F.lit(0).alias(c) for c in ("qb_kneel", "aborted_play", "two_point_attempt", "special_teams_play")], one(q == 50).alias("qb_spike"),
        _text("Q", F.col("l_suppkey") % 40).alias("passer_player_id"), _text("Passer ", F.col("l_suppkey") % 40).alias("passer_player_name"),
        F.lit(None).cast("string").alias("rusher_player_id"), F.lit(None).cast("string").alias("rusher_player_name"), one(flag != "N").alias("pass_attempt"),
        one(q % 2 == 0).alias("complete_pass"), one(q % 2 == 1).alias("incomplete_pass"), q.alias("passing_yards"), q.alias("air_yards"), one(q % 9 == 0).alias("qb_hit"),
        (q - 25).cast("double").alias("cpoe"),
    )


def _results(t):
    home, away = F.col("o_orderkey") % 41, F.col("o_custkey") % 38
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("game_id"), home.cast("int").alias("home_score"), away.cast("int").alias("away_score"),
                           *[F.lit(None).cast("string").alias(c) for c in ("home_qb_id", "home_qb_name", "away_qb_id", "away_qb_name")])
    return scalars.derive_outcome(rows, "home_score", "away_score")


_FORM = """
WITH g AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS game_id, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(o_orderdate AS DATE) AS game_date, 'H' || (o_custkey % 20) AS home, 'A' || (o_custkey % 17) AS away,
    o_orderkey % 41 AS hs, o_custkey % 38 AS aws FROM orders
), v AS (
  SELECT g.*, CASE WHEN l_linenumber % 2 = 1 THEN home ELSE away END AS team, CASE WHEN l_linenumber % 2 = 1 THEN away ELSE home END AS opponent, l_linenumber % 2 = 1 AS is_home,
    round(l_discount * 100 - 5) AS epa, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS f, 'Q' || (l_suppkey % 40) AS qb, l_tax > 0.04 AS success
  FROM lineitem JOIN g ON g.game_id = CAST(l_orderkey AS VARCHAR) WHERE l_quantity <> 50
), o AS (
  SELECT game_id, season, game_date, team, opponent, is_home, count(*) AS plays, avg(epa) AS epa, avg(epa) FILTER (WHERE f <> 'N') AS drop_epa,
    (sum(CASE WHEN q % 11 = 0 THEN 1 ELSE 0 END) + sum(CASE WHEN q % 13 = 0 THEN 1 ELSE 0 END)) / count(*) AS turnover_rate,
    any_value(hs) AS hs, any_value(aws) AS aws FROM v GROUP BY ALL
), t AS (
  SELECT a.*, b.epa AS allowed, CASE WHEN a.is_home THEN a.hs ELSE a.aws END AS points FROM o a JOIN o b ON a.game_id = b.game_id AND a.opponent = b.team
), r AS (
  SELECT *, row_number() OVER w - 1 AS before,
    avg(epa) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS epa4, avg(points) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS points8,
    avg(allowed) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS allowed8, avg(turnover_rate) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS turn4
  FROM t WINDOW w AS (PARTITION BY team, season ORDER BY game_date, game_id)
)"""


@query("team_form", _FORM + """
SELECT game_id, season, team, before AS season_games_played_before, round(epa4, 6) + 0.0::DOUBLE AS pregame_offensive_epa_per_play_last_4, round(points8, 6) AS pregame_points_scored_last_8,
  round(allowed8, 6) + 0.0::DOUBLE AS pregame_defensive_epa_allowed_per_play_last_8, round(turn4, 6) AS pregame_turnover_rate_last_4 FROM r
""")
def team_form(t):
    rolling = form.rolling_team_features(form.team_game_efficiency(_plays(t), _results(t)))
    numbers = ["pregame_offensive_epa_per_play_last_4", "pregame_points_scored_last_8", "pregame_defensive_epa_allowed_per_play_last_8", "pregame_turnover_rate_last_4"]
    return rolling.select("game_id", "season", "team", "season_games_played_before", *[rounded(c).alias(c) for c in numbers])


@query("passer_ratings", _FORM + """, qb AS (
  SELECT game_id, game_date, team, opponent, qb, count(*) AS n, avg(epa) AS epa FROM v WHERE f <> 'N' GROUP BY ALL
), a AS (
  SELECT qb.*, qb.epa - coalesce(r.allowed8, 0) AS adj FROM qb LEFT JOIN r ON r.game_id = qb.game_id AND r.team = qb.opponent
), d AS (SELECT qb, game_date AS day, CAST(sum(n) AS DOUBLE) AS n, sum(n * adj) AS s, sum(n * adj * adj) AS q FROM a GROUP BY ALL),
l AS (SELECT day, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM d GROUP BY day),
pd AS (
  SELECT x.qb, x.day, coalesce(sum(y.n * pow(0.5, (x.day - y.day) / 365.0)), 0) AS n, coalesce(sum(y.s * pow(0.5, (x.day - y.day) / 365.0)), 0) AS s
  FROM d x LEFT JOIN d y ON x.qb = y.qb AND y.day < x.day GROUP BY ALL
), pl AS (
  SELECT x.day, coalesce(sum(y.n * pow(0.5, (x.day - y.day) / 365.0)), 0) AS n, coalesce(sum(y.s * pow(0.5, (x.day - y.day) / 365.0)), 0) AS s, coalesce(sum(y.q * pow(0.5, (x.day - y.day) / 365.0)), 0) AS q
  FROM l x LEFT JOIN l y ON y.day < x.day GROUP BY ALL
), m AS (
  SELECT day, coalesce(s / nullif(n, 0), 0) AS mean, greatest(coalesce(sqrt(greatest(q / nullif(n, 0) - pow(s / nullif(n, 0), 2), 0)), 0.05), 0.05) AS sd FROM pl
)
SELECT a.game_id, a.team, a.qb AS qb_id, round(pd.n, 4) AS pregame_effective_dropbacks,
  round(100 + 15 * ((pd.n * coalesce(pd.s / nullif(pd.n, 0), mean) + 200 * mean) / (pd.n + 200) - mean) / sd, 4) AS pregame_qb_rating, round(15 / sqrt(greatest(pd.n + 200, 1)), 6) AS pregame_rating_standard_error
FROM a JOIN pd ON pd.qb = a.qb AND pd.day = a.game_date JOIN m ON m.day = a.game_date
""")
def passer_ratings(t):
    # As in production, each stage is a table of its own, with the columns that the next one reads.
    plays, results = _plays(t, stored=True), _results(t)
    rolling = form.rolling_team_features(form.team_game_efficiency(plays, results))
    rolling = land(rolling.select("game_id", "team", "pregame_defensive_epa_allowed_per_play_last_8"), "rolling")
    performance = land(form.qb_game_performance(plays, results).select(*form.RATED), "passers")
    history = form.qb_rating_history(performance, rolling)
    return history.select(
        "game_id", "team", "qb_id", rounded("pregame_effective_dropbacks", 4).alias("pregame_effective_dropbacks"), rounded("pregame_qb_rating", 4).alias("pregame_qb_rating"),
        rounded("pregame_rating_standard_error").alias("pregame_rating_standard_error"),
    )


# -- D6 --------------------------------------------------------------------------------

@query("game_context", """
WITH s AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS game_id, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 15 AS INTEGER) AS hr, CAST(o_custkey % 15 AS INTEGER) AS ar,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'dome' WHEN '2-HIGH' THEN 'outdoors' WHEN '3-MEDIUM' THEN 'open' ELSE 'unknown' END AS roof,
    CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_orderkey % 110 AS DOUBLE) END AS temp, CAST(o_custkey % 25 AS DOUBLE) AS wind,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 41 + o_custkey % 38 END AS total FROM orders
), h AS (SELECT day, game_id, total, row_number() OVER (ORDER BY day, game_id) AS rn FROM s WHERE total IS NOT NULL),
k AS (SELECT d.day, count(h.rn) AS before FROM (SELECT DISTINCT day FROM s) d LEFT JOIN h ON h.day < d.day GROUP BY d.day),
e AS (
  SELECT k.day, count(h.rn) AS n64, CAST(sum(total) AS BIGINT) / nullif(count(h.rn), 0) AS m64, round(stddev_samp(total), 6) AS sd64 FROM k LEFT JOIN h ON h.rn <= k.before AND h.rn > k.before - 64 GROUP BY k.day
), w AS (SELECT *, roof IN ('outdoors', 'open') AND temp IS NOT NULL AS known FROM s)
SELECT game_id, hr - ar AS rest_days_difference, CAST(hr <= 6 AS INTEGER) - CAST(ar <= 6 AS INTEGER) AS short_week_difference, CAST(hr >= 13 AS INTEGER) - CAST(ar >= 13 AS INTEGER) AS post_bye_difference,
  roof AS roof_type, roof = 'dome' AS is_indoor, known AS has_game_weather, CASE WHEN known THEN temp ELSE 65 END AS modeled_temperature_f, known AND wind >= 15 AS is_high_wind,
  CASE WHEN known THEN greatest(50 - temp, 0) ELSE 0 END AS cold_degrees_below_50, CASE WHEN known THEN greatest(wind - 10, 0) ELSE 0 END AS wind_mph_above_10,
  n64 AS league_game_count_last_64, m64 AS league_average_total_last_64, sd64 AS league_total_standard_deviation_last_64
FROM w JOIN e USING (day)
""")
def game_context(t):
    schedule = t.orders.select(
        F.col("o_orderkey").cast("string").alias("game_id"), F.year("o_orderdate").alias("season"), F.lit("REG").alias("game_type"), F.month("o_orderdate").alias("week"),
        F.to_date("o_orderdate").alias("gameday"), F.lit("H").alias("home_team"), F.lit("A").alias("away_team"), (F.col("o_orderkey") % 15).alias("home_rest"), (F.col("o_custkey") % 15).alias("away_rest"),
        F.concat(F.lit(" "), scalars.map_codes(F.col("o_orderpriority"), {"1-URGENT": "Dome", "2-HIGH": "outdoors", "3-MEDIUM": "OPEN"}, unmapped=F.lit(""))).alias("roof"),
        F.lit("Grass").alias("surface"), F.lit("S").alias("stadium_id"), F.lit("S").alias("stadium"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderkey") % 110).alias("temp"),
        (F.col("o_custkey") % 25).alias("wind"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 41).alias("home_score"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 38).alias("away_score"),
    )
    schedule = scalars.derive_outcome(schedule, "home_score", "away_score")
    rest = context.schedule_features(schedule).select("game_id", "rest_days_difference", "short_week_difference", "post_bye_difference")
    weather = context.weather_features(schedule).select("game_id", "roof_type", "is_indoor", "has_game_weather", "modeled_temperature_f", "is_high_wind", "cold_degrees_below_50", "wind_mph_above_10")
    scoring = context.scoring_environment(schedule).select(
        "game_id", "league_game_count_last_64", "league_average_total_last_64", rounded("league_total_standard_deviation_last_64").alias("league_total_standard_deviation_last_64")
    )
    return rest.join(weather, "game_id").join(scoring, "game_id")


# -- D9, D10 --------------------------------------------------------------------------------

@query("market_ledger", """
WITH g AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS game_id, year(o_orderdate) AS season, CAST(o_orderkey % 41 - o_custkey % 38 AS DOUBLE) AS margin, CAST(o_orderkey % 41 + o_custkey % 38 AS DOUBLE) AS total,
    0.3 + (o_orderkey % 40) / 100 AS p, 0.35 + (o_custkey % 30) / 100 AS c, CAST(o_custkey % 15 AS DOUBLE) - 7.5 AS line, CAST(o_orderkey % 13 AS DOUBLE) - 6 AS pm, 30.0::DOUBLE + o_custkey % 20 AS tl, 28.0::DOUBLE + o_orderkey % 24 AS pt FROM orders
), l AS (
  SELECT game_id, season, 'h2h' AS market_key, abs(p - c) AS edge, CASE WHEN p - c >= 0 THEN 1 / c ELSE 1 / (1 - c) END AS odds,
    CASE WHEN p - c >= 0 THEN CASE WHEN margin > 0 THEN 1 ELSE -1 END ELSE CASE WHEN margin < 0 THEN 1 ELSE -1 END END AS cmp FROM g
  UNION ALL SELECT game_id, season, 'spreads', abs(pm + line), CASE WHEN pm + line >= 0 THEN 1 + 100 / 110 ELSE 2.05 END, (margin + line) * CASE WHEN pm + line >= 0 THEN 1 ELSE -1 END FROM g
  UNION ALL SELECT game_id, season, 'totals', abs(pt - tl), CASE WHEN pt - tl >= 0 THEN 1 + 100 / 115 ELSE 1 + 100 / 105 END, (total - tl) * CASE WHEN pt - tl >= 0 THEN 1 ELSE -1 END FROM g
), s AS (
  SELECT *, CASE WHEN cmp > 1e-9 THEN 'WIN' WHEN cmp < -1e-9 THEN 'LOSS' ELSE 'PUSH' END AS result, CASE WHEN cmp > 1e-9 THEN odds - 1 WHEN cmp < -1e-9 THEN -1 ELSE 0 END AS profit,
    CASE WHEN market_key = 'h2h' THEN CASE WHEN edge < 0.025 THEN 'LOW' WHEN edge < 0.05 THEN 'MEDIUM' WHEN edge < 0.10 THEN 'HIGH' ELSE 'VERY_HIGH' END
      ELSE CASE WHEN edge < 1 THEN 'LOW' WHEN edge < 2 THEN 'MEDIUM' WHEN edge < 3 THEN 'HIGH' ELSE 'VERY_HIGH' END END AS bucket FROM l
), u AS (SELECT * FROM s UNION ALL SELECT * REPLACE ('ALL' AS bucket) FROM s), r AS (
  SELECT *, sum(profit) OVER (PARTITION BY market_key, bucket ORDER BY season, game_id ROWS UNBOUNDED PRECEDING) AS run FROM u
), d AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY market_key, bucket ORDER BY season, game_id ROWS UNBOUNDED PRECEDING)) AS peak FROM r)
SELECT market_key, bucket AS edge_bucket, count(*) AS bet_count, count(*) FILTER (WHERE result = 'WIN') AS win_count, count(*) FILTER (WHERE result = 'LOSS') AS loss_count,
  count(*) FILTER (WHERE result = 'PUSH') AS push_count, round(sum(profit), 4) AS total_profit, round(avg(profit) * 100, 4) AS roi_percent, round(avg(edge), 6) AS mean_edge, round(max(greatest(peak - run, 0)), 4) AS maximum_drawdown_units
FROM d GROUP BY ALL
""")
def market_ledger(t):
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    games = t.orders.select(
        key.cast("string").alias("game_id"), F.year("o_orderdate").alias("season"), (key % 41 - who % 38).cast("double").alias("actual_home_margin"), (key % 41 + who % 38).cast("double").alias("actual_total"),
        (F.lit(0.3) + (key % 40) / 100).alias("home_win_probability"), (F.lit(0.35) + (who % 30) / 100).alias("home_market_probability_close"), F.lit(0.5).alias("home_market_probability_open"),
        ((who % 15).cast("double") - 7.5).alias("home_line_close"), F.lit(-1.0).alias("home_line_open"), F.lit(-110.0).alias("home_line_close_price"), F.lit(105.0).alias("away_line_close_price"),
        ((key % 13).cast("double") - 6).alias("predicted_home_margin"), (F.lit(30.0) + who % 20).alias("total_line_close"), F.lit(40.0).alias("total_line_open"),
        F.lit(-115.0).alias("over_price_close"), F.lit(-105.0).alias("under_price_close"), (F.lit(28.0) + key % 24).alias("predicted_total"),
    )
    mine = ["home_win_probability", "predicted_home_margin", "predicted_total"]
    predictions = [games.select("game_id", "season", F.lit("m").alias("model_name"), c) for c in mine]
    ledger = market_history.historical_ledger(*predictions, games.drop(*mine))
    out = market_history.historical_summary(ledger)
    numbers = {"total_profit": 4, "roi_percent": 4, "mean_edge": 6, "maximum_drawdown_units": 4}
    return out.select("market_key", "edge_bucket", "bet_count", "win_count", "loss_count", "push_count", *[rounded(c, d).alias(c) for c, d in numbers.items()])


@query("market_movement", """
WITH a AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS k, l_partkey AS game, CASE l_returnflag WHEN 'A' THEN 'spreads' ELSE 'totals' END AS market_key,
    CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'O' THEN 'home' ELSE 'away' END ELSE CASE WHEN l_linestatus = 'O' THEN 'over' ELSE 'under' END END AS side,
    l_shipdate AS ts, l_quantity - 25 AS point, 1.5 + l_quantity / 50 AS odds, l_discount > 0.04 AS tip, round(l_extendedprice) AS ev FROM lineitem
), x AS (SELECT *, sha256(k) AS archive_key FROM a), e AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game, market_key, side ORDER BY ts, ev DESC, point DESC, archive_key) AS rn FROM x WHERE tip) WHERE rn = 1
), m AS (
  SELECT e.game, e.market_key, e.side, e.archive_key AS ek, e.point AS ep, e.odds AS eo, c.archive_key AS lk, c.point AS lp, c.odds AS lo, c.ts AS lts,
    row_number() OVER (PARTITION BY e.archive_key ORDER BY c.ts DESC NULLS LAST, c.ev DESC, c.point DESC, c.archive_key) AS rn
  FROM e LEFT JOIN x c ON c.game = e.game AND c.market_key = e.market_key AND c.side = e.side AND c.ts > e.ts AND c.ts < e.ts + INTERVAL 400 DAY
), f AS (
  SELECT *, CASE WHEN market_key = 'spreads' OR side = 'under' THEN ep - lp ELSE lp - ep END AS adv, 100 * (1 / lo - 1 / eo) AS move FROM m WHERE rn = 1
)
SELECT CAST(game AS VARCHAR) AS game_id, market_key, side AS outcome_type, ek AS entry_archive_key, lk AS latest_archive_key, adv AS entry_line_advantage_points, round(move, 6) AS price_movement_implied_probability_pp,
  CASE WHEN lk IS NULL THEN 'NO_LATER_SNAPSHOT' WHEN adv > 0 THEN 'POSITIVE' WHEN adv < 0 THEN 'NEGATIVE' WHEN move > 1e-6 THEN 'POSITIVE' WHEN move < -1e-6 THEN 'NEGATIVE' ELSE 'UNCHANGED' END AS market_movement_direction
FROM f
""")
def market_movement(t):
    spreads, opened = F.col("l_returnflag") == "A", F.col("l_linestatus") == "O"
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    nothing = F.lit(None).cast("string")
    archive = t.lineitem.select(
        F.sha2(key, 256).alias("archive_key"), F.lit("run").alias("refresh_run_id"), F.lit("s").alias("snapshot_id"), F.col("l_shipdate").alias("fetched_at"), F.col("l_shipdate").alias("archived_at"),
        (F.col("l_shipdate") + F.expr("INTERVAL 400 DAYS")).alias("commence_time"), F.col("l_partkey").cast("string").alias("game_id"), F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"),
        nothing.alias("home_team"), nothing.alias("away_team"), F.when(spreads, "spreads").otherwise("totals").alias("market_key"), nothing.alias("market_name"), nothing.alias("outcome_name"),
        F.when(spreads, F.when(opened, "home").otherwise("away")).otherwise(F.when(opened, "over").otherwise("under")).alias("outcome_type"), F.lit(None).cast("double").alias("market_line"),
        (F.col("l_quantity") - 25).alias("point"), nothing.alias("best_bookmaker_key"), nothing.alias("best_bookmaker_title"), F.lit(None).cast("double").alias("best_american_price"),
        (F.lit(1.5) + F.col("l_quantity") / 50).alias("best_decimal_odds"), nothing.alias("model_name"), nothing.alias("model_version"), nothing.alias("prediction_mode"),
        F.col("l_shipdate").alias("prediction_generated_at"), F.lit(0.5).alias("model_probability"), F.round("l_extendedprice").alias("expected_value_percent"), (F.col("l_discount") > 0.04).alias("is_tip_candidate"),
    )
    rows = market_history.market_movement(archive)
    return rows.select(
        "game_id", "market_key", "outcome_type", "entry_archive_key", "latest_archive_key", "entry_line_advantage_points",
        rounded("price_movement_implied_probability_pp").alias("price_movement_implied_probability_pp"), "market_movement_direction",
    )
