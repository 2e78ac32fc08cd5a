"""Serving products.  D12: dispersion and market diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import aggregates, joins, skew, topk, windows
from fieldglass.operators.quantiles import exact_quantiles
from fieldglass.operators.reshape import prefer_primary
from fieldglass.plans.reference_values import FRANCHISES

_MOVED = {k: FRANCHISES[k] for k in ("OAK", "LAR")}


def weekly_games(probability: DataFrame, spread: DataFrame, totals: DataFrame, scores: DataFrame, completed: DataFrame | None = None, trends: DataFrame | None = None) -> DataFrame:
    """Upcoming games with all forecasts; archived final rows replace played ones."""
    rows = probability.select(
        "game_id", "season", "week", "gameday", "gametime", "away_team", "home_team", "away_win_probability", "home_win_probability", "predicted_winner",
        F.col("model_name").alias("probability_model_name"), F.col("prediction_mode").alias("probability_prediction_mode"),
    )
    rows = joins.join_checked(rows, spread.select("game_id", "predicted_home_margin", F.col("prediction_mode").alias("spread_prediction_mode")), "game_id")
    rows = joins.join_checked(rows, totals.select("game_id", "predicted_total_points", F.col("prediction_mode").alias("totals_prediction_mode")), "game_id")
    rows = joins.join_checked(rows, scores.select("game_id", "implied_away_score", "implied_home_score"), "game_id")
    if trends is not None:
        rows = joins.join_checked(rows, trends.drop("season", "week", "home_team", "away_team", "prediction_generated_at"), "game_id", how="left")
    none = F.lit(None).cast("int")
    rows = rows.withColumns({"is_completed": F.lit(False), "away_score": none, "home_score": none})
    if completed is None:
        return rows
    types = dict(rows.dtypes)
    have = set(completed.columns)
    final = completed.select(*[(F.col(c).cast(types[c]) if c in have else F.lit(None).cast(types[c])).alias(c) for c in rows.columns])
    return prefer_primary(final, rows, "game_id").drop("source_label")


def served_board(board: DataFrame, probability: DataFrame, spread: DataFrame) -> DataFrame:
    p = probability.select("game_id", "home_win_probability")
    m = spread.select("game_id", "predicted_home_margin")
    return joins.join_checked(joins.join_checked(board, p, "game_id"), m, "game_id")


#: Fixed values of the publication rule.
CRITERIA = {"books": 5, "probability": 0.50, "edge": (3.0, 10.0), "value": (0.0, 20.0)}


def publication_status(board: DataFrame, criteria: dict = CRITERIA) -> DataFrame:
    """TOP_PICK, SUPPRESSED_SIDE_CONFLICT or NOT_SELECTED per offer."""
    p, margin = F.col("home_win_probability"), F.col("predicted_home_margin")
    conflict = scalars.flag(((p > 0.5) & (margin < 0)) | ((p < 0.5) & (margin > 0)))
    suppressed = conflict & F.col("market_key").isin("h2h", "spreads")
    edge, value = F.col("probability_edge_percentage_points"), F.col("expected_value_percent")
    eligible = scalars.flag(
        F.col("positive_expected_value") & (F.col("bookmaker_count") >= criteria["books"]) & (F.col("model_probability") >= criteria["probability"])
        & edge.between(*criteria["edge"]) & value.between(*criteria["value"]) & ~suppressed
    )
    return board.withColumns({
        "side_model_conflict": conflict, "side_recommendation_suppressed": suppressed, "publication_eligible": eligible,
        "publication_status": F.when(eligible, "TOP_PICK").when(suppressed, "SUPPRESSED_SIDE_CONFLICT").otherwise("NOT_SELECTED"),
    })


def recommended_picks(board: DataFrame, now: Column) -> DataFrame:
    """The next week's eligible offers, the best one per game and market."""
    rows = board.where((F.col("commence_time") > now) & F.col("week").isNotNull())
    rows = scalars.before_event(rows, "commence_time", ["fetched_at"])
    rows = publication_status(topk.next_period(rows, "commence_time", "week", now))
    order = [F.desc("expected_value_percent"), F.desc("bookmaker_count"), F.asc("commence_time"), F.asc("outcome_type"), F.asc_nulls_last("point")]
    return topk.top_rows(rows.where("publication_eligible"), ["game_id", "market_key"], order)


def featured_picks(picks: DataFrame, limit: int = 6) -> DataFrame:
    """The strongest recommended picks, for a front page."""
    order = [F.desc("expected_value_percent"), F.desc("bookmaker_count"), F.asc("commence_time"), F.asc("game_id"), F.asc("market_key")]
    return topk.limit_ordered(picks, order, limit)


def preferred_sides(board: DataFrame) -> DataFrame:
    """T4: per game and market the likelier side of its most quoted line."""
    line = F.when(F.col("market_key") == "spreads", F.round(F.abs("point"), 6)).when(F.col("market_key") == "totals", F.round("point", 6))
    keep = ["outcome_type", "outcome_name", "point", "bookmaker_count", "model_probability", "probability_edge_percentage_points", "expected_value_percent"]
    rows = topk.preferred_in_modal_group(
        board, ["game_id", "market_key"], F.coalesce(line, F.lit(0.0)), "bookmaker_count", ["model_probability", "bookmaker_count", "outcome_type"], keep
    )
    return rows.withColumn("market_probability", F.col("model_probability") - F.col("probability_edge_percentage_points") / 100.0)


def team_rosters(
    depth: DataFrame, directory: DataFrame, injuries: DataFrame, external: DataFrame, units: DataFrame
) -> DataFrame:
    """Newest depth chart of every team with directory, injury and rank columns.

    Optional sources may be empty frames of their schema; the plan is the same.
    The directory matches on the player id, or on the alternate id of rows that
    have none, written as two equi-joins.
    """
    season = depth.agg(F.max("source_season")).scalar()
    current = depth.where(F.col("source_season") == season).withColumn("snapshot_at", F.to_timestamp("dt"))
    rows = windows.newest_snapshot(current, "team", "snapshot_at").select(
        "source_season", "snapshot_at", "team", "player_name", F.col("espn_id").cast("string").alias("espn_id"), "gsis_id",
        "pos_grp", "pos_name", "pos_abb", "pos_slot", "pos_rank",
    )
    person = ["jersey_number", "headshot", "status"]
    identity = F.coalesce("gsis_id", F.concat(F.lit("ESPN:"), F.col("espn_id").cast("string")))
    people = directory.withColumn("__k", identity).groupBy("__k").agg(
        F.max_by(F.struct("gsis_id", F.col("espn_id").cast("string").alias("espn_id"), *person), F.struct("last_season", "gsis_id", "espn_id")).alias("r")
    ).select("r.*")
    by_id = people.where("gsis_id IS NOT NULL").select("gsis_id", F.struct(*person).alias("__p1"))
    by_alt = people.where("espn_id IS NOT NULL").groupBy("espn_id").agg(F.min(F.struct(*person)).alias("__p2"))
    rows = rows.join(by_id, "gsis_id", "left").withColumn("__alt", F.when(F.col("gsis_id").isNull(), F.col("espn_id")))
    rows = rows.join(by_alt.withColumnRenamed("espn_id", "__alt"), "__alt", "left").withColumn("__p", F.coalesce("__p1", "__p2"))
    rows = rows.withColumns({"jersey_number": F.col("__p.jersey_number"), "headshot": F.col("__p.headshot"), "roster_status": F.col("__p.status")}).drop("__p", "__p1", "__p2", "__alt")
    report = ["report_status", "report_primary_injury", "practice_status"]
    latest = injuries.groupBy(F.col("season").alias("source_season"), "team", "gsis_id").agg(
        F.max_by(F.struct(*report), F.struct("week", "date_modified")).alias("i")
    ).select("source_season", "team", "gsis_id", "i.*")
    rows = rows.join(latest, ["source_season", "team", "gsis_id"], "left")
    # One row per team from here on.
    sides = joins.two_sided(external, ["source_season", "source_week", "source_fetched_at"], {
        "home": {"team": scalars.map_codes(F.col("home_team"), _MOVED), "rating": F.col("home_rating")},
        "away": {"team": scalars.map_codes(F.col("away_team"), _MOVED), "rating": F.col("away_rating")},
    })
    ratings = _opening_week(sides, "source_season", "source_week").groupBy("team").agg(
        F.avg("rating").alias("elo_rating"), F.max("source_fetched_at").alias("elo_source_fetched_at")
    )
    ratings = windows.rank_summary(ratings, "elo_rating", "elo_rank")
    unit = _opening_week(units, "season", "week").withColumn("team", scalars.map_codes(F.col("team"), _MOVED))
    ranks = {"off_value_pre": "offense_rank", "def_value_pre": "defense_rank", "pass_off_value_pre": "pass_offense_rank",
             "rush_off_value_pre": "rush_offense_rank", "pass_def_value_pre": "pass_defense_rank", "rush_def_value_pre": "rush_defense_rank"}
    for value, name in ranks.items():
        unit = windows.rank_summary(unit, value, name)
    unit = unit.select("team", *ranks.values(), F.col("source_fetched_at").alias("units_source_fetched_at"))
    return rows.join(ratings, "team", "left").join(unit, "team", "left")


def _opening_week(df: DataFrame, season: str, week: str) -> DataFrame:
    """Rows of the newest season's first week."""
    newest = df.where(F.col(season) == df.agg(F.max(season)).scalar())
    return newest.where(F.col(week) == newest.agg(F.min(week)).scalar())


def team_schedule(schedule: DataFrame, elo: DataFrame, weeks: int = 18) -> DataFrame:
    """Every team's regular season with bye rows, state labels and opponent ratings."""
    regular = schedule.where("game_type = 'REG'")
    current = regular.where(F.col("season") == regular.agg(F.max("season")).scalar())
    team = lambda c: scalars.map_codes(F.col(c), _MOVED)

    def side(own: str, other: str, home: bool) -> dict[str, Column]:
        return {"team": team(f"{own}_team"), "opponent": team(f"{other}_team"), "is_home": F.lit(home), "team_score": F.col(f"{own}_score"), "opponent_score": F.col(f"{other}_score")}

    games = joins.two_sided(current, ["season", "week", "gameday", "gametime", "is_completed"], {"home": side("home", "away", True), "away": side("away", "home", False)}).drop("side")
    games = windows.first_per_key(games.where(F.col("week").between(1, weeks)), ["team", "week"], ["gameday", "gametime"])
    ratings = elo.select(team("team").alias("opponent"), F.col("elo_rating").alias("opponent_elo"))
    games = games.join(ratings, "opponent", "left")
    spine = games.groupBy("team", "season").agg(F.lit(1).alias("__one")).select("team", "season", F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week"))
    rows = joins.complete_left(spine, games, ["team", "season", "week"], [], "__played")
    open_week = current.where(~F.col("is_completed")).agg(F.min("week")).scalar()
    rows = rows.withColumns({"current_week": open_week, "is_bye": ~F.col("__played"), "is_completed": scalars.flag(F.col("is_completed"))}).drop("__played")
    now = scalars.flag(F.col("week") == F.col("current_week"))
    return rows.withColumns({
        "is_current_week": now, "venue": F.when(F.col("is_bye"), "").when(scalars.flag(F.col("is_home")), "vs").otherwise("@"),
        "schedule_state": F.when(F.col("is_bye"), "BYE").when(F.col("is_completed"), "COMPLETED").when(now, "CURRENT").otherwise("UPCOMING"),
    })


def impact_summary(dataset: DataFrame) -> DataFrame:
    """Overlapping historical segments in one scan."""
    rest = F.col("home_rest_days") - F.col("away_rest_days")
    qb = F.col("home_listed_qb_rating") - F.col("away_listed_qb_rating")
    injury = F.col("home_total_injury_burden") - F.col("away_total_injury_burden")
    rows = dataset.where("target_home_score IS NOT NULL AND target_away_score IS NOT NULL")
    topics = {
        "home_field": {"all_games": F.lit(True)},
        "rest": {"home_3_plus": rest >= 3, "away_3_plus": rest <= -3, "similar": F.abs(rest) < 3, "home_post_bye": F.col("home_post_bye") & ~F.col("away_post_bye")},
        "qb": {"home_advantage": qb >= 0.75, "away_advantage": qb <= -0.75, "similar": F.abs(qb) < 0.75},
        "injury": {"home_more_injured": injury >= 2, "away_more_injured": injury <= -2, "similar": F.abs(injury) < 2},
        "weather": {"indoor": F.col("is_indoor"), "freezing": F.col("is_freezing"), "high_wind": F.col("is_high_wind"),
                    "other_exposed": F.col("is_weather_exposed") & ~F.col("is_freezing") & ~F.col("is_high_wind")},
    }
    out = aggregates.segment_summary(rows, topics, {
        "game_count": F.count(F.lit(1)), "win_rate": F.avg(F.col("target_home_win").cast("double")),
        "average_margin": F.avg("target_point_differential"), "average_total": F.avg("target_total_points"),
    })
    weather = F.col("topic") == "weather"
    return out.withColumns({
        "win_rate": F.when(~weather, F.col("win_rate")), "average_margin": F.when(~weather, F.col("average_margin")),
        "average_total": F.when(weather, F.col("average_total")),
    })


def standings(summary: DataFrame) -> DataFrame:
    """Expected standings of a season summary table (one row per team)."""
    order = windows.Window.orderBy(F.desc("expected_wins"), F.desc("expected_final_elo"), "team")
    return summary.withColumns({
        "rank": F.row_number().over(order), "p10_p90_range": F.format_string("%.0f–%.0f", F.col("p10_wins").cast("double"), F.col("p90_wins").cast("double")),
    })


# -- D12 ------------------------------------------------------------------------

def dispersion_summary(df: DataFrame, by: str | Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Spread and calibration of predictions against outcomes, per model layer."""
    by = skew.names(by)
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    line = aggregates.calibration_line(rows, by, actual, predicted).withColumnsRenamed(
        {"n": "game_count", "slope": "calibration_slope", "intercept": "calibration_intercept", "sd_ratio": "prediction_to_actual_dispersion_ratio"}
    )
    moments = rows.groupBy(*by).agg(
        F.avg(actual).alias("actual_mean"), F.avg(predicted).alias("prediction_mean"),
        F.stddev_pop(actual).alias("actual_standard_deviation"), F.stddev_pop(predicted).alias("prediction_standard_deviation"),
    )
    out = line.join(moments, by)
    for column, name in ((actual, "actual"), (predicted, "prediction")):
        out = out.join(exact_quantiles(rows, by, column, {f"{name}_p10": 0.1, f"{name}_p90": 0.9}), by)
    return out


def market_comparison(moneyline: DataFrame) -> DataFrame:
    """Model against market probability of home offers in one aggregate."""
    rows = moneyline.where("outcome_type = 'home'").select("model_probability", F.col("consensus_no_vig_probability").alias("market_probability")).dropna()
    m, k = "model_probability", "market_probability"
    return rows.agg(
        F.count(F.lit(1)).alias("game_count"), F.avg(m).alias("model_probability_mean"), F.avg(k).alias("market_probability_mean"),
        F.stddev_pop(m).alias("model_probability_standard_deviation"), F.stddev_pop(k).alias("market_probability_standard_deviation"),
        (F.stddev_pop(m) / F.nullif(F.stddev_pop(k), F.lit(0.0))).alias("model_to_market_dispersion_ratio"),
        F.regr_intercept(k, m).alias("market_on_model_intercept"), F.regr_slope(k, m).alias("market_on_model_slope"),
        F.avg(F.abs(F.col(m) - F.col(k))).alias("mean_absolute_probability_difference"),
        F.min(m).alias("model_minimum_probability"), F.max(m).alias("model_maximum_probability"),
        F.min(k).alias("market_minimum_probability"), F.max(k).alias("market_maximum_probability"),
    )


def extreme_predictions(df: DataFrame, by: str | Sequence[str], predicted: str, limits: Sequence[float]) -> DataFrame:
    """A14 over absolute predictions."""
    return aggregates.extreme_rates(df, by, F.abs(predicted), limits)
