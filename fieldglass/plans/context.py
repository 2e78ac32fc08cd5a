"""Schedule tables, D6 game context and D7 the modelling dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import asof, joins
from fieldglass.operators.quality import Rules
from fieldglass.plans import reference_values as ref

_INTEGERS = ["season", "week", "away_score", "home_score", "overtime", "away_rest", "home_rest", "away_moneyline", "home_moneyline",
             "away_spread_odds", "home_spread_odds", "under_odds", "over_odds", "temp", "wind"]
_TEXTS = ["game_id", "game_type", "gametime", "weekday", "away_team", "home_team", "location", "roof", "surface", "away_qb_id", "home_qb_id",
          "away_qb_name", "home_qb_name", "away_coach", "home_coach", "referee", "stadium_id", "stadium"]


def processed_schedule(raw: DataFrame) -> DataFrame:
    """Typed schedule with results, null while a game is unplayed."""
    typed = raw.select(
        *[F.col(c).cast("int").alias(c) for c in _INTEGERS], *[F.col(c).cast("string").alias(c) for c in _TEXTS],
        F.to_date("gameday").alias("gameday"), F.col("spread_line").cast("double").alias("spread_line"), F.col("total_line").cast("double").alias("total_line"),
    )
    rows = scalars.derive_outcome(typed, "home_score", "away_score")
    return rows.withColumns({
        "home_rest_advantage": F.col("home_rest") - F.col("away_rest"),
        "is_regular_season": F.col("game_type") == "REG", "is_playoff": F.col("game_type").isin("WC", "DIV", "CON", "SB"),
    })


def schedule_rules(schedule: DataFrame) -> Rules:
    done = F.col("is_completed")
    return Rules(
        columns=["game_id", "season", "week", "home_team", "away_team"], key=["game_id"],
        rows={
            "missing_game_id": F.col("game_id").isNull(), "same_team": F.col("home_team") == F.col("away_team"),
            "result_without_score": ~done & F.col("home_win").isNotNull(),
            "total_identity": done & (F.col("total_points") != F.col("home_score") + F.col("away_score")),
            "result_domain": ~F.col("game_result").isin("NOT_PLAYED", "HOME_WIN", "AWAY_WIN", "TIE"),
        },
    )


def schedule_features(schedule: DataFrame) -> DataFrame:
    """Rest days, rest flags and their differences."""
    home, away = F.col("home_rest").cast("int"), F.col("away_rest").cast("int")
    rows = schedule.select("game_id", "season", "game_type", "week", F.to_date("gameday").alias("game_date"), "home_team", "away_team",
                           home.alias("home_rest_days"), away.alias("away_rest_days"), (home - away).alias("rest_days_difference"))
    out = {}
    for name, bounds in (("short_week", {"low": ref.SHORT_WEEK}), ("extended_rest", {"high": ref.EXTENDED_REST}), ("post_bye", {"high": ref.POST_BYE})):
        marks = scalars.threshold_diff(F.col("home_rest_days"), F.col("away_rest_days"), **bounds)
        out |= {f"home_{name}": marks["a_flag"].cast("boolean"), f"away_{name}": marks["b_flag"].cast("boolean"), f"{name}_difference": marks["flag_diff"]}
    return rows.withColumns(out)


def weather_features(schedule: DataFrame) -> DataFrame:
    """Venue class and weather, neutral where the game is not exposed."""
    roof = scalars.category(F.col("roof"))
    temperature, wind = F.col("temp").cast("double"), F.col("wind").cast("double")
    exposed = roof.isin(*ref.EXPOSED_ROOFS)
    known = exposed & temperature.isNotNull() & wind.isNotNull()
    return schedule.select(
        "game_id", "season", F.to_date("gameday").alias("game_date"), "home_team", "away_team", roof.alias("roof_type"),
        F.lower(F.trim("surface")).alias("surface_type"), "stadium_id", "stadium", roof.isin(*ref.INDOOR_ROOFS).alias("is_indoor"),
        exposed.alias("is_weather_exposed"), known.alias("has_game_weather"), temperature.alias("raw_temperature_f"), wind.alias("raw_wind_mph"),
        F.when(known, temperature).otherwise(ref.NEUTRAL_TEMPERATURE).alias("modeled_temperature_f"),
        F.when(known, wind).otherwise(ref.NEUTRAL_WIND).alias("modeled_wind_mph"),
        scalars.flag(known & (temperature <= ref.FREEZING)).alias("is_freezing"), scalars.flag(known & (wind >= ref.HIGH_WIND)).alias("is_high_wind"),
        scalars.flag(known & (temperature >= ref.EXTREME_HEAT)).alias("is_extreme_heat"),
        scalars.hinge(temperature, ref.COLD_KNOT, "below", known).alias("cold_degrees_below_50"),
        scalars.hinge(temperature, ref.HEAT_KNOT, "above", known).alias("heat_degrees_above_80"),
        scalars.hinge(wind, ref.WIND_KNOT, "above", known).alias("wind_mph_above_10"),
    )


def scoring_environment(schedule: DataFrame, game_types: tuple[str, ...] = ("REG", "POST")) -> DataFrame:
    """League scoring over the last N games on earlier days, for every game."""
    games = schedule.withColumn("gameday", F.to_date("gameday"))
    history = games.where(F.col("is_completed") & F.col("total_points").isNotNull() & F.col("game_type").isin(*game_types)).select("gameday", "game_id", "total_points")
    targets = games.select("game_id", "season", "game_type", "gameday", "home_team", "away_team")
    rows = asof.trailing_n(targets, history, "gameday", ["game_id"], "total_points", list(ref.SCORING_WINDOWS))
    names = {}
    for n in ref.SCORING_WINDOWS:
        names |= {f"count_last_{n}": f"league_game_count_last_{n}", f"mean_last_{n}": f"league_average_total_last_{n}",
                  f"sd_last_{n}": f"league_total_standard_deviation_last_{n}"}
    return rows.withColumnsRenamed(names | {"gameday": "game_date"})


def modeling_dataset(
    schedule: DataFrame, rest: DataFrame, elo: DataFrame, rolling: DataFrame, qb: DataFrame, injury: DataFrame, weather: DataFrame, scoring: DataFrame
) -> DataFrame:
    """One row per completed game with every pregame feature and the targets.

    All sides have one row per game (checked), so the star join keeps its grain.
    """
    home, away = F.col("home_score"), F.col("away_score")
    base = schedule.where("is_completed").select(
        "game_id", "season", "game_type", "week", F.to_date("gameday").alias("game_date"), "home_team", "away_team",
        home.alias("target_home_score"), away.alias("target_away_score"), F.when(home != away, F.col("home_win")).alias("target_home_win"),
        F.when(home > away, 1.0).when(home < away, 0.0).otherwise(0.5).alias("target_home_result"),
        F.col("point_differential").alias("target_point_differential"), F.col("total_points").alias("target_total_points"),
    )
    common = {"season", "game_type", "week", "game_date", "gameday", "home_team", "away_team"}

    def only(df: DataFrame) -> DataFrame:
        return df.select(*[c for c in df.columns if c not in common])

    elo = elo.select("game_id", F.col("home_advantage").alias("elo_home_advantage"), F.col("home_rating_pre").alias("home_elo_rating"),
                     F.col("away_rating_pre").alias("away_elo_rating"), F.col("home_win_probability").alias("elo_home_win_probability"))
    counts = {"season_games_played_before": "season_games_played_before", "short_window_games": "short_window_games", "long_window_games": "long_window_games"}
    metrics = [f"{m}_last_{n}" for m in ref.FORM_METRICS for n in ref.FORM_WINDOWS]

    def side(flag: bool, prefix: str) -> DataFrame:
        return rolling.where(F.col("is_home") == flag).select(
            "game_id", *[F.col(c).alias(f"{prefix}_{n}") for c, n in counts.items()], *[F.col(f"pregame_{m}").alias(f"{prefix}_{m}") for m in metrics]
        )

    rows = base
    for part in (only(rest), elo, side(True, "home"), side(False, "away"), only(qb), only(injury), only(weather), only(scoring)):
        rows = joins.join_checked(rows, part, "game_id", "m:1")
    differences = {}
    for m in ref.FORM_METRICS:
        for n in ref.FORM_WINDOWS:
            differences[f"{m}_difference_last_{n}"] = F.col(f"home_{m}_last_{n}") - F.col(f"away_{m}_last_{n}")
    complete = {}
    for name, n in (("short", ref.FORM_WINDOWS[0]), ("long", ref.FORM_WINDOWS[1])):
        tests = [F.col(f"{s}_{name}_window_games") == n for s in ("home", "away")]
        complete |= {f"home_{name}_window_complete": tests[0], f"away_{name}_window_complete": tests[1], f"both_{name}_windows_complete": tests[0] & tests[1]}
    return rows.withColumns(differences | complete | {"elo_rating_difference": F.col("home_elo_rating") - F.col("away_elo_rating")})


def modeling_splits(dataset: DataFrame) -> DataFrame:
    """Split label and eligibility flags per game."""
    season = F.col("season")
    rows = dataset.where(season.between(ref.TRAIN_SEASONS[0], ref.HOLDOUT_SEASON))
    label = scalars.assign_split(season, [(ref.TRAIN_SEASONS[1], "train"), (ref.VALIDATION_SEASONS[1], "validation")], "holdout")
    target = F.col("target_home_win").isNotNull()
    qb = F.col("both_listed_qb_ratings_available")
    return rows.select(
        "game_id", "season", "game_type", "week", "game_date", label.alias("split_name"),
        F.when(label == "train", 1).when(label == "validation", 2).otherwise(3).alias("split_order"),
        target.alias("is_binary_target_eligible"), F.col("both_short_windows_complete").alias("has_complete_short_history"),
        F.col("both_long_windows_complete").alias("has_complete_long_history"), qb.alias("has_both_qb_ratings"),
        (target & F.col("both_short_windows_complete") & qb).alias("is_core_model_eligible"),
        (target & F.col("both_long_windows_complete") & qb).alias("is_extended_model_eligible"),
    )
