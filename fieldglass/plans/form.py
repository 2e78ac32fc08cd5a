"""D3: plays to team form.  D4: dropbacks to passer ratings and game features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import aggregates, joins, windows
from fieldglass.plans.reference_values import FORM_METRICS, FORM_WINDOWS, FRANCHISES, PASSER_HALF_LIFE_DAYS, PASSER_PRIOR

EXCLUDED = ["qb_kneel", "qb_spike", "aborted_play", "two_point_attempt", "special_teams_play"]
GAME = ["game_id", "season", "season_type", "week", "game_date", "team", "opponent", "home_team", "away_team", "is_home"]


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _game_columns(plays: DataFrame) -> DataFrame:
    return plays.withColumns({
        "game_date": F.to_date("game_date"), "team": F.col("posteam"), "opponent": F.col("defteam"),
        "is_home": scalars.flag(F.col("posteam") == F.col("home_team")),
        "is_competitive": scalars.flag(F.col("wp").between(0.10, 0.90)),
    })


def valid_plays(pbp: DataFrame) -> DataFrame:
    """Offensive plays that count, with their classes."""
    designed = scalars.flag((F.col("rush") == 1) & (_zero("qb_scramble") == 0))
    dropback = scalars.flag(F.col("qb_dropback") == 1)
    rows = _game_columns(pbp).withColumns({
        "is_dropback": dropback, "is_designed_rush": designed,
        "is_early_down": scalars.flag(F.col("down").isin(1, 2)), "is_red_zone": scalars.flag(F.col("yardline_100") <= 20),
        "is_explosive": scalars.flag((dropback & (F.col("yards_gained") >= 20)) | (designed & (F.col("yards_gained") >= 10))),
    })
    rows = scalars.filter_valid(rows, ["game_id", "posteam", "defteam", "epa"], EXCLUDED)
    return rows.where(F.col("is_dropback") | F.col("is_designed_rush"))


def team_game_offense(plays: DataFrame) -> DataFrame:
    always = F.lit(True)
    epa, success = F.col("epa"), F.col("success").cast("double")
    classes = {"competitive": "is_competitive", "dropback": "is_dropback", "designed_rush": "is_designed_rush", "early_down": "is_early_down"}
    specs = {"offensive_plays": ("count", F.lit(1), always), "offensive_epa_per_play": ("avg", epa, always), "success_rate": ("avg", success, always)}
    counts = {"dropbacks": "is_dropback", "designed_rushes": "is_designed_rush", "competitive_plays": "is_competitive",
              "early_down_plays": "is_early_down", "red_zone_plays": "is_red_zone", "explosive_plays": "is_explosive"}
    specs |= {name: ("count", F.lit(1), F.col(c)) for name, c in counts.items()}
    specs |= {f"{name}_epa_per_play": ("avg", epa, F.col(c)) for name, c in classes.items()}
    specs |= {f"{name}_success_rate": ("avg", success, F.col(c)) for name, c in (("dropback", "is_dropback"), ("designed_rush", "is_designed_rush"))}
    sums = {"sacks_allowed": "sack", "interceptions_thrown": "interception", "fumbles_lost": "fumble_lost"}
    specs |= {name: ("sum", _zero(c), always) for name, c in sums.items()}
    rows = aggregates.agg_where(plays, GAME, specs)
    return rows.withColumns({
        "turnovers": F.col("interceptions_thrown") + F.col("fumbles_lost"),
        "explosive_play_rate": aggregates.ratio(F.col("explosive_plays"), F.col("offensive_plays")),
        "sack_rate": aggregates.ratio(F.col("sacks_allowed"), F.col("dropbacks")),
        "turnover_rate": aggregates.ratio(F.col("interceptions_thrown") + F.col("fumbles_lost"), F.col("offensive_plays")),
    })


#: What a defence allowed is what the opponent's offence did.
DEFENSE = {
    "offensive_epa_per_play": "defensive_epa_allowed_per_play", "competitive_epa_per_play": "competitive_defensive_epa_allowed_per_play",
    "success_rate": "defensive_success_rate_allowed", "explosive_play_rate": "explosive_play_rate_allowed",
    "sack_rate": "sack_rate_generated", "turnover_rate": "turnover_rate_generated",
}


def team_game_efficiency(pbp: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row per team and game: offence, what the defence allowed, the score."""
    offense = team_game_offense(valid_plays(pbp))
    both = joins.mirror_join(offense, "game_id", "team", "opponent", DEFENSE | {"team": "__other"}).where("__other IS NOT NULL").drop("__other")
    scores = schedule.select("game_id", "home_score", "away_score", "home_win", "away_win", "is_tie")
    rows = both.join(scores, "game_id")
    home = F.col("is_home")
    own = F.when(home, F.col("home_score")).otherwise(F.col("away_score"))
    other = F.when(home, F.col("away_score")).otherwise(F.col("home_score"))
    return rows.withColumns({
        "points_scored": own, "points_allowed": other, "point_differential": own - other,
        "team_win": F.when(home, F.col("home_win")).otherwise(F.col("away_win")),
    }).drop("home_score", "away_score", "home_win", "away_win")


def rolling_team_features(efficiency: DataFrame) -> DataFrame:
    """Means over the team's last 4 and 8 earlier games of the season."""
    keep = ["game_id", "season", "season_type", "week", "game_date", "team", "opponent", "is_home"]
    rows = efficiency.select(*keep, *FORM_METRICS)
    out = windows.rolling_prior(rows, ["team", "season"], ["game_date", "game_id"], FORM_METRICS, FORM_WINDOWS)
    short, long = FORM_WINDOWS
    names = {f"{m}_last_{n}": f"pregame_{m}_last_{n}" for m in FORM_METRICS for n in FORM_WINDOWS}
    names |= {"games_before": "season_games_played_before", f"games_last_{short}": "short_window_games", f"games_last_{long}": "long_window_games"}
    return out.drop(*FORM_METRICS).withColumnsRenamed(names)


# -- D4 -------------------------------------------------------------------------------

def valid_dropbacks(pbp: DataFrame) -> DataFrame:
    scramble = scalars.flag(F.col("qb_scramble") == 1)
    rows = _game_columns(pbp).withColumns({
        "qb_id": F.when(scramble, F.coalesce("rusher_player_id", "passer_player_id")).otherwise(F.col("passer_player_id")),
        "qb_name": F.when(scramble, F.coalesce("rusher_player_name", "passer_player_name")).otherwise(F.col("passer_player_name")),
        "is_throw": (_zero("pass_attempt") == 1) & (_zero("sack") == 0) & (_zero("qb_scramble") == 0),
    })
    rows = scalars.filter_valid(rows, ["game_id", "posteam", "defteam", "epa", "qb_id"], EXCLUDED)
    return rows.where(F.col("qb_dropback") == 1)


def qb_game_performance(pbp: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row per passer and game with team share, rank and the listed starter."""
    always, throw = F.lit(True), F.col("is_throw")
    specs = {
        "qb_name": ("max", F.col("qb_name"), always), "dropbacks": ("count", F.lit(1), always),
        "competitive_dropbacks": ("count", F.lit(1), F.col("is_competitive")), "throw_attempts": ("count", F.lit(1), throw),
        "completions": ("sum", _zero("complete_pass"), throw), "incompletions": ("sum", _zero("incomplete_pass"), throw),
        "passing_yards": ("sum", _zero("passing_yards"), throw), "epa_per_dropback": ("avg", F.col("epa"), always),
        "competitive_epa_per_dropback": ("avg", F.col("epa"), F.col("is_competitive")),
        "success_rate": ("avg", F.col("success").cast("double"), always), "cpoe": ("avg", F.col("cpoe"), throw),
        "air_yards_per_attempt": ("avg", F.col("air_yards"), throw), "sacks": ("sum", _zero("sack"), always),
        "qb_hits": ("sum", _zero("qb_hit"), always), "scrambles": ("sum", _zero("qb_scramble"), always),
        "interceptions": ("sum", _zero("interception"), always), "fumbles_lost": ("sum", _zero("fumble_lost"), always),
    }
    rows = aggregates.agg_where(valid_dropbacks(pbp), [*GAME, "qb_id"], specs)
    rows = rows.withColumn("turnovers", F.col("interceptions") + F.col("fumbles_lost"))
    rates = {"sack_rate": "sacks", "qb_hit_rate": "qb_hits", "scramble_rate": "scrambles", "turnover_rate": "turnovers"}
    rows = rows.withColumns(
        {name: aggregates.ratio(F.col(c), F.col("dropbacks")) for name, c in rates.items()}
        | {name: aggregates.ratio(F.col(c), F.col("throw_attempts")) for name, c in (("completion_rate", "completions"), ("interception_rate", "interceptions"))}
    )
    listed = schedule.select("game_id", "home_qb_id", "home_qb_name", "away_qb_id", "away_qb_name")
    rows = rows.join(listed, "game_id").withColumns({
        "listed_starter_qb_id": F.when(F.col("is_home"), F.col("home_qb_id")).otherwise(F.col("away_qb_id")),
        "listed_starter_qb_name": F.when(F.col("is_home"), F.col("home_qb_name")).otherwise(F.col("away_qb_name")),
    }).drop("home_qb_id", "home_qb_name", "away_qb_id", "away_qb_name")
    rows = windows.normalise_within(rows, ["game_id", "team"], "dropbacks", "team_dropback_share", "__team").drop("__team")
    # A team fields a handful of passers in a game.
    order = windows.Window.partitionBy("game_id", "team").orderBy(F.desc("dropbacks"), "qb_id")
    rows = rows.withColumn("qb_rank_by_dropbacks", F.row_number().over(order).cast("long"))
    return rows.withColumn("is_primary_qb", F.col("qb_rank_by_dropbacks") == 1).withColumn(
        "is_listed_starter", scalars.flag(F.col("qb_id") == F.col("listed_starter_qb_id"))
    )


#: What the ratings read of a passer's game.
RATED = ["game_id", "season", "season_type", "week", "game_date", "team", "opponent", "qb_id", "qb_name", "is_primary_qb", "team_dropback_share",
         "dropbacks", "epa_per_dropback", "cpoe", "throw_attempts", "sacks", "turnovers"]
_SUMS = ["dropbacks", "epa", "epa2", "throws", "cpoe_total", "sacks", "turnovers"]


def _passer_days(performance: DataFrame, rolling: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(games with opponent-adjusted value, sums per passer and day)."""
    defense = rolling.select(
        "game_id", F.col("team").alias("opponent"),
        F.col("pregame_defensive_epa_allowed_per_play_last_8").alias("__allowed"),
    )
    games = performance.join(defense, ["game_id", "opponent"], "left")
    games = games.withColumn("opponent_defensive_epa", F.coalesce("__allowed", F.lit(0.0))).drop("__allowed")
    games = games.withColumn("adjusted_epa_per_dropback", F.col("epa_per_dropback") - F.col("opponent_defensive_epa"))
    n, value = F.col("dropbacks").cast("double"), F.col("adjusted_epa_per_dropback")
    counted = F.col("cpoe").isNotNull() & (F.col("throw_attempts") > 0)
    days = games.groupBy("qb_id", F.col("game_date").alias("day")).agg(
        F.sum(n).alias("dropbacks"), F.sum(n * value).alias("epa"), F.sum(n * value * value).alias("epa2"),
        F.sum(F.when(counted, F.col("throw_attempts")).otherwise(0).cast("double")).alias("throws"),
        F.sum(F.when(counted, F.col("throw_attempts") * F.col("cpoe")).otherwise(0.0)).alias("cpoe_total"),
        F.sum(F.col("sacks").cast("double")).alias("sacks"), F.sum(F.col("turnovers").cast("double")).alias("turnovers"),
    )
    return games, days


def _snapshot(entity: DataFrame, pooled: DataFrame, on: list[str]) -> DataFrame:
    pooled = pooled.select(*on, *[F.col(f"prior_{c}").alias(f"pooled_prior_{c}") for c in ("dropbacks", "epa", "epa2")])
    rows = windows.shrink_rating(entity, pooled, on, "prior_dropbacks", "prior_epa", "prior_epa2", PASSER_PRIOR)
    information = F.col("prior_dropbacks") + PASSER_PRIOR
    return rows.withColumns({
        "prior_weight": F.lit(PASSER_PRIOR) / information,
        "rating_cpoe": aggregates.ratio(F.col("prior_cpoe_total"), F.col("prior_throws")),
        "rating_sack_rate": aggregates.ratio(F.col("prior_sacks"), F.col("prior_dropbacks")),
        "rating_turnover_rate": aggregates.ratio(F.col("prior_turnovers"), F.col("prior_dropbacks")),
    })


_RATING = {
    "effective_dropbacks": "prior_dropbacks", "raw_adjusted_epa_per_dropback": "raw_mean", "shrunk_adjusted_epa_per_dropback": "shrunk_mean",
    "league_mean_epa_per_dropback": "pooled_mean", "league_epa_standard_deviation": "pooled_sd", "qb_rating": "rating_index",
    "prior_weight": "prior_weight", "rating_standard_error": "rating_standard_error", "cpoe": "rating_cpoe",
    "sack_rate": "rating_sack_rate", "turnover_rate": "rating_turnover_rate",
}


def qb_rating_history(performance: DataFrame, rolling: DataFrame) -> DataFrame:
    """Pregame rating of each passer, from strictly earlier days."""
    games, days = _passer_days(performance, rolling)
    entity = windows.decayed_prior(days, "qb_id", "day", PASSER_HALF_LIFE_DAYS, _SUMS)
    league = days.groupBy("day").agg(*[F.sum(c).alias(c) for c in _SUMS])
    pooled = windows.decayed_prior(league, [], "day", PASSER_HALF_LIFE_DAYS, _SUMS)
    rated = _snapshot(entity, pooled, ["day"]).select(
        "qb_id", F.col("day").alias("game_date"), *[F.col(c).alias(f"pregame_{n}") for n, c in _RATING.items()]
    )
    keep = ["game_id", "season", "season_type", "week", "game_date", "team", "opponent", "qb_id", "qb_name", "is_primary_qb", "team_dropback_share"]
    return games.select(*keep).join(rated, ["qb_id", "game_date"])


def current_qb_ratings(performance: DataFrame, rolling: DataFrame) -> DataFrame:
    """Every passer's rating at the newest game day, all games included."""
    games, days = _passer_days(performance, rolling)
    as_of = days.agg(F.max("day")).scalar()
    entity = windows.decayed_at(days, "qb_id", "day", as_of, PASSER_HALF_LIFE_DAYS, _SUMS).withColumn("as_of_date", as_of)
    pooled = windows.decayed_at(days, [], "day", as_of, PASSER_HALF_LIFE_DAYS, _SUMS).withColumn("as_of_date", as_of)
    rated = _snapshot(entity, pooled, ["as_of_date"]).select("qb_id", "as_of_date", *[F.col(c).alias(n) for n, c in _RATING.items()])
    last = F.struct("game_date", "game_id", "team")
    played = games.groupBy("qb_id").agg(
        F.max_by("qb_name", last).alias("qb_name"), F.max_by("team", last).alias("current_team"), F.max("game_date").alias("last_game_date"),
        F.count(F.lit(1)).alias("games_played"), F.sum("dropbacks").alias("career_dropbacks"),
    )
    rows = rated.join(played, "qb_id").withColumn("days_since_last_game", F.datediff("as_of_date", "last_game_date"))
    return windows.global_rank(rows, "qb_rating", "qb_rank", ties=["qb_id"])


def game_qb_features(schedule: DataFrame, performance: DataFrame, history: DataFrame) -> DataFrame:
    """Pregame ratings of both listed passers of a completed game."""
    played = joins.semi_join(schedule.where("is_completed"), performance, "game_id")
    games = played.select(
        "game_id", "season", "game_type", "week", F.to_date("gameday").alias("game_date"), "home_team", "away_team",
        *[F.col(f"{s}_qb_{k}").alias(f"{s}_listed_qb_{k}") for s in ("home", "away") for k in ("id", "name")],
    )
    take = {"qb_rating": "rating", "effective_dropbacks": "effective_dropbacks", "prior_weight": "prior_weight", "rating_standard_error": "rating_standard_error"}
    moved = {k: v for k, v in FRANCHISES.items() if k != "LAR"}
    for side in ("home", "away"):
        rated = history.select(
            "game_id", F.col("team").alias("__team"), F.col("qb_id").alias(f"{side}_listed_qb_id"),
            *[F.col(f"pregame_{c}").alias(f"{side}_listed_qb_{n}") for c, n in take.items()],
            F.lit(True).alias(f"{side}_listed_qb_rating_available"),
        )
        games = games.withColumn("__team", scalars.map_codes(F.col(f"{side}_team"), moved))
        games = games.join(rated, ["game_id", "__team", f"{side}_listed_qb_id"], "left").drop("__team")
        games = games.withColumn(f"{side}_listed_qb_rating_available", scalars.flag(F.col(f"{side}_listed_qb_rating_available")))
    both = F.col("home_listed_qb_rating_available") & F.col("away_listed_qb_rating_available")
    error = joins.pooled_error(F.col("home_listed_qb_rating_standard_error"), F.col("away_listed_qb_rating_standard_error"))
    return games.withColumns({
        "both_listed_qb_ratings_available": both,
        "listed_qb_rating_difference": F.when(both, F.col("home_listed_qb_rating") - F.col("away_listed_qb_rating")),
        "listed_qb_rating_difference_standard_error": F.when(both, error),
    })


def game_qb_audit(features: DataFrame, performance: DataFrame) -> DataFrame:
    """Listed starters against the passers who actually led in dropbacks."""
    primary = performance.where("is_primary_qb").select("game_id", "is_home", "qb_id")
    sides = aggregates.pivot_sides(
        primary.withColumn("side", F.when(F.col("is_home"), "HOME").otherwise("AWAY")), "game_id", "side", ["HOME", "AWAY"], ["qb_id"]
    ).withColumnsRenamed({"home_qb_id": "home_actual_qb_id", "away_qb_id": "away_actual_qb_id"})
    listed = features.select("game_id", "home_listed_qb_id", "away_listed_qb_id")
    return joins.match_audit(listed, sides, ["game_id"], {"home_listed_qb_id": "home_actual_qb_id", "away_listed_qb_id": "away_actual_qb_id"})
