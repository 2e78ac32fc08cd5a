"""Current forecasts - probability, spread, totals, scores, contributions, texts, trends."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import aggregates, asof, joins, learn, windows
from fieldglass.plans import reference_values as ref


@dataclass(frozen=True)
class RoutedModel:
    """A primary feature set with a fallback for incomplete games.

    ``strength`` is C for logistic and alpha for ridge models.
    """

    name: str
    version: str
    primary: tuple[str, ...]
    fallback: tuple[str, ...]
    strength: float
    fallback_strength: float
    target: str


UNIT_BURDENS = ("offense_injury_burden_difference", "defense_injury_burden_difference", "special_teams_injury_burden_difference")
RATING, PASSER = "external_rating_difference", "external_qb_adjustment_difference"

#: Fixed values of the production models.
PROBABILITY = RoutedModel("external_probability_routing", "0.3.0", (RATING, "listed_qb_rating_difference", PASSER, *UNIT_BURDENS), (RATING, PASSER), 0.1, 0.1, "target_home_win")
SPREAD = RoutedModel("external_rating_qb_spread", "0.2.0", (RATING, PASSER), (RATING, PASSER), 10.0, 10.0, "target_point_differential")
TOTALS = RoutedModel(
    "ridge_epa_weather_qb_league_64_totals", "0.1.0",
    ("offensive_epa_sum_last_4", "defensive_epa_allowed_sum_last_4", "is_indoor", "has_game_weather", "cold_degrees_below_50",
     "heat_degrees_above_80", "wind_mph_above_10", "listed_qb_rating_sum", "league_average_total_last_64"),
    ("league_average_total_last_64", "is_indoor", "elo_rating_sum"), 100.0, 1.0, "target_total_points",
)


def _complete(features: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])


def projected_starters(depth: DataFrame) -> DataFrame:
    """The passer listed highest on the newest chart of a team's game."""
    rows = depth.where((F.upper("player_position") == "QB") & F.col("gsis_id").isNotNull() & F.col("depth_rank").isNotNull())
    far = F.lit(2_147_483_647)
    order = F.struct("depth_rank", F.coalesce("position_slot", far).alias("slot"), (-F.unix_micros("source_snapshot_at")).alias("age"), "player_name")
    return rows.groupBy("game_id", "team").agg(F.min_by(F.struct("gsis_id", "player_name"), order).alias("r")).select(
        "game_id", "team", F.col("r.gsis_id").alias("qb_id"), F.col("r.player_name").alias("qb_name")
    )


def latest_external_ratings(external: DataFrame) -> DataFrame:
    """Each team's newest external rating and passer adjustment."""
    sides = joins.two_sided(external, ["source_season", "source_week", "game_id"], {
        "home": {"team": F.col("home_team"), "external_rating": F.col("home_rating"), "external_qb_adjustment": F.col("home_qb_adjustment")},
        "away": {"team": F.col("away_team"), "external_rating": F.col("away_rating"), "external_qb_adjustment": F.col("away_qb_adjustment")},
    }).drop("side").dropna(subset=["external_rating", "external_qb_adjustment"])
    return windows.latest_per_key(sides, "team", ["source_season", "source_week", "game_id"])


def current_inputs(
    schedule: DataFrame, elo: DataFrame, qb: DataFrame, injury: DataFrame, external: DataFrame, starters: DataFrame,
    game_types: Sequence[str] = ("REG", "POST"),
) -> DataFrame:
    """Unplayed games with everything the models can use; absent inputs stay null."""
    games = schedule.where(~F.col("is_completed") & F.col("game_type").isin(*game_types))
    keep = ["game_id", "season", "game_type", "week", "gameday", "gametime", "home_team", "away_team", "location",
            "home_qb_id", "home_qb_name", "away_qb_id", "away_qb_name"]
    rows = games.select(*keep).withColumn("is_neutral", scalars.flag(F.upper(F.trim("location")) == "NEUTRAL"))
    for side in ("home", "away"):
        chart = starters.select("game_id", F.col("team").alias(f"{side}_team"), F.col("qb_id").alias("__id"), F.col("qb_name").alias("__name"))
        rows = rows.join(chart, ["game_id", f"{side}_team"], "left").withColumns({
            f"{side}_listed_qb_id": F.coalesce(f"{side}_qb_id", "__id"), f"{side}_listed_qb_name": F.coalesce(f"{side}_qb_name", "__name"),
        }).drop("__id", "__name", f"{side}_qb_id", f"{side}_qb_name")
    rows = joins.dual_role_join(rows, elo, "team", {"home": "home_team", "away": "away_team"}, ["elo_rating", "last_season"]).drop("both_available")
    rows = joins.dual_role_join(rows, qb, "qb_id", {"home_listed": "home_listed_qb_id", "away_listed": "away_listed_qb_id"}, ["qb_rating", "rating_standard_error"])
    rows = rows.withColumnRenamed("both_available", "both_listed_qb_ratings_available")
    latest = latest_external_ratings(external)
    rows = joins.dual_role_join(rows, latest, "team", {"home": "home_team", "away": "away_team"}, ["external_rating", "external_qb_adjustment"]).drop("both_available")
    exact = external.select("game_id", F.col("published_home_probability"))
    rows = rows.join(exact, "game_id", "left")
    rows = rows.join(injury.select("game_id", "has_complete_injury_data", *UNIT_BURDENS), "game_id", "left")
    return rows.withColumns({
        RATING: F.col("home_external_rating") - F.col("away_external_rating"),
        PASSER: F.col("home_external_qb_adjustment") - F.col("away_external_qb_adjustment"),
        "listed_qb_rating_difference": F.col("home_listed_qb_rating") - F.col("away_listed_qb_rating"),
        "listed_qb_rating_sum": F.col("home_listed_qb_rating") + F.col("away_listed_qb_rating"),
        "elo_rating_sum": F.col("home_elo_rating") + F.col("away_elo_rating"),
    })


def totals_inputs(inputs: DataFrame, efficiency: DataFrame, weather: DataFrame, scoring: DataFrame) -> DataFrame:
    """Adds recent form of both teams, weather and league scoring."""
    rows = inputs
    for metric, name in (("offensive_epa_per_play", "offensive_epa"), ("defensive_epa_allowed_per_play", "defensive_epa_allowed")):
        history = efficiency.select("team", "season", F.col("game_date").alias("gameday"), "game_id", metric)
        for side in ("home", "away"):
            targets = rows.select(F.col(f"{side}_team").alias("team"), "season", "gameday").distinct()
            form = asof.trailing_n(targets, history, "gameday", ["game_id"], metric, [4], by=["team", "season"]).select(
                F.col("team").alias(f"{side}_team"), "season", "gameday", F.col("mean_last_4").alias(f"{side}_{name}_last_4"),
                F.col("count_last_4").alias(f"{side}_{name}_games"),
            )
            rows = rows.join(form, [f"{side}_team", "season", "gameday"], "left")
        rows = rows.withColumn(f"{name}_sum_last_4", F.col(f"home_{name}_last_4") + F.col(f"away_{name}_last_4"))
    rows = rows.join(weather.select("game_id", "is_indoor", "has_game_weather", "cold_degrees_below_50", "heat_degrees_above_80", "wind_mph_above_10"), "game_id", "left")
    return rows.join(scoring.select("game_id", "league_average_total_last_64"), "game_id", "left")


def _numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("double") for f in dict.fromkeys(features)})


def _fit_pair(history: DataFrame, model: RoutedModel, logistic: bool) -> tuple[learn.Fit, learn.Fit]:
    """Primary and fallback models on every complete historical row."""
    rows = _numbers(history, [*model.primary, *model.fallback, model.target]).withColumn("__zero", F.lit(0)).where(F.col(model.target).isNotNull())
    out = []
    for label, features, strength in (("primary", model.primary, model.strength), ("fallback", model.fallback, model.fallback_strength)):
        candidate = [learn.Candidate(label, tuple(features))]
        train = rows.where(_complete(features))
        fit = learn.fit_logistic if logistic else learn.fit_ridge
        out += fit(train, "__zero", [1], candidate, [strength], model.target)
    return out[0], out[1]


def _routed(inputs: DataFrame, model: RoutedModel, primary: Column, fallback: Column, value: str, extra: Column | None = None) -> DataFrame:
    complete = _complete(model.primary) if extra is None else _complete(model.primary) & extra
    safe = F.when(_complete(model.fallback), fallback)
    rows = scalars.route_fallback(inputs, complete, primary, safe, value)
    return rows.withColumns({
        "has_complete_production_features": complete, "model_name": F.lit(model.name), "model_version": F.lit(model.version),
    }).withColumnRenamed("route_reason", "prediction_mode_reason")


def probability_predictions(inputs: DataFrame, history: DataFrame, generated_at: Column, model: RoutedModel = PROBABILITY) -> tuple[DataFrame, learn.Fit]:
    """Blend of the primary model and the published probability, else the fallback."""
    primary, fallback = _fit_pair(history, model, True)
    rows = _numbers(inputs, [*model.primary, *model.fallback])
    p1, p2 = scalars.inverse_logit(primary.score()), scalars.inverse_logit(fallback.score())
    published = F.col("published_home_probability")
    blended = F.lit(ref.PRIMARY_WEIGHT) * p1 + F.lit(ref.PUBLISHED_WEIGHT) * published
    extra = published.isNotNull() & scalars.flag(F.col("has_complete_injury_data"))
    rows = _routed(rows, model, blended, p2, "home_win_probability", extra)
    complete = F.col("has_complete_production_features")
    rows = rows.withColumns({
        "primary_logistic_home_win_probability": F.when(complete, p1), "fallback_logistic_home_win_probability": F.when(~complete, p2),
        "applied_primary_weight": F.when(complete, ref.PRIMARY_WEIGHT).otherwise(0.0),
        "applied_published_weight": F.when(complete, ref.PUBLISHED_WEIGHT).otherwise(0.0),
        "away_win_probability": F.lit(1.0) - F.col("home_win_probability"), "prediction_generated_at": generated_at,
        "predicted_winner": F.when(F.col("home_win_probability") >= 0.5, F.col("home_team")).otherwise(F.col("away_team")),
    })
    return rows, primary


def spread_predictions(inputs: DataFrame, history: DataFrame, generated_at: Column, model: RoutedModel = SPREAD) -> DataFrame:
    primary, fallback = _fit_pair(history, model, False)
    rows = _routed(_numbers(inputs, [*model.primary, *model.fallback]), model, primary.score(), fallback.score(), "predicted_home_margin")
    return rows.withColumns({"predicted_away_margin": -F.col("predicted_home_margin"), "prediction_generated_at": generated_at})


def totals_predictions(inputs: DataFrame, history: DataFrame, generated_at: Column, model: RoutedModel = TOTALS) -> DataFrame:
    primary, fallback = _fit_pair(history, model, False)
    rows = _routed(_numbers(inputs, [*model.primary, *model.fallback]), model, primary.score(), fallback.score(), "predicted_total_points")
    return rows.withColumn("prediction_generated_at", generated_at)


_META = ["season", "game_type", "week", "gameday", "gametime", "home_team", "away_team"]


def game_scores(spread: DataFrame, totals: DataFrame, generated_at: Column) -> DataFrame:
    """Two team scores from margin and total; both sources must agree on the game."""
    parts = ["model_name", "model_version", "prediction_mode", "prediction_generated_at"]
    a = spread.select("game_id", *_META, "predicted_home_margin", *[F.col(c).alias(f"spread_{c}") for c in parts])
    b = totals.select("game_id", *[F.col(c).alias(f"__{c}") for c in _META], "predicted_total_points", *[F.col(c).alias(f"totals_{c}") for c in parts])
    rows = joins.join_checked(a, b, "game_id", "1:1", "full_outer")
    agree = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _META])
    split = scalars.score_split(F.col("predicted_total_points"), F.col("predicted_home_margin"))
    rows = rows.withColumns({"implied_home_score": split["home_score"], "implied_away_score": split["away_score"]})
    ok = agree & (F.least("implied_home_score", "implied_away_score") >= 0)
    return rows.withColumns({
        "implied_home_score": F.when(ok, F.col("implied_home_score")).otherwise(F.raise_error(F.lit("spread and totals games differ or a score is negative")).cast("double")),
        "implied_score_winner": F.when(split["winner"] == "HOME", F.col("home_team")).otherwise(F.col("away_team")),
        "score_prediction_generated_at": generated_at,
    }).drop(*[f"__{c}" for c in _META])


def feature_contributions(predictions: DataFrame, fit: learn.Fit) -> DataFrame:
    """Exact log-odds contributions of complete games; they rebuild the probability."""
    terms = fit.terms()
    weights = dict(zip(fit.features, zip(fit.weights, fit.means, fit.sds)))
    rows = predictions.where("has_complete_production_features")
    out = windows.contributions_long(rows.withColumn("__raw", F.create_map(*[x for f in fit.features for x in (F.lit(f), F.col(f).cast("double"))])), ["game_id", "__raw", "primary_logistic_home_win_probability"], terms)
    table = F.create_map(*[x for f, (w, m, s) in weights.items() for x in (F.lit(f), F.struct(F.lit(float(w)).alias("w"), F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")))])
    setting = F.element_at(table, F.col("feature_name"))
    raw = F.element_at("__raw", F.col("feature_name"))
    return out.select(
        "game_id", "feature_name", raw.alias("raw_feature_value"), ((raw - setting["m"]) / setting["s"]).alias("standardized_feature_value"),
        setting["w"].alias("coefficient"), F.col("contribution").alias("log_odds_contribution"),
        F.abs("contribution").alias("absolute_log_odds_contribution"), F.col("importance_rank").alias("contribution_rank"),
        F.lit(float(fit.intercept)).alias("logistic_intercept"),
        scalars.logit(F.col("primary_logistic_home_win_probability"), 1e-15).alias("logistic_total_log_odds"),
        F.col("primary_logistic_home_win_probability").alias("logistic_reconstructed_home_win_probability"),
    )


def explanations(predictions: DataFrame) -> DataFrame:
    """Favourite, its probability and the wording of the edge."""
    home = F.col("predicted_winner") == F.col("home_team")
    favorite = F.greatest("home_win_probability", "away_win_probability")
    return predictions.select(
        "game_id", *_META, "model_name", "model_version", "prediction_mode", "prediction_mode_reason", "home_win_probability", "away_win_probability",
        F.col("predicted_winner").alias("favorite"), F.when(home, F.col("away_team")).otherwise(F.col("home_team")).alias("underdog"),
        favorite.alias("favorite_win_probability"), scalars.edge_strength(favorite).alias("matchup_label"),
        (F.col("home_win_probability") - F.col("published_home_probability")).alias("adjustment_from_published"),
        "has_complete_injury_data", "both_listed_qb_ratings_available", "has_complete_production_features",
    )


def narratives(explained: DataFrame, contributions: DataFrame) -> DataFrame:
    """P25: short texts in two languages, with the strongest feature if there is one."""
    top = contributions.where("contribution_rank = 1").select("game_id", "feature_name", "log_odds_contribution")
    rows = explained.join(top, "game_id", "left")
    percent = F.format_string("%.1f%%", F.col("favorite_win_probability") * 100)
    comma = F.replace(percent, F.lit("."), F.lit(","))
    favorite, underdog, feature = F.col("favorite"), F.col("underdog"), F.col("feature_name")
    supports = (F.col("log_odds_contribution") > 0) == (favorite == F.col("home_team"))
    always, known = F.lit(True), feature.isNotNull()
    texts = scalars.render_text({
        "headline_en": [(F.col("matchup_label") == "toss_up", "%s and %s are close to even", [favorite, underdog]), (always, "%s favored over %s", [favorite, underdog])],
        "headline_hu": [(F.col("matchup_label") == "toss_up", "%s és %s közel egyenlő", [favorite, underdog]), (always, "%s az esélyesebb %s ellen", [favorite, underdog])],
        "summary_en": [(always, "%s has a %s chance to win.", [favorite, percent])],
        "summary_hu": [(always, "%s győzelmi esélye %s.", [favorite, comma])],
        "top_factor_en": [(known & supports, "%s weighs most and supports %s.", [feature, favorite]), (known, "%s weighs most but speaks against %s.", [feature, favorite])],
        "top_factor_hu": [(known & supports, "A legerősebb tényező (%s) %s mellett szól.", [feature, favorite]), (known, "A legerősebb tényező (%s) %s ellen szól.", [feature, favorite])],
    })
    return rows.select("game_id", *[c.alias(n) for n, c in texts.items()])


def technical_view(predictions: DataFrame, contributions: DataFrame) -> DataFrame:
    """One row per game and feature with the direction of its effect."""
    explained = explanations(predictions)
    rows = explained.join(contributions, "game_id", "left")
    known, plus = F.col("feature_name").isNotNull(), F.col("log_odds_contribution") > 0
    home = F.col("favorite") == F.col("home_team")
    return rows.withColumns({
        "feature_effect_on_home_probability": F.when(known, F.when(plus, "supports_home").otherwise("supports_away")),
        "feature_effect_on_favorite": F.when(known, F.when(plus == home, "supports_favorite").otherwise("opposes_favorite")),
    })


def probability_archive_rows(predictions: DataFrame, archived_at: Column, status: str = "PUBLISHED") -> DataFrame:
    """Both sides of each published prediction, ready for S9 by generation time."""
    keep = ["game_id", "season", "week", "model_name", "model_version", "prediction_mode", "prediction_generated_at"]
    return joins.two_sided(predictions, keep, {
        "HOME": {"team": F.col("home_team"), "win_probability": F.col("home_win_probability")},
        "AWAY": {"team": F.col("away_team"), "win_probability": F.col("away_win_probability")},
    }).withColumnRenamed("side", "outcome_side").withColumns({"publication_status": F.lit(status), "archived_at": archived_at})


def probability_trends(predictions: DataFrame, archive: DataFrame, band: float = 0.5) -> DataFrame:
    """Change in points against the newest archived prediction of the same model."""
    key = ["game_id", "team", "outcome_side"]
    prior = archive.where("publication_status = 'PUBLISHED'").select(
        *key, "prediction_generated_at", "archived_at", F.col("win_probability").alias("previous_probability"),
        *[F.col(c).alias(f"previous_{c}") for c in ("model_name", "model_version", "prediction_mode")],
    )
    prior = windows.latest_per_key(prior, key, ["prediction_generated_at", "archived_at"]).withColumnRenamed("prediction_generated_at", "previous_prediction_generated_at")
    now = probability_archive_rows(predictions, F.lit(None).cast("timestamp")).drop("archived_at", "publication_status")
    rows = now.join(prior.drop("archived_at"), key, "left")
    same = scalars.flag(reduce(lambda a, b: a & b, [F.col(f"previous_{c}") == F.col(c) for c in ("model_name", "model_version", "prediction_mode")]))
    current, previous = 100.0 * F.col("win_probability"), 100.0 * F.col("previous_probability")
    rows = rows.withColumns({
        "is_comparable_model_state": same, "previous_win_probability": F.col("previous_probability"),
        "probability_change_pp": F.when(same, current - previous), "probability_trend": windows.trend_class(current, previous, same, band),
    })
    values = ["team", "previous_win_probability", "probability_change_pp", "probability_trend"]
    game = ["game_id", "season", "week", "prediction_generated_at"]
    wide = aggregates.pivot_sides(rows, game, "outcome_side", ["HOME", "AWAY"], values)
    states = rows.groupBy("game_id").agg(
        F.bool_and("is_comparable_model_state").alias("is_comparable_model_state"),
        F.max("previous_prediction_generated_at").alias("previous_prediction_generated_at"),
    )
    return wide.join(states, "game_id").withColumn("neutral_threshold_pp", F.lit(float(band)))
