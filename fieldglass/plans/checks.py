"""Quality suites of the published tables (Q2-Q5).

Each suite returns ``(check_name, issue_count, severity, status)`` rows.  Row
rules of a table share one aggregate; keys, references and recomputations add
one grouped job each.  Counts that belong to one data delivery are arguments,
not constants.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import aggregates, quality
from fieldglass.plans import form, reference_values as ref

TINY = 1e-6


def _c(name: str) -> Column:
    return F.col(name)


def _off(a: Column, b: Column, tolerance: float = TINY) -> Column:
    """Two values differ, null-safely."""
    return (a.isNull() != b.isNull()) | scalars.flag(F.abs(a - b) > tolerance)


def _unit(*columns: str) -> Column:
    """Any of the given shares lies outside 0..1."""
    return reduce(lambda a, b: a | b, [scalars.flag(~_c(c).between(0.0, 1.0)) for c in columns])


def _missing(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, [_c(c).isNull() for c in columns])


def rows_equal(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Both tables have the same number of rows (two scalar counts)."""
    count = F.count(F.lit(1))
    return a.agg(count.alias("n")).select(F.lit(name).alias("check_name"), (F.col("n") != b.agg(count).scalar()).cast("long").alias("issue_count"))


def row_count_is(df: DataFrame, expected: int, name: str) -> DataFrame:
    return df.agg((F.count(F.lit(1)) != expected).cast("long").alias("issue_count")).select(F.lit(name).alias("check_name"), "issue_count")


def count_of(df: DataFrame, name: str) -> DataFrame:
    """The number of rows of a frame that holds only faults."""
    return df.agg(F.count(F.lit(1)).alias("issue_count")).select(F.lit(name).alias("check_name"), "issue_count")


def leaked_columns(df: DataFrame, forbidden: Sequence[str], name: str) -> DataFrame:
    """Post-event columns that must not be in a feature table (schema only)."""
    n = len(set(forbidden) & set(df.columns))
    return df.sparkSession.range(1).select(F.lit(name).alias("check_name"), F.lit(n).cast("long").alias("issue_count"))


def report(
    df: DataFrame | None = None,
    rows: Mapping[str, Column] | None = None,
    keys: Mapping[str, Sequence[str]] | None = None,
    references: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None,
    extra: Sequence[DataFrame] = (),
) -> DataFrame:
    parts = []
    if rows:
        parts.append(quality.row_checks(df, rows))
    parts += [quality.key_check(df, key, name) for name, key in (keys or {}).items()]
    parts += [quality.reference_check(df, other, on, name) for name, (other, on) in (references or {}).items()]
    parts += list(extra)
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumn("severity", F.lit("error")).withColumn("status", F.when(F.col("issue_count") == 0, "PASS").otherwise("FAIL"))


# -- schedule and odds ------------------------------------------------------------------

def processed_schedule(schedule: DataFrame, raw: DataFrame) -> DataFrame:
    home, away = _c("home_score"), _c("away_score")
    done = home.isNotNull() & away.isNotNull()
    return report(schedule, {
        "missing_game_id": _missing("game_id"), "inconsistent_score_pair": home.isNull() != away.isNull(),
        "invalid_completed_flag": _c("is_completed") != done,
        "invalid_game_result_flags": done & ((_c("home_win") != (home > away)) | (_c("away_win") != (away > home)) | (_c("is_tie") != (home == away))),
        "invalid_point_differential": _off(_c("point_differential"), F.when(done, home - away)), "invalid_total_points": _off(_c("total_points"), F.when(done, home + away)),
        "invalid_regular_season_flag": _c("is_regular_season") != (_c("game_type") == "REG"),
        "invalid_playoff_flag": _c("is_playoff") != _c("game_type").isin("WC", "DIV", "CON", "SB"),
        "invalid_team_assignment": _missing("home_team", "away_team") | (_c("home_team") == _c("away_team")),
    }, {"duplicate_game_id": ["game_id"]}, extra=[rows_equal(schedule, raw, "row_count_matches_raw")])


def odds_load(snapshots: DataFrame, events: DataFrame, offers: DataFrame) -> DataFrame:
    outcomes = offers.groupBy("snapshot_id", "event_id", "bookmaker_key", "market_key").agg(F.count(F.lit(1)).alias("n"))
    counted = events.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    bad_events = snapshots.select("snapshot_id", "event_count").join(counted, "snapshot_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("event_count"))
    market = _c("market_key")
    return report(offers, {
        "missing_market_value": _missing("bookmaker_key", "market_key", "outcome_name", "price"),
        "unsupported_market": ~market.isin(*scalars.MARKET_NAMES), "invalid_american_price": scalars.flag(F.abs("price") < 100),
        "invalid_moneyline_point": (market == "h2h") & _c("point").isNotNull(),
        "missing_spread_or_total_point": market.isin("spreads", "totals") & _c("point").isNull(),
    }, {"duplicate_offer": ["snapshot_id", "event_id", "bookmaker_key", "market_key", "outcome_name", "point"]},
        {"orphan_market_record": (events, ["snapshot_id", "event_id"])},
        [
            quality.row_checks(events, {
                "missing_event_identifier": _missing("snapshot_id", "event_id", "commence_time"),
                "invalid_team_assignment": _missing("home_team", "away_team") | (_c("home_team") == _c("away_team")),
            }),
            quality.key_check(events, ["snapshot_id", "event_id"], "duplicate_event"),
            count_of(outcomes.where("n < 2"), "invalid_outcome_count"), count_of(bad_events, "snapshot_event_count_matches"),
        ])


def processed_odds(processed: DataFrame, offers: DataFrame) -> DataFrame:
    market, price = _c("market_key"), _c("american_price")
    group = ["snapshot_id", "event_id", "bookmaker_key", "market_key", "market_line"]
    sums = processed.groupBy(*group).agg(F.sum("no_vig_probability").alias("s")).where(F.abs(F.col("s") - 1.0) > TINY)
    return report(processed, {
        "american_to_decimal_mismatch": _off(_c("decimal_odds"), scalars.american_to_decimal(price)),
        "implied_probability_mismatch": _off(_c("implied_probability"), scalars.implied_probability(price)),
        "invalid_decimal_odds": scalars.flag(_c("decimal_odds") <= 1.0), "invalid_implied_probability": _unit("implied_probability"),
        "invalid_no_vig_probability": _unit("no_vig_probability"), "missing_calculated_value": (F.abs(price) >= 100) & _missing("decimal_odds", "implied_probability", "no_vig_probability"),
        "invalid_moneyline_market_line": (market == "h2h") & _c("market_line").isNotNull(),
        "missing_spread_or_total_market_line": market.isin("spreads", "totals") & _c("market_line").isNull(), "unknown_outcome_type": _c("outcome_type") == "other",
    }, extra=[count_of(sums, "no_vig_group_not_equal_to_one"), rows_equal(processed, offers, "row_count_matches_raw")])


def best_odds(best: DataFrame, processed: DataFrame) -> DataFrame:
    group = ["snapshot_id", "event_id", "market_key", "outcome_type", "point"]
    rebuilt = processed.groupBy(*group).agg(F.max("decimal_odds").alias("top"), F.count(F.lit(1)).cast("double").alias("n"))
    # The line is part of the key and may be null; -9999.5 is no line.
    fill = {"point": -9999.5}
    pairs = best.select(*group, _c("best_decimal_odds").alias("top"), _c("bookmaker_count").cast("double").alias("n")).fillna(fill)
    recompute = quality.recompute_check(pairs, rebuilt.fillna(fill), group, ["top", "n"])
    named = recompute.withColumn("check_name", scalars.map_codes(F.col("check_name"), {"top": "incorrect_best_price", "n": "incorrect_bookmaker_count"}))
    p = _c("consensus_no_vig_probability")
    return report(best, {
        "missing_best_bookmaker": _missing("best_bookmaker_key"), "invalid_consensus_probability": _unit("consensus_no_vig_probability"),
        "consensus_outside_market_range": scalars.flag((p < _c("minimum_no_vig_probability") - TINY) | (p > _c("maximum_no_vig_probability") + TINY)),
        "negative_price_improvement": scalars.flag(_c("decimal_price_improvement") < -TINY),
    }, {"duplicate_offer_group": group}, extra=[named, rows_equal(best, rebuilt, "row_count_matches_offer_groups")])


def event_bridge(bridge: DataFrame, events: DataFrame, teams: Mapping[str, str] = ref.TEAM_CODES) -> DataFrame:
    matched = _c("match_status") == "MATCHED"
    none = F.lit(None).cast("string")
    wrong = [~scalars.map_codes(_c(f"odds_{s}_team"), teams, unmapped=none).eqNullSafe(_c(f"{s}_team_code")) for s in ("home", "away")]
    return report(bridge, {
        "missing_bridge_identifier": _missing("snapshot_id", "odds_event_id"), "event_not_matched": ~matched,
        "incorrect_game_date": matched & (_c("eastern_game_date") != _c("gameday")), "incorrect_team_match": wrong[0] | wrong[1],
    }, {"duplicate_odds_event": ["snapshot_id", "odds_event_id"]}, extra=[
        quality.key_check(bridge.where(matched), ["snapshot_id", "game_id"], "duplicate_schedule_game"), rows_equal(bridge, events, "row_count_matches_odds_events"),
    ])


def market_board(board: DataFrame, best: DataFrame) -> DataFrame:
    newest = best.agg(F.max("fetched_at")).scalar()
    return report(board, {
        "missing_identifier": _missing("snapshot_id", "game_id", "market_key", "outcome_type"), "missing_schedule_context": _missing("season", "week", "gameday"),
        "invalid_best_price": scalars.flag(_c("best_decimal_odds") <= 1.0), "invalid_consensus_probability": _unit("consensus_no_vig_probability"),
        "invalid_market_name": ~scalars.map_codes(_c("market_key"), scalars.MARKET_NAMES).eqNullSafe(_c("market_name")), "not_latest_snapshot": _c("fetched_at") != newest,
    }, {"duplicate_equivalent_offer": ["game_id", "market_key", "outcome_type", "point"]}, extra=[
        board.agg((F.countDistinct("snapshot_id") != 1).cast("long").alias("issue_count")).select(F.lit("contains_exactly_one_snapshot").alias("check_name"), "issue_count"),
    ])


# -- ratings and form ------------------------------------------------------------------------

def rating_history(history: DataFrame, current: DataFrame, games: DataFrame, teams: int | None = None) -> DataFrame:
    change = _c("home_rating_change")
    extra = [
        quality.key_check(current, ["team"], "duplicate_current_team"), quality.row_checks(current, {"invalid_current_rating": _missing("elo_rating")}),
        rows_equal(history, games, "history_row_count_matches_source"),
    ]
    if teams is not None:
        extra.append(row_count_is(current, teams, f"current_team_count_is_{teams}"))
    return report(history, {
        "missing_game_id": _missing("game_id"), "invalid_probability": _unit("home_win_probability"), "invalid_actual_home_score": ~_c("actual_home_score").isin(0.0, 0.5, 1.0),
        "invalid_home_rating_update": _off(_c("home_rating_post"), _c("home_rating_pre") + change), "invalid_away_rating_update": _off(_c("away_rating_post"), _c("away_rating_pre") - change),
        "neutral_game_with_home_advantage": scalars.flag(_c("is_neutral")) & (_c("home_advantage") != 0),
    }, {"duplicate_game_id": ["game_id"]}, extra=extra)


def team_game_efficiency(efficiency: DataFrame, schedule: DataFrame) -> DataFrame:
    per_game = efficiency.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    other = efficiency.select("game_id", _c("opponent").alias("team"), _c("offensive_epa_per_play").alias("__epa"), _c("points_scored").alias("__points"))
    both = efficiency.join(other, ["game_id", "team"])
    return report(efficiency, {
        "invalid_team_assignment": _c("team") == _c("opponent"), "invalid_play_count": (_c("offensive_plays") <= 0) | (_c("dropbacks") > _c("offensive_plays")),
        "invalid_rate": _unit("success_rate", "explosive_play_rate", "sack_rate", "turnover_rate"), "missing_required_value": _missing("offensive_epa_per_play", "points_scored"),
        "invalid_game_result": (_c("points_scored") > _c("points_allowed")) != _c("team_win"),
    }, {"duplicate_game_team": ["game_id", "team"]}, {"orphan_schedule_game": (schedule, ["game_id"])}, [
        count_of(per_game.where("n <> 2"), "invalid_team_rows_per_game"),
        quality.row_checks(both, {
            "inconsistent_defensive_metric": _off(_c("defensive_epa_allowed_per_play"), _c("__epa")), "inconsistent_opponent_score": _off(_c("points_allowed").cast("double"), _c("__points").cast("double")),
        }),
    ])


def rolling_features(rolling: DataFrame, efficiency: DataFrame) -> DataFrame:
    columns = [f"pregame_offensive_epa_per_play_last_{n}" for n in ref.FORM_WINDOWS]
    rebuilt = form.rolling_team_features(efficiency)
    short, long = ref.FORM_WINDOWS
    before = _c("season_games_played_before")
    return report(rolling, {
        "first_game_contains_history": (before == 0) & (_c(columns[0]).isNotNull() | (_c("short_window_games") > 0)),
        "missing_available_history": (before > 0) & _c("pregame_points_scored_last_4").isNull(),
        "invalid_window_size": (_c("short_window_games") != F.least(before, F.lit(short))) | (_c("long_window_games") != F.least(before, F.lit(long))),
        "invalid_rolling_rate": _unit("pregame_success_rate_last_4", "pregame_turnover_rate_last_8"),
    }, {"duplicate_game_team": ["game_id", "team"]}, extra=[
        quality.recompute_check(rolling, rebuilt, ["game_id", "team"], columns).withColumn("check_name", F.concat(F.lit("incorrect_"), "check_name")),
        rows_equal(rolling, efficiency, "row_count_matches_source"),
        leaked_columns(rolling, ["points_scored", "points_allowed", "point_differential", "team_win", "is_tie"], "postgame_result_column_leakage"),
    ])


def qb_game_performance(performance: DataFrame, schedule: DataFrame, minimum_starter_match: float = 0.0) -> DataFrame:
    team = performance.groupBy("game_id", "team").agg(
        F.sum("team_dropback_share").alias("share"), aggregates.count_where(_c("is_primary_qb")).alias("primary"), F.max("dropbacks").alias("most"),
        F.max(F.when(_c("is_primary_qb"), _c("dropbacks"))).alias("led"),
    )
    starters = performance.where("is_primary_qb").agg(F.avg(_c("is_listed_starter").cast("double")).alias("r"))
    return report(performance, {
        "missing_qb_identity": _missing("qb_id"), "invalid_qb_rate": _unit("success_rate", "completion_rate", "sack_rate", "qb_hit_rate", "scramble_rate"),
        "invalid_qb_count": (_c("throw_attempts") > _c("dropbacks")) | (_c("completions") > _c("throw_attempts")), "invalid_team_assignment": _c("team") == _c("opponent"),
    }, {"duplicate_game_team_qb": ["game_id", "team", "qb_id"]}, {"orphan_schedule_game": (schedule, ["game_id"])}, [
        quality.row_checks(team, {
            "invalid_team_dropback_share": F.abs(_c("share") - 1.0) > TINY, "invalid_primary_qb_count": _c("primary") != 1, "primary_qb_not_maximum_dropbacks": _c("led") != _c("most"),
        }),
        starters.select(F.lit("starter_match_too_low").alias("check_name"), scalars.flag(_c("r") < minimum_starter_match).cast("long").alias("issue_count")),
    ])


def qb_ratings(history: DataFrame, current: DataFrame, performance: DataFrame) -> DataFrame:
    n, mean = _c("pregame_effective_dropbacks"), _c("pregame_league_mean_epa_per_dropback")
    shrunk, raw = _c("pregame_shrunk_adjusted_epa_per_dropback"), _c("pregame_raw_adjusted_epa_per_dropback")
    formula = 100.0 + 15.0 * (shrunk - mean) / _c("pregame_league_epa_standard_deviation")
    passers = performance.select("qb_id").distinct()
    ranks = current.agg(F.min("qb_rank").alias("lo"), F.max("qb_rank").alias("hi"), F.count(F.lit(1)).alias("n"), F.countDistinct("qb_rank").alias("d"))
    newest = performance.agg(F.max("game_date")).scalar()
    first = history.groupBy("qb_id").agg(F.min_by("pregame_effective_dropbacks", "game_date").alias("n"))
    played = performance.groupBy("qb_id").agg(F.count(F.lit(1)).alias("g"), F.sum("dropbacks").alias("d"))
    meta = current.join(played, "qb_id")
    return report(history, {
        "invalid_historical_rating": _missing("pregame_qb_rating") | F.isnan("pregame_qb_rating"),
        "invalid_historical_shrinkage": _off(shrunk, (n * raw + ref.PASSER_PRIOR * mean) / (n + ref.PASSER_PRIOR)),
        "incorrect_historical_rating_formula": _off(_c("pregame_qb_rating"), formula),
    }, {"duplicate_history_key": ["game_id", "team", "qb_id"]}, extra=[
        count_of(first.where("n > 0"), "first_appearance_leakage"), rows_equal(history, performance, "history_row_count_matches_source"),
        rows_equal(current, passers, "current_qb_count_matches_source"), quality.key_check(current, ["qb_id"], "duplicate_current_qb"),
        quality.row_checks(current, {"invalid_current_rating": _missing("qb_rating"), "invalid_current_as_of_date": _c("as_of_date") != newest}),
        quality.row_checks(ranks, {"invalid_current_rank": (_c("lo") != 1) | (_c("hi") != _c("n")) | (_c("d") != _c("n"))}),
        quality.row_checks(meta, {"incorrect_current_metadata": (_c("games_played") != _c("g")) | (_c("career_dropbacks") != _c("d"))}),
    ])


def game_qb_features(features: DataFrame, audit: DataFrame, schedule: DataFrame) -> DataFrame:
    both = _c("home_listed_qb_rating_available") & _c("away_listed_qb_rating_available")
    return report(features, {
        "invalid_feature_team_assignment": _c("home_team") == _c("away_team"), "invalid_rating_availability_flag": _c("both_listed_qb_ratings_available") != both,
        "invalid_listed_qb_rating_difference": _off(_c("listed_qb_rating_difference"), F.when(both, _c("home_listed_qb_rating") - _c("away_listed_qb_rating"))),
    }, {"duplicate_feature_game": ["game_id"]}, {"orphan_feature_game": (schedule, ["game_id"])}, [
        quality.key_check(audit, ["game_id"], "duplicate_audit_game"), rows_equal(audit, features, "audit_row_count_mismatch"),
        quality.row_checks(audit, {
            "missing_actual_primary_qb": _missing("home_actual_qb_id", "away_actual_qb_id"),
            "invalid_listed_actual_match_flag": ~_c("home_listed_qb_id_matches").eqNullSafe(_c("home_listed_qb_id") == _c("home_actual_qb_id")),
        }),
        leaked_columns(features, ["home_score", "away_score", "home_win", "point_differential"], "postgame_column_in_feature_table"),
    ])


# -- modelling ---------------------------------------------------------------------------------

def modeling_dataset(dataset: DataFrame, schedule: DataFrame) -> DataFrame:
    home, away = _c("target_home_score"), _c("target_away_score")
    wrong = [_off(_c(f"{m}_difference_last_{n}"), _c(f"home_{m}_last_{n}") - _c(f"away_{m}_last_{n}")) for m in ("offensive_epa_per_play", "success_rate") for n in ref.FORM_WINDOWS]
    chance = scalars.rating_probability(_c("home_elo_rating"), _c("away_elo_rating"), _c("elo_home_advantage"))
    short = (_c("home_short_window_games") == 4) & (_c("away_short_window_games") == 4)
    return report(dataset, {
        "invalid_team_assignment": _c("home_team") == _c("away_team"), "missing_elo_feature": _missing("home_elo_rating", "away_elo_rating", "elo_home_win_probability"),
        "invalid_elo_calculation": _off(_c("elo_home_win_probability"), chance) | _off(_c("elo_rating_difference"), _c("home_elo_rating") - _c("away_elo_rating")),
        "invalid_core_rolling_difference": reduce(lambda a, b: a | b, wrong), "invalid_window_metadata": _c("both_short_windows_complete") != short,
        "invalid_qb_rating_difference": _c("both_listed_qb_ratings_available") & _off(_c("listed_qb_rating_difference"), _c("home_listed_qb_rating") - _c("away_listed_qb_rating")),
        "invalid_qb_availability": _c("both_listed_qb_ratings_available") & _missing("home_listed_qb_rating", "away_listed_qb_rating"),
        "invalid_target_calculation": _off(_c("target_point_differential").cast("double"), (home - away).cast("double")) | ((home == away) != _c("target_home_win").isNull()),
    }, {"duplicate_game_id": ["game_id"]}, {"orphan_source_record": (schedule, ["game_id"])}, [
        leaked_columns(dataset, ["home_score", "away_score", "home_win", "point_differential", "total_points"], "unprefixed_target_or_postgame_column"),
    ])


def modeling_splits(splits: DataFrame, dataset: DataFrame) -> DataFrame:
    dates = splits.groupBy("split_order").agg(F.min("game_date").alias("lo"), F.max("game_date").alias("hi"))
    wide = dates.agg(*[F.max(F.when(_c("split_order") == i, _c(c))).alias(f"{c}{i}") for i in (1, 2, 3) for c in ("lo", "hi")])
    label = scalars.assign_split(_c("season"), [(ref.TRAIN_SEASONS[1], "train"), (ref.VALIDATION_SEASONS[1], "validation")], "holdout")
    present = splits.select("split_name").distinct()
    core = _c("is_binary_target_eligible") & _c("has_complete_short_history") & _c("has_both_qb_ratings")
    return report(splits, {
        "invalid_split_name": ~_c("split_name").isin("train", "validation", "holdout"), "invalid_season_assignment": _c("split_name") != label,
        "invalid_split_order": _c("split_order") != F.when(label == "train", 1).when(label == "validation", 2).otherwise(3),
        "invalid_model_eligibility": _c("is_core_model_eligible") != core, "invalid_history_eligibility": _c("has_complete_long_history") & ~_c("has_complete_short_history"),
    }, {"duplicate_game_id": ["game_id"]}, {"orphan_split_record": (dataset, ["game_id"])}, [
        quality.row_checks(wide, {"invalid_split_chronology": scalars.flag((_c("hi1") >= _c("lo2")) | (_c("hi2") >= _c("lo3")))}),
        row_count_is(present, 3, "missing_required_split"),
        rows_equal(splits, dataset.where(_c("season").between(ref.TRAIN_SEASONS[0], ref.HOLDOUT_SEASON)), "row_count_matches_dataset"),
    ])


def schedule_features(features: DataFrame, schedule: DataFrame) -> DataFrame:
    home, away = _c("home_rest_days"), _c("away_rest_days")

    def wrong(name: str, test) -> Column:
        a, b = test(home), test(away)
        return (_c(f"home_{name}") != a) | (_c(f"away_{name}") != b) | (_c(f"{name}_difference") != a.cast("int") - b.cast("int"))

    return report(features, {
        "invalid_rest_days": home.isNull() | away.isNull() | (home < 0) | (away < 0), "invalid_short_week_flags": wrong("short_week", lambda x: x <= ref.SHORT_WEEK),
        "invalid_extended_rest_flags": wrong("extended_rest", lambda x: x >= ref.EXTENDED_REST), "invalid_post_bye_flags": wrong("post_bye", lambda x: x >= ref.POST_BYE),
        "invalid_rest_flag_hierarchy": _c("home_post_bye") & ~_c("home_extended_rest"), "invalid_difference_range": ~_c("short_week_difference").between(-1, 1),
        "invalid_game_identity": _missing("game_id", "game_date") | (_c("home_team") == _c("away_team")),
    }, {"duplicate_game_id": ["game_id"]}, {"orphan_feature_record": (schedule, ["game_id"])}, [
        quality.reference_check(schedule, features, ["game_id"], "missing_feature_record"), rows_equal(features, schedule, "row_count_matches_schedule"),
    ])


# -- forecasts ------------------------------------------------------------------------------------

def predictions(table: DataFrame) -> DataFrame:
    p, q = _c("home_win_probability"), _c("away_win_probability")
    complete = _c("has_complete_production_features")
    blend = _c("applied_primary_weight") * _c("primary_logistic_home_win_probability") + _c("applied_published_weight") * _c("published_home_probability")
    return report(table, {
        "invalid_metadata": _missing("model_name", "model_version", "prediction_generated_at"), "invalid_probability_math": _unit("home_win_probability") | (F.abs(p + q - 1.0) > TINY),
        "invalid_routing": (complete != (_c("prediction_mode") == "PRIMARY")) | (complete & _off(p, blend)) | (~complete & _off(p, _c("fallback_logistic_home_win_probability"))),
    }, {"duplicate_game_id": ["game_id"]})


def explanations(table: DataFrame, predicted: DataFrame) -> DataFrame:
    values = predicted.select("game_id", _c("home_win_probability").alias("__p"))
    return report(table, {
        "invalid_probability_math": _off(_c("favorite_win_probability"), F.greatest("home_win_probability", "away_win_probability")), "invalid_routing": _missing("prediction_mode", "favorite"),
    }, {"duplicate_game_id": ["game_id"]}, extra=[
        quality.reference_check(predicted, table, ["game_id"], "missing_prediction_game"), rows_equal(table, predicted, "row_count_mismatch"),
        quality.row_checks(table.join(values, "game_id"), {"prediction_value_mismatch": _off(_c("home_win_probability"), _c("__p"))}),
    ])


def contributions(table: DataFrame, predicted: DataFrame) -> DataFrame:
    sums = table.groupBy("game_id").agg((F.sum("log_odds_contribution") + F.max("logistic_intercept")).alias("s"), F.max("logistic_total_log_odds").alias("t"))
    primary, rest = predicted.where("has_complete_production_features"), predicted.where("NOT has_complete_production_features")
    return report(table, {"invalid_contribution_value": _off(_c("log_odds_contribution"), _c("coefficient") * _c("standardized_feature_value"))},
                  {"duplicate_feature": ["game_id", "feature_name"]}, extra=[
        quality.row_checks(sums, {"invalid_contribution_math": _off(_c("s"), _c("t"))}), quality.reference_check(primary, table, ["game_id"], "missing_primary_game"),
        count_of(table.join(rest, "game_id", "left_semi"), "unexpected_fallback_contribution"),
    ])


def narratives(table: DataFrame, predicted: DataFrame) -> DataFrame:
    return report(table, {"invalid_required_text": _missing("headline_en", "headline_hu", "summary_en", "summary_hu"), "invalid_primary_factor": _c("top_factor_en").isNull() != _c("top_factor_hu").isNull()},
                  {"duplicate_game_id": ["game_id"]}, extra=[
        quality.reference_check(predicted, table, ["game_id"], "missing_prediction_game"), rows_equal(table, predicted, "row_count_mismatch"),
    ])


def technical_view(view: DataFrame, predicted: DataFrame) -> DataFrame:
    plus = _c("log_odds_contribution") > 0
    return report(view, {
        "invalid_feature_math": _c("feature_name").isNotNull() & ((_c("feature_effect_on_home_probability") == "supports_home") != plus),
        "invalid_probability_metadata": _off(_c("favorite_win_probability"), F.greatest("home_win_probability", "away_win_probability")),
        "unknown_prediction_mode": ~_c("prediction_mode").isin("PRIMARY", "FALLBACK"),
    }, extra=[quality.reference_check(predicted, view, ["game_id"], "missing_prediction_game")])


def spread_predictions(table: DataFrame, probability: DataFrame) -> DataFrame:
    return report(table, {
        "invalid_margin_math": _off(_c("predicted_away_margin"), -_c("predicted_home_margin")), "invalid_required_metadata": _missing("model_name", "model_version", "prediction_generated_at"),
        "unknown_prediction_mode": ~_c("prediction_mode").isin("PRIMARY", "FALLBACK"), "invalid_primary_routing": (_c("prediction_mode") == "PRIMARY") != _c("has_complete_production_features"),
    }, {"duplicate_game_id": ["game_id"]}, {"missing_probability_prediction_game": (probability, ["game_id"])}, [
        quality.reference_check(probability, table, ["game_id"], "missing_spread_prediction_game"), rows_equal(table, probability, "row_count_matches_probability_predictions"),
    ])


def totals_predictions(table: DataFrame, probability: DataFrame) -> DataFrame:
    return report(table, {
        "invalid_predicted_total": scalars.flag(_c("predicted_total_points") <= 0), "invalid_required_metadata": _missing("model_name", "model_version", "prediction_generated_at"),
        "unknown_prediction_mode": ~_c("prediction_mode").isin("PRIMARY", "FALLBACK"), "invalid_elo_rating_sum": _off(_c("elo_rating_sum"), _c("home_elo_rating") + _c("away_elo_rating")),
        "missing_primary_rolling_or_qb_features": (_c("prediction_mode") == "PRIMARY") & _missing("offensive_epa_sum_last_4", "listed_qb_rating_sum"),
    }, {"duplicate_game_id": ["game_id"]}, {"missing_probability_prediction_game": (probability, ["game_id"])}, [
        quality.reference_check(probability, table, ["game_id"], "missing_totals_prediction_game"), rows_equal(table, probability, "row_count_matches_probability_predictions"),
    ])


def game_scores(scores: DataFrame, spread: DataFrame, totals: DataFrame) -> DataFrame:
    home, away = _c("implied_home_score"), _c("implied_away_score")
    return report(scores, {
        "invalid_score_identity": _off(home + away, _c("predicted_total_points")) | _off(home - away, _c("predicted_home_margin")),
        "invalid_winner": _c("implied_score_winner") != F.when(home >= away, _c("home_team")).otherwise(_c("away_team")), "invalid_metadata": _missing("score_prediction_generated_at"),
    }, {"duplicate_game_id": ["game_id"]}, extra=[rows_equal(scores, spread, "row_count_matches_spread"), rows_equal(scores, totals, "row_count_matches_totals")])


def totals_value(value: DataFrame, predicted: DataFrame) -> DataFrame:
    ev = _c("win_probability") * (_c("best_decimal_odds") - 1.0) - _c("loss_probability")
    return report(value, {
        "invalid_market_metadata": (_c("market_key") != "totals") | ~_c("outcome_type").isin("over", "under"), "invalid_probability_math": _unit("win_probability", "push_probability", "loss_probability"),
        "invalid_ev_math": _off(_c("expected_value_per_unit"), ev),
    }, {"duplicate_offer": ["game_id", "market_line", "outcome_type"]}, {"missing_totals_prediction_game": (predicted, ["game_id"])})


def betting_board(board: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    total = reduce(lambda a, b: a.unionByName(b), [s.select("game_id") for s in sources])
    mass = _c("model_probability") + _c("push_probability") + _c("loss_probability")
    return report(board, {
        "invalid_probability": _unit("model_probability", "push_probability", "loss_probability") | (F.abs(mass - 1.0) > TINY),
        "invalid_ev_flag": _c("positive_expected_value") != (_c("expected_value_per_unit") > 0), "invalid_metadata": _missing("betting_board_generated_at", "market_key"),
    }, extra=[rows_equal(board, total, "source_row_count_mismatch"), row_count_is(board.select("market_key").distinct(), 3, "missing_market")])


# -- market history ----------------------------------------------------------------------------------

def historical_market(ledger: DataFrame, summary: DataFrame) -> DataFrame:
    result, profit = _c("result"), _c("profit_per_unit")
    wrong = ((result == "LOSS") & (profit != -1.0)) | ((result == "PUSH") & (profit != 0.0)) | ((result == "WIN") & _off(profit, _c("decimal_odds") - 1.0))
    counts = ledger.groupBy("market_key").agg(F.count(F.lit(1)).alias("n")).join(summary.where("edge_bucket = 'ALL'"), "market_key", "left")
    return report(ledger, {"invalid_market_or_season": ~_c("market_key").isin(*scalars.MARKET_NAMES) | _missing("season"), "invalid_settlement": wrong},
                  {"duplicate_market_game": ["market_key", "game_id"]}, extra=[
        quality.row_checks(counts, {"missing_market_summary": _missing("bet_count"), "summary_bet_count_mismatch": scalars.flag(_c("bet_count") != _c("n"))}),
    ])


def forward_archive(archive: DataFrame, movement: DataFrame) -> DataFrame:
    late = reduce(lambda a, b: a | b, [_c(t) >= _c("commence_time") for t in ("fetched_at", "archived_at")])
    order = (_c("latest_fetched_at") <= _c("entry_fetched_at")) | (_c("latest_fetched_at") >= _c("commence_time"))
    labels = ["NO_LATER_SNAPSHOT", "POSITIVE", "NEGATIVE", "UNCHANGED"]
    return report(archive, {
        "post_kickoff_archive_row": late, "invalid_tip_candidate_flag": _c("is_tip_candidate") != scalars.flag(_c("positive_expected_value")), "invalid_refresh_run": _missing("refresh_run_id"),
    }, {"duplicate_archive_key": ["archive_key"]}, extra=[
        quality.key_check(movement, ["entry_archive_key"], "duplicate_market_movement_entry"),
        quality.row_checks(movement, {"invalid_market_movement_comparison_time": scalars.flag(order), "invalid_market_movement_label": ~_c("market_movement_direction").isin(*labels)}),
    ])


def forward_performance(ledger: DataFrame, summary: DataFrame) -> DataFrame:
    result, profit, settled = _c("result"), _c("profit_units"), _c("settlement_status") == "SETTLED"
    wrong = scalars.flag(
        (~settled & (result.isNotNull() | profit.isNotNull())) | ((result == "LOSS") & (profit != -1.0)) | ((result == "PUSH") & (profit != 0.0))
        | ((result == "WIN") & _off(profit, _c("entry_decimal_odds") - 1.0))
    )
    scored = _c("is_probability_score_eligible")
    mismatch = summary.where(_c("tracked_count") != _c("settled_count") + _c("pending_count"))
    return report(ledger, {
        "invalid_settlement_arithmetic": wrong,
        "invalid_probability_scoring": scalars.flag((scored & ((_c("market_key") != "h2h") | (result == "PUSH"))) | (~scored & (_c("brier_loss").isNotNull() | _c("log_loss").isNotNull()))),
    }, {"duplicate_settlement_key": ["entry_archive_key"]}, extra=[count_of(mismatch, "summary_count_mismatch")])


# -- availability --------------------------------------------------------------------------------------

def injury_reports(raw: DataFrame, status: DataFrame, schedule: DataFrame, expected: Mapping[str, int] | None = None) -> DataFrame:
    flags = reduce(lambda a, b: a | b, [_c(f"is_{s.lower()}") != scalars.flag(_c("report_status") == s) for s in ref.REPORT_STATUSES])
    practice = dict(zip(("did_not_practice", "limited_practice", "full_practice"), ref.PRACTICE_STATUSES))
    moves = reduce(lambda a, b: a | b, [_c(f) != scalars.flag(_c("practice_status") == s) for f, s in practice.items()])
    extra = [quality.row_checks(raw, {"raw_null_business_keys": _missing("season", "week", "team", "gsis_id")})]
    extra += [row_count_is({"raw": raw, "processed": status}[t], n, f"{t}_row_count_is_{n}") for t, n in (expected or {}).items()]
    return report(status, {
        "processed_null_business_keys": _missing("game_id", "team", "gsis_id"), "processed_invalid_report_status": scalars.flag(~_c("report_status").isin(*ref.REPORT_STATUSES)),
        "processed_invalid_practice_status": scalars.flag(~_c("practice_status").isin(*ref.PRACTICE_STATUSES)), "processed_report_flags_inconsistent": flags,
        "processed_practice_flags_inconsistent": moves, "processed_timestamp_flag_inconsistent": _c("has_source_timestamp") != _c("source_date_modified").isNotNull(),
        "invalid_snapshot_count": _c("source_snapshot_count") < 1,
    }, {"processed_duplicate_player_game": ["game_id", "team", "gsis_id"]}, {"processed_game_missing_from_schedule": (schedule, ["game_id"])}, extra)


def depth_charts(depth: DataFrame, schedule: DataFrame) -> DataFrame:
    rank = _c("depth_rank")
    tier = F.when(_c("is_starter"), "STARTER").when(_c("is_primary_backup"), "PRIMARY_BACKUP").otherwise("RESERVE")
    return report(depth, {
        "unified_invalid_depth_rank": rank.isNull() | (rank < 1), "unified_depth_rank_flags_inconsistent": (_c("is_starter") != (rank == 1)) | (_c("is_primary_backup") != (rank == 2)),
        "unified_depth_tier_inconsistent": _c("depth_tier") != tier, "unified_invalid_formation": ~_c("formation").isin("Offense", "Defense", "Special Teams"),
        "unified_formation_flags_inconsistent": _c("is_offense_role") != (_c("formation") == "Offense"), "unified_identifier_flags_inconsistent": _c("has_gsis_id") != _c("gsis_id").isNotNull(),
        "unified_invalid_source_generation": ~_c("source_generation").isin("espn", "legacy_nfl"), "missing_gsis_without_espn_fallback": _c("gsis_id").isNull() & ~_c("player_key").startswith("ESPN:"),
        "espn_missing_timestamped_snapshot": (_c("source_generation") == "espn") & _c("source_snapshot_at").isNull(),
        "espn_future_snapshot_selected": scalars.flag(F.to_date("source_snapshot_at") > _c("gameday")),
        "legacy_contains_espn_only_attributes": (_c("source_generation") == "legacy_nfl") & (_c("espn_id").isNotNull() | _c("position_slot").isNotNull()),
    }, {"unified_duplicate_role_records": ["game_id", "team", "player_key", "formation", "depth_position", "position_slot"]}, {"unified_game_missing_from_schedule": (schedule, ["game_id"])})


def snap_counts(raw: DataFrame, processed: DataFrame, history: DataFrame, directory: DataFrame) -> DataFrame:
    shares = ("offense_snap_share", "defense_snap_share", "special_teams_snap_share")
    return report(processed, {
        "processed_snap_count_null_business_keys": _missing("game_id", "team", "player_key"), "processed_snap_count_invalid_normalized_shares": _unit(*shares),
    }, {"processed_snap_count_duplicate_business_keys": ["game_id", "team", "player_key"]}, extra=[
        rows_equal(processed, raw, "processed_snap_count_matches_raw_count"), quality.key_check(raw, ["game_id", "team", "pfr_player_id"], "raw_snap_count_duplicate_player_team_games"),
        quality.row_checks(directory, {"player_directory_null_gsis_ids": _missing("gsis_id")}), quality.key_check(directory, ["gsis_id"], "player_directory_duplicate_gsis_ids"),
        *[quality.key_check(directory.where(_c(c).isNotNull()), [c], f"player_directory_duplicate_non_null_{c}s") for c in ("espn_id", "pfr_id")],
        quality.key_check(history, ["game_id", "team", "player_key"], "snap_history_duplicate_business_keys"), rows_equal(history, processed, "snap_history_row_count_matches_processed"),
        quality.row_checks(history, {
            "snap_history_invalid_availability_date": _c("available_after_gameday") != _c("gameday"),
            "snap_history_invalid_rolling_shares": _unit(*[f"career_{s}_last_4" for s in shares], *[f"team_{s}_last_8" for s in shares]),
        }),
    ])


def injury_features(impact: DataFrame, burden: DataFrame, features: DataFrame, schedule: DataFrame) -> DataFrame:
    wrong = [_off(_c(f"{m}_difference"), _c(f"home_{m}") - _c(f"away_{m}")) for m in ("total_injury_burden", "offense_injury_burden", "defense_injury_burden")]
    qb = scalars.flag(_c("is_qb"))
    return report(impact, {
        "injury_context_null_business_keys": _missing("game_id", "team", "player_key"), "injury_context_invalid_history_source": ~_c("snap_history_source").isin("NONE", "TEAM", "CAREER"),
        "injury_context_prior_history_leakage": scalars.flag(_c("prior_snap_history_gameday") >= _c("gameday")), "injury_context_invalid_prior_snap_shares": _unit("prior_offense_snap_share_last_4"),
        "player_injury_impact_invalid_scores": _unit("availability_severity_score", "player_importance_score", "injury_impact_score"),
        "player_injury_impact_qb_double_counting": qb & (_c("non_qb_injury_impact_score") + _c("offense_injury_impact_score") > 0),
    }, {"player_injury_impact_duplicate_business_keys": ["game_id", "team", "player_key"]}, extra=[
        quality.key_check(burden, ["game_id", "team"], "team_injury_burden_duplicate_business_keys"),
        quality.row_checks(burden, {
            "team_injury_burden_invalid_scores": _c("total_injury_burden") < 0,
            "team_injury_burden_invalid_missing_data_semantics": ~_c("has_injury_report_data") & ((_c("total_injury_burden") != 0) | _c("maximum_player_injury_impact").isNotNull()),
            "team_injury_burden_sum_identity": _off(_c("total_injury_burden"), _c("qb_injury_burden") + _c("non_qb_injury_burden")),
        }),
        quality.key_check(features, ["game_id"], "game_injury_feature_duplicate_games"), quality.reference_check(features, schedule, ["game_id"], "game_injury_orphan_game"),
        quality.row_checks(features, {
            "game_injury_invalid_burden_differences": reduce(lambda a, b: a | b, wrong),
            "game_injury_invalid_coverage_flags": _c("has_complete_injury_data") != (_c("home_has_injury_report_data") & _c("away_has_injury_report_data")),
        }),
    ])


# -- distributions and governance -------------------------------------------------------------------------

def distributions(dist: DataFrame, summary: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Q5 over a sample distribution and its summary."""
    mass = dist.groupBy(*by).agg(F.sum("probability").alias("p"), F.sum("sample_count").alias("n"), F.sum(_c("probability") * _c(value)).alias("m"))
    joined = mass.join(summary, list(by), "full_outer")
    ranged = dist.join(summary.select(*by, "min", "max"), list(by))
    return report(dist, {"invalid_distribution_values": _unit("probability") | (_c("sample_count") <= 0)}, {"duplicate_value": [*by, value]}, extra=[
        quality.row_checks(joined, {
            "distribution_probability_not_one": scalars.flag(F.abs(_c("p") - 1.0) > TINY), "summary_missing_distribution": _missing("p"), "distribution_contains_unknown_entity": _missing("mean"),
            "expected_value_does_not_match_distribution": _off(_c("m"), _c("mean")), "distribution_count_not_sample_count": scalars.flag(_c("n") != _c("sample_count")),
        }),
        quality.row_checks(ranged, {"distribution_outside_summary_range": ~_c(value).between(_c("min"), _c("max"))}),
    ])


def mode_comparison(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distances and paired differences between two sampling modes."""
    return report(table, {
        "invalid_distribution_distance": _unit("distance"), "invalid_comparison_math": _off(_c("mean_difference"), _c("mean_a") - _c("mean_b")),
    }, {"duplicate_entity": list(by)})


def governance(season_results: DataFrame, scorecard: DataFrame, blend: DataFrame | None = None, models: int | None = None) -> DataFrame:
    per_season = season_results.groupBy("fold").agg(F.countDistinct("candidate").alias("n"))
    n = per_season.agg(F.max("n")).scalar() if models is None else F.lit(models)
    extra = [
        count_of(per_season.where(_c("n") != n), "governance_season_has_all_models"), quality.key_check(scorecard, ["candidate"], "governance_scorecard_duplicate_models"),
        quality.row_checks(scorecard, {"governance_scorecard_invalid_metrics": _unit("weighted_brier", "weighted_accuracy") | (_c("worst_brier") < _c("weighted_brier") - TINY)}),
    ]
    if blend is not None:
        extra += [quality.row_checks(blend, {"blend_weight_grid_invalid_weights": _unit("weight")}), quality.key_check(blend, ["weight"], "blend_weight_grid_duplicate_scope_weights")]
    return report(season_results, {"governance_season_invalid_metrics": _unit("brier", "accuracy") | (_c("log_loss") < 0)},
                  {"governance_season_duplicate_model_results": ["candidate", "setting", "fold"]}, extra=extra)
