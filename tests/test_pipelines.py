"""The domain pipelines end to end on an invented league."""

from __future__ import annotations

import json
import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import ratings
from fieldglass.operators.quality import QualityError, expect
from fieldglass.plans import availability, context, forecasts, form, market_history, odds, serving
from fieldglass.sources import publish, scans
from tests import league

NOW = datetime(2025, 10, 5)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(5)
    games = league.schedule(rng)
    folder = str(tmp_path_factory.mktemp("league"))

    def landed(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    keys = [c.strip().split(" ")[0] for c in league.SCHEDULE_TYPES.split(",")]
    raw = landed("schedule", [tuple(g[k] for k in keys) for g in games], league.SCHEDULE_TYPES)
    out = {"games": games, "schedule": context.processed_schedule(raw)}
    out["pbp"] = landed("pbp", league.plays(rng, games), league.PLAY_TYPES)
    out["reports"] = landed("reports", league.reports(rng, games), league.REPORT_TYPES)
    out["snaps"] = landed("snaps", league.snaps(rng, games), league.SNAP_TYPES)
    out["directory"] = landed("directory", league.directory(), league.DIRECTORY_TYPES)
    out["espn"] = landed("espn", league.espn_charts(rng), league.ESPN_TYPES)
    out["legacy"] = landed("legacy", league.legacy_charts(rng, games), league.LEGACY_TYPES)
    out["external"] = landed("external", league.external(rng, games), league.EXTERNAL_TYPES)
    for i, snapshot in enumerate(league.odds(games)):
        path = tmp_path_factory.mktemp(f"odds{i}") / "odds.json"
        path.write_text(json.dumps(snapshot))
        part = scans.read_snapshots(spark, str(path))
        out["odds_raw"] = part if i == 0 else out["odds_raw"].unionByName(part)

    def store(name, df):
        df.write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
        return out[name]

    schedule = out["schedule"]
    efficiency = store("efficiency", form.team_game_efficiency(out["pbp"], schedule))
    rolling = store("rolling", form.rolling_team_features(efficiency))
    performance = store("performance", form.qb_game_performance(out["pbp"], schedule))
    history = store("qb_history", form.qb_rating_history(performance, rolling))
    store("qb_current", form.current_qb_ratings(performance, rolling))
    store("qb_features", form.game_qb_features(schedule, performance, history))
    depth = store("depth", availability.depth_chart(
        availability.legacy_depth(out["legacy"], schedule, (2018, 2024)), availability.espn_depth(out["espn"], schedule, (2025, 2026))
    ))
    snaps = store("snap_counts", availability.snap_counts(out["snaps"], schedule, out["directory"]))
    usage = store("usage", availability.snap_share_history(snaps))
    status = store("status", availability.injury_status(out["reports"], schedule))
    impact = store("impact", availability.injury_impact(availability.injury_context(status, depth, usage)))
    burden = store("burden", availability.team_injury_burden(impact, schedule))
    injury = store("injury", availability.game_injury_features(burden))
    weather = store("weather", context.weather_features(schedule))
    scoring = store("scoring", context.scoring_environment(schedule))
    rest = store("rest", context.schedule_features(schedule))
    played = schedule.where("is_completed").withColumn("is_neutral", F.col("location") == "Neutral").withColumn("league", F.lit("L"))
    elo = ratings.pairwise_ratings(played, "league", ["gameday", "gametime", "game_id"], cfg=ratings.RatingConfig(advantage=50.0), keep=["gameday", "gametime", "is_neutral"])
    elo = store("elo", elo.withColumn("home_advantage", F.when(F.col("is_neutral"), 0.0).otherwise(50.0)))
    store("elo_current", ratings.current_ratings(elo, "league", ["gameday", "gametime", "game_id"]).withColumnsRenamed({"entity": "team", "rating": "elo_rating"}))
    store("dataset", context.modeling_dataset(schedule, rest, elo, rolling, out["qb_features"], injury, weather, scoring))
    return out


def test_schedule_passes_its_gate(world):
    expect(world["schedule"], context.schedule_rules(world["schedule"]))
    broken = world["schedule"].withColumn("game_result", F.lit("LOST"))
    with pytest.raises(QualityError, match="result_domain"):
        expect(broken, context.schedule_rules(broken))


def test_team_form_matches_sql(world):
    plays, games = world["pbp"].toPandas(), world["schedule"].toPandas()  # noqa: F841 (read by DuckDB)
    want = duckdb.sql("""
        WITH v AS (
          SELECT *, coalesce(qb_dropback = 1, false) AS d, coalesce(rush = 1, false) AND coalesce(qb_scramble, 0) = 0 AS r FROM plays
          WHERE epa IS NOT NULL AND coalesce(qb_kneel, 0) = 0 AND coalesce(special_teams_play, 0) = 0
        ), o AS (
          SELECT game_id, posteam AS team, defteam AS opponent, count(*) AS plays, avg(epa) AS epa, count(*) FILTER (WHERE d) AS dropbacks,
            avg(epa) FILTER (WHERE wp BETWEEN 0.1 AND 0.9) AS comp,
            sum(interception + fumble_lost) / count(*) AS turnover_rate FROM v WHERE d OR r GROUP BY ALL
        )
        SELECT a.game_id, a.team, a.plays, round(a.epa, 9) AS epa, a.dropbacks, round(a.comp, 9) AS comp, round(a.turnover_rate, 9) AS tr, round(b.epa, 9) AS allowed
        FROM o a JOIN o b ON a.game_id = b.game_id AND a.opponent = b.team ORDER BY 1, 2
    """).fetchall()
    got = world["efficiency"].select(
        "game_id", "team", "offensive_plays", F.round("offensive_epa_per_play", 9), "dropbacks", F.round("competitive_epa_per_play", 9),
        F.round("turnover_rate", 9), F.round("defensive_epa_allowed_per_play", 9),
    ).orderBy("game_id", "team").collect()
    assert [tuple(r) for r in got] == want
    assert world["efficiency"].count() == 2 * sum(g["home_score"] is not None for g in world["games"])


def test_rolling_form_has_no_leakage(world):
    rows = world["rolling"].where("team = 'ARI' AND season = 2019").orderBy("game_date", "game_id").collect()
    raw = world["efficiency"].where("team = 'ARI' AND season = 2019").orderBy("game_date", "game_id").collect()
    assert rows[0]["season_games_played_before"] == 0 and rows[0]["pregame_points_scored_last_4"] is None
    for i in range(1, len(rows)):
        past = [r["points_scored"] for r in raw[max(0, i - 4):i]]
        assert rows[i]["pregame_points_scored_last_4"] == pytest.approx(sum(past) / len(past))
        assert rows[i]["short_window_games"] == len(past)


def test_passer_ratings_match_the_day_by_day_recursion(world):
    """The closed form equals decaying and updating state day by day."""
    allowed = {(r["game_id"], r["team"]): r["pregame_defensive_epa_allowed_per_play_last_8"] for r in world["rolling"].collect()}
    games = sorted(world["performance"].collect(), key=lambda r: (r["game_date"], r["game_id"], r["team"], r["qb_id"]))
    got = {(r["game_id"], r["qb_id"]): r for r in world["qb_history"].collect()}
    state: dict[str, list[float]] = {}
    last: dict[str, object] = {}

    def decayed(key, day):
        n, s, q = state.get(key, [0.0, 0.0, 0.0])
        f = 0.5 ** ((day - last[key]).days / 365.0) if key in last else 1.0
        return [n * f, s * f, q * f]

    pending, seen_day = [], None
    for g in [*games, None]:
        if g is None or g["game_date"] != seen_day:
            for key, day, n, v in pending:
                base = decayed(key, day)
                state[key], last[key] = [base[0] + n, base[1] + n * v, base[2] + n * v * v], day
            pending, seen_day = [], g and g["game_date"]
            if g is None:
                break
        day = g["game_date"]
        n, s, _ = decayed(g["qb_id"], day)
        ln, ls, lq = decayed("*", day)
        mean = ls / ln if ln else 0.0
        sd = max((max(lq / ln - mean * mean, 0.0)) ** 0.5, 0.05) if ln else 0.05
        raw = s / n if n else mean
        shrunk = (n * raw + 200 * mean) / (n + 200)
        row = got[(g["game_id"], g["qb_id"])]
        assert row["pregame_effective_dropbacks"] == pytest.approx(n, abs=1e-6)
        assert row["pregame_qb_rating"] == pytest.approx(100 + 15 * (shrunk - mean) / sd, abs=1e-6)
        value = g["epa_per_dropback"] - (allowed.get((g["game_id"], g["opponent"])) or 0.0)
        pending += [(g["qb_id"], day, g["dropbacks"], value), ("*", day, g["dropbacks"], value)]


def test_current_passers_are_ranked(world):
    rows = world["qb_current"].orderBy("qb_rank").collect()
    assert [r["qb_rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["qb_rating"] for r in rows] == sorted((r["qb_rating"] for r in rows), reverse=True)


def test_usage_context_is_strictly_earlier(world):
    rows = world["impact"].where("has_prior_snap_history").collect()
    assert rows and all(r["prior_snap_history_gameday"] < r["gameday"] for r in rows)
    usage = {}
    for r in world["usage"].collect():
        usage.setdefault(r["player_key"], []).append((r["gameday"], r["game_id"]))
    for r in rows:
        assert (r["prior_snap_history_gameday"], r["prior_snap_history_game_id"]) == max(x for x in usage[r["player_key"]] if x[0] < r["gameday"])


def test_injury_burden_is_complete(world):
    covered = world["schedule"].where("season >= 2019").count()
    assert world["burden"].count() == 2 * covered
    assert world["injury"].count() == covered
    one = world["injury"].where("has_complete_injury_data").first()
    assert one["total_injury_burden_difference"] == pytest.approx(one["home_total_injury_burden"] - one["away_total_injury_burden"])
    assert world["status"].groupBy("game_id", "team", "gsis_id").count().where("count > 1").isEmpty()


def test_charts_use_the_newest_one_of_the_day(world):
    rows = world["depth"].where("source_generation = 'espn'").select("gameday", "source_snapshot_at").distinct().collect()
    for r in rows:
        want = "2025-09-20 18" if r["gameday"].isoformat() >= "2025-09-20" else "2025-09-01 10"
        assert str(r["source_snapshot_at"]).startswith(want)


def test_dataset_has_one_row_per_completed_game(world):
    data = world["dataset"]
    want = world["schedule"].where("is_completed AND season >= 2019").count()
    assert data.count() == want == data.select("game_id").distinct().count()
    splits = context.modeling_splits(data)
    assert {r[0] for r in splits.select("split_name").distinct().collect()} == {"train", "validation", "holdout"}


@pytest.fixture(scope="module")
def market(world, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("market"))
    flat = scans.flatten_snapshot(world["odds_raw"])
    tables = odds.odds_pipeline(flat, world["schedule"], league.TEAMS)
    starters = forecasts.projected_starters(world["depth"])
    inputs = forecasts.current_inputs(world["schedule"], world["elo_current"], world["qb_current"], world["injury"], world["external"], starters)
    inputs = forecasts.totals_inputs(inputs, world["efficiency"], world["weather"], world["scoring"])
    ext = world["external"].select(
        "game_id", (F.col("home_rating") - F.col("away_rating")).alias(forecasts.RATING), (F.col("home_qb_adjustment") - F.col("away_qb_adjustment")).alias(forecasts.PASSER)
    )
    history = world["dataset"].join(ext, "game_id").withColumns({
        "offensive_epa_sum_last_4": F.col("home_offensive_epa_per_play_last_4") + F.col("away_offensive_epa_per_play_last_4"),
        "defensive_epa_allowed_sum_last_4": F.col("home_defensive_epa_allowed_per_play_last_4") + F.col("away_defensive_epa_allowed_per_play_last_4"),
        "listed_qb_rating_sum": F.col("home_listed_qb_rating") + F.col("away_listed_qb_rating"), "elo_rating_sum": F.col("home_elo_rating") + F.col("away_elo_rating"),
    })
    history.write.parquet(f"{folder}/history")
    history = spark.read.parquet(f"{folder}/history")
    now = F.lit(NOW)
    out = dict(tables)
    probability, fit = forecasts.probability_predictions(inputs, history, now)
    out |= {"probability": probability, "spread": forecasts.spread_predictions(inputs, history, now), "totals": forecasts.totals_predictions(inputs, history, now)}
    residuals = history.select(
        F.explode(F.array(F.lit("PRIMARY"), F.lit("FALLBACK"))).alias("prediction_mode"),
        (F.col("target_point_differential") - 1.25).alias("residual_home_margin"), (F.col("target_total_points") - 44.0).alias("residual_total_points"),
    )
    for name in ("odds_market_outcomes", "best_odds_by_line", "odds_event_bridge", "current_market_board", "probability", "spread", "totals"):
        out[name].write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    out |= {"residuals": residuals, "fit": fit, "history": history}
    board = out["current_market_board"]
    out["moneyline_value"] = odds.moneyline_value(board, out["probability"])
    out["spread_value"] = odds.spread_value(board, out["spread"], residuals)
    out["totals_value"] = odds.totals_value(board, out["totals"], residuals)
    odds.betting_board(out["moneyline_value"], out["spread_value"], out["totals_value"], now).write.parquet(f"{folder}/board")
    out["board"] = spark.read.parquet(f"{folder}/board")
    return out


def test_market_board(world, market):
    unplayed = sum(g["home_score"] is None for g in world["games"])
    board = market["current_market_board"]
    assert board.count() == unplayed * 6
    statuses = {r["match_status"]: r["count"] for r in market["odds_event_bridge"].groupBy("match_status").count().collect()}
    assert statuses == {"MATCHED": 2 * unplayed, "UNMAPPED_TEAM": 2}
    one = board.where("market_key = 'spreads' AND outcome_type = 'home'").first()
    # Prices -110, -90 (not a price) and -70 (not a price): only the first counts.
    assert one["best_american_price"] == -110 and one["bookmaker_count"] == 3
    fair = market["odds_market_outcomes"].where("market_key = 'h2h'").groupBy("snapshot_id", "event_id", "bookmaker_key").agg(F.sum("no_vig_probability").alias("s"))
    assert fair.where("abs(s - 1) > 1e-9").isEmpty()
    assert board.select("fetched_at").distinct().count() == 1


def test_offer_values(market):
    import numpy as np

    bank = market["residuals"].where("prediction_mode = 'PRIMARY'").toPandas()
    for row in market["spread_value"].collect():
        margin = np.rint(row["predicted_home_margin"] + bank["residual_home_margin"].to_numpy())
        result = (margin if row["outcome_type"] == "home" else -margin) + row["point"]
        assert row["cover_probability"] == pytest.approx((result > 0).mean())
        assert row["push_probability"] == pytest.approx((result == 0).mean(), abs=1e-12)
        assert row["expected_value_per_unit"] == pytest.approx((result > 0).mean() * (row["best_decimal_odds"] - 1) - (result < 0).mean())
    for row in market["totals_value"].collect():
        edge = row["market_line"] - row["predicted_total_points"]
        sample = bank["residual_total_points"].to_numpy()
        want = (sample > edge).mean() if row["outcome_type"] == "over" else (sample < edge).mean()
        assert row["win_probability"] == pytest.approx(want)
        assert row["push_probability"] == pytest.approx(np.isclose(sample, edge, atol=1e-9).mean(), abs=1e-12)
    board = market["board"]
    assert board.where("abs(model_probability + push_probability + loss_probability - 1) > 1e-6").isEmpty()
    assert {r[0] for r in board.select("market_key").distinct().collect()} == {"h2h", "spreads", "totals"}


def test_forecast_products(market):
    now = F.lit(NOW)
    probability = market["probability"]
    modes = {r[0] for r in probability.select("prediction_mode").distinct().collect()}
    assert modes <= {"PRIMARY", "FALLBACK"}
    scores = forecasts.game_scores(market["spread"], market["totals"], now).collect()
    for r in scores:
        assert r["implied_home_score"] + r["implied_away_score"] == pytest.approx(r["predicted_total_points"])
        assert r["implied_home_score"] - r["implied_away_score"] == pytest.approx(r["predicted_home_margin"])
    parts = forecasts.feature_contributions(probability, market["fit"])
    sums = parts.groupBy("game_id").agg(
        (F.sum("log_odds_contribution") + F.first("logistic_intercept")).alias("total"), F.first("logistic_total_log_odds").alias("want")
    ).collect()
    assert all(r["total"] == pytest.approx(r["want"], abs=1e-9) for r in sums)
    texts = forecasts.narratives(forecasts.explanations(probability), parts).collect()
    assert len(texts) == probability.count() and all(t["summary_en"].endswith("chance to win.") for t in texts)
    view = forecasts.technical_view(probability, parts)
    assert view.count() >= probability.count()


def test_probability_trends(market, spark):
    probability = market["probability"]
    earlier = probability.withColumn("home_win_probability", F.col("home_win_probability") - 0.02).withColumn("away_win_probability", F.col("away_win_probability") + 0.02)
    archive = forecasts.probability_archive_rows(earlier, F.lit(NOW))
    rows = forecasts.probability_trends(probability, archive).collect()
    assert {r["home_probability_trend"] for r in rows} == {"INCREASE"} and {r["away_probability_trend"] for r in rows} == {"DECREASE"}
    assert all(r["home_probability_change_pp"] == pytest.approx(2.0) for r in rows)
    fresh = forecasts.probability_trends(probability, archive.where("false")).collect()
    assert {r["home_probability_trend"] for r in fresh} == {"NEW"}
    other = archive.withColumn("model_version", F.lit("x"))
    assert {r["home_probability_trend"] for r in forecasts.probability_trends(probability, other).collect()} == {"MODEL_CHANGED"}


def test_historical_market(world, market, spark):
    data = market["history"].select("game_id", "season", F.col("target_point_differential").cast("double").alias("actual_home_margin"), F.col("target_total_points").cast("double").alias("actual_total"))
    prices = {"home_market_probability_open": 0.5, "home_market_probability_close": 0.52, "home_line_open": -2.0, "home_line_close": -3.0, "home_line_close_price": -110.0,
              "away_line_close_price": -105.0, "total_line_open": 44.0, "total_line_close": 45.0, "over_price_close": -110.0, "under_price_close": 102.0}
    data = data.withColumns({k: F.lit(v) for k, v in prices.items()})
    keys = data.select("game_id", "season")
    probability = market_history.selected_predictions(
        keys.where("season > 2019").withColumn("home_win_probability", F.lit(0.6)), keys.withColumn("home_win_probability", F.lit(0.4)), ("main", "backup")
    )
    spread = keys.withColumn("predicted_home_margin", F.lit(5.0)).withColumn("model_name", F.lit("m"))
    totals = keys.withColumn("predicted_total", F.lit(44.0)).withColumn("model_name", F.lit("m"))
    ledger = market_history.historical_ledger(probability, spread, totals, data)
    n = keys.count()
    assert ledger.count() == 3 * n
    one = ledger.where("market_key = 'spreads'").first()
    assert one["selection"] == "HOME" and one["decimal_odds"] == pytest.approx(1 + 100 / 110) and one["clv_value"] == pytest.approx(1.0) and one["edge_bucket"] == "HIGH"
    under = ledger.where("market_key = 'totals'").first()
    assert under["selection"] == "UNDER" and under["clv_value"] == pytest.approx(-1.0)
    assert {r[0] for r in ledger.where("market_key = 'h2h'").select("model_name").distinct().collect()} == {"main", "backup"}
    summary = {(r["market_key"], r["edge_bucket"]): r for r in market_history.historical_summary(ledger).collect()}
    profits = [r["profit_per_unit"] for r in ledger.where("market_key = 'spreads'").orderBy("season", "game_id").collect()]
    run, peak, worst = 0.0, 0.0, 0.0
    for p in profits:
        run += p
        worst, peak = max(worst, peak - run), max(peak, run)
    row = summary[("spreads", "ALL")]
    assert row["bet_count"] == n and row["total_profit"] == pytest.approx(sum(profits)) and row["maximum_drawdown_units"] == pytest.approx(worst)


def test_forward_archive_and_performance(world, market, spark, folder):
    board = market["board"]
    first = board.withColumn("fetched_at", F.lit(datetime(2025, 10, 1, 1)))
    at = F.lit(datetime(2025, 10, 5, 1))
    location = f"{folder}/archive"
    n = market_history.append_archive(first, "run1", at, location)
    assert n == board.count()
    assert market_history.append_archive(first, "run1", at, location) == 0
    with pytest.raises(QualityError, match="immutable"):
        market_history.append_archive(first.withColumn("best_decimal_odds", F.col("best_decimal_odds") + 1), "run1", at, location)
    later = first.withColumn("snapshot_id", F.lit("later")).withColumn("fetched_at", F.col("commence_time") - F.expr("INTERVAL 60 MINUTES")).withColumn(
        "best_decimal_odds", F.col("best_decimal_odds") - 0.1
    ).withColumn("betting_board_generated_at", F.col("fetched_at")).withColumn("prediction_generated_at", F.lit(NOW))
    market_history.append_archive(later, "kickoff_capture_2", F.lit(datetime(2025, 10, 6)), location)
    archive = spark.read.parquet(location)
    assert archive.count() == 2 * n
    moves = market_history.market_movement(archive)
    tips = archive.where("is_tip_candidate").select("game_id", "market_key", "outcome_type").distinct().count()
    assert moves.count() == tips
    assert moves.where("has_latest_pregame_comparison AND NOT is_clv").isEmpty()
    assert {r[0] for r in moves.select("latest_minutes_before_kickoff").distinct().collect()} == {60}
    assert {r[0] for r in moves.select("market_movement_direction").distinct().collect()} == {"POSITIVE"}
    done = world["schedule"].withColumns({"home_score": F.coalesce("home_score", F.lit(20)), "away_score": F.coalesce("away_score", F.lit(17)), "is_completed": F.col("week") == 12})
    settled = market_history.forward_settlement(moves, done)
    row = settled.where("market_key = 'spreads' AND outcome_type = 'home'").first()
    if row is not None:
        assert row["result"] == "PUSH" and row["profit_units"] == 0.0
    summary = market_history.forward_performance(settled).collect()
    top = [r for r in summary if r["selection_scope"] == "SEASON" and r["sample_scope"] == "ALL_TRACKED"]
    assert len(top) == 1 and top[0]["tracked_count"] == tips and top[0]["settled_count"] == tips
    assert len(summary) == 3 * len({(r["season"], r["week"], r["market_key"]) for r in summary})


def test_serving_products(world, market, spark):
    now = F.lit(NOW)
    scores = forecasts.game_scores(market["spread"], market["totals"], now)
    games = serving.weekly_games(market["probability"], market["spread"], market["totals"], scores)
    assert games.count() == market["probability"].count()
    final = games.limit(1).select("game_id", "season", "week", F.lit(True).alias("is_completed"), F.lit(21).alias("home_score"))
    merged = serving.weekly_games(market["probability"], market["spread"], market["totals"], scores, completed=final)
    assert merged.count() == games.count() and merged.where("is_completed").count() == 1
    served = serving.served_board(market["board"], market["probability"], market["spread"])
    picks = serving.recommended_picks(served.withColumn("bookmaker_count", F.lit(6)), now)
    assert picks.groupBy("game_id", "market_key").count().where("count > 1").isEmpty()
    assert serving.featured_picks(picks).count() <= 6
    assert serving.preferred_sides(served).count() == served.select("game_id", "market_key").distinct().count()
    calendar = serving.team_schedule(world["schedule"], world["elo_current"].select("team", "elo_rating"))
    assert calendar.count() == 4 * 18 and calendar.where("is_bye").count() == 4 * 6
    assert {r[0] for r in calendar.select("schedule_state").distinct().collect()} == {"COMPLETED", "CURRENT", "BYE"}
    units = spark.createDataFrame([(2025, 1, t, float(i), 1.0, 2.0, 3.0, 4.0, 5.0, NOW) for i, t in enumerate(league.CODES)],
                                  "season int, week int, team string, off_value_pre double, def_value_pre double, pass_off_value_pre double, rush_off_value_pre double, pass_def_value_pre double, rush_def_value_pre double, source_fetched_at timestamp")
    roster = serving.team_rosters(world["espn"], world["directory"], world["reports"], world["external"], units)
    assert roster.count() == 4 * 3
    assert roster.where("roster_status IS NULL").isEmpty()
    assert roster.where("defense_rank <> 1").isEmpty() and roster.select("offense_rank").distinct().count() == 4
    segments = {(r["topic"], r["segment"]): r for r in serving.impact_summary(world["dataset"]).collect()}
    assert segments[("home_field", "all_games")]["game_count"] == world["dataset"].count()
    spread = serving.dispersion_summary(world["dataset"].withColumn("layer", F.lit("elo")), "layer", "target_total_points", "league_average_total_last_64")
    assert spread.first()["game_count"] > 0
    assert serving.market_comparison(market["moneyline_value"]).first()["game_count"] == market["probability"].count()
    summary = spark.createDataFrame([("A", 9.0, 1500.0, 7, 11), ("B", 10.0, 1490.0, 8, 12)], "team string, expected_wins double, expected_final_elo double, p10_wins int, p90_wins int")
    assert [(r["rank"], r["team"], r["p10_p90_range"]) for r in serving.standings(summary).orderBy("rank").collect()] == [(1, "B", "8–12"), (2, "A", "7–11")]


def test_publish_keeps_the_old_table_on_failure(world, spark, folder):
    good = world["schedule"]
    publish.publish(good, folder, "schedule", context.schedule_rules)
    with pytest.raises(QualityError):
        publish.publish(good.unionByName(good), folder, "schedule", context.schedule_rules)
    assert publish.read_table(spark, folder, "schedule").count() == good.count()
    publish.publish(good.where("season = 2025"), folder, "schedule", context.schedule_rules)
    assert publish.read_table(spark, folder, "schedule").count() == good.where("season = 2025").count()
    states = publish.health(spark, folder, {"schedule": "gameday", "absent": None}).collect()
    assert {(s["table_name"], s["is_present"]) for s in states} == {("schedule", True), ("absent", False)}
    assert publish.export_tables(spark, folder, ["schedule"], folder + "/copy") == {"schedule": good.where("season = 2025").count()}


def test_quality_suites_pass_on_clean_tables(world, market, spark):
    from fieldglass.plans import checks

    w, m = world, market
    flat = scans.flatten_snapshot(w["odds_raw"])
    now = F.lit(NOW)
    parts = forecasts.feature_contributions(m["probability"], m["fit"])
    explained = forecasts.explanations(m["probability"])
    scores = forecasts.game_scores(m["spread"], m["totals"], now)
    audit = form.game_qb_audit(w["qb_features"], w["performance"])
    played = w["schedule"].where("is_completed")
    expected_failures = {
        # The invented odds hold prices inside +-100 on purpose, and an unknown club.
        "odds_load": {"invalid_american_price"}, "event_bridge": {"event_not_matched"}, "processed_odds": set(),
    }
    suites = {
        "schedule": checks.processed_schedule(w["schedule"], w["schedule"]),
        "odds_load": checks.odds_load(flat["snapshots"], flat["events"], flat["offers"]),
        "processed_odds": checks.processed_odds(m["odds_market_outcomes"], flat["offers"]),
        "best_odds": checks.best_odds(m["best_odds_by_line"], m["odds_market_outcomes"]),
        "event_bridge": checks.event_bridge(m["odds_event_bridge"], flat["events"], league.TEAMS),
        "market_board": checks.market_board(m["current_market_board"], m["best_odds_by_line"]),
        "ratings": checks.rating_history(w["elo"], w["elo_current"], played, teams=4),
        "efficiency": checks.team_game_efficiency(w["efficiency"], w["schedule"]),
        "rolling": checks.rolling_features(w["rolling"], w["efficiency"]),
        "passers": checks.qb_game_performance(w["performance"], w["schedule"], 0.5),
        "passer_ratings": checks.qb_ratings(w["qb_history"], w["qb_current"], w["performance"]),
        "passer_features": checks.game_qb_features(w["qb_features"], audit, w["schedule"]),
        "dataset": checks.modeling_dataset(w["dataset"], w["schedule"]),
        "splits": checks.modeling_splits(context.modeling_splits(w["dataset"]), w["dataset"]),
        "rest": checks.schedule_features(w["rest"], w["schedule"]),
        "predictions": checks.predictions(m["probability"]),
        "explanations": checks.explanations(explained, m["probability"]),
        "contributions": checks.contributions(parts, m["probability"]),
        "narratives": checks.narratives(forecasts.narratives(explained, parts), m["probability"]),
        "technical": checks.technical_view(forecasts.technical_view(m["probability"], parts), m["probability"]),
        "spreads": checks.spread_predictions(m["spread"], m["probability"]),
        "totals": checks.totals_predictions(m["totals"], m["probability"]),
        "scores": checks.game_scores(scores, m["spread"], m["totals"]),
        "totals_value": checks.totals_value(m["totals_value"], m["totals"]),
        "board": checks.betting_board(m["board"], [m["moneyline_value"], m["spread_value"], m["totals_value"]]),
        "reports": checks.injury_reports(w["reports"], w["status"], w["schedule"], {"raw": w["reports"].count()}),
        "depth": checks.depth_charts(w["depth"], w["schedule"]),
        "snaps": checks.snap_counts(w["snaps"], w["snap_counts"], w["usage"], w["directory"]),
        "injury": checks.injury_features(w["impact"], w["burden"], w["injury"], w["schedule"]),
    }
    for name, suite in suites.items():
        failed = {r["check_name"] for r in suite.where("status = 'FAIL'").collect()}
        assert failed == expected_failures.get(name, set()), name


def test_quality_suites_notice_faults(world, market):
    from fieldglass.plans import checks

    def failed(suite):
        return {r["check_name"] for r in suite.where("status = 'FAIL'").collect()}

    w = world
    shifted = w["rolling"].withColumn("pregame_offensive_epa_per_play_last_4", F.col("pregame_offensive_epa_per_play_last_4") + 0.1)
    assert failed(checks.rolling_features(shifted, w["efficiency"])) == {"incorrect_pregame_offensive_epa_per_play_last_4"}
    twice = w["efficiency"].unionByName(w["efficiency"])
    assert {"duplicate_game_team", "invalid_team_rows_per_game"} <= failed(checks.team_game_efficiency(twice, w["schedule"]))
    leaky = w["rolling"].withColumn("team_win", F.lit(True))
    assert failed(checks.rolling_features(leaky, w["efficiency"])) == {"postgame_result_column_leakage"}
    worse = market["best_odds_by_line"].withColumn("best_decimal_odds", F.col("best_decimal_odds") + 1)
    assert "incorrect_best_price" in failed(checks.best_odds(worse, market["odds_market_outcomes"]))
