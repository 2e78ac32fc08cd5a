"""Sequential ratings: hand values, brute force, both execution forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import ratings
from fieldglass.operators.ratings import RatingConfig

CFG = RatingConfig(k=20.0, advantage=40.0, retention=0.6)


def schedule(leagues=2, seasons=3, weeks=5, teams=6, seed=1):
    rng = random.Random(seed)
    rows = []
    for league in range(leagues):
        for season in range(2020, 2020 + seasons):
            for week in range(weeks):
                order = list(range(teams))
                rng.shuffle(order)
                for i in range(0, teams, 2):
                    rows.append((f"L{league}", season, season * 100 + week, f"{league}-{season}-{week}-{i}", f"T{order[i]}", f"T{order[i + 1]}",
                                 rng.randint(0, 4), rng.randint(0, 4), rng.random() < 0.2))
    return rows


TYPES = "league string, season int, round int, game_id string, home_team string, away_team string, home_score int, away_score int, is_neutral boolean"


def brute(rows, cfg):
    out, state, current = {}, {}, {}
    for league, season, rnd, game, home, away, hs, as_, neutral in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        table = state.setdefault(league, {})
        if current.get(league, season) != season:
            for t in table:
                table[t] = cfg.initial + (table[t] - cfg.initial) * cfg.retention
        current[league] = season
        a, b = table.get(home, cfg.initial), table.get(away, cfg.initial)
        p = 1 / (1 + 10 ** ((b - a - (0 if neutral else cfg.advantage)) / 400))
        change = cfg.k * ((hs > as_) + 0.5 * (hs == as_) - p)
        table[home], table[away] = a + change, b - change
        out[game] = (a, b, p, a + change, b - change)
    return out


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame(schedule(), TYPES).repartition(3)


def values(frame):
    return {r["game_id"]: (r["home_rating_pre"], r["away_rating_pre"], r["home_win_probability"], r["home_rating_post"], r["away_rating_post"]) for r in frame.collect()}


def test_equal_ratings_are_even(spark):
    row = spark.range(1).select(scalars.rating_probability(F.lit(1500.0), F.lit(1500.0)).alias("p")).first()
    assert row["p"] == 0.5


def test_streamed_chain_matches_brute_force(games):
    got, want = values(ratings.pairwise_ratings(games, "league", ["round", "game_id"], cfg=CFG)), brute(schedule(), CFG)
    assert got.keys() == want.keys()
    for game in want:
        assert got[game] == pytest.approx(want[game])


def test_rounds_match_the_streamed_chain(games):
    got, want = values(ratings.ratings_by_round(games, "league", "round", cfg=CFG)), brute(schedule(), CFG)
    for game in want:
        assert got[game] == pytest.approx(want[game])


def test_change_is_zero_sum(games):
    rows = ratings.pairwise_ratings(games, "league", ["round", "game_id"], cfg=CFG).collect()
    for r in rows:
        assert (r["home_rating_post"] - r["home_rating_pre"]) + (r["away_rating_post"] - r["away_rating_pre"]) == pytest.approx(0.0, abs=1e-9)


def test_small_arrow_batches_carry_state(spark, games):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = values(ratings.pairwise_ratings(games, "league", ["round", "game_id"], cfg=CFG))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for game, want in brute(schedule(), CFG).items():
        assert got[game] == pytest.approx(want)


def test_an_entity_cannot_play_twice_in_a_round(spark):
    rows = [("L", 2020, 1, "a", "T1", "T2", 1, 0, False), ("L", 2020, 1, "b", "T1", "T3", 1, 0, False)]
    with pytest.raises(Exception, match="twice in one round"):
        ratings.ratings_by_round(spark.createDataFrame(rows, TYPES), "league", "round").collect()


def test_regression_differs_between_history_and_forecast(spark):
    """Once per season change in history, once per crossed season in forecasts."""
    rows = [("L", 2020, 1, "a", "A", "B", 1, 0, False), ("L", 2023, 2, "b", "A", "B", 1, 0, False)]
    history = ratings.pairwise_ratings(spark.createDataFrame(rows, TYPES), "league", ["round", "game_id"], cfg=CFG)
    by_game = values(history)
    post = by_game["a"][3]
    assert by_game["b"][0] == pytest.approx(1500 + (post - 1500) * 0.6)
    current = ratings.current_ratings(history.where("game_id = 'a'"), "league", ["game_id"])
    upcoming = spark.createDataFrame([(2023, "A", "B", False)], "season int, home_team string, away_team string, is_neutral boolean")
    row = ratings.forecast_events(upcoming, current, "season", cfg=CFG).first()
    assert row["home_rating"] == pytest.approx(1500 + (post - 1500) * 0.6**3)


def test_current_ratings(games):
    history = ratings.pairwise_ratings(games, "league", ["round", "game_id"], cfg=CFG, keep=["round"])
    got = {(r["league"], r["entity"]): r for r in ratings.current_ratings(history, "league", ["round", "game_id"]).collect()}
    played = {}
    for league, season, rnd, game, home, away, *_ in schedule():
        for t in (home, away):
            played[(league, t)] = played.get((league, t), 0) + 1
    assert {k: r["games_played"] for k, r in got.items()} == played


def test_tuning_grid(games):
    grid = ratings.rating_grid((10.0, 20.0), (0.0, 40.0), (0.6,))
    table = ratings.tune_ratings(games, "league", ["round", "game_id"], grid, F.when(F.col("season") == 2022, "VALIDATION").otherwise("DEVELOPMENT"))
    rows = {(r["k"], r["advantage"], r["period"]): r for r in table.collect()}
    assert len(rows) == 8
    decided = [r for r in schedule() if r[6] != r[7] and r[1] == 2022]
    want = brute(schedule(), RatingConfig(k=20.0, advantage=40.0, retention=0.6))
    brier = sum((want[r[3]][2] - (r[6] > r[7])) ** 2 for r in decided) / len(decided)
    assert rows[(20.0, 40.0, "VALIDATION")]["brier"] == pytest.approx(brier)
    assert len(ratings.rating_grid(**{k: v for k, v in ratings.GRID.items()})) == 200
