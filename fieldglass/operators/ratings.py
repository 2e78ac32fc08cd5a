"""Sequential pairwise ratings.

A rating chain is serial by nature: each result depends on both sides' previous
results.  Two forms are offered.

``pairwise_ratings`` sends each independent chain (league x parameter set) to a
task in time order and streams it in Arrow batches; memory holds one rating per
entity, never the games.  Parallelism comes from the chains.

``ratings_by_round`` spreads a *single* big chain over the cluster: games of one
round are independent (an entity plays at most once), so a round is two joins
with the rating table.  The loop runs over the calendar's rounds, not over rows,
and every round is written to the shared folder, which cuts lineage and lets a
lost executor be replaced.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.scalars import rating_probability, regress_rating
from fieldglass.session import shared_folder

from .joins import two_sided
from .skew import names


@dataclass(frozen=True)
class RatingConfig:
    initial: float = 1500.0
    k: float = 20.0
    advantage: float = 0.0
    retention: float = 0.60
    scale: float = 400.0


@dataclass(frozen=True)
class GameColumns:
    """Names of the input columns; scores are numeric, ``neutral`` is boolean."""

    game: str = "game_id"
    season: str = "season"
    home: str = "home_team"
    away: str = "away_team"
    home_score: str = "home_score"
    away_score: str = "away_score"
    neutral: str = "is_neutral"


_RESULT = (
    "home_rating_pre double, away_rating_pre double, home_win_probability double, "
    "actual_home_score double, home_rating_post double, away_rating_post double, home_rating_change double"
)


def _walk(batches: Iterator[pd.DataFrame], chain: list[str], cols: GameColumns, out: list[str], cfg_cols: bool, cfg: RatingConfig):
    """Rate games that arrive sorted by chain and time; state is one dict."""
    current, season, ratings, setting = None, None, {}, cfg
    for batch in batches:
        rows = []
        keys = list(zip(*[batch[c] for c in chain]))
        params = list(zip(batch["k"], batch["advantage"], batch["retention"])) if cfg_cols else None
        columns = [batch[c].tolist() for c in (cols.season, cols.home, cols.away, cols.home_score, cols.away_score, cols.neutral)]
        for i, (year, home, away, hs, as_, neutral) in enumerate(zip(*columns)):
            if keys[i] != current:
                current, season, ratings = keys[i], None, {}
                if params:
                    setting = RatingConfig(cfg.initial, params[i][0], params[i][1], params[i][2], cfg.scale)
            if season is not None and year != season:
                # Once per change, however many seasons were skipped.
                ratings = {e: cfg.initial + (r - cfg.initial) * setting.retention for e, r in ratings.items()}
            season = year
            a, b = ratings.get(home, cfg.initial), ratings.get(away, cfg.initial)
            edge = 0.0 if neutral else setting.advantage
            p = 1.0 / (1.0 + 10.0 ** ((b - (a + edge)) / setting.scale))
            score = 1.0 if hs > as_ else 0.0 if hs < as_ else 0.5
            change = setting.k * (score - p)
            ratings[home], ratings[away] = a + change, b - change
            rows.append((a, b, p, score, a + change, b - change, change))
        result = pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")])
        yield pd.concat([batch[out].reset_index(drop=True), result], axis=1)


def pairwise_ratings(
    games: DataFrame,
    chain: str | Sequence[str],
    order: Sequence[str],
    cols: GameColumns = GameColumns(),
    cfg: RatingConfig = RatingConfig(),
    keep: Sequence[str] = (),
    cfg_columns: bool = False,
) -> DataFrame:
    """Pre- and post-game ratings, expectation and change for every game.

    ``chain`` names the independent leagues; ``order`` ends in a unique key.
    With ``cfg_columns`` the parameters come from columns ``k``, ``advantage``
    and ``retention``, constant within a chain.
    """
    chain = names(chain)
    out = list(dict.fromkeys([*chain, cols.game, cols.season, cols.home, cols.away, *keep]))
    used = list(dict.fromkeys([*out, cols.home_score, cols.away_score, cols.neutral, *order, *(["k", "advantage", "retention"] if cfg_columns else [])]))
    rows = games.select(*used).repartition(*chain).sortWithinPartitions(*chain, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*out).schema.fields) + ", " + _RESULT
    return rows.mapInPandas(lambda it: _walk(it, chain, cols, out, cfg_columns, cfg), schema)


def ratings_by_round(
    games: DataFrame,
    chain: str | Sequence[str],
    round_col: str,
    cols: GameColumns = GameColumns(),
    cfg: RatingConfig = RatingConfig(),
    keep: Sequence[str] = (),
) -> DataFrame:
    """R1 for chains too big for one task: one distributed step per round.

    ``round_col`` increases with time across seasons, and an entity plays at
    most once per round (checked).  Rating state is a table keyed by entity.
    """
    chain = names(chain)
    spark = games.sparkSession
    folder = f"{shared_folder(spark)}/ratings-{uuid.uuid4().hex}"
    calendar = [tuple(r) for r in games.select(cols.season, round_col).distinct().orderBy(round_col, cols.season).collect()]
    if len({r for _, r in calendar}) != len(calendar):
        raise ValueError("a round spans two seasons")
    entity = games.select(*chain, F.col(cols.home).alias("entity")).schema
    state = spark.createDataFrame([], entity.add("rating", "double"))
    out = list(dict.fromkeys([*chain, cols.game, cols.season, round_col, cols.home, cols.away, *keep]))
    # One pass lays the games out by round, so each step reads its round only.
    # The range order keeps a round in few files and splits a large one.
    games.repartitionByRange(F.col(round_col), F.col(cols.home)).write.partitionBy(round_col).parquet(f"{folder}/games")
    landed = spark.read.schema(games.schema).parquet(f"{folder}/games")
    previous = None
    for step, (season, number) in enumerate(calendar):
        if previous is not None and season != previous:
            state = state.withColumn("rating", regress_rating(F.col("rating"), F.lit(1), cfg.initial, cfg.retention))
        previous = season
        rows = landed.where(F.col(round_col) == number)
        for side, name in (("home", cols.home), ("away", cols.away)):
            side_state = state.select(*chain, F.col("entity").alias(name), F.col("rating").alias(f"{side}_rating_pre"))
            rows = rows.join(side_state, [*chain, name], "left").fillna(cfg.initial, [f"{side}_rating_pre"])
        edge = F.when(F.coalesce(F.col(cols.neutral), F.lit(False)), 0.0).otherwise(cfg.advantage)
        hs, as_ = F.col(cols.home_score), F.col(cols.away_score)
        rows = rows.withColumn(
            "home_win_probability", rating_probability(F.col("home_rating_pre"), F.col("away_rating_pre"), edge, cfg.scale)
        ).withColumn("actual_home_score", F.when(hs > as_, 1.0).when(hs < as_, 0.0).otherwise(0.5))
        rows = rows.withColumn("home_rating_change", F.lit(cfg.k) * (F.col("actual_home_score") - F.col("home_win_probability")))
        rows = rows.withColumn("home_rating_post", F.col("home_rating_pre") + F.col("home_rating_change")).withColumn(
            "away_rating_post", F.col("away_rating_pre") - F.col("home_rating_change")
        )
        result = [c.split()[0] for c in _RESULT.split(", ")]
        rows.select(*out, *result).write.parquet(f"{folder}/history/step={step}")
        done = spark.read.parquet(f"{folder}/history/step={step}")
        played = two_sided(done, chain, {
            "home": {"entity": F.col(cols.home), "rating": F.col("home_rating_post")},
            "away": {"entity": F.col(cols.away), "rating": F.col("away_rating_post")},
        }).groupBy(*chain, "entity").agg(F.max("rating").alias("rating"), F.count(F.lit(1)).alias("__n"))
        once = F.when(F.col("__n") == 1, F.col("rating")).otherwise(
            F.raise_error(F.lit("an entity plays twice in one round"))
        )
        fresh = played.select(*chain, "entity", once.alias("rating"))
        rest = state.join(fresh.select(*chain, "entity"), [*chain, "entity"], "left_anti")
        rest.unionByName(fresh).write.parquet(f"{folder}/state/step={step}")
        state = spark.read.parquet(f"{folder}/state/step={step}")
    return spark.read.parquet(*[f"{folder}/history/step={i}" for i in range(len(calendar))]).select(*out, *result)


def rating_grid(ks: Sequence[float], advantages: Sequence[float], retentions: Sequence[float]) -> list[tuple[float, float, float]]:
    return list(itertools.product(ks, advantages, retentions))


#: The tuned parameter grid (8 x 5 x 5).
GRID = {
    "ks": tuple(15.0 + 5.0 * i for i in range(8)),
    "advantages": tuple(35.0 + 5.0 * i for i in range(5)),
    "retentions": (0.40, 0.50, 0.60, 0.70, 0.80),
}


_SCORES = "setting long, __period string, n long, brier double, log_loss double, hits double"


def _walk_settings(batches: Iterator[pd.DataFrame], chain: list[str], cols: GameColumns, cfg: RatingConfig, grid: np.ndarray, epsilon: float):
    """Rate each chain once for all settings: an entity's state is one vector, a game a few vector operations."""
    k, advantage, retention = grid.T
    current, season, ratings = None, None, {}
    sums: dict[str, np.ndarray] = {}
    fresh = np.full(len(grid), cfg.initial)
    for batch in batches:
        keys = list(zip(*[batch[c] for c in chain]))
        columns = [batch[c].tolist() for c in (cols.season, cols.home, cols.away, cols.home_score, cols.away_score, cols.neutral, "__period")]
        for key, (year, home, away, hs, as_, neutral, period) in zip(keys, zip(*columns)):
            if key != current:
                current, season, ratings = key, None, {}
            if season is not None and year != season:
                ratings = {e: cfg.initial + (r - cfg.initial) * retention for e, r in ratings.items()}
            season = year
            a, b = ratings.get(home, fresh), ratings.get(away, fresh)
            p = 1.0 / (1.0 + 10.0 ** ((b - (a if neutral else a + advantage)) / cfg.scale))
            score = 1.0 if hs > as_ else 0.0 if hs < as_ else 0.5
            change = k * (score - p)
            ratings[home], ratings[away] = a + change, b - change
            if score != 0.5:
                # A tie carries no winner to score.
                safe = np.clip(p, epsilon, 1 - epsilon)
                total = sums.setdefault(period, np.zeros((4, len(grid))))
                total += (
                    np.ones(len(grid)), (p - score) ** 2, -np.log(safe if score else 1 - safe), ((p >= 0.5) == (score == 1.0)).astype(float)
                )
    for period, (n, brier, loss, hits) in sums.items():
        yield pd.DataFrame({
            "setting": np.arange(len(grid)), "__period": period, "n": n.astype("int64"), "brier": brier, "log_loss": loss, "hits": hits,
        })


def tune_ratings(
    games: DataFrame,
    chain: str | Sequence[str],
    order: Sequence[str],
    grid: Sequence[tuple[float, float, float]],
    period: Column,
    cols: GameColumns = GameColumns(),
    cfg: RatingConfig = RatingConfig(),
    epsilon: float = 1e-15,
) -> DataFrame:
    """R2: probability scores per parameter set and period, all sets in one pass over the games.

    Columns: k, advantage, retention, period, n, brier, log_loss, accuracy.  Games
    are not copied per set; chains run in parallel, and what leaves a task are
    sums, one row per set and period.  ``period`` names where a game counts.
    """
    chain = names(chain)
    used = list(dict.fromkeys([*chain, cols.season, cols.home, cols.away, cols.home_score, cols.away_score, cols.neutral, *order]))
    rows = games.select(*used, period.cast("string").alias("__period")).repartition(*chain).sortWithinPartitions(*chain, *order)
    settings = np.array([[float(x) for x in row] for row in grid])
    parts = rows.mapInPandas(lambda it: _walk_settings(it, chain, cols, cfg, settings, epsilon), _SCORES)
    sums = parts.groupBy("setting", "__period").agg(*[F.sum(c).alias(c) for c in ("n", "brier", "log_loss", "hits")])
    table = games.sparkSession.createDataFrame(
        [(i, *map(float, row)) for i, row in enumerate(grid)], "setting long, k double, advantage double, retention double"
    )
    return sums.join(F.broadcast(table), "setting").select(
        "k", "advantage", "retention", F.col("__period").alias("period"), "n", (F.col("brier") / F.col("n")).alias("brier"),
        (F.col("log_loss") / F.col("n")).alias("log_loss"), (F.col("hits") / F.col("n")).alias("accuracy"),
    )


def current_ratings(history: DataFrame, chain: str | Sequence[str], order: Sequence[str], cols: GameColumns = GameColumns()) -> DataFrame:
    """Last rating, games played and last season per entity (not ranked)."""
    chain = names(chain)
    sides = two_sided(history, [*chain, cols.season, *order], {
        "home": {"entity": F.col(cols.home), "rating": F.col("home_rating_post")},
        "away": {"entity": F.col(cols.away), "rating": F.col("away_rating_post")},
    })
    return sides.groupBy(*chain, "entity").agg(
        F.max_by("rating", F.struct(*order)).alias("rating"),
        F.count(F.lit(1)).alias("games_played"),
        F.max(cols.season).alias("last_season"),
    )


def forecast_events(
    upcoming: DataFrame, ratings: DataFrame, season: str, cols: GameColumns = GameColumns(), cfg: RatingConfig = RatingConfig()
) -> DataFrame:
    """Probability of upcoming events; ratings regress once per crossed season."""
    from .joins import dual_role_join

    rows = dual_role_join(upcoming, ratings, "entity", {"home": cols.home, "away": cols.away}, ["rating", "last_season"])
    for side in ("home", "away"):
        crossed = F.greatest(F.col(season) - F.col(f"{side}_last_season"), F.lit(0))
        rows = rows.withColumn(
            f"{side}_rating",
            F.coalesce(regress_rating(F.col(f"{side}_rating"), crossed, cfg.initial, cfg.retention), F.lit(cfg.initial)),
        )
    edge = F.when(F.coalesce(F.col(cols.neutral), F.lit(False)), 0.0).otherwise(cfg.advantage)
    return rows.withColumn(
        "home_win_probability", rating_probability(F.col("home_rating"), F.col("away_rating"), edge, cfg.scale)
    ).withColumn("away_win_probability", F.lit(1.0) - F.col("home_win_probability"))
