"""Odds snapshots to the current market board.  D2: board to offer values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import joins, skew, topk, windows
from fieldglass.operators.quality import require_columns
from fieldglass.operators.reshape import union_products
from fieldglass.plans.reference_values import GAME_ZONE, TEAM_CODES

OFFER_GROUP = ["snapshot_id", "event_id", "market_key", "outcome_type", "point"]


def processed_odds(snapshots: DataFrame, events: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers with sides, decimal odds and margin-free probabilities."""
    teams = events.select("snapshot_id", "event_id", "commence_time", "home_team", "away_team")
    fetched = snapshots.select("snapshot_id", "fetched_at")
    # The time of fetching joins the events, not the offers: offers are dealt by event, never by snapshot alone.
    rows = offers.join(skew.join_lookup(teams, fetched, "snapshot_id", "inner"), ["snapshot_id", "event_id"])
    price = F.col("price")
    rows = rows.select(
        "snapshot_id", "fetched_at", "event_id", "commence_time", "home_team", "away_team", "bookmaker_key",
        "bookmaker_title", "bookmaker_last_update", "market_key", "outcome_name",
        scalars.outcome_side(F.col("outcome_name"), F.col("home_team"), F.col("away_team")).alias("outcome_type"),
        price.alias("american_price"), "point",
        scalars.market_line(F.col("market_key"), F.col("point")).alias("market_line"),
        scalars.american_to_decimal(price).alias("decimal_odds"),
        scalars.implied_probability(price).alias("implied_probability"),
    )
    market = ["snapshot_id", "event_id", "bookmaker_key", "market_key", "market_line"]
    rows = windows.normalise_within(rows, market, "implied_probability", "no_vig_probability", "__sum")
    return rows.withColumn("bookmaker_margin", F.col("__sum") - 1.0).drop("__sum")


def best_odds_by_line(processed: DataFrame) -> DataFrame:
    """The best price of each line beside the consensus of all bookmakers."""
    fair = F.col("no_vig_probability")
    best = windows.best_with_consensus(
        processed, OFFER_GROUP, "decimal_odds", ["bookmaker_key"],
        ["fetched_at", "commence_time", "home_team", "away_team", "outcome_name", "market_line", "bookmaker_key",
         "bookmaker_title", "american_price", "implied_probability", "bookmaker_margin", "no_vig_probability"],
        {
            "bookmaker_count": F.count(F.lit(1)),
            "consensus_no_vig_probability": F.avg(fair),
            "minimum_no_vig_probability": F.min(fair),
            "maximum_no_vig_probability": F.max(fair),
            "average_decimal_odds": F.avg("decimal_odds"),
        },
    )
    event = ["fetched_at", "commence_time", "home_team", "away_team", "outcome_name", "market_line"]
    best = best.withColumnsRenamed({f"best_{c}": c for c in event} | {"best_no_vig_probability": "best_bookmaker_no_vig_probability"})
    return best.withColumn(
        "probability_dispersion", F.col("maximum_no_vig_probability") - F.col("minimum_no_vig_probability")
    ).withColumn("decimal_price_improvement", F.col("best_decimal_odds") - F.col("average_decimal_odds"))


def event_bridge(events: DataFrame, schedule: DataFrame, teams: Mapping[str, str] = TEAM_CODES) -> DataFrame:
    """Odds events matched to scheduled games by team codes and local date."""
    unknown = F.lit(None).cast("string")
    mapped = events.select(
        "snapshot_id", F.col("event_id").alias("odds_event_id"), "commence_time",
        scalars.local_date(F.col("commence_time"), GAME_ZONE, None).alias("eastern_game_date"),
        F.col("home_team").alias("odds_home_team"), F.col("away_team").alias("odds_away_team"),
        scalars.map_codes(F.col("home_team"), teams, unmapped=unknown).alias("home_team_code"),
        scalars.map_codes(F.col("away_team"), teams, unmapped=unknown).alias("away_team_code"),
    )
    games = schedule.select(
        F.col("home_team").alias("home_team_code"), F.col("away_team").alias("away_team_code"),
        F.col("gameday").alias("eastern_game_date"), "game_id", "season", "game_type", "week", "gameday", "gametime",
    )
    keys = ["home_team_code", "away_team_code", "eastern_game_date"]
    return joins.bridge(
        mapped, games, keys, ["home_team_code", "away_team_code"], "game_id", "match_status",
        ("UNMAPPED_TEAM", "UNMATCHED_GAME", "MATCHED"),
    )


def market_board(best: DataFrame, bridge: DataFrame) -> DataFrame:
    """Best odds of the newest snapshot, tied to scheduled games."""
    latest = topk.latest_snapshot(best, "fetched_at", "snapshot_id")
    games = bridge.where("match_status = 'MATCHED'").select(
        "snapshot_id", F.col("odds_event_id").alias("event_id"), "game_id", "season", "game_type", "week", "gameday", "gametime",
        "home_team_code", "away_team_code",
    )
    board = latest.withColumnsRenamed({"home_team": "odds_home_team", "away_team": "odds_away_team"}).join(games, ["snapshot_id", "event_id"])
    return board.withColumnsRenamed(
        {"event_id": "odds_event_id", "home_team_code": "home_team", "away_team_code": "away_team"}
    ).withColumn("market_name", scalars.map_codes(F.col("market_key"), scalars.MARKET_NAMES))


def odds_pipeline(tables: Mapping[str, DataFrame], schedule: DataFrame, teams: Mapping[str, str] = TEAM_CODES) -> dict[str, DataFrame]:
    """D1 in one call: flattened snapshot tables to the board."""
    processed = processed_odds(tables["snapshots"], tables["events"], tables["offers"])
    best = best_odds_by_line(processed)
    bridge = event_bridge(tables["events"], schedule, teams)
    return {
        "odds_market_outcomes": processed, "best_odds_by_line": best, "odds_event_bridge": bridge,
        "current_market_board": market_board(best, bridge),
    }


# -- D2 -----------------------------------------------------------------------

_VALUE = ["probability_edge", "fair_decimal_odds", "expected_value_per_unit", "full_kelly_fraction", "positive_expected_value"]


def _with_value(rows: DataFrame, win: Column, push: Column, loss: Column, infinite_fair: bool) -> DataFrame:
    priced = scalars.price_columns(
        win, push, loss, F.col("best_decimal_odds"), F.col("consensus_no_vig_probability"), infinite_fair
    )
    names = dict(zip(["edge", "fair_odds", "expected_value", "kelly_fraction", "is_positive"], _VALUE))
    rows = rows.select("*", *[priced[k].alias(n) for k, n in names.items()])
    return rows.withColumn("probability_edge_percentage_points", 100.0 * F.col("probability_edge")).withColumn(
        "expected_value_percent", 100.0 * F.col("expected_value_per_unit")
    )


def _predicted(board: DataFrame, market: str, predictions: DataFrame, columns: list[str], required: bool = True) -> DataFrame:
    """Offers of one market beside their game's prediction (one per game)."""
    source = predictions.select("game_id", "model_name", "model_version", "prediction_mode", "prediction_generated_at", *columns)
    rows = joins.join_checked(board.where(F.col("market_key") == market), source, "game_id", "m:1", "left" if required else "inner")
    if not required:
        return rows
    missing = F.raise_error(F.concat(F.lit(f"{market} game without a production prediction: "), F.col("game_id")))
    return rows.withColumn("model_name", F.coalesce(F.col("model_name"), missing.cast("string")))


def moneyline_value(board: DataFrame, predictions: DataFrame) -> DataFrame:
    rows = _predicted(board, "h2h", predictions, ["home_win_probability", "away_win_probability"])
    p = F.when(F.col("outcome_type") == "home", F.col("home_win_probability")).otherwise(F.col("away_win_probability"))
    rows = rows.withColumn("model_probability", p)
    return _with_value(rows, F.col("model_probability"), F.lit(0.0), 1.0 - F.col("model_probability"), False)


def spread_value(board: DataFrame, predictions: DataFrame, residuals: DataFrame) -> DataFrame:
    """Spread offers priced on the residual bank of their prediction mode.

    A simulated home margin is rint(prediction + residual).  Whether it beats a
    line is a half-open question about the residual, so each offer needs only
    the counts below two thresholds.
    """
    rows = _predicted(board, "spreads", predictions, ["predicted_home_margin", "predicted_away_margin"])
    is_home = F.col("outcome_type") == "home"
    # The home margin a home offer must exceed, an away offer must stay below.
    line = F.when(is_home, -F.col("point")).otherwise(F.col("point"))
    above, below = F.floor(line) + 1, F.ceil(line) - 1
    rows = rows.withColumn("__above", above).withColumn("__below", below)
    rows = rows.withColumn("__up", F.col("__above") - F.lit(0.5) - F.col("predicted_home_margin"))
    rows = rows.withColumn("__down", F.col("__below") + F.lit(0.5) - F.col("predicted_home_margin"))
    bank = residuals.select("prediction_mode", F.col("residual_home_margin").cast("double").alias("__res"))
    rows = joins.rank_in_sample(rows, bank, "prediction_mode", "__res", ["__up", "__down"])
    n = F.col("sample_size")
    # Half-even rounding: x.5 goes to the even neighbour.
    over = n - F.when(F.col("__above") % 2 == 0, F.col("__up_lt")).otherwise(F.col("__up_le"))
    under = F.when(F.col("__below") % 2 == 0, F.col("__down_le")).otherwise(F.col("__down_lt"))
    rows = rows.withColumn("__win", F.when(is_home, over).otherwise(under)).withColumn("__loss", F.when(is_home, under).otherwise(over))
    share = lambda c: c / F.nullif(n, F.lit(0))
    rows = rows.withColumn("cover_probability", share(F.col("__win"))).withColumn("loss_probability", share(F.col("__loss")))
    rows = rows.withColumn("push_probability", share(n - F.col("__win") - F.col("__loss")))
    rows = rows.withColumn("predicted_outcome_margin", F.when(is_home, F.col("predicted_home_margin")).otherwise(F.col("predicted_away_margin")))
    rows = rows.withColumnRenamed("sample_size", "calibration_sample_count")
    decisive = F.nullif(F.col("cover_probability") + F.col("loss_probability"), F.lit(0.0))
    rows = rows.withColumn("no_push_cover_probability", F.col("cover_probability") / decisive)
    out = _with_value(rows, F.col("cover_probability"), F.col("push_probability"), F.col("loss_probability"), False)
    # A spread without any winning residual has no finite fair price.
    checked = F.when(F.col("cover_probability") > 0, F.col("fair_decimal_odds")).otherwise(
        F.raise_error(F.lit("spread value must be finite")).cast("double")
    )
    return out.withColumn("fair_decimal_odds", checked).drop(*[c for c in out.columns if c.startswith("__")])


def totals_value(board: DataFrame, predictions: DataFrame, residuals: DataFrame) -> DataFrame:
    """Totals offers; only lines quoted on both sides count.

    Win and loss compare strictly while a push accepts a small tolerance, as
    published; a residual inside the tolerance counts on both.
    """
    offers = board.where("market_key = 'totals'")
    paired = skew.attach_totals(
        offers, ["game_id", "market_line"],
        __over=F.max((F.col("outcome_type") == "over").cast("int")), __under=F.max((F.col("outcome_type") == "under").cast("int")),
    ).where("__over = 1 AND __under = 1").drop("__over", "__under")
    rows = _predicted(paired, "totals", predictions, ["predicted_total_points"], required=False)
    rows = rows.withColumn("__t", F.col("market_line") - F.col("predicted_total_points"))
    slack = F.lit(1e-9) + F.lit(1e-5) * F.abs(F.col("__t"))
    rows = rows.withColumn("__lo", F.col("__t") - slack).withColumn("__hi", F.col("__t") + slack)
    bank = residuals.select("prediction_mode", F.col("residual_total_points").cast("double").alias("__res"))
    rows = joins.rank_in_sample(rows, bank, "prediction_mode", "__res", ["__t", "__lo", "__hi"])
    n = F.coalesce(F.nullif(F.col("sample_size"), F.lit(0)), F.raise_error(F.lit("no residuals of the prediction mode")).cast("long"))
    over = F.col("outcome_type") == "over"
    above, below = n - F.col("__t_le"), F.col("__t_lt")
    rows = rows.withColumn("win_probability", F.when(over, above).otherwise(below) / n)
    rows = rows.withColumn("loss_probability", F.when(over, below).otherwise(above) / n)
    rows = rows.withColumn("push_probability", (F.col("__hi_le") - F.col("__lo_lt")) / n)
    rows = rows.withColumnRenamed("sample_size", "calibration_sample_count")
    decisive = F.nullif(F.col("win_probability") + F.col("loss_probability"), F.lit(0.0))
    rows = rows.withColumn("no_push_win_probability", F.coalesce(F.col("win_probability") / decisive, F.lit(0.5)))
    out = _with_value(rows, F.col("win_probability"), F.col("push_probability"), F.col("loss_probability"), True)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


_BOARD = [
    "snapshot_id", "fetched_at", "game_id", "season", "game_type", "week", "gameday", "commence_time", "home_team", "away_team",
    "market_key", "market_name", "market_line", "outcome_name", "outcome_type", "point", "best_bookmaker_key", "best_bookmaker_title",
    "best_american_price", "best_decimal_odds", "bookmaker_count", "model_name", "model_version", "prediction_mode", "model_probability",
    "push_probability", "loss_probability", "probability_edge", "probability_edge_percentage_points", "fair_decimal_odds",
    "expected_value_per_unit", "expected_value_percent", "full_kelly_fraction", "positive_expected_value", "prediction_generated_at",
]


def betting_board(moneyline: DataFrame, spreads: DataFrame, totals: DataFrame, generated_at: Column) -> DataFrame:
    """The three products under one schema; ``generated_at`` is passed in."""
    moneyline = moneyline.drop("market_line", "point").withColumn("push_probability", F.lit(0.0)).withColumn("loss_probability", 1.0 - F.col("model_probability"))
    products = [
        moneyline,
        spreads.withColumn("model_probability", F.col("cover_probability")),
        totals.withColumn("model_probability", F.col("win_probability")),
    ]
    board = union_products([p.select(*[c for c in _BOARD if c in p.columns]) for p in products])
    return require_columns(board, _BOARD).select(*_BOARD).withColumn("betting_board_generated_at", generated_at)


#: T1 order of the board when it is served.
BOARD_ORDER = [("positive_expected_value", "desc"), ("expected_value_percent", "desc"), ("commence_time", "asc"), ("game_id", "asc"),
               ("market_key", "asc"), ("outcome_type", "asc"), ("point", "asc")]
