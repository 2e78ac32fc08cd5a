"""Historical market ledger and summary.  D10: forward archive, settlement, performance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import aggregates, asof, joins, skew, windows
from fieldglass.operators.reshape import prefer_primary, union_products
from fieldglass.session import land
from fieldglass.sources import publish

_STEPS = {"h2h": scalars.PROBABILITY_STEPS, "spreads": scalars.POINT_STEPS, "totals": scalars.POINT_STEPS}
_TOP = {m: "VERY_HIGH" for m in _STEPS}


def selected_predictions(primary: DataFrame, fallback: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Primary out-of-fold predictions, fallback ones for the other games."""
    return prefer_primary(primary, fallback, "game_id", names).withColumnRenamed("source_label", "model_name")


def _ledger(rows: DataFrame, market: str, selection: Column, basis: str, line: Column, price: Column, odds: Column,
            model_value: Column, market_value: Column, edge: Column, comparison: Column, clv: Column) -> DataFrame:
    outcome = scalars.settle_columns(comparison, odds)
    return rows.select(
        "game_id", "season", F.lit(market).alias("market_key"), "model_name", selection.alias("selection"), F.lit(basis).alias("pricing_basis"),
        line.cast("double").alias("market_line"), price.cast("double").alias("market_price"), odds.alias("decimal_odds"), model_value.alias("model_value"),
        market_value.alias("market_value"), edge.alias("edge"), edge.alias("absolute_edge"),
        scalars.edge_bucket(F.lit(market), edge, _STEPS, _TOP).alias("edge_bucket"), outcome["settlement"].alias("result"),
        outcome["profit"].alias("profit_per_unit"), clv.alias("clv_value"), clv.isNotNull().alias("clv_available"), "actual_home_margin", "actual_total",
    )


def historical_ledger(probability: DataFrame, spread: DataFrame, totals: DataFrame, market: DataFrame) -> DataFrame:
    """One model-preferred side per game and market, settled at closing prices."""
    def beside(predictions: DataFrame) -> DataFrame:
        return joins.join_checked(predictions, market, ["game_id", "season"], "1:1")

    none = F.lit(None).cast("double")
    p, close, opened = F.col("home_win_probability"), F.col("home_market_probability_close"), F.col("home_market_probability_open")
    margin, total = F.col("actual_home_margin"), F.col("actual_total")

    home = p - close >= 0
    side = lambda c: F.when(home, c).otherwise(F.lit(1.0) - c)
    won = F.when(home, margin > 0).otherwise(margin < 0)
    moneyline = _ledger(
        beside(probability), "h2h", F.when(home, "HOME").otherwise("AWAY"), "SYNTHETIC_CLOSE_FAIR", none, none, F.lit(1.0) / side(close),
        side(p), side(close), F.abs(p - close), F.when(won, 1.0).otherwise(-1.0), side(close) - side(opened),
    )
    line = F.col("home_line_close")
    signed = F.col("predicted_home_margin") + line
    home_s = signed >= 0
    turn = F.when(home_s, 1.0).otherwise(-1.0)
    price = F.when(home_s, F.col("home_line_close_price")).otherwise(F.col("away_line_close_price"))
    spreads = _ledger(
        beside(spread), "spreads", F.when(home_s, "HOME").otherwise("AWAY"), "CLOSING_PRICE", line * turn, price, scalars.american_to_decimal(price, strict=False),
        F.col("predicted_home_margin"), -line, F.abs(signed), (margin + line) * turn, (F.col("home_line_open") - line) * turn,
    )
    mark = F.col("total_line_close")
    gap = F.col("predicted_total") - mark
    over = gap >= 0
    turn_t = F.when(over, 1.0).otherwise(-1.0)
    price_t = F.when(over, F.col("over_price_close")).otherwise(F.col("under_price_close"))
    points = _ledger(
        beside(totals), "totals", F.when(over, "OVER").otherwise("UNDER"), "CLOSING_PRICE", mark, price_t, scalars.american_to_decimal(price_t, strict=False),
        F.col("predicted_total"), mark, F.abs(gap), (total - mark) * turn_t, (mark - F.col("total_line_open")) * turn_t,
    )
    return union_products([moneyline, spreads, points])


def historical_summary(ledger: DataFrame) -> DataFrame:
    """Per market and edge bucket, and per market over all buckets."""
    result = F.col("result")
    measures = {
        "bet_count": F.count(F.lit(1)), "win_count": aggregates.count_where(result == "WIN"), "loss_count": aggregates.count_where(result == "LOSS"),
        "push_count": aggregates.count_where(result == "PUSH"), "total_profit": F.sum("profit_per_unit"), "roi_percent": F.avg("profit_per_unit") * 100.0,
        "mean_edge": F.avg("edge"), "clv_bet_count": aggregates.count_where(F.col("clv_available")),
        "mean_clv": F.avg(F.when(F.col("clv_available"), F.col("clv_value"))),
    }
    # Three joins lie behind a ledger and several passes ahead of it: what they need is written once.
    needed = ["market_key", "edge_bucket", "season", "game_id", "result", "profit_per_unit", "edge", "clv_available", "clv_value"]
    ledger = ledger.select(*needed) if skew.is_small(ledger) else land(ledger.select(*needed), "ledger")
    sums = aggregates.multi_scope(ledger, [["market_key"], ["market_key", "edge_bucket"]], {"ALL_ROWS": F.lit(True)}, measures).drop("scope")
    both = ledger.withColumn("edge_bucket", F.explode(F.array(F.col("edge_bucket"), F.lit("ALL"))))
    falls = windows.max_drawdown(both, ["market_key", "edge_bucket"], ["season", "game_id"], "profit_per_unit")
    out = sums.join(falls.select("market_key", "edge_bucket", F.col("max_drawdown").alias("maximum_drawdown_units")), ["market_key", "edge_bucket"])
    return out.withColumn("win_rate_excluding_pushes", aggregates.ratio(F.col("win_count"), F.col("win_count") + F.col("loss_count")))


# -- D10 -----------------------------------------------------------------------------------

ARCHIVE_KEY = ["snapshot_id", "game_id", "market_key", "outcome_type", "point", "best_bookmaker_key"]
_TIMES = ["fetched_at", "prediction_generated_at", "betting_board_generated_at", "archived_at"]


def archive_rows(board: DataFrame, run_id: str, archived_at: Column) -> DataFrame:
    """Board rows known before kickoff; the time of archiving is an argument."""
    rows = board.withColumns({"archived_at": archived_at, "refresh_run_id": F.lit(run_id)})
    kept = scalars.before_event(rows, "commence_time", _TIMES)
    return kept.withColumn("is_tip_candidate", scalars.flag(F.col("positive_expected_value")))


def append_archive(board: DataFrame, run_id: str, archived_at: Column, location: str) -> int:
    """S10 over the board; every board value of a known key must be unchanged."""
    payload = [*board.columns, "is_tip_candidate"]
    return publish.archive_append(archive_rows(board, run_id, archived_at), location, ARCHIVE_KEY, payload)


_HEX = "0123456789abcdef"
_MOVE = ["archive_key", "refresh_run_id", "snapshot_id", "fetched_at", "market_line", "point", "best_bookmaker_key", "best_bookmaker_title", "best_american_price", "best_decimal_odds"]


def market_movement(archive: DataFrame, capture: tuple[int, int] = (45, 75), capture_prefix: str = "kickoff_capture_") -> DataFrame:
    """First tip of each selection against its latest later price before kickoff."""
    key = ["game_id", "market_key", "outcome_type"]
    # Order of preference at one time: newest archive row, higher value, higher point, smaller key.
    low = F.lit(float("-inf"))
    archive = archive.withColumns({"__value": F.col("expected_value_percent"), "__point": F.coalesce("point", low)})
    order = {"fetched_at": F.col("fetched_at"), "archived_at": F.col("archived_at"), "__v": -F.col("__value"), "__p": -F.col("__point"), "archive_key": F.col("archive_key")}
    rest = [c for c in archive.columns if c not in [*key, *order, "__value", "__point"]]
    # One struct is order and row at once, so that no column travels twice.
    row = F.struct(*[c.alias(n) for n, c in order.items()], *rest)
    entries = archive.where("is_tip_candidate").groupBy(*key).agg(F.min(row).alias("r")).select(*key, "r.*").drop("__v", "__p")
    renamed = {"best_bookmaker_key": "bookmaker_key", "best_bookmaker_title": "bookmaker", "best_american_price": "american_price", "best_decimal_odds": "decimal_odds"}
    later = archive.select(
        *key, F.col("fetched_at").alias("__ts"), "archived_at", "__value", "__point",
        # The smallest key wins a full tie, so its complement sorts last; the complement's complement is the key.
        F.translate("archive_key", _HEX, _HEX[::-1]).alias("__rev"),
        *[F.col(c).alias(f"latest_{renamed.get(c, c)}") for c in _MOVE if c not in ("archive_key", "fetched_at")],
    )
    payload = [c for c in later.columns if c.startswith("latest_")]
    rows = asof.latest_before(
        entries, later, key, "fetched_at", "commence_time", "__ts", ["archived_at", "__value", "__point", "__rev"], ["__ts", "__rev", *payload]
    ).withColumnsRenamed({"__ts": "latest_fetched_at"}).withColumn("latest_archive_key", F.translate("__rev", _HEX[::-1], _HEX))
    payload = [f"latest_{renamed.get(c, c)}" for c in _MOVE]
    shown = {c: f"entry_{renamed.get(c, c)}" for c in _MOVE} | {
        "model_name": "entry_model_name", "model_version": "entry_model_version", "prediction_mode": "entry_prediction_mode",
        "prediction_generated_at": "entry_prediction_generated_at", "model_probability": "entry_model_probability", "expected_value_percent": "entry_expected_value_percent",
    }
    keep = ["game_id", "season", "week", "commence_time", "home_team", "away_team", "market_key", "market_name", "outcome_name", "outcome_type"]
    rows = rows.select(*keep, *[F.col(c).alias(n) for c, n in shown.items()], *payload)
    entry_p, latest_p = F.lit(1.0) / F.col("entry_decimal_odds"), F.lit(1.0) / F.col("latest_decimal_odds")
    side = F.lower("outcome_type")
    gap = F.col("entry_point") - F.col("latest_point")
    advantage = F.when((F.col("market_key") == "spreads") | ((F.col("market_key") == "totals") & (side == "under")), gap).when(
        (F.col("market_key") == "totals") & (side == "over"), F.col("latest_point") - F.col("entry_point")
    )
    found = F.col("latest_fetched_at").isNotNull()
    minutes = scalars.minute_difference(F.col("latest_fetched_at"), F.col("commence_time"))
    move, tiny = 100.0 * (latest_p - entry_p), 1e-6
    line = F.coalesce(advantage, F.lit(0.0))
    closing = scalars.flag(F.col("latest_refresh_run_id").startswith(capture_prefix) & minutes.between(*capture))
    return rows.withColumns({
        "entry_implied_probability": entry_p, "latest_implied_probability": latest_p, "price_movement_implied_probability_pp": move,
        "entry_line_advantage_points": advantage, "latest_minutes_before_kickoff": F.when(found, minutes),
        "market_movement_direction": F.when(~found, "NO_LATER_SNAPSHOT").when(line > tiny, "POSITIVE").when(line < -tiny, "NEGATIVE")
        .when(move > tiny, "POSITIVE").when(move < -tiny, "NEGATIVE").otherwise("UNCHANGED"),
        "has_latest_pregame_comparison": found, "is_closing_snapshot": closing, "is_clv": closing,
    })


def forward_settlement(entries: DataFrame, schedule: DataFrame) -> DataFrame:
    """Tracked entries settled by final scores; unplayed ones stay pending."""
    games = schedule.select("game_id", "home_score", "away_score", "is_completed")
    rows = joins.join_checked(entries, games, "game_id", "m:1", "left")
    done = scalars.flag(F.col("is_completed")) & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    margin, total = F.col("home_score") - F.col("away_score"), F.col("home_score") + F.col("away_score")
    side, point, market = F.lower("outcome_type"), F.col("entry_point"), F.col("market_key")
    own = F.when(side == "home", margin).otherwise(-margin)
    comparison = (
        F.when(market == "h2h", own.cast("double")).when(market == "spreads", own + point)
        .when(market == "totals", F.when(side == "over", total - point).otherwise(point - total))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported market: "), market)).cast("double"))
    )
    outcome = scalars.settle_columns(comparison, F.col("entry_decimal_odds"))
    rows = rows.withColumns({
        "settlement_status": F.when(done, "SETTLED").otherwise("PENDING"), "actual_home_margin": F.when(done, margin), "actual_total": F.when(done, total),
        "result": F.when(done, outcome["settlement"]), "profit_units": F.when(done, outcome["profit"]),
    })
    scored = scalars.flag((market == "h2h") & F.col("result").isin("WIN", "LOSS"))
    p = F.least(F.greatest(F.col("entry_model_probability"), F.lit(1e-15)), F.lit(1.0 - 1e-15))
    y = F.when(F.col("result") == "WIN", 1.0).otherwise(0.0)
    return rows.withColumns({
        "is_probability_score_eligible": scored, "brier_loss": F.when(scored, (p - y) * (p - y)), "log_loss": F.when(scored, aggregates.log_loss(p, y, 1e-15)),
    }).drop("is_completed")


SCOPES: Sequence[Sequence[str]] = (["season"], ["season", "market_key"], ["season", "week"], ["season", "week", "market_key"])


def forward_performance(ledger: DataFrame) -> DataFrame:
    """Season, market and week scopes x sample scopes, from one tagged pass each."""
    settled, result = F.col("settlement_status") == "SETTLED", F.col("result")
    decided = settled & result.isin("WIN", "LOSS")
    positive = F.col("market_movement_direction") == "POSITIVE"
    clv = F.col("is_clv")
    when = lambda test, c: F.when(test, F.col(c))
    measures = {
        "tracked_count": F.count(F.lit(1)), "settled_count": aggregates.count_where(settled), "pending_count": aggregates.count_where(~settled),
        "win_count": aggregates.count_where(settled & (result == "WIN")), "loss_count": aggregates.count_where(settled & (result == "LOSS")),
        "push_count": aggregates.count_where(settled & (result == "PUSH")), "win_rate": F.avg(F.when(decided, (result == "WIN").cast("double"))),
        "average_decimal_odds": F.avg(when(settled, "entry_decimal_odds")), "total_profit_units": F.coalesce(F.sum(when(settled, "profit_units")), F.lit(0.0)),
        "roi_percent": F.avg(when(settled, "profit_units")) * 100.0, "brier_score": F.avg("brier_loss"), "log_loss": F.avg("log_loss"),
        "clv_count": aggregates.count_where(clv), "positive_clv_count": aggregates.count_where(clv & positive),
        "positive_clv_rate": F.avg(F.when(clv, positive.cast("double"))),
        "average_price_movement_probability_pp": F.avg(when(clv, "price_movement_implied_probability_pp")),
        "average_line_advantage_points": F.avg(when(clv, "entry_line_advantage_points")),
    }
    samples = {"ALL_TRACKED": F.lit(True), "SETTLED_ONLY": settled, "CLV_ELIGIBLE": clv}
    rows = aggregates.multi_scope(ledger, SCOPES, samples, measures).withColumnRenamed("scope", "sample_scope")
    week, market = F.col("week") == "ALL", F.col("market_key") == "ALL"
    rows = rows.withColumn(
        "selection_scope",
        F.when(week & market, "SEASON").when(week, "SEASON_MARKET").when(market, "WEEK").otherwise("WEEK_MARKET"),
    )
    # Every scope also reports its empty samples.
    grid = rows.where("sample_scope = 'ALL_TRACKED'").select("season", "week", "market_key", "selection_scope").withColumn(
        "sample_scope", F.explode(F.array(*[F.lit(s) for s in samples]))
    )
    keys = ["season", "week", "market_key", "selection_scope", "sample_scope"]
    zeros = [c for c in measures if c.endswith("_count")] + ["total_profit_units"]
    rows = joins.complete_left(grid, rows, keys, zeros)
    # Drawdown of the settled rows in kickoff order, per scope.
    text = {c: F.col(c).cast("string") for c in ("season", "week")}
    tags = F.array(*[
        F.struct(*[(text.get(c, F.col(c)) if c in dims else F.lit("ALL")).alias(c) for c in ("season", "week", "market_key")]) for dims in SCOPES
    ])
    paid = ledger.where(settled).withColumn("__t", F.explode(tags)).withColumn(
        "sample_scope", F.explode(F.array_compact(F.array(F.lit("ALL_TRACKED"), F.lit("SETTLED_ONLY"), F.when(clv, F.lit("CLV_ELIGIBLE")))))
    ).select("__t.*", "sample_scope", "commence_time", F.col("game_id").alias("__g"), F.col("market_key").alias("__m"), F.col("outcome_type").alias("__o"), "profit_units")
    falls = windows.max_drawdown(
        paid, ["season", "week", "market_key", "sample_scope"], ["commence_time", "__g", "__m", "__o"], "profit_units"
    ).select("season", "week", "market_key", "sample_scope", F.col("max_drawdown").alias("maximum_drawdown_units"))
    return joins.complete_left(rows, falls, ["season", "week", "market_key", "sample_scope"], ["maximum_drawdown_units"])
