"""Small value checks of the traps: odds, rounding, bins, zones, nulls."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import aggregates, reshape


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("price", "strict", "loose"), [(-110, 1.9090909, 1.9090909), (150, 2.5, 2.5), (50, None, 1.5), (-100, 2.0, 2.0), (0, None, None)])
def test_american_odds(spark, price, strict, loose):
    r = one(spark, a=scalars.american_to_decimal(F.lit(price)), b=scalars.american_to_decimal(F.lit(price), strict=False))
    assert (r["a"], r["b"]) == (strict and pytest.approx(strict), loose and pytest.approx(loose))


def test_settlement(spark):
    odds = F.lit(1.909)
    win = one(spark, **scalars.settle_columns(F.lit(7 - 3.0), odds))
    push = one(spark, **scalars.settle_columns(F.lit(0.0), odds))
    loss = one(spark, **scalars.settle_columns(F.lit(-0.5), odds))
    assert (win["settlement"], win["profit"]) == ("WIN", pytest.approx(0.909))
    assert (push["settlement"], push["profit"]) == ("PUSH", 0.0)
    assert (loss["settlement"], loss["profit"]) == ("LOSS", -1.0)
    none = one(spark, **scalars.settle_columns(F.lit(None).cast("double"), odds))
    assert none["settlement"] is None and none["profit"] is None


def test_fair_odds_without_a_chance(spark):
    args = [F.lit(x) for x in (0.0, 0.2, 0.8, 2.0, 0.5)]
    assert one(spark, **scalars.price_columns(*args))["fair_odds"] is None
    assert one(spark, **scalars.price_columns(*args, infinite_fair=True))["fair_odds"] == math.inf


def test_local_date_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        ts = F.lit("2025-09-08 00:20:00").cast("timestamp_ntz")
        assert str(one(spark, d=scalars.local_date(ts, "America/New_York"))["d"]) == "2025-09-07"
        instant = F.lit("2025-09-08T00:20:00Z").cast("timestamp")
        assert str(one(spark, d=scalars.local_date(instant, "America/New_York", None))["d"]) == "2025-09-07"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_minute_difference_counts_boundaries(spark):
    a, b = (F.lit(datetime(2025, 1, 1, 0, m, s)) for m, s in ((0, 59), (1, 1)))
    assert one(spark, m=scalars.minute_difference(a, b))["m"] == 1


@pytest.mark.parametrize(("p", "left", "right"), [(0.0, 0, 0), (0.1, 1, 0), (0.15, 1, 1), (1.0, 9, 9)])
def test_bin_edges(spark, p, left, right):
    r = one(spark, a=aggregates.probability_bin(F.lit(p), 10, "left"), b=aggregates.probability_bin(F.lit(p), 10, "right"))
    assert (r["a"], r["b"]) == (left, right)


def test_codes_and_flags(spark):
    r = one(spark, a=scalars.map_codes(F.lit("OAK"), {"OAK": "LV"}), b=scalars.map_codes(F.lit("X"), {"OAK": "LV"}), c=scalars.map_codes(F.lit("OAK"), {"OAK": "LV"}, when=F.lit(2018) >= 2020),
            d=scalars.flag(F.lit(None).cast("boolean")), e=scalars.clean_text(F.lit("  ")), f=scalars.allow_list(F.lit(" Out"), ["Out"]), g=scalars.category(F.lit(None).cast("string")))
    assert tuple(r) == ("LV", "X", "OAK", False, None, "Out", "unknown")


def test_edge_words(spark):
    words = [one(spark, w=scalars.edge_strength(F.lit(p)))["w"] for p in (0.51, 0.55, 0.64, 0.8)]
    assert words == ["toss_up", "slight_edge", "clear_edge", "strong_edge"]


def test_impact_score_caps(spark):
    w = scalars.IMPACT_WEIGHTS
    none = F.lit(None).cast("double")
    out = one(spark, **scalars.impact_columns(F.lit("Out"), F.lit("DNP"), F.lit("STARTER"), none, none, w))
    assert (out["severity"], out["impact"]) == (1.0, 1.0)
    q = one(spark, **scalars.impact_columns(F.lit("Questionable"), F.lit("FULL"), F.lit("RESERVE"), F.lit(0.8), F.lit(2), w))
    assert q["severity"] == pytest.approx(0.30) and q["importance"] == pytest.approx(0.5 * 0.8 + 0.5 * 0.25)
    assert one(spark, **scalars.impact_columns(F.lit(None).cast("string"), F.lit("DNP"), F.lit("x"), none, none, w))["severity"] == 0.0


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([(0.0, 1)], "p double, y int")
    assert aggregates.probability_metrics(df, [], "p", "y", 1e-15).first()["log_loss"] == pytest.approx(-math.log(1e-15))


def test_uncovered_pairs_fail(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.1)], "u int, c string, l double")
    with pytest.raises(Exception, match="cover different rows"):
        aggregates.paired_compare(df, ["u"], "c", "l", "a", "b").collect()


def test_gap_fill_extends_to_bounds(spark):
    df = spark.createDataFrame([("t", 2, 5), ("t", 4, 6)], "k string, w int, v int")
    rows = reshape.fill_periods(df, "k", "w", F.min(F.lit(1)), F.max(F.lit(5)))
    assert sorted((r["w"], r["v"], r["is_gap"]) for r in rows.collect()) == [(1, None, True), (2, 5, False), (3, None, True), (4, 6, False), (5, None, True)]


def test_preferred_rows_fill_in(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    got = sorted((r["k"], r["v"], r["source_label"]) for r in reshape.prefer_primary(a, b, "k").collect())
    assert got == [(1, "x", "PRIMARY"), (2, "z", "FALLBACK")]
