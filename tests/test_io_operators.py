"""Training-frame lock, profiles, snapshot gate, streaming runs and hashed bootstrap on small tables."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import bootstrap, quality, training
from fieldglass.sources import scans


@pytest.fixture
def tables(spark, folder):
    games = [(i, float(i), i % 2) for i in range(12)]
    spark.createDataFrame(games, "game_id long, x double, y int").write.parquet(f"{folder}/games")
    names = ("train", "validation", "holdout")
    spark.createDataFrame([(i, names[i % 3], i != 4) for i in range(12)], "game_id long, split_name string, is_core_model_eligible boolean").write.parquet(f"{folder}/splits")
    return spark.read.parquet(f"{folder}/games"), spark.read.parquet(f"{folder}/splits")


def test_training_frame_holds_development_rows_only(tables):
    games, splits = tables
    rows = training.training_frame(games, splits, "game_id", "y", ["x"]).collect()
    assert sorted(r["game_id"] for r in rows) == [i for i in range(12) if i % 3 != 2 and i != 4]
    assert {r["split_name"] for r in rows} == {"train", "validation"}


def test_plan_without_the_filter_is_refused(spark, tables):
    games, splits = tables
    open_ = games.join(splits, "game_id")
    with pytest.raises(training.HoldoutError):
        training.locked(open_, "split_name", ["holdout"])
    with pytest.raises(training.HoldoutError):
        training.locked(open_.where("split_name <> 'train'"), "split_name", ["holdout"])
    # A filter on something computed from the split is not pushed into the scan.
    with pytest.raises(training.HoldoutError):
        training.locked(open_.where("length(split_name) <> 7 or x > 0"), "split_name", ["holdout"])
    with pytest.raises(training.HoldoutError):
        training.locked(games, "split_name_of_nothing", ["holdout"]) if "split_name_of_nothing" in games.columns else training.training_frame(
            games, splits, "game_id", "y", ["x"], development=("train", "holdout"))
    assert training.locked(open_.where("split_name <> 'holdout'"), "split_name", ["holdout"]).count() == 8
    local = spark.createDataFrame([(1, "train")], "game_id long, split_name string")
    with pytest.raises(training.HoldoutError):
        training.locked(local.where("split_name = 'train'"), "split_name", ["holdout"])


def test_missing_target_fails(spark, tables):
    games, splits = tables
    frame = training.training_frame(games.withColumn("y", F.when(F.col("x") != 3, F.col("y"))), splits, "game_id", "y", ["x"])
    with pytest.raises(Exception, match="development row without target"):
        frame.collect()


def test_profiles(spark):
    df = spark.createDataFrame(
        [(1, "a", date(2024, 1, 2), True), (1, None, None, False), (None, "b", date(2023, 5, 1), None), (2, "", None, True)],
        "k long, s string, d date, f boolean",
    )
    rows = {r["column_name"]: r for r in quality.profile_columns(df, distinct_error=0.01).collect()}
    assert rows["k"]["null_count"] == 1 and (rows["k"]["min_number"], rows["k"]["max_number"]) == (1.0, 2.0)
    assert (rows["s"]["min_text"], rows["s"]["max_text"]) == ("", "b") and rows["s"]["min_number"] is None
    assert rows["d"]["min_time"].year == 2023 and rows["f"]["max_number"] == 1.0 and rows["s"]["approximate_distinct"] == 3
    keys = quality.profile_keys(df, ["k"]).first()
    assert tuple(keys) == (4, 3, 1, 1, 1)
    empty = df.limit(0)
    assert quality.profile_columns(empty).where("row_count = 0 and min_number is null").count() == 4
    assert tuple(quality.profile_keys(empty, "k").first()) == (0, 0, 0, 0, 0)


def test_snapshot_gate_and_offers(spark):
    good = '{"metadata": {"fetched_at": "t", "sport_key": "s"}, "events": [{"id": "e", "bookmakers": [{"key": "b", "markets": [{"key": "m", "outcomes": [{"name": "n", "price": -110}]}]}]}, {"id": "x", "bookmakers": []}, {}]}'
    bodies = {
        1: good, 2: None, 3: "{", 4: "3", 5: '{"events": []}', 6: '{"metadata": {}, "events": 1}', 7: '{"metadata": {"sport_key": "s"}, "events": []}',
        8: '{"metadata": {"fetched_at": 5, "sport_key": "s"}, "events": []}', 9: '{"metadata": {"fetched_at": "t"}, "events": []}', 10: "",
    }
    df = scans.gate_snapshots(spark.createDataFrame(list(bodies.items()), "id long, body string"))
    assert {r["id"]: r["reason"] for r in df.collect()} == {
        1: None, 2: "no text", 3: "invalid JSON", 4: "not an object", 5: "metadata missing", 6: "events missing", 7: "fetched_at missing",
        8: "fetched_at missing", 9: "sport_key missing", 10: "invalid JSON",
    }
    offers = [tuple(r) for r in scans.snapshot_offers(df, ["id"]).collect()]
    assert offers == [(1, "e", "b", "m", "n", -110.0, None)]


def test_bootstrap_does_not_depend_on_partitioning(spark):
    rows = [("g" if i % 3 else None, i, (i * 37 % 101) / 7.0) for i in range(300)]
    df = spark.createDataFrame([*rows, ("g", 999, None)], "g string, id long, x double")
    one = {tuple(r) for r in bootstrap.bootstrap_mean(df.repartition(1), "g", "x", "id", 400).collect()}
    two = {tuple(r) for r in bootstrap.bootstrap_mean(df.repartition(7), "g", "x", "id", 400).collect()}
    assert one == two and {r[0] for r in one} == {"g", None}
    for group, n, mean, low, high in one:
        mine = [r[2] for r in rows if r[0] == group]
        sd = (sum((v - sum(mine) / len(mine)) ** 2 for v in mine) / len(mine)) ** 0.5
        half = 1.96 * sd / len(mine) ** 0.5
        assert n == len(mine) and mean == pytest.approx(sum(mine) / len(mine))
        assert low == pytest.approx(mean - half, abs=0.25 * half) and high == pytest.approx(mean + half, abs=0.25 * half)
    assert bootstrap.bootstrap_mean(df.limit(0), [], "x", "id", 50).count() == 0
