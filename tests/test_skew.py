"""Hot keys take another path; the results must not change.

One key owns about a third of all rows.  Every operator is run with the
threshold so low that this key is split, and compared with the ordinary plan
and with a brute-force answer.
"""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import asof, joins, quantiles, skew, windows


def make_rows(n=400, seed=3):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.35 else rng.choice(["a", "b", "c", None])
        ts = start + timedelta(days=rng.randint(0, 9), minutes=30 * rng.randint(0, 6))
        rows.append((key, i, ts, rng.randint(-50, 50)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, ts timestamp_ntz, x long").repartition(5).cache()


@pytest.fixture(autouse=True)
def many_pieces(monkeypatch):
    """Hot keys are cut into many small pieces."""
    monkeypatch.setattr(skew, "PIECE_ROWS", 13)


def same(a, b):
    cols = sorted(a.columns)
    left = sorted(map(str, (tuple(r) for r in a.select(*cols).collect())))
    right = sorted(map(str, (tuple(r) for r in b.select(*cols).collect())))
    assert left == right and left


def test_hot_keys_are_found_and_bounded(frame):
    found = skew.hot_keys(frame, "k", 50).collect()
    assert found[0][0] == "hot"
    assert skew.hot_keys(frame, "k", 10_000) is None


def test_split_keeps_every_row(frame):
    cold, hot = skew.split_hot(frame, "k", 50)
    assert hot.count() > 50 and cold.count() + hot.count() == frame.count()
    assert cold.where("k = 'hot'").isEmpty()


def test_null_key_can_be_hot(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [("a", 1)], "k string, x long")
    cold, hot = skew.split_hot(df, "k", 10)
    assert hot.count() == 30 and cold.count() == 1
    out = skew.attach_totals(df, "k", 10, n=F.count(F.lit(1)))
    assert {(r["k"], r["n"]) for r in out.collect()} == {(None, 30), ("a", 1)}


def test_attach_totals(frame):
    same(skew.attach_totals(frame, "k", 50, s=F.sum("x"), n=F.count(F.lit(1))), skew.attach_totals(frame, "k", 10**9, s=F.sum("x"), n=F.count(F.lit(1))))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_lookup(spark, frame, how):
    right = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, v long")
    same(skew.join_lookup(frame, right, "k", how, hot_rows=50), frame.join(right, "k", how))


def test_ordered_rank(frame, rows):
    got = {r["id"]: r["p"] for r in skew.ordered_rank(frame, "k", [F.col("ts"), F.col("id")], "p").collect()}
    for key in ("hot", "a", None):
        mine = sorted((r[2], r[1]) for r in rows if r[0] == key)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("chunk", [7, 20, 1000])
def test_rolling_prior(frame, chunk):
    run = lambda hot: windows.rolling_prior(frame, "k", ["ts", "id"], ["x"], [3, 7], hot_rows=hot, chunk_rows=chunk)
    same(run(20), run(10**9))


def test_rolling_prior_by_hand(frame, rows):
    got = {r["id"]: r for r in windows.rolling_prior(frame, "k", ["ts", "id"], ["x"], [3], hot_rows=20, chunk_rows=10).collect()}
    mine = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[2], r[1]))
    for i, r in enumerate(mine):
        past = [q[3] for q in mine[max(0, i - 3):i]]
        row = got[r[1]]
        assert row["games_before"] == i and row["games_last_3"] == len(past)
        assert row["x_last_3"] == (pytest.approx(sum(past) / len(past)) if past else None)


def test_running_history(frame):
    run = lambda hot: windows.running_history(frame, "k", ["ts", "id"], "ts", "x", 4, hot_rows=hot, chunk_rows=9)
    same(run(20), run(10**9))


@pytest.mark.parametrize("hot", [20, 10**9])
def test_max_drawdown(frame, rows, hot):
    got = {r["k"]: r for r in windows.max_drawdown(frame, "k", ["ts", "id"], "x", hot_rows=hot).collect()}
    for key in ("hot", "a", "b", "c", None):
        run, peak, worst = 0, 0, 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            run += r[3]
            worst, peak = max(worst, peak - run), max(peak, run)
        assert got[key]["max_drawdown"] == worst and got[key]["total"] == run


def sides(frame):
    left = frame.where("id % 2 = 0").select("k", "id", "ts", "x")
    right = frame.where("id % 2 = 1").select("k", F.col("id").alias("rid"), F.col("ts").alias("rts"))
    return left, right


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("hot", [20, 10**9])
def test_asof_join(frame, rows, strict, hot):
    left, right = sides(frame)
    got = {r["id"]: r["rid"] for r in asof.asof_join(left, right, "k", "ts", "rts", ["rid"], ["rid"], strict=strict, hot_rows=hot).collect()}
    for key, i, ts, _ in rows:
        if i % 2:
            continue
        past = [(r[2], r[1]) for r in rows if key is not None and r[0] == key and r[1] % 2 and (r[2] < ts or (not strict and r[2] == ts))]
        assert got[i] == (max(past)[1] if past else None)


@pytest.mark.parametrize("hot", [20, 10**9])
def test_latest_before(frame, rows, hot):
    left, right = sides(frame)
    left = left.withColumn("until", F.col("ts") + F.expr("INTERVAL 2 DAYS"))
    got = {r["id"]: r["rid"] for r in asof.latest_before(left, right, "k", "ts", "until", "rts", ["rid"], ["rid"], hot_rows=hot).collect()}
    for key, i, ts, _ in rows:
        if i % 2:
            continue
        past = [(r[2], r[1]) for r in rows if key is not None and r[0] == key and r[1] % 2 and ts < r[2] < ts + timedelta(days=2)]
        assert got[i] == (max(past)[1] if past else None)


def test_snapshot_asof(frame, rows):
    spine = frame.select("k", "id", F.to_date("ts").alias("day"))
    snaps = frame.select("k", F.to_date("ts").alias("sday"), F.col("id").alias("sid"))
    run = lambda hot: asof.snapshot_asof(spine, snaps, "k", "day", "sday", strict=True, hot_rows=hot)
    same(run(3), run(10**9))


def test_trailing_n_by_hand(frame, rows):
    history = frame.select("k", F.to_date("ts").alias("day"), "ts", "id", "x")
    targets = history.select("k", "day").distinct()
    got = {(r["k"], r["day"]): r for r in asof.trailing_n(targets, history, "day", ["ts", "id"], "x", [3, 5], by="k").where("k IS NOT NULL").collect()}
    for (key, day), row in got.items():
        past = [r[3] for r in sorted((r for r in rows if r[0] == key and r[2].date() < day), key=lambda r: (r[2], r[1]))]
        for n in (3, 5):
            tail = past[-n:]
            assert row[f"count_last_{n}"] == len(tail)
            assert row[f"mean_last_{n}"] == (pytest.approx(np.mean(tail)) if tail else None)
            assert row[f"sd_last_{n}"] == (pytest.approx(np.std(tail, ddof=1)) if len(tail) > 1 else None)


def test_trailing_n_for_days_without_events(spark):
    history = spark.createDataFrame([(date(2024, 1, d), d, float(d)) for d in (1, 2, 3)], "day date, id long, x double")
    targets = spark.createDataFrame([(date(2024, 1, 10),), (date(2024, 1, 1),)], "day date")
    got = {r["day"].day: r for r in asof.trailing_n(targets, history, "day", ["id"], "x", [2]).collect()}
    assert got[10]["mean_last_2"] == 2.5 and got[1]["count_last_2"] == 0


@pytest.mark.parametrize("distributed", [True, False])
def test_exact_quantiles(frame, rows, distributed):
    qs = {"p05": 0.05, "p50": 0.5, "p90": 0.9}
    for row in quantiles.exact_quantiles(frame, "k", "x", qs, distributed=distributed).collect():
        values = [r[3] for r in rows if r[0] == row["k"]]
        for name, q in qs.items():
            assert row[name] == pytest.approx(np.quantile(values, q))


@pytest.mark.parametrize("distributed", [True, False])
def test_global_rank(frame, rows, distributed):
    ranked = windows.global_rank(frame, "x", "a", distributed=distributed)
    got = {r["id"]: (r["a"], r["b"]) for r in windows.global_rank(ranked, "x", "b", ties=["id"], distributed=distributed).collect()}
    ordered = sorted(rows, key=lambda r: (-r[3], r[1]))
    for place, r in enumerate(ordered, start=1):
        assert got[r[1]] == (1 + sum(q[3] > r[3] for q in rows), place)


@pytest.mark.parametrize("small", [0, skew.SMALL_BYTES])
def test_sample_rank(frame, rows, monkeypatch, small):
    monkeypatch.setattr(skew, "SMALL_BYTES", small)
    offers = frame.where("id % 3 = 0").select("k", "id", (F.col("x") + F.lit(0.5) * (F.col("id") % 2)).alias("t"))
    got = {r["id"]: r for r in joins.empirical_probability(offers, frame.select("k", F.col("x").cast("double").alias("r")), "k", "t", "r").where("k IS NOT NULL").collect()}
    for i, row in got.items():
        sample = np.array([r[3] for r in rows if r[0] == row["k"]])
        assert row["share_above"] == pytest.approx((sample > row["t"]).mean())
        assert row["share_equal"] == pytest.approx((sample == row["t"]).mean())
        assert row["sample_size"] == len(sample)


def test_order_and_partitions_do_not_matter(frame):
    run = lambda df: windows.rolling_prior(df, "k", ["ts", "id"], ["x"], [4], hot_rows=30, chunk_rows=11)
    same(run(frame.repartition(1).orderBy("x")), run(frame.repartition(9)))


def test_mirror_and_checked_joins(spark):
    df = spark.createDataFrame([(1, "a", "b", 5), (1, "b", "a", 7), (2, "a", "c", 1)], "g long, t string, o string, x long")
    got = {(r["g"], r["t"]): r["y"] for r in joins.mirror_join(df, "g", "t", "o", {"x": "y"}).collect()}
    assert got == {(1, "a"): 7, (1, "b"): 5, (2, "a"): None}
    with pytest.raises(Exception, match="more than two sides"):
        joins.mirror_join(df.unionByName(df), "g", "t", "o", {"x": "y"}).collect()
    dims = spark.createDataFrame([("a", 1), ("a", 2)], "t string, d long")
    with pytest.raises(Exception, match="not unique on t"):
        joins.join_checked(df, dims, "t").collect()
    one = spark.createDataFrame([("a", 1)], "t string, d long")
    assert joins.join_checked(df, one, "t").count() == 2
    assert joins.join_checked(df, one, "t", how="left").count() == 3
    with pytest.raises(Exception, match="left side"):
        joins.join_checked(df, one, "t", "1:1").collect()


def test_join_either_pairs_once(spark):
    left = spark.createDataFrame([(1, "a", "b"), (2, "a", None), (3, None, None)], "i long, p string, q string")
    right = spark.createDataFrame([("x", "a", "b"), ("y", "c", "a")], "n string, u string, v string")
    got = sorted((r["i"], r["n"]) for r in joins.join_either(left, ["p", "q"], right, ["u", "v"]).collect())
    assert got == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]


def test_one_moment_can_be_cut(spark):
    """A third of all rows at one time of one key still spreads over pieces."""
    moment = datetime(2024, 1, 1)
    rows = [("hot", moment, i) for i in range(120)] + [("hot", moment + timedelta(days=i), 1000 + i) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long")
    pieces = skew.cut_in_order(df, ["k"], [F.col("ts"), F.col("id")])
    sizes = [r["count"] for r in pieces.groupBy("__piece").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 60
    left = df.select("k", "id", "ts")
    right = df.where("id % 2 = 0").select("k", F.col("id").alias("rid"), F.col("ts").alias("rts"))
    for strict in (True, False):
        same(*[asof.asof_join(left, right, "k", "ts", "rts", ["rid"], ["rid"], strict=strict, hot_rows=hot) for hot in (10, 10**9)])


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_lookup_reads_its_left_side_once(spark, folder, how):
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}" if i % 3 == 1 else None, i) for i in range(600)]
    spark.createDataFrame(rows, "k string, x long").write.parquet(f"{folder}/left")
    left = spark.read.parquet(f"{folder}/left")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, v long")
    out = left
    for n in range(3):
        out = skew.join_lookup(out, right.withColumnRenamed("v", f"v{n}"), "k", how, hot_rows=50)
    text = out._jdf.queryExecution().sparkPlan().toString()
    assert text.count("FileScan") == 1
    same(out.select("k", "x", "v0"), left.join(right.withColumnRenamed("v", "v0"), "k", how).select("k", "x", "v0"))


def test_checked_join_raises_and_keeps_nulls(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (3, 30), (None, 1), (None, 2)], "k int, y int")
    got = joins.join_checked(left, right, "k", "m:1", "left", hot_rows=1)
    same(got, spark.createDataFrame([(1, "a", 10), (1, "b", 10), (2, "c", None), (None, "d", None)], "k int, x string, y int"))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="right side is not unique on k: 2"):
        joins.join_checked(left, right.union(right.where("k = 1")), "k").collect()
    with pytest.raises(Exception, match="left side is not unique on k: 2"):
        joins.join_checked(left, right, "k", "1:1").collect()
    one = joins.join_checked(left.where("x <> 'a'"), right, "k", "1:1", "left")
    same(one, spark.createDataFrame([(1, "b", 10), (2, "c", None), (None, "d", None)], "k int, x string, y int"))


def test_join_either_spreads_a_hot_key(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"a{i}", f"b{i % 7}" if i % 3 else None) for i in range(200)], "i int, p string, q string")
    right = spark.createDataFrame([(j, "hot" if j < 5 else f"a{j}", f"b{j % 9}") for j in range(40)], "j int, r string, s string")
    plain = joins.join_either(left, ["p", "q"], right, ["r", "s"], hot_rows=None)
    spread = joins.join_either(left, ["p", "q"], right, ["r", "s"], hot_rows=20)
    same(plain, spread)
    keyed = left.withColumn("__key", F.lit("hot")).where("p = 'hot'")
    salts = skew.salted_keys(keyed.select("__key"), "__key", 20)
    sizes = [r["count"] for r in skew.salted(keyed, salts, "__key").groupBy("__key", "__salt").count().collect()]
    assert len(sizes) == 5 and max(sizes) <= 40
