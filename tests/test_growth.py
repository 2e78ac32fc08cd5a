"""Plans and rows of the steps that must not grow faster than their input."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import asof, joins, learn, skew
from fieldglass.plans import contract_learn, contract_pipelines, market_history, odds
from fieldglass.sources import scans

DAY = dt.datetime(1995, 3, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def t(spark):
    orders = spark.createDataFrame([(k, k * 7, DAY + dt.timedelta(days=k)) for k in range(6)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    lines = spark.createDataFrame(
        [(k, k, k % 3, n, float(5 * n + k), 0.05, 0.02 * n, "RAN"[(k + n) % 3], "OF"[n % 2]) for k in range(6) for n in range(1, 5)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
    )
    return SimpleNamespace(spark=spark, orders=orders, lineitem=lines)


def test_offers_never_meet_by_snapshot_alone(spark, t):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(odds.processed_odds(*contract_pipelines.odds_tables(t)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    top = next(line for line in text.splitlines() if "SortMergeJoin" in line)
    assert "event_id" in top


def test_rank_in_sample_sorts_edges_not_rows(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, float(i % 4) if i % 5 else None, float(i % 3) - 0.5) for i in range(40)]
    sample = [("a", float(v)) for v in (0, 1, 1, 2, 3)] + [("b", 1.5), ("c", 0.0)]
    out = joins.rank_in_sample(
        spark.createDataFrame(rows, "id long, g string, x double, y double"), spark.createDataFrame(sample, "g string, r double"), "g", "r", ["x", "y"]
    )
    assert "Window" not in plan(out)
    got = {r["id"]: tuple(r)[4:] for r in out.select("id", "g", "x", "y", "x_lt", "x_le", "y_lt", "y_le", "sample_size").collect()}
    assert len(got) == len(rows)
    for i, g, x, y in rows:
        mine = [v for k, v in sample if k == g]
        below = [0 if e is None else sum(v < e or (equal and v == e) for v in mine) for e in (x, y) for equal in (False, True)]
        assert got[i] == (*below, len(mine) or None)


def test_texts_of_labelled_documents_are_read_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    documents = spark.createDataFrame([(i, f"a1 b22 {i}", "en", f"s{i % 3}", 8) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    rows = contract_learn._labelled(SimpleNamespace(spark=spark, documents=documents, labels=labels))
    assert "regexp" not in plan(rows)
    assert rows.where("doc_id = 4").first()["digit_share"] == 4 / 8


def test_newton_sums_are_those_of_each_model(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = (rng.random(60) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    rows = [(int(i % 3), float(v), float(a), None if i % 9 == 0 else float(b)) for i, (v, (a, b)) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "p long, y double, a double, b double")
    fits = learn.fit_logistic(df, "p", [1, 2], [learn.Candidate("one", ("a",)), learn.Candidate("two", ("a", "b"))], [0.1, 10.0], "y")
    assert len(fits) == 8
    for f in fits:
        used = [r for r in rows if r[0] < f.fold]
        raw = np.array([[r[2 + "ab".index(n)] if r[2 + "ab".index(n)] is not None else f.fill[k] for k, n in enumerate(f.features)] for r in used])
        z = (raw - np.array(f.means)) / np.array(f.sds)
        p = 1 / (1 + np.exp(-(f.intercept + z @ np.array(f.weights))))
        gap = p - np.array([r[1] for r in used])
        assert abs(f.setting * gap.sum()) < 1e-6
        assert np.allclose(f.setting * z.T @ gap + np.array(f.weights), 0, atol=1e-6)


def test_a_snapshot_text_is_parsed_once(spark):
    body = '{"metadata": {"fetched_at": "x", "sport_key": "y"}, "events": [{"id": 7, "bookmakers": [{"key": "k", "markets": [3, {"key": "m", "outcomes": [{"name": "n", "price": "no", "point": 1}, null]}]}]}, 5]}'
    out = scans.snapshot_offers(scans.gate_snapshots(spark.createDataFrame([(1, body), (2, "[]"), (3, None)], "id long, body string")), ["id"])
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("parse_json") + logical.count("parseJson") == 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "7", "k", "m", "n", None, 1.0), (1, "7", "k", "m", None, None, None)], key=str)


def test_a_large_ledger_is_written_before_its_passes(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    columns = "market_key string, edge_bucket string, season int, game_id string, result string, profit_per_unit double, edge double, clv_available boolean, clv_value double"
    ledger = spark.createDataFrame([("h2h", "LOW", 1, "a", "WIN", 0.9, 0.1, False, None), ("h2h", "LOW", 1, "b", "LOSS", -1.0, 0.2, True, 0.5)], columns)
    out = market_history.historical_summary(ledger)
    assert "/ledger-" in "".join(out.inputFiles())
    assert {(r["edge_bucket"], r["bet_count"], r["maximum_drawdown_units"]) for r in out.collect()} == {("LOW", 2, 1.0), ("ALL", 2, 1.0)}


def test_asof_carries_no_tie_twice(spark):
    left = spark.createDataFrame([(1, 5), (2, 5)], "k long, at long")
    right = spark.createDataFrame([(1, 3, "x"), (1, 3, "y"), (1, 5, "z")], "k long, ts long, tie string")
    out = asof.asof_join(left, right, "k", "at", "ts", ["tie"], ["ts", "tie"])
    assert "__payload" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 5, 3, "y"), (2, 5, None, None)]


def test_stored_plays_are_the_joined_lines(spark, t):
    stored, direct = contract_pipelines._plays(t, stored=True), contract_pipelines._plays(t)
    assert "/plays-" in "".join(stored.inputFiles())
    assert sorted(map(str, stored.collect())) == sorted(map(str, direct.collect()))
