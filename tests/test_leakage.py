"""Point-in-time property: later rows never reach an earlier row's features.

A random table is built twice, with everything at or after a random moment
replaced; features of rows before that moment must be identical.
"""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldglass.operators import asof, windows

TYPES = "k string, day date, id long, x double"


@st.composite
def tables(draw):
    n = draw(st.integers(10, 40))
    rows = [
        (draw(st.sampled_from("ab")), date(2024, 1, 1) + timedelta(days=draw(st.integers(0, 12))), i, float(draw(st.integers(-9, 9))))
        for i in range(n)
    ]
    cut = date(2024, 1, 1) + timedelta(days=draw(st.integers(2, 11)))
    extra = draw(st.integers(0, 5))
    return rows, cut, extra


def changed(rows, cut, extra):
    out = [r if r[1] < cut else (r[0], r[1], r[2], r[3] * 1000 + 7) for r in rows]
    return out + [("a", cut, 1000 + i, 1e6) for i in range(extra)]


def rolling(df):
    return windows.rolling_prior(df, "k", ["day", "id"], ["x"], [3], hot_rows=5, chunk_rows=4)


def history(df):
    return windows.running_history(df, "k", ["day", "id"], "day", "x", 3)


def decayed(df):
    days = df.groupBy("k", "day").agg(F.sum("x").alias("x"))
    return windows.decayed_prior(days, "k", "day", 5.0, ["x"]).drop("x")


def joined(df):
    right = df.select("k", F.col("day").alias("rday"), F.col("id").alias("rid"), F.col("x").alias("rx"))
    return asof.asof_join(df.select("k", "day", "id"), right, "k", "day", "rday", ["rid"], ["rid", "rx"])


def snapshots(df):
    right = df.select("k", F.col("day").alias("sday"), F.col("x").alias("sx"))
    return asof.snapshot_asof(df.select("k", "day", "id"), right, "k", "day", "sday", strict=True)


def trailing(df):
    return asof.trailing_n(df.select("day").distinct(), df, "day", ["id"], "x", [4])


@pytest.mark.parametrize("feature", [rolling, history, decayed, joined, snapshots, trailing])
@given(case=tables())
@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
def test_no_leakage(spark, feature, case):
    rows, cut, extra = case
    before, after = (feature(spark.createDataFrame(r, TYPES)).where(F.col("day") < F.lit(cut)) for r in (rows, changed(rows, cut, extra)))
    cols = sorted(before.columns)
    left, right = (sorted(map(str, map(tuple, df.select(*cols).collect()))) for df in (before, after))
    assert left == right
