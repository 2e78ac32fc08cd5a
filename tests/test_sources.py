"""Landed files, archive, audit, partitions and the streaming archive."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions import scalars
from fieldglass.operators.quality import QualityError
from fieldglass.sources import publish, scans
from fieldglass.streaming import archive as streaming


def test_parquet_files_are_unioned_by_name(spark, folder):
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(f"{folder}/season_2019")
    spark.createDataFrame([("b", 2, 3.0)], "y string, x int, z double").write.parquet(f"{folder}/season_2020")
    df = scans.with_source_file(scans.scan_parquet(spark, f"{folder}/season_2019", f"{folder}/season_2020"), r"season_(\d{4})", "season")
    got = sorted((r["x"], r["y"], r["z"], r["season"]) for r in df.collect())
    assert got == [(1, "a", None, 2019), (2, "b", 3.0, 2020)]


def test_csv_has_the_declared_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("team,rating\nARI,1510.5\nBUF,\n")
    schema = T.StructType([T.StructField("team", T.StringType()), T.StructField("rating", T.DoubleType())])
    assert [tuple(r) for r in scans.scan_csv(spark, str(path), schema).collect()] == [("ARI", 1510.5), ("BUF", None)]


def test_range_reads_prune_partitions(spark, folder):
    spark.createDataFrame([(s, s * 10) for s in range(2018, 2024)], "season int, x int").write.partitionBy("season").parquet(f"{folder}/t")
    df = scans.read_range(spark.read.parquet(f"{folder}/t"), "season", 2020, 2021)
    assert df.count() == 2
    assert "PartitionFilters: [isnotnull(season" in df._jdf.queryExecution().executedPlan().toString()


def test_optional_source_is_an_empty_typed_frame(spark, folder):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    empty = scans.optional_source(spark, publish.exists(spark, f"{folder}/none"), f"{folder}/none", schema)
    assert empty.count() == 0 and empty.schema == schema
    spark.createDataFrame([("7", "x", 1.0)], "a string, b string, c double").write.parquet(f"{folder}/some")
    assert [tuple(r) for r in scans.optional_source(spark, True, f"{folder}/some", schema).collect()] == [(7, "x")]


def test_conform_casts_leniently(spark):
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("missing", T.DoubleType())])
    df = spark.createDataFrame([("12", 1), ("x", 2)], "n string, extra int")
    assert [tuple(r) for r in scalars.conform_schema(df, schema).collect()] == [(12, None), (None, None)]


def test_numeric_rows_drop_or_fail(spark):
    df = spark.createDataFrame([("1", "2"), (None, "x"), ("3", "4")], "a string, b string")
    assert scalars.numeric_or_reject(df, ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="partly missing"):
        scalars.numeric_or_reject(spark.createDataFrame([("1", None)], "a string, b string"), ["a", "b"]).collect()


def test_replace_partition_is_idempotent(spark, folder):
    location = f"{folder}/t"
    day = spark.createDataFrame([("s1", 1), ("s1", 2)], "snapshot_id string, x int")
    publish.replace_partition(day, location, "snapshot_id")
    publish.replace_partition(spark.createDataFrame([("s2", 9)], "snapshot_id string, x int"), location, "snapshot_id")
    publish.replace_partition(day, location, "snapshot_id")
    got = sorted((r["snapshot_id"], r["x"]) for r in spark.read.parquet(location).collect())
    assert got == [("s1", 1), ("s1", 2), ("s2", 9)]


def test_archive_rejects_two_payloads_in_one_batch(spark, folder):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(QualityError, match="two payloads"):
        publish.archive_append(df, f"{folder}/a", ["k"], ["v"])


def test_archive_key_spells_out_nulls(spark):
    import hashlib

    df = spark.createDataFrame([("a", None)], "k string, p double")
    got = publish.archive_keys(df, ["k", "p"]).first()["archive_key"]
    assert got == hashlib.sha256(b"a|<NULL>").hexdigest()


def test_audit_keeps_the_latest_state(spark, folder):
    location = f"{folder}/audit"
    publish.audited(spark, location, "full", lambda: 5)

    def boom():
        raise RuntimeError("no odds")

    with pytest.raises(RuntimeError):
        publish.audited(spark, location, "full", boom)
    states = {r["status"]: r for r in publish.run_states(spark, location).collect()}
    assert set(states) == {"SUCCESS", "FAILED"}
    assert states["SUCCESS"]["archived_market_row_count"] == 5 and states["FAILED"]["error_message"] == "no odds"


def test_stream_archive_adds_each_row_once(spark, folder):
    landing, location, checkpoint = (f"{folder}/{n}" for n in ("landing", "archive", "checkpoint"))
    schema = "k string, v int, fetched_at timestamp"
    now = datetime(2025, 1, 1)

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)

    def run(where):
        stream = streaming.landed_files(spark, landing, schema, max_files=1)
        streaming.stream_archive(stream, location, where, ["k"], ["v"]).awaitTermination()

    land([("a", 1, now), ("b", 2, now)])
    run(checkpoint)
    land([("b", 2, now), ("c", 3, now)])
    run(checkpoint)
    assert sorted(r["k"] for r in spark.read.parquet(location).collect()) == ["a", "b", "c"]
    # A replay from the beginning (lost checkpoint) finds everything archived.
    run(checkpoint + "2")
    assert spark.read.parquet(location).count() == 3


def test_late_guard_drops_repeats(spark, folder):
    schema = "k string, ts timestamp"
    start = datetime(2025, 1, 1)
    rows = [("a", start), ("a", start + timedelta(minutes=1)), ("b", start)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in")
    stream = streaming.guard_late(streaming.landed_files(spark, f"{folder}/in", schema), "ts", "10 minutes", ["k"])
    q = stream.writeStream.format("memory").queryName("guarded").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["k"] for r in spark.table("guarded").collect()) == ["a", "b"]


def test_next_event_of_a_feed(spark):
    feed = spark.createDataFrame([("A", "out"), ("B", "ques"), ("Z", "out")], "team string, status string")
    sides = spark.createDataFrame(
        [("A", datetime(2025, 1, 5), "g2"), ("A", datetime(2025, 1, 1), "g1"), ("A", datetime(2024, 1, 1), "g0"), ("B", datetime(2025, 1, 2), "g3")],
        "team string, kickoff timestamp, game_id string",
    )
    got = scans.feed_to_next_event(feed, sides, "team", "kickoff", "game_id", F.lit(datetime(2024, 6, 1)), "status", {"out": "Out"})
    assert sorted((r["team"], r["status"], r["game_id"]) for r in got.collect()) == [("A", "Out", "g1"), ("B", None, "g3")]
