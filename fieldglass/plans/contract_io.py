"""Contract queries over sources, archives, streams, profiles and training frames."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import quality, ratings, topk, training
from fieldglass.plans.registry import query, rounded
from fieldglass.session import shared_folder
from fieldglass.sources import publish, scans
from fieldglass.streaming import archive


def _scratch(t, label: str) -> str:
    return f"{shared_folder(t.spark)}/{label}-{uuid.uuid4().hex}"


# -- profiles --------------------------------------------------------------------------------

@query("profile_columns", """
WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderdate, o_totalprice > 30000 AS is_large FROM orders)
SELECT 'o_orderkey' AS column_name, 'bigint' AS data_type, count(*) AS row_count, count(*) - count(o_orderkey) AS null_count, CAST(min(o_orderkey) AS DOUBLE) AS min_number, CAST(max(o_orderkey) AS DOUBLE) AS max_number,
  CAST(NULL AS TIMESTAMP) AS min_time, CAST(NULL AS TIMESTAMP) AS max_time, CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text FROM o
UNION ALL SELECT 'o_orderstatus', 'string', count(*), count(*) - count(o_orderstatus), NULL, NULL, NULL, NULL, min(o_orderstatus), max(o_orderstatus) FROM o
UNION ALL SELECT 'o_totalprice', 'double', count(*), count(*) - count(o_totalprice), min(o_totalprice), max(o_totalprice), NULL, NULL, NULL, NULL FROM o
UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(*), count(*) - count(o_orderdate), NULL, NULL, min(o_orderdate), max(o_orderdate), NULL, NULL FROM o
UNION ALL SELECT 'is_large', 'boolean', count(*), count(*) - count(is_large), CAST(min(CAST(is_large AS INTEGER)) AS DOUBLE), CAST(max(CAST(is_large AS INTEGER)) AS DOUBLE), NULL, NULL, NULL, NULL FROM o
""")
def profile_columns(t):
    rows = t.orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice", "o_orderdate",
        (F.col("o_totalprice") > 30000).alias("is_large"),
    )
    return quality.profile_columns(rows).drop("approximate_distinct")


@query("profile_keys", """
WITH k AS (SELECT l_orderkey, nullif(l_suppkey % 7, 0) AS part, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS key_count, count(*) FILTER (WHERE n > 1) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
  CAST(coalesce(sum(n) FILTER (WHERE part IS NULL), 0) AS BIGINT) AS null_key_rows FROM k
""")
def profile_keys(t):
    return quality.profile_keys(t.lineitem.withColumn("part", F.nullif(F.col("l_suppkey") % 7, F.lit(0))), ["l_orderkey", "part"])


# -- snapshots -------------------------------------------------------------------------------

#: A snapshot text for every order, one kind of damage per remainder of its key.
_BODY = """CASE o_orderkey % 8
  WHEN 0 THEN '{"metadata": {"fetched_at": "t' || o_orderkey || '", "sport_key": "s"}, "events": [{"id": "e' || o_custkey || '", "bookmakers": [{"key": "b", "markets": [{"key": "h2h", "outcomes": [{"name": "home", "price": ' || o_custkey || '}, {"name": "away", "price": 2, "point": 1.5}]}]}]}, {"id": "none"}]}'
  WHEN 1 THEN '{"metadata": {"fetched_at": "t", "sport_key": "s"}, "events": [' WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{"metadata": "x", "events": []}'
  WHEN 4 THEN '{"metadata": {"fetched_at": "t", "sport_key": "s"}, "events": {}}' WHEN 5 THEN '{"metadata": {"sport_key": "s"}, "events": []}'
  WHEN 6 THEN '{"metadata": {"fetched_at": "t", "sport_key": null}, "events": []}' END"""
_REASON = """CASE WHEN body IS NULL THEN 'no text' WHEN NOT json_valid(body) THEN 'invalid JSON' WHEN json_type(body) <> 'OBJECT' THEN 'not an object'
  WHEN coalesce(json_type(body, '$.metadata'), '') <> 'OBJECT' THEN 'metadata missing' WHEN coalesce(json_type(body, '$.events'), '') <> 'ARRAY' THEN 'events missing'
  WHEN coalesce(json_type(body, '$.metadata.fetched_at'), '') <> 'VARCHAR' THEN 'fetched_at missing' WHEN coalesce(json_type(body, '$.metadata.sport_key'), '') <> 'VARCHAR' THEN 'sport_key missing' END"""


def _gated(t):
    return scans.gate_snapshots(t.orders.select("o_orderkey", F.expr(_BODY).alias("body")))


@query("snapshot_rejects", f"""
WITH s AS (SELECT o_orderkey, {_BODY} AS body FROM orders)
SELECT * FROM (SELECT o_orderkey, {_REASON} AS reason FROM s) WHERE reason IS NOT NULL
""")
def snapshot_rejects(t):
    return _gated(t).where("reason is not null").select("o_orderkey", "reason")


@query("snapshot_offers", """
SELECT o_orderkey, 'e' || o_custkey AS event_id, 'b' AS bookmaker_key, 'h2h' AS market_key, outcome_name,
  CASE outcome_name WHEN 'home' THEN CAST(o_custkey AS DOUBLE) ELSE 2.0::DOUBLE END AS price, CASE outcome_name WHEN 'away' THEN 1.5::DOUBLE END AS point
FROM orders, (SELECT unnest(['home', 'away']) AS outcome_name) WHERE o_orderkey % 8 = 0
""")
def snapshot_offers(t):
    return scans.snapshot_offers(_gated(t), ["o_orderkey"])


# -- training frames -------------------------------------------------------------------------

@query("training_frame", """
WITH d AS (SELECT l_orderkey, count(*) AS line_count, round(sum(l_quantity), 2) AS quantity, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS target FROM lineitem GROUP BY l_orderkey),
e AS (SELECT o_orderkey AS l_orderkey, round(o_totalprice, 2) AS rating FROM orders WHERE o_orderkey % 3 <> 0)
SELECT d.l_orderkey, line_count, quantity, o_orderstatus, target, rating FROM d JOIN orders ON o_orderkey = d.l_orderkey LEFT JOIN e ON e.l_orderkey = d.l_orderkey
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 20000
""")
def training_frame(t):
    dataset = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("line_count"), rounded(F.sum("l_quantity"), 2).alias("quantity"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("target"),
    )
    splits = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", (F.col("o_totalprice") > 20000).alias("eligible"))
    ratings = t.orders.where(F.col("o_orderkey") % 3 != 0).select(F.col("o_orderkey").alias("l_orderkey"), rounded("o_totalprice", 2).alias("rating"))
    return training.training_frame(
        dataset, splits, "l_orderkey", "target", ["line_count", "quantity"], split="o_orderstatus", development=("F", "O"),
        holdout=("P",), eligible="eligible", extra=ratings, extra_columns=["rating"],
    )


# -- archives and streams --------------------------------------------------------------------

_KEYS = ("event_id", "user_id")
_ARCHIVED = """
SELECT event_id, user_id, event_type, round(value, 6) AS value, sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR))) AS archive_key FROM events
"""


def _archived(t, location: str):
    rows = t.spark.read.parquet(location)
    return rows.select("event_id", "user_id", "event_type", rounded("value").alias("value"), "archive_key")


@query("stream_archive", _ARCHIVED)
def stream_archive(t):
    """Two runs over one checkpoint; the second finds nothing new."""
    events = t.events
    location, checkpoint = _scratch(t, "stream-archive"), _scratch(t, "stream-checkpoint")
    for _ in range(2):
        stream = archive.landed_files(t.spark, f"{t.sf_dir}/events.parquet*", events.schema)
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
        stream = archive.guard_late(stream, "ts", "2 days", list(_KEYS))
        archive.stream_archive(stream, location, checkpoint, _KEYS, ["event_type", "value"]).awaitTermination()
    return _archived(t, location)


@query("archive_append", _ARCHIVED)
def archive_append(t):
    """Three batches that overlap; known rows are not written again."""
    location = _scratch(t, "archive")
    for batch in ("event_id % 3 <> 0", "event_id % 3 <> 1", "event_id is not null"):
        publish.archive_append(t.events.where(batch), location, _KEYS, ["event_type", "value"])
    return _archived(t, location)


# -- sources and publishing ------------------------------------------------------------------

@query("scan_merged", """
SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region_key, CAST(NULL AS DOUBLE) AS balance, 1 AS part FROM nation
UNION ALL SELECT CAST(s_suppkey AS INTEGER), s_name, NULL, round(s_acctbal, 2), 2 FROM supplier
""")
def scan_merged(t):
    """Files of differing columns read as one table, with the number in the folder's name."""
    root = _scratch(t, "merged")
    t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_key")).write.parquet(f"{root}/batch_1")
    t.supplier.select(F.col("s_suppkey").cast("int").alias("key"), F.col("s_name").alias("name"), rounded("s_acctbal", 2).alias("balance")).write.parquet(f"{root}/batch_2")
    rows = scans.with_source_file(scans.scan_parquet(t.spark, f"{root}/batch_1", f"{root}/batch_2"), r"batch_([0-9]+)/", "part")
    return rows.select("key", "name", "region_key", "balance", "part")


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def scan_csv(t):
    """A CSV written and read back with a declared schema; nulls stay nulls."""
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", rounded("c_acctbal", 2).alias("c_acctbal"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    location = _scratch(t, "csv")
    rows.write.option("header", True).csv(location)
    return scans.scan_csv(t.spark, location, rows.schema)


@query("read_range", "SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS order_count, max(o_orderkey) AS last_order FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1")
def read_range(t):
    """A range of partitions of a partitioned table."""
    location = _scratch(t, "years")
    t.orders.select("o_orderkey", F.year("o_orderdate").alias("order_year")).write.partitionBy("order_year").parquet(location)
    rows = scans.read_range(t.spark.read.parquet(location), "order_year", 1996, 1998)
    return rows.groupBy("order_year").agg(F.count(F.lit(1)).alias("order_count"), F.max("o_orderkey").alias("last_order"))


def _priced_parts(t):
    return t.part.select("p_partkey", "p_brand", rounded("p_retailprice", 2).alias("price"))


@query("publish_table", "SELECT p_partkey, p_brand, round(p_retailprice, 2) AS price FROM part WHERE p_size > 10")
def publish_table(t):
    """A failed check leaves the version before it current."""
    root = _scratch(t, "published")
    good = _priced_parts(t).join(t.part.where("p_size > 10").select("p_partkey"), "p_partkey", "left_semi")
    rules = quality.Rules(columns=["p_partkey", "price"], rows={"negative_price": F.col("price") < 0}, key=["p_partkey"])
    publish.publish(_priced_parts(t), root, "parts", rules)
    publish.publish(good, root, "parts", rules)
    for bad in (good.unionByName(good), good.withColumn("price", F.lit(-1.0)), good.limit(0)):
        try:
            publish.publish(bad, root, "parts", rules)
        except quality.QualityError:
            continue
        raise AssertionError("a broken table was published")
    return publish.read_table(t.spark, root, "parts")


@query("replace_partition", """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS load_number FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey % 2 = 0
""")
def replace_partition(t):
    """A reload rewrites only the partitions it holds; doing it twice changes nothing."""
    location = _scratch(t, "partitions")
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    publish.replace_partition(rows.withColumn("load_number", F.lit(1)), location, "o_orderstatus")
    again = rows.where("o_orderstatus = 'O' and o_orderkey % 2 = 0").withColumn("load_number", F.lit(2))
    for _ in range(2):
        publish.replace_partition(again, location, "o_orderstatus")
    return t.spark.read.schema("o_orderkey bigint, load_number int, o_orderstatus string").parquet(location)


@query("export_tables", """
SELECT 'nation' AS table_name, count(*) AS row_count, CAST(sum(n_nationkey) AS BIGINT) AS key_sum FROM nation
UNION ALL SELECT 'part', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part
""")
def export_tables(t):
    """Published tables copied with equal row counts."""
    root, dest = _scratch(t, "source"), _scratch(t, "export")
    publish.publish(t.nation.select(F.col("n_nationkey").cast("long").alias("key")), root, "nation")
    publish.publish(t.part.select(F.col("p_partkey").alias("key")), root, "part")
    publish.export_tables(t.spark, root, ["nation", "part"], dest)
    copies = [t.spark.read.parquet(f"{dest}/{name}").select(F.lit(name).alias("table_name"), "key") for name in ("nation", "part")]
    return copies[0].unionByName(copies[1]).groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"), F.sum("key").alias("key_sum"))


@query("run_audit", """
SELECT 'refresh' AS mode, 'SUCCESS' AS status, count(*) AS archived_rows, CAST(NULL AS VARCHAR) AS error_message FROM orders
UNION ALL SELECT 'broken', 'FAILED', NULL, 'no ' || count(*) FROM nation
""")
def run_audit(t):
    """A finished row for a run that works and for one that fails."""
    location = _scratch(t, "audit")
    nations = t.nation.count()

    def broken() -> int:
        raise ValueError(f"no {nations}")

    publish.audited(t.spark, location, "refresh", lambda: t.orders.count())
    try:
        publish.audited(t.spark, location, "broken", broken)
    except ValueError:
        pass
    rows = publish.run_states(t.spark, location)
    return rows.select("mode", "status", F.col("archived_market_row_count").alias("archived_rows"), "error_message")


@query("table_health", """
SELECT 'events' AS table_name, true AS is_present, max(ts) AS newest, count(*) AS row_count FROM events UNION ALL
SELECT 'nation', true, NULL, count(*) FROM nation UNION ALL SELECT 'absent', false, NULL, 0
""")
def table_health(t):
    """Presence, newest time and rows of required tables."""
    root = _scratch(t, "health")
    publish.publish(t.events.select("event_id", "ts"), root, "events")
    publish.publish(t.nation.select("n_nationkey"), root, "nation")
    rows = publish.health(t.spark, root, {"events": "ts", "nation": None, "absent": "ts"})
    return rows.withColumn("newest", F.col("newest").cast("timestamp_ntz"))


@query("phase_and_edge", """
SELECT o_orderkey, CASE WHEN w <= 6 THEN 'early' WHEN w <= 12 THEN 'middle' WHEN w <= 18 THEN 'late' ELSE 'postseason' END AS phase,
  CASE WHEN d < 0.025 THEN 'toss_up' WHEN d < 0.075 THEN 'slight_edge' WHEN d < 0.15 THEN 'clear_edge' ELSE 'strong_edge' END AS edge
FROM (SELECT o_orderkey, o_orderkey % 23 AS w, abs((o_custkey % 97) / 100.0::DOUBLE - 0.5) AS d FROM orders)
""")
def phase_and_edge(t):
    """Season phases and edge wordings."""
    return t.orders.select(
        "o_orderkey", scalars.season_phase(F.col("o_orderkey") % 23).alias("phase"),
        scalars.edge_strength((F.col("o_custkey") % 97) / 100.0).alias("edge"),
    )


@query("forecast_events", """
WITH c AS (
  SELECT c_custkey AS id, 1400 + c_custkey % 211 AS rating, 1995 + c_custkey % 4 AS last_season FROM customer WHERE c_custkey % 5 <> 0
), u AS (SELECT o_orderkey, year(o_orderdate) AS season, o_custkey AS home, o_orderkey % (SELECT max(c_custkey) FROM customer) + 1 AS away, o_orderkey % 6 = 0 AS neutral FROM orders
), r AS (
  SELECT u.*, CASE WHEN h.id IS NULL THEN 1500.0::DOUBLE ELSE 1500 + (h.rating - 1500) * pow(0.6, greatest(season - h.last_season, 0)) END AS hr,
    CASE WHEN a.id IS NULL THEN 1500.0::DOUBLE ELSE 1500 + (a.rating - 1500) * pow(0.6, greatest(season - a.last_season, 0)) END AS ar
  FROM u LEFT JOIN c h ON h.id = home LEFT JOIN c a ON a.id = away
)
SELECT o_orderkey, round(hr, 6) AS home_rating, round(ar, 6) AS away_rating, round(1 / (1 + pow(10, (ar - hr - CASE WHEN neutral THEN 0 ELSE 48 END) / 400)), 6) AS home_win_probability FROM r
""")
def forecast_events(t):
    """Probabilities of events between customers, whose ratings fade once per season since they last played."""
    last = t.customer.agg(F.max("c_custkey")).scalar()
    current = t.customer.where("c_custkey % 5 <> 0").select(
        F.col("c_custkey").alias("entity"), (1400 + F.col("c_custkey") % 211).cast("double").alias("rating"), (1995 + F.col("c_custkey") % 4).alias("last_season"),
    )
    upcoming = t.orders.select(
        "o_orderkey", F.year("o_orderdate").cast("long").alias("season"), F.col("o_custkey").alias("home_team"),
        (F.col("o_orderkey") % last + 1).alias("away_team"), (F.col("o_orderkey") % 6 == 0).alias("is_neutral"),
    )
    out = ratings.forecast_events(upcoming, current, "season", cfg=ratings.RatingConfig(advantage=48.0))
    return out.select("o_orderkey", *[rounded(c).alias(c) for c in ("home_rating", "away_rating", "home_win_probability")])


@query("board_order", """
SELECT l_returnflag, l_linestatus, quantity, row_number() OVER (ORDER BY quantity DESC NULLS LAST, l_returnflag NULLS LAST, l_linestatus NULLS LAST) AS position
FROM (SELECT nullif(l_returnflag, 'A') AS l_returnflag, l_linestatus, nullif(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), 0) AS quantity FROM lineitem GROUP BY ALL)
""")
def board_order(t):
    """A board in mixed order with nulls last; its positions are those of the sorted rows."""
    board = t.lineitem.groupBy(F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"), "l_linestatus").agg(F.nullif(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("quantity"))
    # A handful of rows: flags times states.
    ordered = topk.board_order(board, [("quantity", "desc"), ("l_returnflag", "asc"), ("l_linestatus", "asc")]).coalesce(1)
    return ordered.withColumn("position", F.monotonically_increasing_id() + 1)
