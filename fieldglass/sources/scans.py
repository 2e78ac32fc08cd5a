"""Reading landed files (S1-S7) and nested snapshots (S3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.scalars import conform_schema
from fieldglass.operators.skew import join_lookup


def scan_parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """Files of differing columns as one table, by column name.

    A given schema skips the footer merge, which matters with many files.
    """
    reader = spark.read
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", True)
    return reader.parquet(*paths)


def with_source_file(df: DataFrame, pattern: str, name: str, kind: str = "int") -> DataFrame:
    """The file a row came from and a value parsed from its name."""
    path = F.col("_metadata.file_path")
    return df.select(
        "*", path.alias("source_file"), F.regexp_extract(path, pattern, 1).try_cast(kind).alias(name)
    )


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A landed CSV with a declared schema (no inference pass)."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def read_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """A range of partitions; prunes when ``column`` is a partition column."""
    return df.where(F.col(column).between(low, high))


def optional_source(spark: SparkSession, path_exists: bool, path: str, schema: T.StructType) -> DataFrame:
    """An optional table: its rows, or an empty frame of the same schema."""
    if path_exists:
        return conform_schema(spark.read.parquet(path), schema)
    return spark.createDataFrame([], schema)


#: Shape of a landed odds snapshot.
OUTCOME = "array<struct<name:string,price:double,point:double>>"
MARKETS = f"array<struct<key:string,last_update:timestamp,outcomes:{OUTCOME}>>"
BOOKMAKERS = f"array<struct<key:string,title:string,last_update:timestamp,markets:{MARKETS}>>"
EVENTS = (
    "array<struct<id:string,sport_key:string,sport_title:string,commence_time:timestamp,"
    f"home_team:string,away_team:string,bookmakers:{BOOKMAKERS}>>"
)
SNAPSHOT_SCHEMA = (
    "metadata struct<fetched_at:timestamp,sport_key:string,regions:string,markets:array<string>,"
    "odds_format:string,requests_remaining:int,requests_used:int,requests_last:int>,"
    f"events {EVENTS}"
)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot JSON files with a declared schema; the file name becomes the id."""
    raw = spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).json(path)
    source = F.col("_metadata.file_path")
    return raw.select(
        F.sha2(F.concat_ws("|", F.regexp_extract(source, r"([^/]+)$", 1), F.col("metadata.fetched_at").cast("string")), 256).alias("snapshot_id"),
        source.alias("source_file"), "metadata", "events",
    )


def flatten_snapshot(df: DataFrame) -> dict[str, DataFrame]:
    """S3: snapshots, events and offers from nested snapshot rows."""
    snapshots = df.select(
        "snapshot_id", "metadata.*", F.size("events").alias("event_count"), "source_file"
    )
    events = df.select("snapshot_id", F.explode("events").alias("e"))
    event_rows = events.select(
        "snapshot_id", F.col("e.id").alias("event_id"), "e.sport_key", "e.sport_title",
        "e.commence_time", "e.home_team", "e.away_team",
    )
    books = events.select("snapshot_id", "e.id", F.explode("e.bookmakers").alias("b"))
    markets = books.select("snapshot_id", "id", "b.key", "b.title", "b.last_update", F.explode("b.markets").alias("m"))
    offers = markets.select(
        "snapshot_id", F.col("id").alias("event_id"), F.col("key").alias("bookmaker_key"),
        F.col("title").alias("bookmaker_title"), F.col("last_update").alias("bookmaker_last_update"),
        F.col("m.key").alias("market_key"), F.explode("m.outcomes").alias("o"),
    ).select(
        "snapshot_id", "event_id", "bookmaker_key", "bookmaker_title", "bookmaker_last_update",
        "market_key", F.col("o.name").alias("outcome_name"), F.col("o.price").alias("price"),
        F.col("o.point").alias("point"),
    )
    return {"snapshots": snapshots, "events": event_rows, "offers": offers}


def feed_to_next_event(
    feed: DataFrame,
    schedule_sides: DataFrame,
    entity: str,
    event_time: str,
    event_id: str,
    now: Column,
    status: str,
    status_map: Mapping[str, str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Attach each entity's next scheduled event to its status rows.

    ``schedule_sides`` has one row per (event, entity).  The next event is a
    ``min_by`` per entity; feed rows of an entity without one drop out.
    """
    from fieldglass.functions.scalars import map_codes

    upcoming = (
        schedule_sides.where(F.col(event_time) >= now)
        .groupBy(entity)
        .agg(F.min(F.struct(event_time, event_id, *keep)).alias("__e"))
        .select(entity, F.col(f"__e.{event_time}").alias(event_time), F.col(f"__e.{event_id}").alias(event_id),
                *[F.col(f"__e.{c}").alias(c) for c in keep])
    )
    mapped = feed.withColumn(status, map_codes(F.col(status), status_map, unmapped=F.lit(None).cast("string")))
    return join_lookup(mapped, upcoming, entity, "inner")


#: What a snapshot must hold: path, type (as the parser names it) and the reason given without it.
REQUIRED = (
    ("$.metadata", "OBJECT", "metadata missing"),
    ("$.events", "ARRAY", "events missing"),
    ("$.metadata.fetched_at", "STRING", "fetched_at missing"),
    ("$.metadata.sport_key", "STRING", "sport_key missing"),
)


def gate_snapshots(df: DataFrame, body: str = "body", required: Sequence[tuple[str, str, str]] = REQUIRED) -> DataFrame:
    """S3: parse snapshot texts once and say why one is rejected.

    Adds ``parsed`` (VARIANT; null if rejected) and ``reason`` (null if accepted):
    'no text', 'invalid JSON', 'not an object', or the first missing requirement.
    A required value of another type counts as missing.  Nothing is dropped.
    """
    parsed = F.try_parse_json(F.col(body))
    # An object is what can be read as a map, an array what can be read as one; their whole schema is not needed.
    whole = {"OBJECT": "map<string, variant>", "ARRAY": "array<variant>"}

    def is_a(path: str, wanted: str) -> Column:
        if wanted in whole:
            return F.try_variant_get("__v", path, whole[wanted]).isNotNull()
        return F.coalesce(F.schema_of_variant(F.try_variant_get("__v", path, "variant")).startswith(wanted), F.lit(False))

    reason = F.when(F.col(body).isNull(), "no text").when(F.col("__v").isNull(), "invalid JSON").when(
        ~is_a("$", "OBJECT"), "not an object"
    )
    for path, wanted, missing in required:
        reason = reason.when(~is_a(path, wanted), missing)
    rows = df.withColumn("__v", parsed).withColumn("reason", reason)
    return rows.withColumn("parsed", F.when(F.col("reason").isNull(), F.col("__v"))).drop("__v")


_OUTCOMES = "array<struct<name: string, price: double, point: double>>"
_BOOKS = f"array<struct<key: string, markets: array<struct<key: string, outcomes: {_OUTCOMES}>>>>"
_EVENTS = f"array<struct<id: string, bookmakers: {_BOOKS}>>"


def snapshot_offers(df: DataFrame, keep: Sequence[str], parsed: str = "parsed") -> DataFrame:
    """S3: offers of gated snapshots, reading only the paths that offers need.

    Rejected snapshots have no offers; a level that is missing or empty ends there.
    """
    # One typed read takes all levels; a value of another type is null there, as if it were read alone.  An outer
    # explode keeps its test for missing levels behind it: pushed below, a test would read every text again.
    events = df.select(*keep, F.explode_outer(F.try_variant_get(F.col(parsed), "$.events", _EVENTS)).alias("e"))
    books = events.select(*keep, F.col("e.id").alias("event_id"), F.explode("e.bookmakers").alias("b"))
    markets = books.select(*keep, "event_id", F.col("b.key").alias("bookmaker_key"), F.explode("b.markets").alias("m"))
    offers = markets.select(*keep, "event_id", "bookmaker_key", F.col("m.key").alias("market_key"), F.explode("m.outcomes").alias("o"))
    return offers.select(
        *keep, "event_id", "bookmaker_key", "market_key", F.col("o.name").alias("outcome_name"), F.col("o.price").alias("price"), F.col("o.point").alias("point"),
    )
