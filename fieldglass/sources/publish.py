"""Publishing tables: validated replace, idempotent reload, archive, audit.

Tables are Parquet folders below a root every executor can reach.  A table's
current version is named by a one-row pointer folder, so a reader sees either
the old or the new version, never a half-written one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators.quality import QualityError, Rules, expect
from fieldglass.operators.skew import names


def _path(spark: SparkSession, location: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, location: str) -> bool:
    fs, path = _path(spark, location)
    return bool(fs.exists(path))


def _pointer(root: str, table: str) -> str:
    return f"{root}/{table}/_current"


def current_version(spark: SparkSession, root: str, table: str) -> str | None:
    """Newest published version of a table; versions sort by time."""
    folder = _pointer(root, table)
    if not exists(spark, folder):
        return None
    return spark.read.schema("version string, published_at timestamp").json(folder).agg(
        F.max_by("version", F.struct("published_at", "version"))
    ).first()[0]


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    version = current_version(spark, root, table)
    if version is None:
        raise QualityError(f"table {table} is not published")
    return spark.read.parquet(f"{root}/{table}/{version}")


def publish(df: DataFrame, root: str, table: str, rules: Rules | Callable[[DataFrame], Rules] | None = None,
            partition_by: Sequence[str] = ()) -> str:
    """Write a new version, audit what was written, then move the pointer.

    A failed check leaves the previous version current.
    """
    spark = df.sparkSession
    version = "v_" + uuid.uuid4().hex
    location = f"{root}/{table}/{version}"
    df.write.partitionBy(*partition_by).parquet(location)
    written = spark.read.schema(df.schema).parquet(location)
    if rules is not None:
        expect(written, rules(written) if callable(rules) else rules)
    spark.range(1).select(
        F.lit(version).alias("version"), F.lit(datetime.now(timezone.utc)).alias("published_at")
    ).coalesce(1).write.mode("append").json(_pointer(root, table))
    return location


def replace_partition(df: DataFrame, location: str, key: str | Sequence[str]) -> None:
    """Rewrite only the partitions present in ``df`` (idempotent reload)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names(key)).parquet(location)


def content_key(columns: Sequence[str]):
    """SHA-256 identity of some columns, nulls spelled out."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def archive_keys(df: DataFrame, columns: Sequence[str], name: str = "archive_key") -> DataFrame:
    return df.withColumn(name, content_key(columns))


def archive_new(new: DataFrame, archive: DataFrame, key: str = "archive_key") -> DataFrame:
    """Unseen rows of an archive.

    The archive is first reduced to the keys of the batch (a small batch is
    broadcast, so the archive is scanned but never shuffled).
    """
    seen = archive.select(key).join(new.select(key).distinct(), key, "left_semi").distinct()
    return new.join(seen, key, "left_anti")


def archive_conflicts(new: DataFrame, archive: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Rows whose key is archived with another payload."""
    old = archive.select(key, *[F.col(c).alias(f"__a_{c}") for c in payload])
    joined = new.join(old, key)
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"__a_{c}"))
    return joined.where(~same).select(*new.columns)


def archive_append(
    new: DataFrame, location: str, key_cols: Sequence[str], payload_cols: Sequence[str]
) -> int:
    """Append rows not archived yet; reject a changed payload of a known key."""
    spark = new.sparkSession
    keyed = archive_keys(new, key_cols).dropDuplicates(["archive_key", *payload_cols])
    clash = keyed.groupBy("archive_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not clash.isEmpty():
        raise QualityError("one archive key with two payloads in the same batch")
    if exists(spark, location):
        archive = spark.read.schema(keyed.schema).parquet(location)
        if not archive_conflicts(keyed, archive, "archive_key", payload_cols).isEmpty():
            raise QualityError("archived rows are immutable; payload changed")
        keyed = archive_new(keyed, archive)
    # Counted while writing, so the anti join runs once.
    from pyspark.sql import Observation

    seen = Observation()
    keyed.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(location)
    return int(seen.get["n"])


def export_tables(spark: SparkSession, root: str, tables: Sequence[str], dest: str) -> dict[str, int]:
    """Copy approved tables and require equal row counts."""
    counts = {}
    for table in tables:
        source = read_table(spark, root, table)
        source.write.parquet(f"{dest}/{table}")
        expected, copied = source.count(), spark.read.parquet(f"{dest}/{table}").count()
        if expected != copied:
            raise QualityError(f"{table}: copied {copied} of {expected} rows")
        counts[table] = copied
    return counts


AUDIT_SCHEMA = (
    "run_id string, mode string, snapshot_file string, started_at timestamp, completed_at timestamp, "
    "status string, archived_market_row_count long, error_message string"
)


def record_run(spark: SparkSession, location: str, **row) -> None:
    """Append one audit row (RUNNING, SUCCESS or FAILED)."""
    known = [part.strip().split(" ")[0] for part in AUDIT_SCHEMA.split(",")]
    spark.createDataFrame([tuple(row.get(c) for c in known)], AUDIT_SCHEMA).write.mode("append").parquet(location)


def run_states(spark: SparkSession, location: str) -> DataFrame:
    """The latest state of each run; a finished row beats its start row."""
    rows = spark.read.schema(AUDIT_SCHEMA).parquet(location)
    rank = F.struct(F.col("completed_at").isNotNull().alias("done"), "completed_at", "started_at")
    cols = [c for c in rows.columns if c != "run_id"]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*cols), rank).alias("r")).select("run_id", "r.*")


def audited(spark: SparkSession, location: str, mode: str, work: Callable[[], int | None], snapshot_file: str | None = None) -> str:
    """Run ``work`` between a RUNNING and a SUCCESS or FAILED row."""
    run_id, started = uuid.uuid4().hex, datetime.now(timezone.utc)
    base = dict(run_id=run_id, mode=mode, snapshot_file=snapshot_file, started_at=started)
    record_run(spark, location, **base, status="RUNNING")
    try:
        count = work()
    except Exception as error:
        record_run(spark, location, **base, completed_at=datetime.now(timezone.utc), status="FAILED", error_message=str(error))
        raise
    record_run(spark, location, **base, completed_at=datetime.now(timezone.utc), status="SUCCESS", archived_market_row_count=count)
    return run_id


def health(spark: SparkSession, root: str, stamps: Mapping[str, str | None]) -> DataFrame:
    """Per required table whether it is present and its newest time."""
    frames = []
    for table, stamp in stamps.items():
        version = current_version(spark, root, table)
        if version is None:
            one = spark.range(1).select(F.lit(table).alias("table_name"), F.lit(False).alias("is_present"),
                                        F.lit(None).cast("timestamp").alias("newest"), F.lit(0).cast("long").alias("row_count"))
        else:
            df = spark.read.parquet(f"{root}/{table}/{version}")
            newest = F.max(F.col(stamp).cast("timestamp")) if stamp else F.lit(None).cast("timestamp")
            one = df.agg(newest.alias("newest"), F.count(F.lit(1)).alias("row_count")).select(
                F.lit(table).alias("table_name"), F.lit(True).alias("is_present"), "newest", "row_count")
        frames.append(one)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
