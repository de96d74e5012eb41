"""Batch sinks of the raw, processed and monitoring zones."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skygauge import fixed_values as V
from skygauge.functions.scalars import event_ts, slug, utc_date
from skygauge.sources.shared import materialise, remove, temporary


def run_stamp(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; CSV has no nested types."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ])


def with_event_date(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    return df.withColumn("event_date", utc_date(event_ts(F.col(timestamp))))


def write_batch(
    df: DataFrame, path: str, fmt: str = "json", run_id: str | None = None,
    partition_by=(),
) -> str:
    """Overwrite the run's own folder below ``path``; returns that folder.

    As many files as the frame has partitions: nothing is pulled into one task. With
    ``partition_by`` a rebalance shuffle groups rows by folder, so there are few files in each,
    and adaptive execution splits large folders over several tasks.
    """
    target = f"{path}/weather_processed_{run_id or run_stamp()}.{fmt}"
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = (flatten_for_csv(df) if fmt == "csv" else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    if fmt not in ("json", "parquet", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(fmt).save(target)
    return target


def with_address(df: DataFrame) -> DataFrame:
    """City slug and UTC day, the folders events are written to."""
    return with_event_date(df).withColumn("city_slug", slug(F.col("city")))


def _append_by(df: DataFrame, path: str, fmt: str, folders) -> None:
    """Append by folder with few, evenly sized files.

    The rebalance shuffle groups rows by folder; adaptive execution splits the folders
    of a hot city over several tasks and joins small ones.
    """
    balanced = df.hint("rebalance", *folders)
    balanced.write.mode("append").format(fmt).partitionBy(*folders).save(path)


def write_events(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append processed events by city and day.

    Appending never overwrites: two events of one city in one second both stay.
    """
    _append_by(with_address(df), path, fmt, ["city_slug", "event_date"])


def land_raw(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append normalised readings to the raw zone by source and city."""
    addressed = df.withColumns({"source_slug": slug(F.col("source")), "city_slug": slug(F.col("city"))})
    _append_by(addressed, path, fmt, ["source_slug", "city_slug"])


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append monitoring records as JSON Lines, nulls written out."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def retain_recent(
    df: DataFrame, ts_col: str, days: int = V.RETENTION_DAYS, now=None,
) -> DataFrame:
    """Rows younger than ``days`` whole days.

    An age counts in whole days, so a row goes once it is ``days + 1`` days old.
    """
    reference = F.current_timestamp() if now is None else now
    return df.where(F.col(ts_col) > reference - F.make_interval(days=F.lit(days + 1)))


def write_retained(df: DataFrame, target: str, partition_by=("event_date",)) -> None:
    """Write the rows that stay to a folder of their own, to take the zone's place.

    Spark cannot overwrite a folder it is reading, and replacing single partitions would
    leave the expired ones behind.
    """
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)


def retain_zone(spark: SparkSession, zone: str, ts_col: str = "event_ts", days: int = V.RETENTION_DAYS, now=None) -> dict[str, list[str]]:
    """Apply ``retain_recent`` to a Parquet zone by ``event_date`` in its place; returns what was dropped and rewritten.

    Days that have expired as a whole go by their folders, without a row read, and so do rows without a
    day; days that have not keep their files. Only the day in which the limit falls is read: the rows that
    stay are frozen on shared storage, then take its place by dynamic partition overwrite, in
    files of even size. A run that is repeated finds nothing more to do.
    """
    reference = F.current_timestamp() if now is None else now
    limit = reference - F.make_interval(days=F.lit(days + 1))
    at, border = spark.range(1).select(F.unix_micros(limit.cast("timestamp")), utc_date(limit.cast("timestamp")).cast("string")).first()
    dropped, rewritten = [], []
    for folder, day in _days(spark, zone):
        if day is None or day < border:
            remove(spark, folder)
            dropped.append(day)
        elif day == border:
            rows = spark.read.option("basePath", zone).parquet(folder)
            kept = rows.where(F.col(ts_col) > F.timestamp_micros(F.lit(at)))
            expired = rows.count() - kept.count()
            if expired:
                with temporary(spark):
                    still = materialise(kept, "border-day")
                    if still.isEmpty():
                        remove(spark, folder)
                        dropped.append(day)
                    else:
                        still.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(zone)
                        rewritten.append(day)
    return {"dropped": dropped, "rewritten": rewritten}


def _days(spark: SparkSession, zone: str) -> list[tuple[str, str | None]]:
    """The folders of a zone by ``event_date``, one listing call, and their days; None for rows without one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(zone)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in files.listStatus(path):
        name, _, day = status.getPath().getName().partition("=")
        if name == "event_date":
            found.append((status.getPath().toString(), None if day.startswith("__HIVE_DEFAULT") else day))
    return sorted(found, key=str)
