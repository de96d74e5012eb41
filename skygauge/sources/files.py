"""Batch scans of the raw and processed zones."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skygauge import fixed_values as V
from skygauge.operators.filters import require_fields
from skygauge.schemas import READING

CORRUPT = "_corrupt"


def _reader(spark: SparkSession, schema: T.StructType | None):
    reader = (
        spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    )
    if schema is None:
        return reader
    if CORRUPT not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return reader.schema(schema)


def read_raw_json(spark: SparkSession, path, schema: T.StructType | None = READING) -> DataFrame:
    """Files that hold one object or an array of objects, one row per object.

    A file that is no JSON gives one row with its text in ``_corrupt``; nothing is
    dropped. Without a schema it is inferred, which costs one more scan.
    """
    return _reader(spark, schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path, schema: T.StructType = READING) -> DataFrame:
    """JSON Lines: splittable, so the format to prefer for large inputs."""
    return _reader(spark, schema).json(path)


def read_recent_json(
    spark: SparkSession, path, days: int = 1, now: datetime | None = None,
    schema: T.StructType | None = READING, lines: bool = False,
) -> DataFrame:
    """Like ``read_raw_json`` (or JSON Lines), for files modified in the last ``days`` days.

    Older files are left out while listing; they are never opened. ``now`` is read
    as UTC.
    """
    now = now or datetime.now(timezone.utc)
    since = (now.astimezone(timezone.utc) if now.tzinfo else now) - timedelta(days=days)
    # The option takes whole seconds and keeps later files only, so step back one
    # second and let the exact comparison finish the work on file metadata.
    floor = since.replace(microsecond=0) - timedelta(seconds=1)
    reader = (
        _reader(spark, schema)
        .option("multiLine", not lines)
        .option("modifiedAfter", floor.strftime("%Y-%m-%dT%H:%M:%S"))
        .option("timeZone", "UTC")
    )
    exact = F.to_timestamp(F.lit(since.strftime("%Y-%m-%dT%H:%M:%S.%fZ")))
    return reader.json(path).where(F.col("_metadata.file_modification_time") >= exact)


def stream_recent_json(
    spark: SparkSession, path: str, days: int = 1, archive: str | None = None,
    schema: T.StructType = READING, lines: bool = False, files_at_once: int | None = None,
) -> DataFrame:
    """A raw zone as a stream: each file is read once, rows as in ``read_raw_json`` (or JSON Lines).

    Rows of files modified more than ``days`` before their micro-batch are left out; listings after the first
    leave out files that much older than the newest one seen. Files that are done move to
    ``archive``, outside of ``path``, when the micro-batch after theirs begins, so that listings stay short;
    Spark moves them in the background and tries none twice. ``files_at_once`` bounds a micro-batch.
    """
    if CORRUPT not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": not lines, "maxFileAge": f"{days}d"}
    if archive:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    if files_at_once:
        options["maxFilesPerTrigger"] = files_at_once
    since = F.current_timestamp() - F.expr(f"make_interval(0, 0, 0, {int(days)})")
    return spark.readStream.schema(schema).options(**options).json(path).where(F.col("_metadata.file_modification_time") >= since)


def read_processed(
    spark: SparkSession, path, required=V.DASHBOARD_FIELDS,
    schema: T.StructType = READING, name_pattern: str = "processed_*.json",
    lines: bool = False,
) -> DataFrame:
    """Processed files by name pattern, with every required key present.

    A key that is there with a null counts as present, so the check runs on the
    JSON text of the file's object (or line) before it is parsed.
    """
    text = spark.read.option("pathGlobFilter", name_pattern).text(path, wholetext=not lines)
    kept = require_fields(text, required, "value")
    return kept.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_processed_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)
