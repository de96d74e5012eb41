"""Whole jobs: batch processing, reports, and both in a row."""

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from skygauge import fixed_values as V
from skygauge.operators import filters as F_, reports as R
from skygauge.operators.enrich import enrich
from skygauge.schemas import READING
from skygauge.sources.files import (
    CORRUPT, read_json_lines, read_raw_json, read_recent_json,
)
from skygauge.sources.shared import materialise, temporary
from skygauge.sources.sinks import run_stamp, with_event_date, write_batch


class NoInput(RuntimeError):
    """The raw zone had no reading; later steps of a chain must not run."""


def apply_all(df: DataFrame, transforms: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply user functions in order, on a batch or a stream.

    A function drops events by filtering them out.
    """
    for transform in transforms:
        df = df.transform(transform)
    return df


def run_batch(
    spark: SparkSession, source: str, target: str, severity: str = "condition",
    formats=("parquet", "json"), now: datetime | None = None, transforms=(),
    schema=READING, lines: bool = False,
) -> dict:
    """Read the raw zone, enrich, write every format; returns folders and counts.

    The first write counts rows on the way and the others copy its result, so the raw
    files are scanned once. A zone without a reading stops the run with ``NoInput`` before there is any
    output; readings that all fall to ``transforms`` give empty outputs. ``lines`` is for JSON Lines, which
    large files should be: Spark can split them.
    """
    raw = _known_columns(_sound((read_json_lines if lines else read_raw_json)(spark, source, schema)))
    if raw.head() is None:  # stops at the first row, before anything is written
        raise NoInput(f"no reading in {source}")
    frame = apply_all(enrich(raw, severity, now), transforms)
    frame, seen = R.run_counts(frame)
    stamp = run_stamp(now)
    dated = with_event_date(frame)
    partition_by = ("event_date",) if formats[0] == "parquet" else ()
    first = write_batch(
        dated if partition_by else frame, target, formats[0], stamp, partition_by
    )
    folders = {formats[0]: first}
    if len(formats) > 1:
        done = _read_back(spark, first, formats[0], frame)
        for fmt in formats[1:]:
            folders[fmt] = write_batch(done, target, fmt, stamp)
    return {"folders": folders, "records": seen.get["records"]}


def _sound(df: DataFrame) -> DataFrame:
    """Rows of readable files, without the column that holds unreadable text, which an
    inferred schema has only if there was such text."""
    return df.where(f"{CORRUPT} IS NULL").drop(CORRUPT) if CORRUPT in df.columns else df


def _known_columns(df: DataFrame) -> DataFrame:
    """An inferred schema lacks the columns that no file has; the steps count on them."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in READING.fields if f.name not in df.columns}
    return df.withColumns(missing)


def _read_back(spark, path, fmt, like):
    if fmt == "csv":
        return like  # nested columns are text there, so take the source again
    return spark.read.schema(like.schema).format(fmt).load(path)


#: The columns that the report tables read; only these are kept while they run.
_REPORTED = (
    "timestamp", "city", *V.FEATURES, "weather_condition", "weather_description", "weather_severity",
)


def report_tables(df: DataFrame, conditions=None) -> dict[str, DataFrame]:
    """The tables of the daily report from enriched readings."""
    return {**R.rolled_up(R.report_counts(df), conditions), "severe_alerts": F_.severe_alerts(df, report=True)}


def run_reports(
    spark: SparkSession, source: str, target: str, days: int = 1, now: datetime | None = None,
    conditions=None, schema=READING, lines: bool = False,
) -> dict[str, str]:
    """Reports of the last days as CSV folders; returns their paths.

    The recent readings are read and enriched once for all tables, which roll up from one small frame of counts
    on shared storage, and once more for the alerts, a filter; nothing is kept in memory.
    """
    recent = _known_columns(_sound(read_recent_json(spark, source, days, now, schema, lines)))
    frame = enrich(recent, now=now).select(*_REPORTED)
    stamp = run_stamp(now)
    paths = {}
    with temporary(spark):
        tables = R.rolled_up(materialise(R.report_counts(frame), "report-counts"), conditions)
        for name, table in {**tables, "severe_alerts": F_.severe_alerts(frame, report=True)}.items():
            paths[name] = f"{target}/{name}_{stamp}"
            table.write.mode("overwrite").option("header", True).csv(paths[name])
    return paths


def run_chain(
    spark: SparkSession, collect: Callable[[], object] | None, raw: str, processed: str,
    reports: str, **options,
) -> dict:
    """Collect, process, report; an exception in one step, ``NoInput`` too, keeps the next from running."""
    if collect is not None:
        collect()
    shared = {k: options[k] for k in ("now", "schema", "lines") if k in options}
    batch = run_batch(spark, raw, processed, **shared)
    return {"batch": batch, "reports": run_reports(spark, raw, reports, **options)}
