"""Row filters. All are narrow, so they reach the scan where it supports them."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from skygauge.functions.scalars import event_ts


def filter_cities(df: DataFrame, cities=None) -> DataFrame:
    """Rows of the given cities; no list, or an empty one, keeps every row."""
    return df.where(F.col("city").isin(list(cities))) if cities else df


def filter_range(df: DataFrame, start=None, end=None, ts_col: str = "event_ts") -> DataFrame:
    """start <= ts <= end; either end may be left open."""
    if start is not None:
        df = df.where(F.col(ts_col) >= _ts(start))
    if end is not None:
        df = df.where(F.col(ts_col) <= _ts(end))
    return df


def filter_days(df: DataFrame, start=None, end=None, ts_col: str = "event_ts") -> DataFrame:
    """Whole days from start to end; without both bounds every row stays."""
    if start is None or end is None:
        return df
    until = _ts(end) + F.make_interval(days=F.lit(1))
    return df.where((F.col(ts_col) >= _ts(start)) & (F.col(ts_col) <= until))


def _ts(bound):
    """A bound as TIMESTAMP literal; text and naive datetimes are UTC."""
    text = bound if isinstance(bound, str) else bound.isoformat()
    return event_ts(F.lit(text))


def severe_alerts(df: DataFrame, cities=None, report: bool = False) -> DataFrame:
    """Severe readings; the report form leaves out humidity and time."""
    columns = ["city", "weather_condition", "temperature", "wind_speed"]
    if not report:
        columns = ["city", "weather_condition", "temperature", "humidity", "wind_speed", "timestamp"]
    return filter_cities(df, cities).where(F.col("weather_severity") == "severe").select(*columns)


def with_event_ts(df: DataFrame, source: str = "timestamp") -> DataFrame:
    return df.withColumn("event_ts", event_ts(F.col(source)))


def drop_invalid_ts(df: DataFrame, source: str = "timestamp") -> DataFrame:
    """Adds ``event_ts`` and drops rows whose timestamp does not parse."""
    return with_event_ts(df, source).where(F.col("event_ts").isNotNull())


def require_fields(df: DataFrame, fields, json_col: str | None = None) -> DataFrame:
    """Rows that have all fields.

    With a JSON text column the key must be present and may hold null; on typed
    columns present and not null are the same thing.
    """
    if json_col is None:
        return df.where(reduce(and_, [F.col(f).isNotNull() for f in fields]))
    keys = F.json_object_keys(F.col(json_col))
    return df.where(F.size(F.array_except(F.array(*map(F.lit, fields)), keys)) == 0)


def valid_points(df: DataFrame) -> DataFrame:
    """Points a chart can draw: city and timestamp not empty, numbers present."""
    return df.where(
        (F.col("city") != "") & (F.col("timestamp") != "")
        & F.col("temperature").isNotNull() & F.col("humidity").isNotNull()
        & F.col("wind_speed").isNotNull()
    )


def city_readings(df: DataFrame, city: str) -> DataFrame:
    return df.where(F.col("city") == city)


def latest_day(df: DataFrame, end=None, ts_col: str = "event_ts") -> DataFrame:
    """Rows from one day before the reference on.

    The reference is ``end`` or the newest timestamp, read as a scalar subquery:
    a one-row aggregate, no join.
    """
    if end is None:
        reference = df.agg(F.max(ts_col).alias("newest")).scalar()
    else:
        reference = _ts(end)
    return df.where(F.col(ts_col) >= reference - F.make_interval(days=F.lit(1)))


def passed(df: DataFrame) -> DataFrame:
    return df.where(F.col("data_quality.passed"))


def failed(df: DataFrame) -> DataFrame:
    return df.where(~F.col("data_quality.passed"))
