"""Derived columns of a reading. All narrow, all inside code generation."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from skygauge.functions import severity as S
from skygauge.functions.scalars import iso_utc
from skygauge.functions.units import c_to_f, f_to_c, heat_index_f


def with_ingest_ts(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Time of normalisation as ISO text, one value per query or micro-batch."""
    return df.withColumn(column, iso_utc(F.current_timestamp()))


def with_processed_ts(df: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """``processed_timestamp`` as ISO text, one value per batch."""
    if now is None:
        return df.withColumn("processed_timestamp", iso_utc(F.current_timestamp()))
    if isinstance(now, datetime):
        if now.tzinfo is not None:
            now = now.astimezone(timezone.utc)
        now = now.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return df.withColumn("processed_timestamp", F.lit(now))


def with_fahrenheit(df: DataFrame) -> DataFrame:
    return df.withColumn("temperature_fahrenheit", c_to_f(F.col("temperature")))


def with_heat_index(df: DataFrame) -> DataFrame:
    """Heat index in both units; NULL for cool or incomplete readings."""
    hot = heat_index_f(c_to_f(F.col("temperature")), F.col("humidity"))
    return df.withColumn("heat_index_fahrenheit", hot).withColumn(
        "heat_index_celsius", f_to_c(F.col("heat_index_fahrenheit"))
    )


def with_severity(
    df: DataFrame, kind: str = "condition", description: str = "weather_description",
    promote: bool = True,
) -> DataFrame:
    """``weather_severity`` by condition, by temperature, or by both texts."""
    if kind == "condition":
        level = S.condition_severity(F.col("weather_condition"))
    elif kind == "thermal":
        level = S.thermal_severity(F.col("temperature"))
    elif kind == "combined":
        level = S.combined_severity(F.col("temperature"), F.col(description), promote)
    else:
        raise ValueError(f"unknown severity: {kind}")
    return df.withColumn("weather_severity", level)


def enrich(
    df: DataFrame, severity: str = "condition", now=None,
    description: str = "weather_description", promote: bool = True,
) -> DataFrame:
    """Processing time, Fahrenheit, heat index and severity."""
    return (
        df.transform(with_processed_ts, now)
        .transform(with_fahrenheit)
        .transform(with_heat_index)
        .transform(with_severity, severity, description, promote)
    )
