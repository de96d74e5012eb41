"""Sources, sinks, payload normalisation and whole jobs."""

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F, types as T

from catalog.core_queries import ENRICHED, enriched
from catalog.readings import JSON_EVENTS, READINGS, json_events, reading_stream, readings
from catalog.registry import register
from skygauge.functions.scalars import event_ts
from skygauge.operators import enrich as E, normalize as N, reports as R
from skygauge.plans import jobs as J
from skygauge.schemas import READING
from skygauge.sources import files as S, kafka as K, sinks as W
from skygauge.sources.shared import new_path
from skygauge.streaming.sinks import start_event_sink, start_parquet_sink

_READING = "event_id, timestamp, source, city, temperature, humidity, weather_condition, lat"


def sql(body: str) -> str:
    return f"WITH {READINGS} {body}"


def flat(df, *extra):
    """The compared columns of a reading."""
    return df.select(
        *extra, "timestamp", "source", "city", "temperature", "humidity", "weather_condition",
        F.col("coordinates.lat").alias("lat"),
    )


_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), *READING.fields])
_TEXT_SCHEMA = T.StructType([T.StructField("source", T.StringType())])
_STORED = ["event_id", "timestamp", "source", "city", "coordinates", "temperature", "humidity", "weather_condition"]


# --- provider payloads


def _payloads(df):
    """The provider JSON a reading would have come from."""
    openweather = F.to_json(F.struct(
        F.col("city").alias("name"), F.struct("country").alias("sys"),
        F.col("coordinates").alias("coord"),
        F.struct(F.col("temperature").alias("temp"), "humidity", "pressure").alias("main"),
        F.struct(F.col("wind_speed").alias("speed"), F.col("wind_direction").alias("deg")).alias("wind"),
        F.struct(F.col("clouds").alias("all")).alias("clouds"),
        F.array(F.struct(
            F.col("weather_condition").alias("main"), F.col("weather_description").alias("description")
        )).alias("weather"),
    ))
    weatherapi = F.to_json(F.struct(
        F.struct(
            F.col("city").alias("name"), "country", F.col("coordinates.lat").alias("lat"),
            F.col("coordinates.lon").alias("lon"),
        ).alias("location"),
        F.struct(
            F.col("temperature").alias("temp_c"), "humidity", F.col("pressure").alias("pressure_mb"),
            F.col("wind_speed").alias("wind_kph"), F.col("wind_direction").alias("wind_degree"),
            F.col("clouds").alias("cloud"), F.struct(F.col("weather_condition").alias("text")).alias("condition"),
        ).alias("current"),
    ))
    is_open = F.col("source") == "openweathermap"
    return df.select("event_id", "timestamp", "source", F.when(is_open, openweather).otherwise(weatherapi).alias("payload"))


_FIELDS = """event_id, timestamp, source, city, country, lat, lon, {temp} AS temperature, humidity, pressure,
  round({wind}, 6) AS wind_speed, wind_direction, clouds, weather_condition, {text} AS weather_description"""


def _normalised(df):
    return df.select(
        "event_id", "timestamp", "source", "city", "country", F.col("coordinates.lat").alias("lat"),
        F.col("coordinates.lon").alias("lon"), F.round("temperature", 6).alias("temperature"), "humidity", "pressure",
        F.round("wind_speed", 6).alias("wind_speed"), "wind_direction", "clouds", "weather_condition",
        "weather_description",
    )


@register("normalize_openweather", sql(f"""SELECT {_FIELDS.format(
    temp='round(temperature - 273.15e0, 6)', wind='wind_speed', text='weather_description')}
  FROM readings WHERE source = 'openweathermap'"""))
def normalize_openweather(spark, sf_dir):
    rows = _payloads(readings(spark, sf_dir)).where("source = 'openweathermap'")
    return _normalised(N.normalize_openweather(rows, temp_unit="kelvin", timestamp_col="timestamp", keep=["event_id"]))


@register("normalize_weatherapi", sql(f"""SELECT {_FIELDS.format(
    temp='round(temperature, 6)', wind='wind_speed / 3.6e0', text='weather_condition')}
  FROM readings WHERE source = 'weatherapi'"""))
def normalize_weatherapi(spark, sf_dir):
    rows = _payloads(readings(spark, sf_dir)).where("source = 'weatherapi'")
    return _normalised(N.normalize_weatherapi(rows, timestamp_col="timestamp", keep=["event_id"]))


@register("normalize_mixed", sql("""SELECT event_id, timestamp, source, coalesce(city, 'Unknown') AS city,
  coalesce(temperature, 0) AS temperature, coalesce(lat, 0) AS lat,
  coalesce(weather_condition, 'Unknown') AS weather_condition FROM readings"""))
def normalize_mixed(spark, sf_dir):
    out = N.normalize(
        _payloads(readings(spark, sf_dir, spread=True)), timestamp_col="timestamp", defaults=True,
        wind_to_mps=False, keep=["event_id"],
    )
    return out.select(
        "event_id", "timestamp", "source", "city", "temperature", F.col("coordinates.lat").alias("lat"),
        "weather_condition",
    )


@register("normalize_unknown", sql("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE source END AS source,
  CASE WHEN event_id % 5 <> 0 THEN city END AS city, event_id % 5 = 0 AS kept_raw FROM readings"""))
def normalize_unknown(spark, sf_dir):
    rows = _payloads(readings(spark, sf_dir)).withColumn(
        "source", F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("source"))
    )
    out = N.normalize(rows, timestamp_col="timestamp", unknown="keep", keep=["event_id"])
    return out.select("event_id", "source", "city", F.col("raw_data").isNotNull().alias("kept_raw"))


@register("union_sources", sql(f"SELECT {_READING}, CASE WHEN source = 'weatherapi' THEN clouds END AS clouds FROM readings"))
def union_sources(spark, sf_dir):
    rows = readings(spark, sf_dir)
    parts = [
        rows.where("source = 'openweathermap'").drop("clouds"), rows.where("source = 'weatherapi'"),
    ]
    return N.union_sources(parts).select(
        "event_id", "timestamp", "source", "city", "temperature", "humidity", "weather_condition",
        F.col("coordinates.lat").alias("lat"), "clouds",
    )


@register("flatten_coordinates", sql("SELECT event_id, coalesce(lat, 0) AS lat, coalesce(lon, 0) AS lon FROM readings"))
def flatten_coordinates(spark, sf_dir):
    return N.flatten_coordinates(readings(spark, sf_dir)).select("event_id", "lat", "lon")


# --- Kafka-shaped frames


@register("parse_kafka_value", f"""WITH {READINGS}, {JSON_EVENTS}
  SELECT j.event_id, coalesce(j.city, 'unknown') AS key, CASE WHEN json_valid(value) THEN j.source END AS source,
  CASE WHEN json_valid(value) THEN pressure END AS pressure, NOT json_valid(value) AS corrupt
  FROM json_events j JOIN readings USING (event_id)""")
def parse_kafka_value(spark, sf_dir):
    out = K.parse_kafka_value(json_events(readings(spark, sf_dir, spread=True)), keep=["event_id"])
    return out.select("event_id", "key", "source", "pressure", F.col(S.CORRUPT).isNotNull().alias("corrupt"))


@register("parse_counts", f"""WITH {READINGS}, {JSON_EVENTS}
  SELECT count(*) FILTER (json_valid(value)) AS processed, count(*) FILTER (NOT json_valid(value)) AS failed
  FROM json_events""")
def parse_counts(spark, sf_dir):
    rows = json_events(readings(spark, sf_dir))
    # Text where a number belongs is a quality issue, not a broken message.
    return R.parse_counts(K.parse_kafka_value(rows, _TEXT_SCHEMA))


@register("kafka_records", sql("""SELECT event_id, coalesce(city, 'unknown') || '_' || timestamp AS key,
  1704067200000 AS ingest_ts_unix_ms, temperature FROM readings"""))
def kafka_records(spark, sf_dir):
    now = F.timestamp_micros(F.lit(1704067200000000))
    records = K.to_kafka_records(readings(spark, sf_dir).drop("event_ts"), "city_timestamp", now)
    fields = F.from_json("value", "event_id long, ingest_ts_unix_ms long, temperature double")
    return records.select("key", fields.alias("r")).select("r.event_id", "key", "r.ingest_ts_unix_ms", "r.temperature")


_WIDE = f"""WITH {READINGS}, {ENRICHED} SELECT event_id, timestamp, source, city, lat, temperature, humidity, weather_condition,
  round(t, 6) AS temperature_fahrenheit, weather_severity FROM enriched"""


def _wide(df):
    return flat(df, "event_id", F.round("temperature_fahrenheit", 6).alias("temperature_fahrenheit"), "weather_severity")


@register("kafka_value", _WIDE)
def kafka_value(spark, sf_dir):
    rows = enriched(spark, sf_dir).drop("event_ts")
    return _wide(K.to_kafka_value(rows).select(F.from_json("value", rows.schema).alias("r")).select("r.*"))


@register("peek_topic", sql("""SELECT partition, "offset", coalesce(city, 'unknown') AS key, event_id, pressure, false AS has_raw
  FROM readings ORDER BY event_ts DESC LIMIT 20"""))
def peek_topic(spark, sf_dir):
    """The newest messages; their values lose the bulky field and keep the others."""
    bulky = F.to_json(F.struct("event_id", "pressure", F.lit("x" * 50).alias("raw_data")))
    rows = json_events(readings(spark, sf_dir)).drop("value").join(
        readings(spark, sf_dir).select("event_id", bulky.alias("value")), "event_id"
    )
    seen = K.peek_topic(rows, 20)
    fields = F.from_json("value", "event_id long, pressure double, raw_data string").alias("r")
    return seen.select("partition", "offset", "key", fields).select(
        "partition", "offset", "key", "r.event_id", "r.pressure", F.col("r.raw_data").isNotNull().alias("has_raw")
    )


# --- files


@register("json_lines_files", sql(f"SELECT {_READING} FROM readings"))
def json_lines_files(spark, sf_dir):
    path = W.write_batch(readings(spark, sf_dir).select(*_STORED), new_path(spark, "json"), "json", "run")
    return flat(S.read_json_lines(spark, path, _SCHEMA), "event_id")


@register("parquet_files", sql(f"SELECT {_READING} FROM readings WHERE event_ts >= TIMESTAMP '2024-01-20'"))
def parquet_files(spark, sf_dir):
    rows = W.with_event_date(readings(spark, sf_dir).select(*_STORED))
    path = W.write_batch(rows, new_path(spark, "parquet"), "parquet", "run", ["event_date"])
    back = S.read_processed_parquet(spark, path)
    return flat(back.where("event_date >= DATE '2024-01-20'"), "event_id")


@register("csv_files", sql("SELECT event_id, city, temperature, lat FROM readings"))
def csv_files(spark, sf_dir):
    path = W.write_batch(readings(spark, sf_dir).select(*_STORED), new_path(spark, "csv"), "csv", "run")
    schema = """event_id long, timestamp string, source string, city string, coordinates string,
      temperature double, humidity double, weather_condition string"""
    back = spark.read.schema(schema).option("header", True).csv(path)
    lat = F.get_json_object("coordinates", "$.lat").cast("double")
    return back.select("event_id", "city", "temperature", lat.alias("lat"))


def _write_arrays(rows, path):
    """Raw zone files that hold an array of 500 objects each."""
    chunk = rows.select(F.expr("event_id div 500").alias("chunk"), F.struct(*_STORED).alias("r"))
    arrays = chunk.groupBy("chunk").agg(F.to_json(F.collect_list("r")).alias("value"))
    arrays.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)


@register("raw_json_arrays", sql(f"SELECT {_READING} FROM readings"))
def raw_json_arrays(spark, sf_dir):
    """Arrays of objects, flattened to rows."""
    path = new_path(spark, "arrays")
    _write_arrays(readings(spark, sf_dir), path)
    return flat(S.read_raw_json(spark, path, _SCHEMA), "event_id")


@register("recent_files", sql(f"SELECT {_READING} FROM readings WHERE (event_id // 500) % 2 = 1"))
def recent_files(spark, sf_dir):
    """Every second array is in a file that is just too old."""
    path, rows = new_path(spark, "recent"), readings(spark, sf_dir)
    _write_arrays(rows.where("event_id div 500 % 2 = 0"), path)
    time.sleep(1.1)
    between = datetime.now(timezone.utc)
    time.sleep(0.1)
    _write_arrays(rows.where("event_id div 500 % 2 = 1"), path)
    return flat(S.read_recent_json(spark, path, days=1, now=between + timedelta(days=1), schema=_SCHEMA), "event_id")


@register("events_sink", sql("""SELECT replace(lower(coalesce(city, 'unknown')), ' ', '_') AS city_slug,
  CAST(event_ts AS DATE)::VARCHAR AS event_date, count(*) AS events FROM readings GROUP BY ALL"""))
def events_sink(spark, sf_dir):
    path = new_path(spark, "events")
    W.write_events(readings(spark, sf_dir).select(*_STORED), path, "parquet")
    return spark.read.parquet(path).groupBy(
        "city_slug", F.col("event_date").cast("string").alias("event_date")
    ).agg(F.count(F.lit(1)).alias("events"))


@register("land_raw", sql(f"SELECT {_READING} FROM readings"))
def land_raw(spark, sf_dir):
    path = new_path(spark, "raw")
    W.land_raw(readings(spark, sf_dir).select(*_STORED), path)
    return flat(S.read_json_lines(spark, path, _SCHEMA), "event_id")


@register("retain_recent", sql("""SELECT event_id FROM readings
  WHERE event_ts > TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 31 DAY"""))
def retain_recent(spark, sf_dir):
    now = F.timestamp_micros(F.lit(1707566400000000))
    return W.retain_recent(readings(spark, sf_dir), "event_ts", now=now).select("event_id")


# --- streaming sinks and whole jobs


@register("parquet_stream", _WIDE)
def parquet_stream(spark, sf_dir):
    path = new_path(spark, "stream")
    query = start_parquet_sink(
        E.enrich(reading_stream(spark, sf_dir)), path, new_path(spark, "stream-checkpoint"), "available_now"
    )
    query.awaitTermination()
    return _wide(spark.read.parquet(path))


@register("event_stream", sql("""SELECT replace(lower(coalesce(city, 'unknown')), ' ', '_') AS city_slug,
  count(*) AS events FROM readings GROUP BY ALL"""))
def event_stream(spark, sf_dir):
    path = new_path(spark, "event-stream")
    query = start_event_sink(
        reading_stream(spark, sf_dir).select(*_STORED), path, new_path(spark, "event-checkpoint"), "available_now"
    )
    query.awaitTermination()
    back = spark.read.schema("event_id long, city_slug string, event_date date").json(path)
    return back.groupBy("city_slug").agg(F.count(F.lit(1)).alias("events"))


@register("batch_job", f"WITH {READINGS}, {ENRICHED} SELECT event_id, weather_severity FROM enriched WHERE temperature > 0")
def batch_job(spark, sf_dir):
    """Raw files to processed Parquet, with a user step that drops events."""
    raw = new_path(spark, "job-raw")
    W.land_raw(readings(spark, sf_dir).select(*_STORED), raw)
    done = J.run_batch(
        spark, raw, new_path(spark, "job"), formats=("parquet",), now=datetime(2024, 1, 1, tzinfo=timezone.utc),
        schema=_SCHEMA, lines=True, transforms=[lambda df: df.where("temperature > 0")],
    )
    return S.read_processed_parquet(spark, done["folders"]["parquet"]).select("event_id", "weather_severity")


@register("report_job", f"""WITH {READINGS}, {ENRICHED} SELECT city, printf('%.1f', round(avg(temperature), 9)) AS avg_temp
  FROM enriched WHERE city IS NOT NULL GROUP BY city""")
def report_job(spark, sf_dir):
    """Raw files of the last day to report files; the daily summary is read back."""
    raw = new_path(spark, "report-raw")
    W.land_raw(readings(spark, sf_dir).select(*_STORED), raw)
    paths = J.run_reports(spark, raw, new_path(spark, "reports"), schema=_SCHEMA, lines=True)
    summary = spark.read.option("header", True).csv(paths["daily_summary"])
    shown = R.display(summary.select("city", F.round(F.col("avg_temp").cast("double"), 9).alias("avg_temp")), ["avg_temp"])
    return shown


@register("processed_files", sql(f"SELECT {_READING} FROM readings WHERE city IS NOT NULL AND temperature IS NOT NULL"))
def processed_files(spark, sf_dir):
    """Processed files by name pattern; absent keys make a record drop out."""
    path = new_path(spark, "processed")
    # Nulls are left out of the JSON here, so they are absent keys in the files.
    readings(spark, sf_dir).select(*_STORED).write.option("ignoreNullFields", True).json(path)
    back = S.read_processed(
        spark, path, ["city", "temperature"], _SCHEMA, name_pattern="part-*.json", lines=True
    )
    return flat(back, "event_id")


@register("run_counts", sql("SELECT count(*) AS records FROM readings"))
def run_counts(spark, sf_dir):
    """Rows counted on the way into a sink, without a pass of their own."""
    frame, seen = R.run_counts(readings(spark, sf_dir))
    W.write_batch(frame.select(*_STORED), new_path(spark, "counted"), "parquet", "run")
    return spark.createDataFrame([(seen.get["records"],)], "records long")


@register("ingest_stamp", sql("SELECT event_id, true AS stamped FROM readings"))
def ingest_stamp(spark, sf_dir):
    """Every reading gets the time of normalisation, as ISO text in UTC."""
    stamped = E.with_ingest_ts(readings(spark, sf_dir), "normalised_at")
    recent = event_ts(F.col("normalised_at")) > F.current_timestamp() - F.make_interval(hours=F.lit(1))
    return stamped.select("event_id", recent.alias("stamped"))
