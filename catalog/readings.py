"""Weather readings derived from the ``events`` table, in Spark and in SQL.

The driver tables hold no weather, so every query runs on a projection of the whole
``events`` table. Both sides compute the same values from the same columns.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def project(events: DataFrame) -> DataFrame:
    """Readings from event rows, batch or stream; independent of the time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("ts"))
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("long")

    def by_kind(*pairs, other):
        out = F.when(kind == pairs[0][0], pairs[0][1])
        for name, text in pairs[1:]:
            out = out.when(kind == name, text)
        return out.otherwise(other)

    return events.select(
        "event_id",
        F.date_format("ts", _ISO).alias("timestamp"),
        F.timestamp_micros(micros).alias("event_ts"),
        F.when(i % 2 == 0, "openweathermap").otherwise("weatherapi").alias("source"),
        F.when(i % 101 != 0, F.concat(F.lit("City "), (u % 5).cast("string"))).alias("city"),
        F.concat(F.lit("C"), (u % 3).cast("string")).alias("country"),
        F.when(i % 67 != 0, F.struct(
            ((u % 5) * 10 + 0.5).cast("double").alias("lat"),
            ((u % 5) * -7 - 0.25).cast("double").alias("lon"),
        )).alias("coordinates"),
        F.when(i % 97 != 0, (cents % 8000) / F.lit(100.0) - 25.0).alias("temperature"),
        F.when(i % 53 != 0, ((i * 7) % 103).cast("double")).alias("humidity"),
        (868 + (i * 13) % 230).cast("double").alias("pressure"),
        F.col("value").alias("wind_speed"),
        ((i * 11) % 360).cast("double").alias("wind_direction"),
        ((i * 3) % 101).cast("double").alias("clouds"),
        F.when(i % 61 != 0, by_kind(
            ("click", "Clear"), ("view", "Light rain"), ("signup", "Partly cloudy"),
            ("error", "Thunderstorm"), other="Fog",
        )).alias("weather_condition"),
        by_kind(
            ("click", "clear sky"), ("view", "light Rain"), ("signup", "gentle wind"),
            ("error", "severe storm"), other="haze",
        ).alias("weather_description"),
        F.lit(0).alias("partition"),
        i.alias("offset"),
    )


def readings(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Readings of the whole table.

    ``spread`` is for work that is heavy per row: the rows are dealt out evenly, whatever the
    splits of the file, one part per core.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return project(events.repartition(spark.sparkContext.defaultParallelism) if spread else events)


def reading_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream over the table's file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    return project(events)


READINGS = """readings AS (
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, ts AS event_ts,
    CASE WHEN event_id % 2 = 0 THEN 'openweathermap' ELSE 'weatherapi' END AS source,
    CASE WHEN event_id % 101 <> 0 THEN 'City ' || (user_id % 5)::VARCHAR END AS city,
    'C' || (user_id % 3)::VARCHAR AS country,
    CASE WHEN event_id % 67 <> 0 THEN (user_id % 5) * 10 + 0.5e0 END AS lat,
    CASE WHEN event_id % 67 <> 0 THEN (user_id % 5) * -7 - 0.25e0 END AS lon,
    CASE WHEN event_id % 97 <> 0
      THEN (CAST(round(value * 100) AS BIGINT) % 8000) / 100.0e0 - 25.0e0 END AS temperature,
    CASE WHEN event_id % 53 <> 0 THEN CAST((event_id * 7) % 103 AS DOUBLE) END AS humidity,
    CAST(868 + (event_id * 13) % 230 AS DOUBLE) AS pressure,
    value AS wind_speed,
    CAST((event_id * 11) % 360 AS DOUBLE) AS wind_direction,
    CAST((event_id * 3) % 101 AS DOUBLE) AS clouds,
    CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_type = 'click' THEN 'Clear'
      WHEN event_type = 'view' THEN 'Light rain' WHEN event_type = 'signup' THEN 'Partly cloudy'
      WHEN event_type = 'error' THEN 'Thunderstorm' ELSE 'Fog' END AS weather_condition,
    CASE event_type WHEN 'click' THEN 'clear sky' WHEN 'view' THEN 'light Rain'
      WHEN 'signup' THEN 'gentle wind' WHEN 'error' THEN 'severe storm' ELSE 'haze' END
      AS weather_description,
    0 AS partition, event_id AS "offset"
  FROM events)"""

# Event JSON as a producer would send it, with every kind of fault. The text is valid
# in both engines; it runs on the readings.
JSON_VALUE = """CASE WHEN event_id % 991 = 7 THEN '{broken' ELSE
  '{"timestamp": ' || CASE WHEN event_id % 73 = 0 THEN 'null' ELSE '"' || timestamp || '"' END
  || ', "source": "' || source || '"'
  || CASE WHEN event_id % 31 = 0 THEN '' ELSE ', "city": "' || coalesce(city, 'Nowhere') || '"' END
  || ', "country": ' || CASE WHEN event_id % 37 = 0 THEN 'null' ELSE '"' || country || '"' END
  || CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 97 = 0 THEN ', "temperature": null'
     WHEN event_id % 41 = 0 THEN ', "temperature": "abc"'
     WHEN event_id % 43 = 0 THEN ', "temperature": {"v": 1}'
     WHEN event_id % 47 = 0 THEN ', "temperature": [1]'
     WHEN event_id % 59 = 0 THEN ', "temperature": "12.5"'
     WHEN event_id % 61 = 0 THEN ', "temperature": true'
     WHEN event_id % 71 = 0 THEN ', "temperature": "nan"'
     WHEN event_id % 79 = 0 THEN ', "temperature": -75.5'
     ELSE ', "temperature": ' || CAST(temperature AS STRING) END
  || ', "humidity": ' || coalesce(CAST(humidity AS STRING), 'null')
  || ', "pressure": ' || CAST(pressure AS STRING)
  || ', "wind_speed": ' || CAST(wind_speed AS STRING) || '}' END"""


def json_events(df: DataFrame) -> DataFrame:
    """Kafka-shaped rows: key, JSON value, topic, partition, offset, event id, event time."""
    return df.select(
        F.coalesce("city", F.lit("unknown")).alias("key"), F.expr(JSON_VALUE).alias("value"),
        F.lit("weather-raw-data").alias("topic"), "partition", "offset",
        F.col("event_ts").alias("timestamp"), "event_id",
    )


JSON_EVENTS = f"json_events AS (SELECT event_id, {JSON_VALUE} AS value, city, source, event_ts FROM readings)"
