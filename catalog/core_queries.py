"""Enrichment, reports, filters and dashboard views."""

from pyspark.sql import functions as F

from catalog.readings import READINGS, readings
from catalog.registry import register
from skygauge.functions import scalars as C, severity as S
from skygauge.operators import enrich as E, filters as FL, reports as R, views as VW


def sql(body: str, enriched: bool = False) -> str:
    return f"WITH {READINGS}{', ' + ENRICHED if enriched else ''} {body}"


def rounded(df, *columns, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


F_SQL = "(temperature * 9.0e0 / 5.0e0 + 32.0e0)"


def _has(column, *words):
    return "(" + " OR ".join(f"lower({column}) LIKE '%{w}%'" for w in words) + ")"


SEVERITY_SQL = f"""CASE WHEN {_has('weather_condition', 'thunderstorm', 'tornado', 'hurricane', 'blizzard')} THEN 'severe'
  WHEN {_has('weather_condition', 'rain', 'snow', 'drizzle', 'fog', 'mist', 'shower')} THEN 'moderate'
  WHEN {_has('weather_condition', 'cloudy', 'overcast', 'partly cloudy')} THEN 'mild' ELSE 'normal' END"""
THERMAL_SQL = """CASE WHEN temperature > 35 OR temperature < -10 THEN 'high'
  WHEN temperature > 30 OR temperature < 0 THEN 'moderate' ELSE 'normal' END"""
HEAT_SQL = f"""CASE WHEN t > 80 THEN -42.379e0 + 2.04901523e0 * t + 10.14333127e0 * humidity
  - 0.22475541e0 * t * humidity - 0.00683783e0 * t * t - 0.05481717e0 * humidity * humidity
  + 0.00122874e0 * t * t * humidity + 0.00085282e0 * t * humidity * humidity
  - 0.00000199e0 * t * t * humidity * humidity END"""
ENRICHED = f"""fahrenheit AS (SELECT *, {F_SQL} AS t FROM readings),
enriched AS (SELECT *, t AS temperature_fahrenheit, {HEAT_SQL} AS heat_index_fahrenheit,
  {SEVERITY_SQL} AS weather_severity FROM fahrenheit)"""


def enriched(spark, sf_dir):
    return E.enrich(readings(spark, sf_dir), now="2024-01-01T00:00:00.000000Z")


# --- enrichment and scalar functions


@register("enrich_condition", sql("""SELECT event_id, '2024-01-01T00:00:00.000000Z' AS processed_timestamp,
  round(t, 6) AS temperature_fahrenheit, round(heat_index_fahrenheit, 6) AS heat_index_fahrenheit,
  round((heat_index_fahrenheit - 32) * 5 / 9, 6) AS heat_index_celsius, weather_severity FROM enriched""", True))
def enrich_condition(spark, sf_dir):
    columns = ("temperature_fahrenheit", "heat_index_fahrenheit", "heat_index_celsius")
    out = enriched(spark, sf_dir).select("event_id", "processed_timestamp", *columns, "weather_severity")
    return rounded(out, *columns)


@register("enrich_thermal", sql(f"SELECT event_id, {THERMAL_SQL} AS weather_severity FROM readings"))
def enrich_thermal(spark, sf_dir):
    return E.with_severity(readings(spark, sf_dir), "thermal").select("event_id", "weather_severity")


_HIGH = _has("weather_description", "storm", "hurricane", "tornado", "blizzard", "flood", "severe")
_MODERATE = _has("weather_description", "rain", "snow", "wind", "fog", "mist", "drizzle")


@register("combined_severity", sql(f"""SELECT event_id,
  CASE WHEN {_HIGH} OR base = 'high' THEN 'high' WHEN {_MODERATE} THEN 'moderate' ELSE base END AS promoted,
  CASE WHEN {_HIGH} THEN 'high' ELSE base END AS unpromoted
  FROM (SELECT *, {THERMAL_SQL} AS base FROM readings)"""))
def combined_severity(spark, sf_dir):
    t, d = F.col("temperature"), F.col("weather_description")
    return readings(spark, sf_dir).select(
        "event_id", S.combined_severity(t, d).alias("promoted"),
        S.combined_severity(t, d, promote=False).alias("unpromoted"),
    )


@register("display_functions", sql(f"""SELECT event_id,
  CASE WHEN {_has('weather_condition', 'clear', 'sunny')} THEN '☀️'
    WHEN {_has('weather_condition', 'cloud', 'overcast')} THEN '☁️'
    WHEN {_has('weather_condition', 'rain', 'drizzle')} THEN '🌧️'
    WHEN {_has('weather_condition', 'snow')} THEN '❄️'
    WHEN {_has('weather_condition', 'storm', 'thunder')} THEN '⛈️'
    WHEN {_has('weather_condition', 'fog', 'mist')} THEN '🌫️' ELSE '🌤️' END AS icon,
  CASE WHEN coalesce(temperature, 0) < 0 THEN '#9ec5fe' WHEN coalesce(temperature, 0) < 10 THEN '#6ea8fe'
    WHEN temperature < 20 THEN '#a3cfbb' WHEN temperature < 30 THEN '#ffda6a' ELSE '#ea868f' END AS band,
  replace(lower(coalesce(city, 'unknown')), ' ', '_') AS slug,
  CASE WHEN abs(temperature) < 5 THEN 5.0e0 ELSE coalesce(abs(temperature), 5.0e0) END AS marker,
  coalesce(temperature, 0.0e0) AS chart_value,
  CASE WHEN temperature IS NOT NULL THEN printf('%.1f', temperature) END AS shown,
  upper(weather_description[1]) || lower(weather_description[2:]) AS title FROM readings"""))
def display_functions(spark, sf_dir):
    t = F.col("temperature")
    return readings(spark, sf_dir).select(
        "event_id", S.weather_icon(F.col("weather_condition")).alias("icon"),
        S.temperature_band(t).alias("band"), C.slug(F.col("city")).alias("slug"),
        C.temperature_size(t).alias("marker"), C.num_or_zero("temperature").alias("chart_value"),
        C.fmt1(t).alias("shown"), C.capitalize(F.col("weather_description")).alias("title"),
    )


@register("event_time", sql("""SELECT event_id, epoch_us(event_ts) / 1000.0e0 AS plain_ms,
  epoch_us(event_ts) / 1000.0e0 - 7200000 AS zoned_ms FROM readings"""))
def event_time(spark, sf_dir):
    text = F.col("timestamp")
    return readings(spark, sf_dir).select(
        "event_id", C.event_ts_ms(text).alias("plain_ms"),
        C.event_ts_ms(F.concat(text, F.lit("+02:00"))).alias("zoned_ms"),
    )


# --- reports


@register("temperature_report", sql("""SELECT city, round(avg(temperature), 6) AS avg_temp,
  min(temperature) AS min_temp, max(temperature) AS max_temp FROM readings WHERE city IS NOT NULL GROUP BY city"""))
def temperature_report(spark, sf_dir):
    return rounded(R.temperature_report(readings(spark, sf_dir)), "avg_temp")


@register("daily_summary", sql("""SELECT city, round(avg(temperature), 6) AS avg_temp,
  min(temperature) AS min_temp, max(temperature) AS max_temp, round(avg(humidity), 6) AS avg_humidity
  FROM enriched WHERE city IS NOT NULL GROUP BY city""", True))
def daily_summary(spark, sf_dir):
    return rounded(R.daily_summary(enriched(spark, sf_dir)), "avg_temp", "avg_humidity")


@register("records_by_city", sql(
    "SELECT city, count(*) AS records FROM readings WHERE city IS NOT NULL GROUP BY city"))
def records_by_city(spark, sf_dir):
    return R.records_by_city(readings(spark, sf_dir))


_KEYED = "city IS NOT NULL AND weather_condition IS NOT NULL"


@register("condition_counts", sql(f"""SELECT city, weather_condition, count(*) AS count FROM readings
  WHERE {_KEYED} GROUP BY ALL"""))
def condition_counts(spark, sf_dir):
    return R.condition_counts(readings(spark, sf_dir))


@register("severity_counts", sql("""SELECT city, weather_severity, count(*) AS count FROM enriched
  WHERE city IS NOT NULL GROUP BY ALL""", True))
def severity_counts(spark, sf_dir):
    return R.severity_counts(enriched(spark, sf_dir))


_CONDITIONS = ("Clear", "Fog", "Light rain", "Partly cloudy", "Thunderstorm")


@register("condition_pivot", sql("SELECT city, " + ", ".join(
    f"count(*) FILTER (weather_condition = '{c}') AS \"{c}\"" for c in _CONDITIONS
) + f" FROM readings WHERE {_KEYED} GROUP BY city"))
def condition_pivot(spark, sf_dir):
    return R.condition_report(readings(spark, sf_dir))


@register("severity_pivot", sql("SELECT city, " + ", ".join(
    f"count(*) FILTER (weather_severity = '{c}') AS {c}" for c in ("normal", "mild", "moderate", "severe")
) + " FROM enriched WHERE city IS NOT NULL GROUP BY city", True))
def severity_pivot(spark, sf_dir):
    return R.severity_report(enriched(spark, sf_dir))


_METRICS = ("temperature", "humidity", "pressure")
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS x FROM readings" for m in _METRICS)
_MOMENTS = """metric, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stddev,
  min(x) AS min, max(x) AS max"""


@register("describe_metrics", sql(f"SELECT {_MOMENTS} FROM ({_LONG}) GROUP BY metric"))
def describe_metrics(spark, sf_dir):
    return rounded(R.describe_metrics(readings(spark, sf_dir)), "mean", "stddev")


@register("describe_quartiles", sql(f"""SELECT {_MOMENTS}, round(quantile_cont(x, 0.25), 6) AS p25,
  round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75
  FROM ({_LONG}) GROUP BY metric"""))
def describe_quartiles(spark, sf_dir):
    out = R.describe_metrics(readings(spark, sf_dir), quartiles=True)
    return rounded(out, "mean", "stddev", "p25", "p50", "p75")


_DOMINANT = f"""counted AS (SELECT city, weather_condition, weather_severity, count(*) AS n FROM enriched
  WHERE {_KEYED} GROUP BY ALL),
totals AS (SELECT city, weather_condition, sum(n) AS total FROM counted GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY total DESC, weather_condition) AS r FROM totals),
level AS (SELECT c.*, row_number() OVER (PARTITION BY city, weather_condition ORDER BY n DESC, weather_severity) AS s
  FROM counted c)"""


@register("dominant_condition", f"""WITH {READINGS}, {ENRICHED}, {_DOMINANT}
  SELECT b.city, b.weather_condition, l.weather_severity FROM best b JOIN level l
  ON b.city = l.city AND b.weather_condition = l.weather_condition WHERE r = 1 AND s = 1""")
def dominant_condition(spark, sf_dir):
    return R.dominant_condition(enriched(spark, sf_dir))


@register("condition_share", sql(f"""SELECT city, weather_condition, count(*) AS count,
  round(count(*) * 100.0e0 / sum(count(*)) OVER (PARTITION BY city), 6) AS percent
  FROM readings WHERE {_KEYED} GROUP BY city, weather_condition"""))
def condition_share(spark, sf_dir):
    return rounded(R.condition_share(readings(spark, sf_dir)), "percent")


@register("cities", sql("SELECT DISTINCT city FROM readings WHERE city IS NOT NULL ORDER BY city"))
def cities(spark, sf_dir):
    return R.cities(readings(spark, sf_dir))


# --- filters

_PLAIN = "event_id, city, temperature, timestamp"
_PLAIN_COLUMNS = ("event_id", "city", "temperature", "timestamp")


@register("filter_cities_range", sql(f"""SELECT {_PLAIN} FROM readings WHERE city IN ('City 1', 'City 3')
  AND event_ts >= TIMESTAMP '2024-01-05 06:00:00' AND event_ts <= TIMESTAMP '2024-01-20 18:30:00'"""))
def filter_cities_range(spark, sf_dir):
    rows = FL.filter_cities(readings(spark, sf_dir), ["City 1", "City 3"])
    return FL.filter_range(rows, "2024-01-05T06:00:00", "2024-01-20T18:30:00").select(*_PLAIN_COLUMNS)


@register("filter_days", sql(f"""SELECT {_PLAIN} FROM readings
  WHERE event_ts >= TIMESTAMP '2024-01-03' AND event_ts <= TIMESTAMP '2024-01-11'"""))
def filter_days(spark, sf_dir):
    return FL.filter_days(readings(spark, sf_dir), "2024-01-03", "2024-01-10").select(*_PLAIN_COLUMNS)


@register("severe_alerts", sql("""SELECT city, weather_condition, temperature, humidity, wind_speed, timestamp
  FROM enriched WHERE weather_severity = 'severe'""", True))
def severe_alerts(spark, sf_dir):
    return FL.severe_alerts(enriched(spark, sf_dir))


@register("severe_alerts_report", sql("""SELECT city, weather_condition, temperature, wind_speed
  FROM enriched WHERE weather_severity = 'severe' AND city IN ('City 0', 'City 2')""", True))
def severe_alerts_report(spark, sf_dir):
    return FL.severe_alerts(enriched(spark, sf_dir), ["City 0", "City 2"], report=True)


_BAD_TIME = """CASE event_id % 7 WHEN 0 THEN 'not a time' WHEN 1 THEN NULL
  WHEN 2 THEN replace(timestamp, 'T', ' ') WHEN 3 THEN timestamp || 'Z'
  WHEN 4 THEN substr(timestamp, 1, 10) WHEN 5 THEN timestamp || '-03:30' ELSE timestamp END"""


@register("drop_invalid_ts", sql("""SELECT event_id, epoch_us(CASE event_id % 7
  WHEN 4 THEN date_trunc('day', event_ts) WHEN 5 THEN event_ts + INTERVAL 210 MINUTE ELSE event_ts END) AS event_us
  FROM readings WHERE event_id % 7 > 1"""))
def drop_invalid_ts(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("timestamp", F.expr(_BAD_TIME)).drop("event_ts")
    return FL.drop_invalid_ts(rows).select("event_id", F.unix_micros("event_ts").alias("event_us"))


@register("valid_points", sql(f"""SELECT {_PLAIN} FROM readings WHERE city IS NOT NULL
  AND temperature IS NOT NULL AND humidity IS NOT NULL AND wind_speed IS NOT NULL"""))
def valid_points(spark, sf_dir):
    return FL.valid_points(readings(spark, sf_dir)).select(*_PLAIN_COLUMNS)


@register("city_readings", sql(f"SELECT {_PLAIN} FROM readings WHERE city = 'City 4'"))
def city_readings(spark, sf_dir):
    return FL.city_readings(readings(spark, sf_dir), "City 4").select(*_PLAIN_COLUMNS)


@register("latest_day", sql(f"""SELECT {_PLAIN} FROM readings
  WHERE event_ts >= (SELECT max(event_ts) FROM readings) - INTERVAL 1 DAY"""))
def latest_day(spark, sf_dir):
    return FL.latest_day(readings(spark, sf_dir)).select(*_PLAIN_COLUMNS)


@register("newest_timestamp", sql("SELECT epoch_us(max(event_ts)) AS newest FROM readings"))
def newest_timestamp(spark, sf_dir):
    return R.newest_timestamp(readings(spark, sf_dir)).select(F.unix_micros("newest").alias("newest"))


# --- dashboard views

_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY city ORDER BY event_ts DESC, event_id DESC) AS rank FROM {source}))"""


@register("latest_per_city", f"""WITH {READINGS}, {_LATEST.format(source='readings')}
  SELECT event_id, city, source, temperature, timestamp FROM latest WHERE rank = 1""")
def latest_per_city(spark, sf_dir):
    return VW.latest_per_city(readings(spark, sf_dir)).select(
        "event_id", "city", "source", "temperature", "timestamp"
    )


@register("first_per_city", sql("""SELECT event_id, city, temperature FROM (SELECT *, row_number() OVER (
  PARTITION BY city ORDER BY event_id) AS r FROM readings) WHERE r = 1"""))
def first_per_city(spark, sf_dir):
    return VW.first_per_city(readings(spark, sf_dir)).select("event_id", "city", "temperature")


@register("last5_per_city", f"""WITH {READINGS}, {_LATEST.format(source='readings')}
  SELECT event_id, city, rank, humidity, wind_speed FROM latest WHERE rank <= 5""")
def last5_per_city(spark, sf_dir):
    return VW.last_n_per_city(readings(spark, sf_dir)).select(
        "event_id", "city", F.col("rank").cast("long").alias("rank"), "humidity", "wind_speed"
    )


@register("city_cards", f"""WITH {READINGS}, {ENRICHED}, {_LATEST.format(source='enriched')}
  SELECT event_id, city, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, temperature, humidity, lat, lon,
  weather_condition, weather_severity, round(heat_index_fahrenheit, 6) AS heat_index_fahrenheit,
  CASE weather_condition WHEN 'Clear' THEN '☀️' WHEN 'Partly cloudy' THEN '☁️' WHEN 'Light rain' THEN '🌧️'
    WHEN 'Thunderstorm' THEN '⛈️' WHEN 'Fog' THEN '🌫️' ELSE '🌤️' END AS weather_icon,
  CASE WHEN coalesce(temperature, 0) < 0 THEN '#9ec5fe' WHEN coalesce(temperature, 0) < 10 THEN '#6ea8fe'
    WHEN temperature < 20 THEN '#a3cfbb' WHEN temperature < 30 THEN '#ffda6a' ELSE '#ea868f' END AS temp_color
  FROM latest WHERE rank = 1""")
def city_cards(spark, sf_dir):
    cards = VW.city_cards(enriched(spark, sf_dir)).select(
        "event_id", "city", "event_ts", "temperature", "humidity", F.col("coordinates.lat").alias("lat"),
        F.col("coordinates.lon").alias("lon"), "weather_condition", "weather_severity",
        "heat_index_fahrenheit", "weather_icon", "temp_color",
    )
    return rounded(cards, "heat_index_fahrenheit")


@register("temperature_map", f"""WITH {READINGS}, chosen AS (SELECT * FROM readings
  WHERE city IN ('City 0', 'City 1', 'City 2')),
recent AS (SELECT * FROM chosen WHERE event_ts >= (SELECT max(event_ts) FROM chosen) - INTERVAL 1 DAY),
{_LATEST.format(source='recent')}
  SELECT event_id, city, temperature, coalesce(lat, 0) AS lat, coalesce(lon, 0) AS lon,
  greatest(abs(temperature), 5.0e0) AS temperature_size FROM latest WHERE rank = 1""")
def temperature_map(spark, sf_dir):
    return VW.temperature_map(readings(spark, sf_dir), ["City 0", "City 1", "City 2"]).select(
        "event_id", "city", "temperature", "lat", "lon", "temperature_size"
    )


@register("metric_series", sql("""SELECT timestamp, humidity, city FROM readings
  WHERE city IN ('City 1', 'City 2') AND event_ts >= TIMESTAMP '2024-01-10'"""))
def metric_series(spark, sf_dir):
    return VW.metric_series(readings(spark, sf_dir), "humidity", ["City 1", "City 2"], start="2024-01-10")


@register("severity_chart", sql("""SELECT city, weather_severity, count(*) AS count FROM enriched
  WHERE city IN ('City 1', 'City 2') AND event_ts >= TIMESTAMP '2024-01-02'
  AND event_ts <= TIMESTAMP '2024-01-16' GROUP BY ALL""", True))
def severity_chart(spark, sf_dir):
    return VW.severity_chart(enriched(spark, sf_dir), ["City 1", "City 2"], "2024-01-02", "2024-01-15")


@register("data_table", sql("""SELECT coalesce(city, 'N/A') AS city, timestamp,
  coalesce(temperature::VARCHAR, 'N/A') AS temperature, coalesce(humidity::VARCHAR, 'N/A') AS humidity,
  pressure::VARCHAR AS pressure, wind_speed::VARCHAR AS wind_speed,
  coalesce(weather_condition, 'N/A') AS weather_condition FROM readings"""))
def data_table(spark, sf_dir):
    return VW.data_table(readings(spark, sf_dir))


@register("json_safe", sql("""SELECT event_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts,
  CASE WHEN humidity > 0 THEN round(pressure / humidity, 6) END AS ratio, lat FROM readings"""))
def json_safe(spark, sf_dir):
    infinite = F.when(F.col("humidity") == 0, F.lit(float("inf"))).otherwise(
        F.round(F.col("pressure") / F.nullif(F.col("humidity"), F.lit(0.0)), 6)
    )
    rows = readings(spark, sf_dir).withColumn("ratio", infinite)
    return VW.json_safe(rows.select("event_id", "event_ts", "ratio", "coordinates")).select(
        "event_id", "event_ts", "ratio", F.col("coordinates.lat").alias("lat")
    )


@register("sorted_by_time", sql("SELECT event_id, timestamp FROM readings ORDER BY event_ts, event_id"))
def sorted_by_time(spark, sf_dir):
    return VW.sorted_by_time(readings(spark, sf_dir)).select("event_id", "timestamp")
