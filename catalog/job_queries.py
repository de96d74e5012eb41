"""Whole jobs, report tables, retention, faulty payloads and lenient numbers."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from catalog.core_queries import ENRICHED
from catalog.feed_queries import _SCHEMA, _STORED
from catalog.readings import READINGS, readings
from catalog.registry import register
from skygauge import fixed_values as V
from skygauge.functions import scalars as C
from skygauge.operators import metrics as M, normalize as N
from skygauge.plans import jobs as J
from skygauge.sources import files as S, sinks as W
from skygauge.sources.shared import new_path

_NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)
_CONDITIONS = ("Clear", "Light rain", "Partly cloudy", "Thunderstorm", "Fog")


def sql(body: str) -> str:
    return f"WITH {READINGS} {body}"


def _landed(spark, sf_dir, name):
    path = new_path(spark, name)
    W.land_raw(readings(spark, sf_dir).select(*_STORED, "weather_description", "pressure", "wind_speed"), path)
    return path


# --- numbers in text

_TEXT = """CASE event_id % 11 WHEN 0 THEN ' 12.5 ' WHEN 1 THEN '1_000' WHEN 2 THEN 'abc' WHEN 3 THEN '1e3'
  WHEN 4 THEN '0x10' WHEN 5 THEN 'NaN' WHEN 6 THEN '12f' WHEN 7 THEN '' WHEN 8 THEN '-inf' WHEN 9 THEN '+.5'
  ELSE CAST(pressure AS STRING) END"""


@register("lenient_numbers", sql("""SELECT event_id, CASE event_id % 11 WHEN 0 THEN 12.5e0 WHEN 1 THEN 1000.0e0
    WHEN 3 THEN 1000.0e0 WHEN 9 THEN 0.5e0 WHEN 10 THEN pressure END AS number, event_id % 11 = 5 AS is_nan,
  event_id % 11 = 8 AS is_infinite, CASE event_id % 11 WHEN 0 THEN 12.5e0 WHEN 1 THEN 1000.0e0 WHEN 3 THEN 1000.0e0
    WHEN 9 THEN 0.5e0 WHEN 10 THEN pressure WHEN 8 THEN -1.0e300 ELSE 0.0e0 END AS chart_value FROM readings"""))
def lenient_numbers(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("text", F.expr(_TEXT))
    number = C.safe_double("text")
    return rows.select(
        "event_id", C.finite_or_null(number).alias("number"), F.coalesce(F.isnan(number), F.lit(False)).alias("is_nan"),
        F.coalesce(F.abs(number) == float("inf"), F.lit(False)).alias("is_infinite"),
        F.greatest(C.num_or_zero("text"), F.lit(-1e300)).alias("chart_value"),
    )


# --- faulty payloads


@register("normalize_faults", sql("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN pressure WHEN 2 THEN NULL
    WHEN 3 THEN 0.0e0 WHEN 4 THEN NULL ELSE pressure END AS temperature,
  CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 5 THEN 'Here' ELSE 'Unknown' END AS city,
  CASE WHEN event_id % 6 = 0 THEN '{broken ' || event_id::VARCHAR END AS corrupt FROM readings"""))
def normalize_faults(spark, sf_dir):
    """Broken payloads, numbers in quotes, other text, absent keys and nulls."""
    payload = F.expr("""CASE event_id % 6 WHEN 0 THEN '{broken ' || event_id
      WHEN 1 THEN '{"main": {"temp": "' || pressure || '"}}' WHEN 2 THEN '{"main": {"temp": "warm"}}'
      WHEN 3 THEN '{"main": {"humidity": 5}}' WHEN 4 THEN '{"main": {"temp": null}}'
      ELSE '{"name": "Here", "main": {"temp": ' || pressure || '}}' END""")
    rows = readings(spark, sf_dir).select("event_id", payload.alias("payload"))
    out = N.normalize_openweather(rows, defaults=True, keep=["event_id"])
    return out.select("event_id", "temperature", "city", F.col(S.CORRUPT).alias("corrupt"))


# --- jobs


@register("inferred_job", f"""WITH {READINGS}, {ENRICHED}
  SELECT event_id, city, round(t, 6) AS temperature_fahrenheit, weather_severity FROM enriched""")
def inferred_job(spark, sf_dir):
    """The batch job on files whose schema it finds out itself."""
    done = J.run_batch(
        spark, _landed(spark, sf_dir, "inferred-raw"), new_path(spark, "inferred"), formats=("parquet",), now=_NOW,
        schema=None, lines=True,
    )
    out = S.read_processed_parquet(spark, done["folders"]["parquet"])
    return out.select("event_id", "city", F.round("temperature_fahrenheit", 6).alias("temperature_fahrenheit"), "weather_severity")


_KEYED = "city IS NOT NULL"
_REPORTS = f"""WITH {READINGS}, {ENRICHED}, by_city AS (SELECT city, avg(temperature) AS a, min(temperature) AS l,
    max(temperature) AS h, avg(humidity) AS u FROM enriched WHERE {_KEYED} GROUP BY city),
  pairs AS (SELECT city, weather_condition AS c, weather_severity AS s, count(*) AS n FROM enriched
    WHERE {_KEYED} AND weather_condition IS NOT NULL GROUP BY ALL),
  top AS (SELECT city, c, row_number() OVER (PARTITION BY city ORDER BY sum(n) DESC, c) AS r FROM pairs GROUP BY city, c),
  kinds AS (SELECT city, c, s, row_number() OVER (PARTITION BY city, c ORDER BY n DESC, s) AS r FROM pairs)
SELECT 'temperature_report' AS report, city, 'avg_temp' AS detail, round(a, 6) AS value FROM by_city
UNION ALL SELECT 'temperature_report', city, 'min_temp', round(l, 6) FROM by_city
UNION ALL SELECT 'temperature_report', city, 'max_temp', round(h, 6) FROM by_city
UNION ALL SELECT 'daily_summary', city, 'avg_temp', round(a, 6) FROM by_city
UNION ALL SELECT 'daily_summary', city, 'min_temp', round(l, 6) FROM by_city
UNION ALL SELECT 'daily_summary', city, 'max_temp', round(h, 6) FROM by_city
UNION ALL SELECT 'daily_summary', city, 'avg_humidity', round(u, 6) FROM by_city
""" + "".join(f"""UNION ALL SELECT 'weather_condition_report', city, '{c}', (SELECT count(*) FROM enriched e
  WHERE e.city = b.city AND e.weather_condition = '{c}')::DOUBLE FROM by_city b
""" for c in _CONDITIONS) + "".join(f"""UNION ALL SELECT 'weather_severity_report', city, '{s}', (SELECT count(*) FROM enriched e
  WHERE e.city = b.city AND e.weather_severity = '{s}')::DOUBLE FROM by_city b
""" for s in V.SEVERITY_LEVELS) + """UNION ALL SELECT 'severe_alerts', city, weather_condition, count(*)::DOUBLE FROM enriched
  WHERE weather_severity = 'severe' GROUP BY ALL
UNION ALL SELECT 'dominant_condition', t.city, t.c || ': ' || upper(k.s[1]) || lower(k.s[2:]), 1.0 FROM top t
  JOIN kinds k ON t.city = k.city AND t.c = k.c WHERE t.r = 1 AND k.r = 1"""


@register("report_tables", _REPORTS)
def report_tables(spark, sf_dir):
    """The report job's six tables, read back from its files, in long form."""
    paths = J.run_reports(
        spark, _landed(spark, sf_dir, "tables-raw"), new_path(spark, "tables"), schema=_SCHEMA, lines=True,
        conditions=list(_CONDITIONS),
    )
    out = None
    for name in ("temperature_report", "daily_summary", "weather_condition_report", "weather_severity_report"):
        table = spark.read.option("header", True).csv(paths[name])
        values = [F.round(F.col(f"`{c}`").cast("double"), 6).alias(c) for c in table.columns if c != "city"]
        long = table.select("city", *values).unpivot(["city"], None, "detail", "value").select(F.lit(name).alias("report"), "city", "detail", "value")
        out = long if out is None else out.unionByName(long)
    alerts = spark.read.option("header", True).csv(paths["severe_alerts"]).groupBy("city", "weather_condition").count()
    dominant = spark.read.option("header", True).csv(paths["dominant_condition"])
    out = out.unionByName(dominant.select(
        F.lit("dominant_condition").alias("report"), "city",
        F.concat_ws(": ", "weather_condition", "weather_severity").alias("detail"), F.lit(1.0).alias("value")))
    return out.unionByName(alerts.select(
        F.lit("severe_alerts").alias("report"), "city", F.col("weather_condition").alias("detail"), F.col("count").cast("double").alias("value")
    ))


@register("chain_job", f"""WITH {READINGS}, {ENRICHED} SELECT 'processed' AS step, count(*) AS n FROM enriched
  UNION ALL SELECT 'reports', 6 UNION ALL SELECT 'cities', count(DISTINCT city) FROM enriched""")
def chain_job(spark, sf_dir):
    """Collect, process and report in a row: the collecting step lands the raw files."""
    raw = new_path(spark, "chain-raw")
    done = J.run_chain(
        spark, lambda: W.land_raw(readings(spark, sf_dir).select(*_STORED), raw), raw, new_path(spark, "chain"),
        new_path(spark, "chain-reports"), schema=_SCHEMA, lines=True, conditions=list(_CONDITIONS),
    )
    cities = spark.read.option("header", True).csv(done["reports"]["daily_summary"]).count()
    rows = [("processed", done["batch"]["records"]), ("reports", len(done["reports"])), ("cities", cities)]
    return spark.createDataFrame(rows, "step string, n long")


@register("retained_files", sql("""SELECT CAST(event_ts AS DATE)::VARCHAR AS event_date, count(*) AS events FROM readings
  WHERE event_ts > TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 31 DAY GROUP BY ALL"""))
def retained_files(spark, sf_dir):
    """The zone after its expired days were dropped and its border day rewritten."""
    path, now = new_path(spark, "retained"), F.timestamp_micros(F.lit(1707566400000000))
    rows = W.with_event_date(readings(spark, sf_dir).select("event_ts", *_STORED))
    rows.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(path)
    W.retain_zone(spark, path, now=now)
    back = S.read_processed_parquet(spark, path)
    return back.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count(F.lit(1)).alias("events"))


@register("zone_volume", sql("SELECT count(*) AS records, true AS has_bytes FROM readings"))
def zone_volume(spark, sf_dir):
    path = W.write_batch(readings(spark, sf_dir).select(*_STORED), new_path(spark, "zone"), "parquet", "run")
    volume = M.zone_volume(S.read_processed_parquet(spark, path))
    return volume.select("records", (F.col("bytes") > 0).alias("has_bytes"))
