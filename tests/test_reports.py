import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skygauge.operators.ordered import exact_quantiles
from skygauge.operators import filters as FL, metrics as M, ordered as R_ordered, reports as R, views as VW
from skygauge.operators.enrich import enrich, with_severity
from skygauge.operators.ordered import exact_quantiles

NAN = float("nan")
ROWS = [
    (1, "A", 10.0, 40.0, "Clear", "2024-01-01T00:00:00"), (2, "A", NAN, 50.0, "Fog", "2024-01-02T00:00:00"),
    (3, "A", 20.0, None, "Fog", "2024-01-02T12:00:00"), (4, "A", None, 60.0, "Clear", "2024-01-02T12:00:00"),
    (5, "B", -5.0, 10.0, "Tornado", "2024-01-01T00:00:00"), (6, None, 99.0, 1.0, "Clear", "2024-01-03T00:00:00"),
    (7, "B", -6.0, 20.0, None, "bad"),
]


@pytest.fixture
def frame(spark):
    schema = "event_id long, city string, temperature double, humidity double, weather_condition string, timestamp string"
    rows = FL.with_event_ts(spark.createDataFrame(ROWS, schema))
    return with_severity(rows.withColumns({"pressure": F.lit(1000.0), "wind_speed": F.lit(1.0)}))


def pdf():
    return pd.DataFrame(ROWS, columns=["event_id", "city", "temperature", "humidity", "weather_condition", "timestamp"])


def test_reports_follow_pandas(frame):
    want = pdf().groupby("city")["temperature"].agg(["mean", "min", "max"])
    got = {r.city: (r.avg_temp, r.min_temp, r.max_temp) for r in R.temperature_report(frame).collect()}
    assert got == {c: tuple(want.loc[c]) for c in want.index}
    humidity = pdf().groupby("city")["humidity"].mean()
    assert {r.city: r.avg_humidity for r in R.daily_summary(frame).collect()} == dict(humidity)
    counts = pdf().groupby(["city", "weather_condition"]).size()
    assert {(r.city, r.weather_condition): r["count"] for r in R.condition_counts(frame).collect()} == dict(counts)


def test_pivots(frame):
    severity = R.severity_report(frame)
    assert severity.columns == ["city", "normal", "mild", "moderate", "severe"]
    assert {tuple(r) for r in severity.collect()} == {("A", 2, 0, 2, 0), ("B", 1, 0, 0, 1)}
    assert {tuple(r) for r in R.condition_report(frame, ["Fog", "Hail"]).collect()} == {("A", 2, 0), ("B", 0, 0)}


def test_dominant_condition_ties(frame):
    got = {r.city: (r.weather_condition, r.weather_severity) for r in R.condition_summary(frame).collect()}
    assert got == {"A": ("Clear", "Normal"), "B": ("Tornado", "Severe")}


def test_describe_like_pandas(frame):
    want = pdf()[["temperature", "humidity"]].describe()
    for r in R.describe_metrics(frame, ["temperature", "humidity"], quartiles=True).collect():
        w = want[r.metric]
        assert (r["count"], r.min, r.max) == (w["count"], w["min"], w["max"])
        assert [r.mean, r.stddev, r.p25, r.p50, r.p75] == pytest.approx(
            [w["mean"], w["std"], w["25%"], w["50%"], w["75%"]])


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_exact_quantiles_both_ways(spark, limit):
    rnd = np.random.default_rng(2)
    data = pd.DataFrame({"a": rnd.integers(0, 40, 997).astype(float), "b": rnd.normal(size=997)})
    got = exact_quantiles(spark.createDataFrame(data), ["a", "b"], [0.0, 0.25, 0.5, 0.95, 1.0], limit)
    rows = got.collect()
    assert len(rows) == 10
    for r in rows:
        assert r.value == pytest.approx(data[r.metric].quantile(r.probability), abs=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "a double")
    assert exact_quantiles(empty, ["a"], [0.5]).count() == 0


def test_views(frame):
    ids = {r.city: r.event_id for r in VW.latest_per_city(frame).collect()}
    assert ids == {"A": 4, "B": 5, None: 6}
    assert {r.city: r.event_id for r in VW.first_per_city(frame).collect()} == {"A": 1, "B": 5, None: 6}
    last = VW.last_n_per_city(frame.where("city = 'A'"), 2).orderBy("rank").collect()
    assert [r.event_id for r in last] == [4, 3]
    table = {r.timestamp: r for r in VW.data_table(frame.where("city = 'A'")).collect()}
    assert table["2024-01-01T00:00:00"].temperature == "10.0"
    cards = {r.city: r for r in VW.city_cards(frame).collect()}
    assert (cards["B"].weather_icon, cards["B"].temp_color, cards["B"].event_ts) == (
        "🌤️", "#9ec5fe", "2024-01-01 00:00:00")


def test_json_safe(spark):
    row = spark.createDataFrame(
        [(NAN, (float("inf"), 1.0), datetime(2024, 1, 1, 5), {"z": NAN}, [1])],
        "a double, s struct<x double, y double>, t timestamp_ntz, m map<string,double>, l array<int>")
    safe = VW.json_safe(row).first()
    assert (safe.a, tuple(safe.s), safe.t, safe.m, safe.l) == (None, (None, 1.0), "2024-01-01 05:00:00", {"z": None}, "[1]")


def test_filters(frame):
    def ids(df):
        return sorted(r.event_id for r in df.collect())

    assert ids(FL.filter_cities(frame, [])) == ids(FL.filter_cities(frame, None)) == list(range(1, 8))
    assert ids(FL.filter_cities(frame, ["B"])) == [5, 7]
    assert ids(FL.filter_range(frame, "2024-01-02", "2024-01-02T12:00:00")) == [2, 3, 4]
    assert ids(FL.filter_range(frame, end="2024-01-01")) == [1, 5]
    assert ids(FL.filter_days(frame, "2024-01-01", "2024-01-01")) == [1, 2, 5]
    assert len(ids(FL.filter_days(frame, "2024-01-01"))) == 7
    assert ids(FL.latest_day(frame)) == [2, 3, 4, 6]
    assert ids(FL.latest_day(frame, "2024-01-02")) == [1, 2, 3, 4, 5, 6]
    assert ids(FL.drop_invalid_ts(frame)) == [1, 2, 3, 4, 5, 6]
    assert ids(FL.valid_points(frame)) == [1, 2, 5, 7]
    assert ids(FL.require_fields(frame, ["city", "humidity"])) == [1, 2, 4, 5, 7]
    assert FL.severe_alerts(frame, report=True).columns == ["city", "weather_condition", "temperature", "wind_speed"]
    assert FL.city_readings(frame, "Z").count() == 0


def test_require_fields_counts_null_as_present(spark):
    rows = spark.createDataFrame([('{"a": null, "b": 1}',), ('{"b": 1}',), ("x",)], "value string")
    assert FL.require_fields(rows, ["a", "b"], "value").count() == 1


def test_one_processed_time_per_batch(frame):
    out = enrich(frame, now=datetime(2024, 1, 1, 2, 3, 4, 5)).select("processed_timestamp").distinct().collect()
    assert [r[0] for r in out] == ["2024-01-01T02:03:04.000005Z"]


def messages(spark, n=60, parts=2):
    rows = [(i % parts, i // parts, 1000.0 + i * (1 + i % parts), "2024-01-01T00:00:00Z" if i % 7 else "x") for i in range(n)]
    frame = spark.createDataFrame(rows, "partition int, offset long, at double, timestamp string")
    return rows, frame.withColumn("processed_at", F.timestamp_micros((F.col("at") * 1e6).cast("long")))


@pytest.mark.parametrize("step", [1, 2, 4096])
def test_stream_metrics(spark, step):
    rows, frame = messages(spark)
    got = {}
    for r in M.stream_metrics(M.with_latency(frame), 25, step=step).collect():
        got[r.kafka_partition, r.kafka_offset] = (r.window_messages, r.window_seconds, r.throughput_mps)
    want = {}
    for part in (0, 1):
        mine = [r for r in rows if r[0] == part]
        previous = mine[0][2]
        for at in range(0, len(mine), 25):
            window = mine[at:at + 25]
            seconds = max(1e-6, window[-1][2] - previous)
            want[part, window[-1][1]] = (len(window), pytest.approx(seconds), pytest.approx(len(window) / seconds))
            previous = window[-1][2]
    assert got == want and {v[0] for v in got.values()} == {25, 5}


def test_latency(spark):
    rows = spark.createDataFrame(
        [("1970-01-01T00:00:01Z",), ("1970-01-01T00:00:09",), ("x",), (None,)], "timestamp string")
    timed = rows.withColumn("processed_at", F.timestamp_micros(F.lit(5_000_500)))
    assert [r.latency_ms for r in M.with_latency(timed).collect()] == [4000.5, 0.0, None, None]
    epoch = timed.withColumn("ingest_ts_unix_ms", F.lit(4000))
    assert M.with_latency(epoch, timestamp_col="ingest_ts_unix_ms").first().latency_ms == 1000.5


def test_metrics_summary(spark):
    _, frame = messages(spark, 400, 1)
    metrics = M.stream_metrics(M.with_latency(frame), 25)
    data = metrics.toPandas()
    exact, rough = M.metrics_summary(metrics).first(), M.metrics_summary(metrics, approximate=True).first()
    assert (exact.events, exact.windows, rough.events) == (400, 16, 400)
    assert exact.median_latency_ms == pytest.approx(data.avg_latency_ms.quantile(0.5))
    assert exact.p95_throughput_mps == pytest.approx(data.throughput_mps.quantile(0.95))
    assert rough.median_latency_ms in list(data.avg_latency_ms)
    assert not math.isnan(exact.p95_latency_ms)


def test_observed_counts(spark, tmp_path):
    frame, seen = R.run_counts(spark.range(10), "n")
    frame.write.format("noop").mode("overwrite").save()
    assert seen.get["records"] == 10
    parsed = spark.createDataFrame([(None,), ("bad",)], "_corrupt string")
    frame, seen = R.observe_parse(parsed)
    frame.write.format("noop").mode("overwrite").save()
    assert seen.get == {"processed": 1, "failed": 1}


def test_zone_volume(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "z"))
    volume = M.zone_volume(spark.read.parquet(str(tmp_path / "z"))).first()
    assert volume.records == 100 and volume.bytes > 0


def test_both_forms_of_quantiles_agree_to_the_bit(spark):
    rows = [(i, ((i * 7919) % 997) / 7.0, None if i % 5 else float(i)) for i in range(1000)]
    frame = spark.createDataFrame(rows, "i long, a double, b double")
    at = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.95, 1.0]
    forms = [
        sorted(tuple(r) for r in exact_quantiles(frame, ["a", "b"], at, few_values=few).select("metric", "probability", "value").collect())
        for few in (True, False)
    ]
    assert forms[0] == forms[1] and len(forms[0]) == 14


def test_windows_go_on_across_cuts(spark):
    """Any cut of the same messages gives the same closed windows; the open ones make up the rest."""
    rows, frame = messages(spark, 330, 3)
    timed = M.with_latency(frame)
    whole = {(r.kafka_partition, r.kafka_offset): r for r in M.stream_metrics(timed, 25).collect()}
    for cuts in ([40], [1, 2, 26, 27, 100], [25, 50, 75]):
        got, state, open_ = [], None, []
        for low, high in zip([0, *cuts], [*cuts, 10**6]):
            new = M.message_windows(timed.where(f"offset >= {low} and offset < {high}"), 25)
            closed, still, carried = M.live_windows(new, state, 25)
            got += closed.collect()
            open_, state = still.collect(), spark.createDataFrame(carried.collect(), carried.schema)
        assert len({(r.kafka_partition, r.kafka_offset) for r in got + open_}) == len(got + open_) == len(whole)
        for r in got + open_:
            want = whole[r.kafka_partition, r.kafka_offset]
            assert r.window_messages == want.window_messages and r.ts_utc == want.ts_utc
            assert r.avg_latency_ms == pytest.approx(want.avg_latency_ms)
            assert r.window_seconds == pytest.approx(want.window_seconds)


@pytest.mark.parametrize("n, accuracy, bracket_rows", [(1, 10_000, 10 ** 6), (2, 10_000, 10 ** 6), (7, 10_000, 10 ** 6), (300, 10_000, 10 ** 6), (9000, 50, 10)])
def test_bracketed_quantiles_are_exact(spark, n, accuracy, bracket_rows):
    rnd = np.random.default_rng(n)
    data = pd.DataFrame({
        "a": rnd.integers(0, 3, n).astype(float), "b": rnd.normal(size=n), "c": np.full(n, 4.0),
        "d": np.where(rnd.random(n) < 0.3, np.nan, rnd.lognormal(0, 9, n)), "e": np.full(n, np.nan)})
    data.loc[0, "b"] = np.inf
    at = [0.0, 0.25, 0.95, 1.0]
    frame = spark.createDataFrame(data).repartition(3)
    got = {(r.metric, r.probability): r.value for r in exact_quantiles(frame, list(data), at, accuracy=accuracy, bracket_rows=bracket_rows).collect()}
    few = {(r.metric, r.probability): r.value for r in exact_quantiles(frame, list(data), at, few_values=True).collect()}
    assert set(got) == set(few) and all(got[k] == few[k] or got[k] != got[k] and few[k] != few[k] for k in few)
    assert len(got) == len(at) * sum(data[c].notna().any() for c in data)


def test_brackets_hold_few_values(spark):
    frame = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    brackets = R_ordered.quantile_brackets(frame, ["x"], [0.5], accuracy=1000, bracket_rows=100)
    counted = R_ordered.bracket_counts(frame, ["x"], brackets)
    assert counted.count() <= 102
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Sort" not in text


def test_conditions_beyond_the_pivots_limit(spark):
    spark.conf.set("spark.sql.pivotMaxValues", 3)
    try:
        rows = [(c, f"kind {k}.`x`") for c in "AB" for k in range(12) for _ in range(k) if (c, k) != ("B", 5)] + [(None, "kind 1.`x`"), ("A", None)]
        frame = spark.createDataFrame(rows, "city string, weather_condition string")
        got = {r.city: tuple(r)[1:] for r in R.condition_report(frame, group=5).collect()}
        names = sorted(f"kind {k}.`x`" for k in range(1, 12))
        assert R.condition_report(frame, group=5).columns == ["city", *names]
        want = {c: tuple(rows.count((c, n)) for n in names) for c in "AB"}
        assert {c: got[c] for c in "AB"} == want and 0 in got["B"]
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_tables_roll_up_from_one_frame_of_counts(frame):
    tables, counts = R.rolled_up(R.report_counts(frame)), R.report_counts(frame)
    one_by_one = {
        "temperature_report": R.temperature_report(frame), "weather_condition_report": R.condition_report(frame),
        "weather_severity_report": R.severity_report(frame), "daily_summary": R.daily_summary(frame),
        "dominant_condition": R.condition_summary(frame),
    }
    assert set(tables) == set(one_by_one)
    for name, table in one_by_one.items():
        assert tables[name].columns == table.columns, name
        rows = lambda t: sorted(t.collect(), key=str)
        assert rows(tables[name]) == rows(table), name
    text = counts._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in text
