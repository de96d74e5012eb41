import json
import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skygauge.operators import reports as R
from skygauge.plans import jobs as J
from skygauge.sources import files as S, kafka as K, sinks as W


def reading(i, **extra):
    base = {
        "timestamp": f"2024-05-0{1 + i % 3}T10:00:0{i % 10}", "source": "weatherapi", "city": f"New City {i % 2}",
        "country": "X", "coordinates": {"lat": 1.0, "lon": 2.0}, "temperature": 20.0 + i, "humidity": 65.25,
        "pressure": 1010.0, "wind_speed": 3.0, "weather_condition": "Thunderstorm" if i % 2 else "Clear",
    }
    return {**base, **extra}


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "object.json").write_text(json.dumps(reading(1), indent=4))
    (folder / "array.json").write_text(json.dumps([reading(2), reading(3)], indent=4))
    (folder / "broken.json").write_text("{not json")
    (folder / "old.json").write_text(json.dumps(reading(4), indent=4))
    past = time.time() - 3 * 86400
    os.utime(folder / "old.json", (past, past))
    return str(folder)


def test_raw_json(spark, raw):
    rows = S.read_raw_json(spark, raw).collect()
    assert sorted(r.temperature for r in rows if r._corrupt is None) == [21.0, 22.0, 23.0, 24.0]
    assert [r._corrupt for r in rows if r._corrupt is not None] == ["{not json"]
    assert {r.humidity for r in rows if r._corrupt is None} == {65.25}
    assert "temperature" in S.read_raw_json(spark, raw, None).columns


def test_recent(spark, raw):
    recent = S.read_recent_json(spark, raw, 1).where("_corrupt IS NULL")
    assert sorted(r.temperature for r in recent.collect()) == [21.0, 22.0, 23.0]
    later = datetime.now(timezone.utc) + timedelta(days=5)
    assert S.read_recent_json(spark, raw, 1, later).count() == 0
    assert len(S.read_recent_json(spark, raw, 9).where("_corrupt IS NULL").collect()) == 4


def test_processed_needs_keys(spark, tmp_path):
    for name, extra in (("processed_a", {}), ("processed_b", {"humidity": None}), ("other", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(reading(1, **extra), indent=2))
    short = reading(5)
    del short["city"]
    (tmp_path / "processed_c.json").write_text(json.dumps(short))
    (tmp_path / "processed_d.json").write_text("oops")
    rows = S.read_processed(spark, str(tmp_path)).collect()
    assert sorted((r.city, r.humidity is None) for r in rows) == [("New City 1", False), ("New City 1", True)]


def frame(spark, n=12):
    text = spark.createDataFrame([(json.dumps(reading(i)),) for i in range(n)], "value string")
    return text.select(F.from_json("value", S.READING).alias("r")).select("r.*")


@pytest.mark.parametrize("fmt", ["json", "parquet", "csv"])
def test_write_batch(spark, tmp_path, fmt):
    path = W.write_batch(frame(spark), str(tmp_path), fmt, "run1")
    assert path.endswith(f"weather_processed_run1.{fmt}")
    back = {
        "json": lambda: S.read_json_lines(spark, path), "parquet": lambda: S.read_processed_parquet(spark, path),
        "csv": lambda: spark.read.option("header", True).csv(path),
    }[fmt]()
    assert sorted(float(r.temperature) for r in back.select("temperature").collect()) == [20.0 + i for i in range(12)]
    again = W.write_batch(frame(spark, 2), str(tmp_path), fmt, "run1")
    assert again == path  # the run's own folder is replaced
    with pytest.raises(ValueError):
        W.write_batch(frame(spark), str(tmp_path), "xml", "run1")


def test_json_round_trip_keeps_fields(spark, tmp_path):
    rows = spark.createDataFrame([("value", 42, None)], "key string, number long, empty string")
    W.append_jsonl(rows, str(tmp_path / "log"))
    W.append_jsonl(rows, str(tmp_path / "log"))
    text = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert text == [{"key": "value", "number": 42, "empty": None}] * 2


def test_events_never_overwrite(spark, tmp_path):
    same = frame(spark, 1)
    for _ in range(2):
        W.write_events(same, str(tmp_path / "e"))
        W.land_raw(same, str(tmp_path / "r"))
    assert S.read_json_lines(spark, str(tmp_path / "e")).count() == 2
    assert os.path.isdir(tmp_path / "e" / "city_slug=new_city_0" / "event_date=2024-05-01")
    assert os.path.isdir(tmp_path / "r" / "source_slug=weatherapi" / "city_slug=new_city_0")


def test_retention(spark, tmp_path):
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    ages = [30 * 86400, 31 * 86400 - 1, 31 * 86400, 40 * 86400]
    rows = spark.createDataFrame([(a, now - timedelta(seconds=a)) for a in ages], "age long, ts timestamp")
    kept = W.retain_recent(rows, "ts", now=F.lit(now))
    assert sorted(r.age for r in kept.collect()) == ages[:2]
    W.write_retained(kept.withColumn("event_date", F.to_date("ts")), str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_kafka_shapes(spark):
    rows = frame(spark, 3).withColumn("city", F.when(F.col("temperature") > 20, F.col("city")))
    records = K.to_kafka_records(rows, "city_timestamp", F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)))
    keys = {r.key: json.loads(r.value) for r in records.collect()}
    assert "unknown_2024-05-01T10:00:00" in keys
    assert {v["ingest_ts_unix_ms"] for v in keys.values()} == {1704067200000}
    with pytest.raises(ValueError):
        K.to_kafka_records(rows, "other")
    topic = spark.createDataFrame(
        [(f"k{i}".encode(), v.encode(), 0, i, datetime(2024, 1, 1)) for i, v in enumerate([
            '{"city": "A", "temperature": "12.5", "coordinates": {"lat": "x", "lon": 2}, "raw_data": {"a": 1}}',
            "{oops", '{"city": 5, "temperature": "abc", "humidity": [1]}',
        ])], "key binary, value binary, partition int, offset int, timestamp timestamp")
    got = K.parse_kafka_value(topic, keep=["partition", "offset"]).orderBy("offset").collect()
    assert (got[0].key, got[0].city, got[0].temperature, tuple(got[0].coordinates)) == ("k0", "A", 12.5, (None, 2.0))
    assert got[1]._corrupt == "{oops" and got[1].city is None
    assert got[2]._corrupt is None and (got[2].city, got[2].temperature, got[2].humidity) == ("5", None, None)
    assert tuple(R.parse_counts(K.parse_kafka_value(topic)).first()) == (2, 1)
    peek = K.peek_topic(topic, 2).collect()
    assert [r.offset for r in peek] == [2, 1]
    whole = {r.offset: r.value for r in K.peek_topic(topic, 9).collect()}
    assert "raw_data" not in json.loads(whole[0]) and whole[1] == "{oops"


def test_batch_job(spark, raw, tmp_path):
    now = datetime(2024, 5, 5, 1, 2, 3, tzinfo=timezone.utc)
    done = J.run_batch(spark, raw, str(tmp_path / "out"), now=now)
    assert done["records"] == 4
    assert done["folders"]["json"].endswith("weather_processed_20240505_010203.json")
    parquet = S.read_processed_parquet(spark, done["folders"]["parquet"])
    assert parquet.where("weather_severity = 'severe'").count() == 2
    assert spark.read.json(done["folders"]["json"]).count() == 4
    none = J.run_batch(spark, raw, str(tmp_path / "none"), transforms=[lambda d: d.where("false")], formats=("parquet",))
    assert none["records"] == 0


def test_chain_stops_at_failure(spark, raw, tmp_path):
    def fail():
        raise RuntimeError("no data")

    with pytest.raises(RuntimeError):
        J.run_chain(spark, fail, raw, str(tmp_path / "p"), str(tmp_path / "r"))
    assert not (tmp_path / "p").exists()
    done = J.run_chain(spark, None, raw, str(tmp_path / "p"), str(tmp_path / "r"), days=1)
    alerts = spark.read.option("header", True).csv(done["reports"]["severe_alerts"])
    assert alerts.count() == 2
    pivot = spark.read.option("header", True).csv(done["reports"]["weather_severity_report"])
    assert pivot.columns == ["city", "normal", "mild", "moderate", "severe"]


def test_a_zone_without_readings_stops_the_chain(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "nothing.json").write_text("[]")
    for formats in (("parquet", "json"), ("json",)):
        with pytest.raises(J.NoInput):
            J.run_batch(spark, str(raw), str(out), formats=formats)
    with pytest.raises(J.NoInput):
        J.run_chain(spark, None, str(raw), str(out), str(tmp_path / "reports"))
    assert not (tmp_path / "reports").exists() and not out.exists()


def test_retention_touches_the_border_day_only(spark, tmp_path):
    zone, now = str(tmp_path / "zone"), datetime(2024, 3, 10, 12, tzinfo=timezone.utc)
    rows = [(i, now - timedelta(hours=6 * i)) for i in range(60)] + [(99, None)]
    frame = spark.createDataFrame(rows, "n long, event_ts timestamp").withColumn("event_date", F.to_date("event_ts"))
    frame.write.partitionBy("event_date").parquet(zone)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "zone").glob("event_date=*/*.parquet")}
    before = files()
    done = W.retain_zone(spark, zone, days=4, now=F.lit(now))
    assert done["rewritten"] == ["2024-03-05"] and None in done["dropped"] and "2024-03-04" in done["dropped"]
    kept = [r.n for r in spark.read.parquet(zone).collect()]
    assert sorted(kept) == [i for i, t in rows if t and t > now - timedelta(days=5)]
    after = files()
    assert all(after[p] == before[p] for p in after if "2024-03-05" not in p) and not set(after) <= {p for p in after if "2024-03-05" in p}
    assert W.retain_zone(spark, zone, days=4, now=F.lit(now)) == {"dropped": [], "rewritten": []}
    assert W.retain_zone(spark, zone, days=-1, now=F.lit(now + timedelta(days=9)))["rewritten"] == [] and not files()


def test_a_streamed_zone_is_read_once_and_archived(spark, tmp_path):
    zone, archive, out = tmp_path / "zone", tmp_path / "archive", tmp_path / "out"
    zone.mkdir()
    now = time.time()

    def land(name, age, *rows):
        (zone / name).write_text(json.dumps([{"city": c, "humidity": 1.0} for c in rows]))
        os.utime(zone / name, (now - age,) * 2)

    def round_():
        source = S.stream_recent_json(spark, str(zone), 1, str(archive))
        query = source.select("city").writeStream.format("json").option("path", str(out)).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.city for r in spark.read.schema("city string").json(str(out)).collect())

    land("a.json", 60, "a", "b")
    land("old.json", 3 * 86400, "z")
    assert round_() == ["a", "b"]
    land("b.json", 30, "c")
    assert round_() == ["a", "b", "c"]
    land("c.json", 1, "d", "d")
    assert round_() == ["a", "b", "c", "d", "d"]
    assert round_() == ["a", "b", "c", "d", "d"]
    kept, gone = {p.name for p in zone.iterdir()}, {p.name for p in archive.rglob("*.json")}
    assert {"a.json", "b.json", "old.json"} <= gone and not kept & gone
