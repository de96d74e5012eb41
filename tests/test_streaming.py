"""Streams must give what the batch forms give, however the input is cut."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge import fixed_values as V
from skygauge.operators import anomaly as A
from skygauge.operators.enrich import enrich
from skygauge.operators.metrics import progress_metrics
from skygauge.sources.sinks import with_event_date
from skygauge.streaming import monitor as MO, stateful as ST
from skygauge.streaming.sinks import start_log_sink, start_parquet_sink

SCHEMA = "timestamp string, city string, source string, " + ", ".join(f"{f} double" for f in V.FEATURES) + \
    ", weather_description string, partition int, offset long"


def events(n=420):
    rnd = np.random.default_rng(11)
    out = []
    for i in range(n):
        x = rnd.normal([15, 60, 1010, 5], [3, 8, 4, 2])
        if i == 401:
            x = np.array([59.0, 5.0, 880.0, 70.0])
        out.append({
            "timestamp": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}", "city": "Hot" if i % 4 else "Cold", "source": "s",
            **{f: float(v) for f, v in zip(V.FEATURES, x) if not (f == "humidity" and i % 9 == 0)},
            "weather_description": "light rain", "partition": 0, "offset": i,
        })
    return out


def land(folder, rows, parts):
    """Write the rows as that many JSON Lines files, in arrival order."""
    folder.mkdir(exist_ok=True)
    already = len(list(folder.iterdir()))
    for p, chunk in enumerate(np.array_split(np.arange(len(rows)), parts)):
        name = folder / f"{already + p:04d}.json"
        name.write_text("\n".join(json.dumps(rows[i]) for i in chunk))
        # files are read in the order of their times, which must not be equal
        os.utime(name, (1_700_000_000 + already + p,) * 2)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def batch(spark, rows):
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(
        F.from_json("value", SCHEMA).alias("r")).select("r.*")


def scores(rows):
    return {r["offset"]: (r["anomaly"]["is_anomaly"], r["anomaly"]["score"]) for r in rows}


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0]
        assert got[k][1] == (None if want[k][1] is None else pytest.approx(want[k][1], abs=1e-9))


@pytest.fixture
def rocksdb(spark):
    ST.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def finish(query):
    query.awaitTermination()
    return query


@pytest.mark.parametrize("parts", [1, 4])
def test_zscore_stream_equals_batch(spark, tmp_path, rocksdb, parts):
    rows = events()
    want = scores([r.asDict(True) for r in A.detect(
        batch(spark, rows), id_col="offset", order=["offset"]).collect()])
    land(tmp_path / "in", rows[:250], parts)

    def run():
        out = ST.zscore_stream(stream(spark, tmp_path / "in"), ["offset"])
        return finish(start_log_sink(out, str(tmp_path / "out"), str(tmp_path / "cp"), "available_now"))

    query = run()
    assert sum(p["input_rows"] for p in progress_metrics(query)) == 250
    land(tmp_path / "in", rows[250:], parts)
    run()  # a new query on the old checkpoint goes on with the kept state
    back = spark.read.json(str(tmp_path / "out"))
    close(scores([r.asDict(True) for r in back.collect()]), want)
    assert want[401][0]


def test_iforest_stream_equals_batch(spark, tmp_path, rocksdb):
    rows = events()
    options = {"min_samples": 90, "trees": 30}
    want = scores([r.asDict(True) for r in A.detect(
        batch(spark, rows), "isolation_forest", True, "offset", ["offset"], iforest_options=options).collect()])
    land(tmp_path / "in", rows, 3)
    out = ST.iforest_stream(stream(spark, tmp_path / "in"), ["offset"], **options)
    finish(start_log_sink(out, str(tmp_path / "out"), str(tmp_path / "cp"), "available_now"))
    got = scores([r.asDict(True) for r in spark.read.json(str(tmp_path / "out")).collect()])
    close(got, want)
    assert want[401][0] and sum(v[1] is not None for v in want.values()) > 150


@pytest.mark.parametrize("tasks", [None, 3])
def test_monitor_stream(spark, tmp_path, tasks):
    rows = events()
    del rows[5]["timestamp"], rows[6]["source"]
    rows[7]["pressure"] = 2000.0
    with_text = batch(spark, rows).withColumn("value", F.to_json(F.struct(*SCHEMA_FIELDS)))
    want = {r["offset"]: r for r in (
        x.asDict(True) for x in MO.monitor(with_text, "offset", ["offset"]).collect())}
    land(tmp_path / "in", rows[:300], 2)

    def run():
        source = stream(spark, tmp_path / "in").withColumn("value", F.to_json(F.struct(*SCHEMA_FIELDS)))
        finish(MO.start_monitor(
            source, str(tmp_path / "out"), str(tmp_path / "cp"), "available_now", tasks=tasks))

    run()
    land(tmp_path / "in", rows[300:], 1)
    run()
    got = {r["offset"]: r for r in (
        x.asDict(True) for x in spark.read.json(str(tmp_path / "out" / "events")).collect())}
    close(scores(got.values()), scores(want.values()))
    for i, row in want.items():
        assert got[i]["data_quality"] == row["data_quality"]
        assert got[i]["weather_severity"] == row["weather_severity"]
    assert got[7]["data_quality"]["issue_count"] == want[7]["data_quality"]["issue_count"] == 2
    quality = spark.read.json(str(tmp_path / "out" / "quality")).count()
    assert quality == sum(not r["data_quality"]["passed"] for r in want.values())
    anomalies = spark.read.json(str(tmp_path / "out" / "anomalies")).count()
    assert anomalies == sum(r["anomaly"]["is_anomaly"] for r in want.values()) > 0
    metrics = spark.read.json(str(tmp_path / "out" / "metrics")).drop("batch").unionByName(
        spark.read.json(str(tmp_path / "out" / "open_metrics"))).collect()
    assert sorted(r.window_messages for r in metrics) == [20] + [25] * 16
    assert all(r.window_seconds > 1e-6 for r in metrics)


SCHEMA_FIELDS = ["timestamp", "city", "source", *V.FEATURES]


def test_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    """A micro-batch that fails after its state is written runs again from the state before it."""
    rows = events(180)
    land(tmp_path / "in", rows, 3)
    logged, fails = A.anomaly_events, [False, True, False, False]

    def anomaly_events(*given):
        if fails.pop(0):
            raise RuntimeError("no room")
        return logged(*given)

    monkeypatch.setattr(A, "anomaly_events", anomaly_events)

    def run():
        source = stream(spark, tmp_path / "in").withColumn("value", F.to_json(F.struct(*SCHEMA_FIELDS)))
        return MO.start_monitor(source, str(tmp_path / "out"), str(tmp_path / "cp"), "available_now", tasks=2)

    with pytest.raises(Exception, match="no room"):
        run().awaitTermination()
    finish(run())
    assert not fails
    got = scores([r.asDict(True) for r in spark.read.json(str(tmp_path / "out" / "events")).collect()])
    close(got, scores([r.asDict(True) for r in A.detect(batch(spark, rows), id_col="offset", order=["offset"]).collect()]))


def test_rows_pass_the_state_unchanged(spark, tmp_path):
    """Any columns of the stream come back as they were: NaN, nulls, structs, times, an own anomaly column."""
    schema = SCHEMA + ", extra struct<a: double, b: array<int>>, seen timestamp, day date, line string, anomaly int"
    rows = [{**r, "extra": {"a": i / 7, "b": [i]} if i % 2 else None, "seen": f"2024-03-01T00:00:00.{i:03d}Z",
             "day": "2024-03-01", "line": 'a "b"\n', "anomaly": 1} for i, r in enumerate(events(40))]
    rows[3]["pressure"], rows[4]["city"] = "NaN", None
    folder = tmp_path / "in"
    land(folder, rows, 2)
    source = spark.readStream.schema(schema).json(str(folder)).withColumn("value", F.to_json(F.struct(*SCHEMA_FIELDS)))
    finish(MO.start_monitor(source, str(tmp_path / "out"), str(tmp_path / "cp"), "available_now"))
    names = ["offset", "city", "temperature", "humidity", "pressure", "extra", "seen", "day", "line"]
    read = lambda path: sorted(map(str, spark.read.schema(schema.replace("anomaly int", "x int")).json(path).select(*names).collect()))
    assert read(str(tmp_path / "out" / "events")) == read(str(folder))
    times = spark.range(3).select(F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id")).alias("t"), F.expr(
        "CASE id WHEN 0 THEN double('NaN') WHEN 1 THEN -double('inf') ELSE 1e-320 END AS x"))
    line = F.to_json(F.struct("t", "x"), MO._EXACT)
    back = times.select(F.from_json(line, times.schema, MO._EXACT).alias("r"), "t", "x")
    assert back.where("r.t = t AND r.x = x").count() == 3


def test_small_chunks_of_a_key(spark, tmp_path, rocksdb):
    rows = events()
    rnd = np.random.default_rng(5)
    land(tmp_path / "in", [rows[i] for i in rnd.permutation(len(rows))], 1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 17)
    try:
        out = ST.zscore_stream(stream(spark, tmp_path / "in"), ["offset", "city"])
        finish(start_log_sink(out, str(tmp_path / "out"), str(tmp_path / "cp"), "available_now"))
    finally:
        spark.conf.set(name, before)
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert {r.offset: r.city for r in got} == {r["offset"]: r["city"] for r in rows}
    close(scores([r.asDict(True) for r in got]), scores([r.asDict(True) for r in A.detect(
        batch(spark, rows), id_col="offset", order=["offset"]).collect()]))


class OnDisk:
    """A map state that keeps its values out of memory."""

    def __init__(self, folder):
        self.folder = folder

    def updateValue(self, key, value):
        (self.folder / str(key[0])).write_bytes(value[0])

    def getValue(self, key):
        return ((self.folder / str(key[0])).read_bytes(),)

    def removeKey(self, key):
        (self.folder / str(key[0])).unlink()


def test_a_key_with_a_million_rows_takes_bounded_memory(tmp_path):
    import tracemalloc

    import pandas as pd

    processor = ST._ZScore(["line"], ["offset"], ["x"], 240, 30)
    processor.waiting = OnDisk(tmp_path)
    kept = []
    processor.past = type("Past", (), {"get": lambda self: None, "update": lambda self, v: kept.append(v)})()
    rnd = np.random.default_rng(1)

    def chunks():
        for i in range(100):
            offset = np.arange(i * 10_000, (i + 1) * 10_000)
            yield pd.DataFrame({"line": [f"{o:0500d}" for o in offset], "offset": offset[::-1], "x": rnd.normal(size=10_000), "given_x": True})

    tracemalloc.start()
    rows = sum(len(part) for part in processor.handleInputRows(("k",), chunks(), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1_000_000 and len(kept[0][0]) == 240 and not list(tmp_path.iterdir())
    assert peak < 200 << 20  # the texts alone are 550 MB


def test_parquet_stream_equals_batch(spark, tmp_path):
    rows = [{**r, "weather_condition": "Rain" if i % 2 else None} for i, r in enumerate(events(50))]
    land(tmp_path / "in", rows, 3)
    source = spark.readStream.schema(SCHEMA + ", weather_condition string").json(str(tmp_path / "in"))
    out = with_event_date(enrich(source))
    finish(start_parquet_sink(out, str(tmp_path / "out"), str(tmp_path / "cp"), "available_now", ["event_date"]))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.groupBy("weather_severity").count().collect().__len__() == 2 and got.count() == 50


def test_monitor_with_isolation_forest(spark, tmp_path):
    rows = events()
    options = {"min_samples": 90, "trees": 30}
    with_text = batch(spark, rows).withColumn("value", F.to_json(F.struct(*SCHEMA_FIELDS)))
    want = scores([r.asDict(True) for r in MO.monitor(
        with_text, "offset", ["offset"], method="isolation_forest", enabled=True, iforest_options=options).collect()])
    for at, (low, high) in enumerate([(0, 60), (60, 300), (300, 420)]):
        land(tmp_path / "in", rows[low:high], 1)
        source = stream(spark, tmp_path / "in").withColumn("value", F.to_json(F.struct(*SCHEMA_FIELDS)))
        finish(MO.start_monitor(
            source, str(tmp_path / "out"), str(tmp_path / "cp"), "available_now", tasks=2 + at,
            method="isolation_forest", enabled=True, **options))
    got = scores([r.asDict(True) for r in spark.read.json(str(tmp_path / "out" / "events")).collect()])
    close(got, want)
    assert want[401][0] and sum(v[1] is not None for v in want.values()) > 150


def test_a_key_holds_its_numbers_once(tmp_path):
    import tracemalloc

    import pandas as pd

    features = ["a", "b", "c", "d"]
    processor = ST._ZScore(["line"], ["partition", "offset"], features, 240, 30)
    processor.waiting = OnDisk(tmp_path)
    processor.past = type("Past", (), {"get": lambda self: None, "update": lambda self, v: None})()

    def chunks():
        for i in range(100):
            offset = np.arange(i * 10_000, (i + 1) * 10_000)
            given = {f"given_{f}": np.ones(10_000, bool) for f in features}
            yield pd.DataFrame({"line": offset, "partition": 0, "offset": -offset, **{f: np.sin(offset) for f in features}, **given})

    tracemalloc.start()
    rows = sum(len(part) for part in processor.handleInputRows(("k",), chunks(), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1_000_000 and peak < rows * 100  # 52 bytes a row come in, a column at a time is copied


def test_rows_pass_the_state_in_packs(spark, tmp_path):
    """The state's task gets packs of rows of one key, and gives back packs."""
    import pyarrow as pa

    land(tmp_path / "in", events(40), 1)
    out = ST.zscore_stream(stream(spark, tmp_path / "in"), ["offset", "city"], tasks=2)
    assert out.schema.names == ["offset", "city", "anomaly"]
    text = out._jdf.queryExecution().analyzed().toString()
    state = next(line for line in text.splitlines() if "TransformWithState" in line)
    assert "pack#" in state and "scores#" in state and "offset" not in state
    rows = 30_000
    table = pa.table({"key0": ["a" if i % 3 else "b" for i in range(rows)], "key1": ["s"] * rows, "x": range(rows)})
    parts = list(ST._by_key(table, ["key0", "key1"]))
    assert len(parts) == 8 and max(len(part) for _, part in parts) == 4096  # 20,000 and 10,000 rows
    for key, part in parts:
        assert set(part["key0"].to_pylist()) == {key[0]} and key[1] == "s"
        batch = part.to_batches()[0]
        assert ST._unpack(ST._pack(batch), batch.schema).equals(batch)
        assert part["x"].to_pylist() == sorted(part["x"].to_pylist())
    assert sorted(x for _, part in parts for x in part["x"].to_pylist()) == list(range(rows))
