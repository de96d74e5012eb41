import math
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge import fixed_values as V
from skygauge.operators import anomaly as A, iforest as I
from skygauge.operators.ordered import top_rows, with_position
from skygauge.sources.shared import materialise
from skygauge.streaming.stateful import rolling_z


def series(n=900, seed=3):
    """Rows of three keys, one of them with most of the rows; gaps, flat runs, spikes."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        city = "Hot" if rnd.random() < 0.8 else rnd.choice(["A", None])
        spike = 60.0 if rnd.random() < 0.01 else 0.0
        rows.append((
            i, city, "s",
            None if rnd.random() < 0.3 else rnd.gauss(10, 2) + spike,
            50.0 if i < n // 2 else rnd.gauss(50, 5),
            float("nan") if i == n // 3 else rnd.gauss(1000, 1),
            7.0,
        ))
    return rows


SCHEMA = "event_id long, city string, source string, " + ", ".join(f"{f} double" for f in V.FEATURES)


def brute(rows, window=240, least=30):
    past = defaultdict(lambda: deque(maxlen=window))
    out = {}
    for row in rows:
        key = (row[1] or "unknown", row[2])
        for f, x in zip(V.FEATURES, row[3:]):
            if x is None:
                continue
            w = past[key, f]
            z = None
            if len(w) >= least:
                mean = sum(w) / len(w)
                sd = math.sqrt(sum((v - mean) ** 2 for v in w) / max(1, len(w) - 1))
                z = 0.0 if sd <= 1e-12 else (x - mean) / sd
            out[row[0], f] = z
            w.append(x)
    return out


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("options", [
    {"hot_keys": False}, {"piece_rows": 250}, {},
    {"window": 7, "min_samples": 3, "hot_keys": False}, {"window": 7, "min_samples": 1, "piece_rows": 1},
])
def test_zscore_matches_brute_force(spark, options):
    rows = series()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {
        (r.event_id, r.feature): r.z
        for r in A.zscore_long(frame, order=["event_id"], **options).collect()
    }
    want = brute(rows, options.get("window", 240), options.get("min_samples", 30))
    assert got.keys() == want.keys()
    for k, z in want.items():
        assert same(got[k], z), (k, got[k], z)


def test_event_result(spark):
    rows = series()
    want = brute(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    for r in A.detect(frame, order=["event_id"]).collect():
        z = {f: want.get((r.event_id, f)) for f in V.FEATURES}
        known = [0.0 if math.isnan(v) else abs(v) for v in z.values() if v is not None]
        assert same(r.anomaly.score, max(known) if known else None)
        assert r.anomaly.is_anomaly == bool(known and max(known) >= 3.5)
        assert r.anomaly.method == "zscore"
        assert all(same(r.anomaly.feature_scores[f], z[f]) for f in V.FEATURES)


def test_threshold_is_inclusive_and_flat_series_scores_zero(spark):
    rows = [(i, "C", "s", None, None, None, 1.0) for i in range(31)]
    out = A.detect(spark.createDataFrame(rows, SCHEMA), order=["event_id"]).orderBy("event_id").collect()
    assert out[29].anomaly.score is None and out[30].anomaly.score == 0.0
    z = spark.range(1).select(A.anomaly_struct({"a": F.lit(-3.5), "b": F.lit(None).cast("double")}).alias("a")).first().a
    assert z.is_anomaly and z.score == 3.5 and z.feature_scores == {"a": -3.5, "b": None}


def test_anomaly_events(spark):
    rows = series()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.col("event_id").cast("string"))
    detected = A.detect(frame, order=["event_id"])
    events = A.anomaly_events(detected, now="now").collect()
    assert len(events) == detected.where("anomaly.is_anomaly").count() > 0
    assert {e.ts_utc for e in events} == {"now"}


def test_rolling_z_in_numpy_matches():
    rnd = np.random.default_rng(1)
    values = rnd.normal(size=700)
    whole, exists = rolling_z(np.zeros(0), values, 240, 30)
    past, parts = np.zeros(0), []
    for chunk in np.array_split(values, 9):
        z, _ = rolling_z(past, chunk, 240, 30)
        parts.append(z)
        past = np.concatenate([past, chunk])[-240:]
    assert exists.sum() == 670
    np.testing.assert_allclose(np.concatenate(parts)[30:], whole[30:], atol=1e-12)


def test_positions_are_dense(spark):
    frame = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"))
    rows = with_position(frame, ["x"]).collect()
    assert all(r.x == r.position for r in rows) and len(rows) == 5000


def test_top_rows(spark):
    rows = [(i, "hot" if i % 10 else "cold", (i * 37) % 1009) for i in range(1000)]
    frame = spark.createDataFrame(rows, "event_id long, k string, v long")
    got = top_rows(frame, ["k"], ["v", "event_id"], 20, "event_id", salts=5)
    for k in ("hot", "cold"):
        want = sorted((v, i) for i, c, v in rows if c == k)[:20]
        assert [(r.v, r.event_id) for r in got.where(F.col("k") == k).orderBy("rank").collect()] == want


# --- Isolation Forest


def cloud(n=600, seed=5):
    rnd = np.random.default_rng(seed)
    x = rnd.normal([15, 60, 1010, 5], [3, 8, 4, 2], size=(n, 4))
    return x


def test_forest_finds_planted_outliers():
    train, later = cloud(200), cloud(400, 6)
    forest = I.Forest.fit(train, 200, 0.01, 42)
    assert 0 < (forest.decision(train) < 0).sum() <= 4
    outliers = np.array([[60.0, 5.0, 880.0, 70.0], [-55.0, 99.0, 1080.0, 60.0]])
    assert (forest.decision(outliers) < 0).all()
    assert forest.decision(outliers).max() < np.median(forest.decision(later))
    again = I.Forest.from_bytes(I.Forest.fit(train, 200, 0.01, 42).to_bytes())
    np.testing.assert_array_equal(again.decision(later), forest.decision(later))


def test_forest_structure():
    forest = I.Forest.fit(cloud(200), 50, 0.01, 1)
    assert (forest.size[:, 0] == 200).all()  # every tree sees all samples up to 256
    assert forest.feature.shape[1] == 2 ** 9 - 1
    assert I.expected_path(2) == 1.0 and I.expected_path(1) == 0.0
    constant = I.Forest.fit(np.ones((20, 4)), 5, 0.01, 1)
    assert (constant.feature == -1).all()
    big = I.Forest.fit(cloud(500), 5, 0.01, 1)
    assert (big.size[:, 0] == 256).all()


def iforest_rows():
    x = cloud(900)
    x[851] = [60.0, 5.0, 880.0, 70.0]
    return [
        (i, "Hot" if i % 3 else "B", "s", None if i % 50 == 0 else float(a), float(b), float(c), float(d))
        for i, (a, b, c, d) in enumerate(x)
    ]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "group_rows": 60}])
def test_iforest_detect(spark, options):
    rows = iforest_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    out = {r.event_id: r.anomaly for r in A.detect(
        frame, "isolation_forest", True, order=["event_id"],
        iforest_options={"min_samples": 100, "trees": 60, **options},
    ).collect()}
    seen = defaultdict(int)
    for row in rows:
        complete = all(v is not None for v in row[3:])
        seen[row[1]] += complete
        due = complete and seen[row[1]] > 100
        assert (out[row[0]].score is not None) == due, row
    assert out[851].is_anomaly and out[851].method == "isolation_forest"
    by_hand = {}
    for key in ("Hot", "B"):
        vectors = [r for r in rows if r[1] == key and None not in r]
        forest = I.Forest.fit(np.array([r[3:] for r in vectors[:100]]), 60, 0.01, 42)
        scores = forest.decision(np.array([r[3:] for r in vectors[100:]]))
        by_hand.update(zip([r[0] for r in vectors[100:]], scores))
    assert all(out[i].score == pytest.approx(s, abs=1e-12) for i, s in by_hand.items())


def test_iforest_needs_the_switch(spark):
    frame = spark.createDataFrame(iforest_rows(), SCHEMA)
    assert A.detect(frame, "isolation_forest", False, order=["event_id"]).first().anomaly.method == "zscore"


def test_iforest_fit_needs_enough_rows(spark):
    frame = spark.createDataFrame(iforest_rows(), SCHEMA)
    models = materialise(I.iforest_fit(frame, order=["event_id"], min_samples=400, trees=5), "m")
    assert [r.city for r in models.collect()] == ["Hot"]


def test_both_forms_of_forest_scores_agree_to_the_bit(spark):
    """Also where the order holds nulls, among them that of the last training row."""
    rows = [(*r, None if i < 130 else float(i)) for i, r in enumerate(iforest_rows())]
    frame = spark.createDataFrame(rows, SCHEMA + ", at double")
    models = materialise(I.iforest_fit(frame, order=["at", "event_id"], min_samples=50, trees=20), "m")
    forms = [
        {r.event_id: r.score for r in I.iforest_score(frame, models, order=["at", "event_id"], **options).collect()}
        for options in ({}, {"broadcast_bytes": 0, "group_rows": 40})
    ]
    assert forms[0] == forms[1] and len(forms[0]) > 700


def test_both_forms_of_zscores_agree(spark):
    frame = spark.createDataFrame(series(), SCHEMA)
    forms = [
        {(r.event_id, r.feature): r.z for r in A.zscore_long(frame, order=["event_id"], window=240, **options).collect()}
        for options in ({"hot_keys": False}, {"piece_rows": 480})
    ]
    assert forms[0].keys() == forms[1].keys()
    assert all(same(z, forms[1][k]) for k, z in forms[0].items())


@pytest.mark.parametrize("options", [{"hot_keys": False}, {"piece_rows": 480}])
def test_tasks_grow_with_the_rows(spark, monkeypatch, options):
    from skygauge.operators import ordered

    frame = spark.createDataFrame(series(), SCHEMA)
    rows = lambda scored: {(r.event_id, r.feature): r.z for r in scored.collect()}
    want = rows(A.zscore_long(frame, order=["event_id"], **options))
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 40)
    scored = A.zscore_long(frame, order=["event_id"], **options)
    tasks = -(-len(want) // 40)
    assert ("_piece" in scored._jdf.queryExecution().toString()) == ("piece_rows" in options)
    assert tasks > 8 and f", {tasks}), REPARTITION_BY_NUM" in scored._jdf.queryExecution().toString()
    got = rows(scored)
    assert got.keys() == want.keys() and all(same(z, want[k]) for k, z in got.items())


def test_keys_that_do_not_fit_a_task_are_cut(spark):
    frame = spark.createDataFrame(series(), SCHEMA)
    forms = [A.zscore_long(frame, order=["event_id"], hot_keys=False, **options) for options in ({}, {"piece_rows": 100})]
    assert ["_piece" in f._jdf.queryExecution().toString() for f in forms] == [False, True]
    a, b = ({(r.event_id, r.feature): r.z for r in f.collect()} for f in forms)
    assert a.keys() == b.keys() and all(same(z, b[k]) for k, z in a.items())
