"""Z-scores on the event's own row: against a loop, for keys of any size, with the plan promised."""

import random

import pytest

from catalog.readings import readings
from skygauge import fixed_values as V
from skygauge.operators import anomaly as A, rolling as R

SF = "/root/testdata/sf0.001"


def rows(seed, n=1500):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        city = rng.choice(["a"] * 6 + ["b", "c", None])
        x = None if rng.random() < 0.2 else float("nan") if rng.random() < 0.002 else round(rng.gauss(0, 5), 1)
        y = 7.0 if city == "b" else rng.random() if i % 13 == 0 else None
        out.append((i, rng.choice([None, rng.randrange(400)]) if i % 50 == 0 else i // 3, city, "s", x, y, {"k": str(i)}))
    return out


SCHEMA = "event_id long, t long, city string, source string, x double, y double, payload map<string,string>"


def slowly(data, window, least):
    """Row by row, with the last values of each feature in a list."""
    past, out = {}, {}
    for r in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        z = []
        for f, v in enumerate(r[4:6]):
            seen = past.setdefault((r[2] or "unknown", f), [])
            last = seen[-window:]
            if v is None or len(last) < least:
                z.append(None)
            else:
                mean = sum(last) / len(last)
                sd = (sum((o - mean) ** 2 for o in last) / max(1, len(last) - 1)) ** 0.5
                z.append(0.0 if sd <= 1e-12 else (v - mean) / sd)
            if v is not None:
                seen.append(v)
        out[r[0]] = z
    return out


@pytest.mark.parametrize("piece_rows", [40, 300, 10 ** 6])
def test_scores_are_those_of_a_loop(spark, piece_rows):
    data = rows(5)
    frame = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = R.zscore_rows(frame, ["t", "event_id"], ["x", "y"], window=12, min_samples=4, piece_rows=piece_rows).collect()
    want = slowly(data, 12, 4)
    assert len(got) == len(data) and {r.event_id for r in got} == set(want)
    for r in got:
        assert r.payload == {"k": str(r.event_id)}
        for mine, theirs in zip((r.z_x, r.z_y), want[r.event_id]):
            assert (mine is None) == (theirs is None)
            assert mine is None or mine == pytest.approx(theirs, nan_ok=True, abs=1e-9)


def test_hot_keys_are_scored_by_several_tasks(spark):
    frame = spark.createDataFrame([(i, i, "a", "s", float(i % 7), 1.0, None) for i in range(4000)], SCHEMA)
    keyed = frame.withColumnsRenamed({"city": "_key0", "source": "_key1"})
    cut = R._cuts(keyed, ["_key0", "_key1"], keyed["t"].cast("double"), ["x", "y"], 20, 500).collect()
    assert len(cut) == 1 and 8 <= len({c[0] for c in cut[0].copies}) <= 16
    assert sum(len(c) > 1 for c in cut[0].copies) == len({c[0] for c in cut[0].copies}) - 1
    assert R._cuts(keyed, ["_key0", "_key1"], keyed["t"].cast("double"), ["x", "y"], 20, 4000) is None


def test_pieces_look_back_as_far_as_the_rarest_feature_needs():
    slices = [(10, 10, 1)] * 8
    made = R.copies_of(slices, 3, 20)
    for piece in range(1, 4):
        first = min(i for i, c in enumerate(made) if c[0] == piece)
        back = [i for i, c in enumerate(made) if piece in c[1:]]
        assert back == list(range(max(0, first - 3), first))


def test_text_orders_and_odd_types(spark):
    frame = spark.createDataFrame([(i, f"{i:04d}", "a", "s", float(i % 5), None, None) for i in range(300)],
                                  SCHEMA.replace("t long", "t string"))
    got = R.zscore_rows(frame, ["t"], ["x", "y"], window=10, min_samples=2, piece_rows=20).collect()
    assert sum(r.z_x is not None for r in got) == 298 and all(r.z_y is None for r in got)
    assert R.zscore_rows(frame.limit(0), ["t"], ["x"]).count() == 0


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_keys", [False, True])
def test_flags_take_one_shuffle_and_no_join(spark, hot_keys):
    columns = ["event_id", "event_ts", "city", "source", *V.FEATURES]
    text = plan(A.detect(readings(spark, SF).select(columns), hot_keys=hot_keys))
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1 and "Join" not in text and "Window" not in text


def test_cut_keys_take_a_broadcast_of_their_cuts_besides(spark):
    text = plan(A.detect(readings(spark, SF), piece_rows=100))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in text
