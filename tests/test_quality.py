import json
import math
import random

from pyspark.sql import functions as F

from skygauge import fixed_values as V
from skygauge.operators import filters as FL, quality as Q


def brute(text):
    """The rules once more, event by event."""
    try:
        event = json.loads(text)
    except (TypeError, ValueError):
        return None
    if not isinstance(event, dict):
        return None
    found = []
    for f in V.REQUIRED_FIELDS:
        if f not in event:
            found.append(("missing_field", f, f"Required field `{f}` is missing."))
        elif event[f] is None:
            found.append(("null_value", f, f"Required field `{f}` is null."))
    for f in V.FEATURES:
        v = event.get(f)
        if v is None:
            continue
        try:
            x = float(v)
        except (TypeError, ValueError):
            found.append(("type_mismatch", f, f"Expected numeric for `{f}`, got {type(v).__name__}."))
            continue
        low, high = V.BOUNDS[f]
        if x < low or x > high:
            found.append(("out_of_bounds", f, f"`{f}`={x} outside [{low}, {high}]"))
    return found


def check(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, value string")
    got = {r.id: r for r in Q.validate(frame).collect()}
    for i, text in enumerate(texts):
        want, row = brute(text), got[i]
        mine = None if row.issues is None else [tuple(x) for x in row.issues]
        assert mine == want, text
        assert row.data_quality == (None if want is None else (not want, len(want)))


def test_rules_on_random_events(spark):
    rnd = random.Random(7)
    values = [None, "abc", "12.5", "1_0", "12d", "true", {"a": 1}, {}, [1], [], True, False, math.nan, math.inf,
              -math.inf, 0, -60, -60.0, -60.1, 60, 60.1, 100, 100.5, 870, 869.99, 1085, 1085.01, 75.01, 1e7, 1e16, 1e-5]
    texts = []
    for _ in range(400):
        event = {}
        for f in V.REQUIRED_FIELDS:
            if rnd.random() < 0.15:
                continue
            event[f] = rnd.choice(values) if f in V.FEATURES else rnd.choice([None, "x", "y: NaN, z", ""])
        texts.append(json.dumps(event))
    check(spark, texts + ["nope", "[1]", "{}", "", None, "12"])


def test_custom_rules(spark):
    frame = spark.createDataFrame([('{"a": 5, "humidity": 500}',)], "value string")
    row = Q.validate(frame, required=["a", "b"], bounds={"humidity": (0, None)}, numeric=["humidity"]).first()
    assert [(i.type, i.field) for i in row.issues] == [("missing_field", "b")]


def test_events_and_summary(spark):
    rows = [("C", "s", "t1", '{"timestamp": "t1"}'), ("C", "s", "t2", "nope")]
    frame = Q.validate(spark.createDataFrame(rows, "city string, source string, timestamp string, value string"))
    events = Q.quality_events(frame, now="2024").collect()
    assert [(e.ts_utc, e.city, e.event_timestamp, len(e.issues)) for e in events] == [("2024", "C", "t1", 7)]
    summary = Q.quality_summary(frame)
    assert summary.agg(F.sum("issue_count")).first()[0] == 7
    assert FL.failed(frame).count() == 1 and FL.passed(frame).count() == 0


def test_checks_are_short_enough_to_be_compiled(spark):
    """The JVM leaves methods of more than 8,000 bytes of bytecode to its interpreter."""
    rows = spark.range(10).selectExpr("concat('{\"city\": ', id, '}') AS value")
    stages = Q.validate(rows)._jdf.queryExecution().debug().codegenToSeq()
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]
    assert sizes and max(sizes) < 8000
