"""Quality, anomalies and stream metrics, in batch and streaming."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from catalog.readings import (
    JSON_EVENTS, JSON_VALUE, READINGS, json_events, reading_stream, readings,
)
from catalog.registry import register
from skygauge import fixed_values as V
from skygauge.operators import anomaly as A, filters as FL, iforest as I, metrics as M, quality as Q
from skygauge.schemas import ANOMALY_EVENT, QUALITY_EVENT, STREAM_METRIC
from skygauge.sources import sinks as W
from skygauge.sources.shared import materialise, new_path
from skygauge.streaming import monitor as MO, stateful as ST
from skygauge.streaming.sinks import start_log_sink


def rounded(df, *columns, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- data quality


def _required_sql(field):
    kind = f"json_type(value, '$.{field}')"
    return f"""CASE WHEN {kind} IS NULL THEN {{'type': 'missing_field', 'field': '{field}',
      'message': 'Required field `{field}` is missing.'}}
    WHEN {kind} = 'NULL' THEN {{'type': 'null_value', 'field': '{field}',
      'message': 'Required field `{field}` is null.'}} END"""


def _numeric_sql(field):
    kind, text = f"json_type(value, '$.{field}')", f"json_extract_string(value, '$.{field}')"
    number = f"CASE WHEN {kind} = 'BOOLEAN' THEN 1.0e0 ELSE TRY_CAST({text} AS DOUBLE) END"
    low, high = V.BOUNDS[field]
    return f"""CASE WHEN {kind} IS NULL OR {kind} = 'NULL' THEN NULL
    WHEN {kind} IN ('OBJECT', 'ARRAY') OR {number} IS NULL THEN {{'type': 'type_mismatch', 'field': '{field}',
      'message': 'Expected numeric for `{field}`, got ' || CASE {kind} WHEN 'OBJECT' THEN 'dict'
        WHEN 'ARRAY' THEN 'list' ELSE 'str' END || '.'}}
    WHEN NOT isnan({number}) AND ({number} < {low} OR {number} > {high}) THEN
      {{'type': 'out_of_bounds', 'field': '{field}',
      'message': '`{field}`=' || CAST({number} AS VARCHAR) || ' outside [{low}, {high}]'}} END"""


_CHECKS = ",\n    ".join([_required_sql(f) for f in V.REQUIRED_FIELDS] + [_numeric_sql(f) for f in V.FEATURES])
ISSUES = f"""{JSON_EVENTS}, checked AS (SELECT *, CASE WHEN json_valid(value) THEN
  list_filter([{_CHECKS}], lambda x: x IS NOT NULL) END AS issues FROM json_events)"""


def validated(spark, sf_dir):
    rows = readings(spark, sf_dir, spread=True)
    return Q.validate(rows.withColumn("value", F.expr(JSON_VALUE)))


@register("quality_issues", f"""WITH {READINGS}, {ISSUES}
  SELECT event_id, pos AS position, issues[pos].type AS type, issues[pos].field AS field,
  issues[pos].message AS message
  FROM (SELECT event_id, issues, unnest(range(1, len(issues) + 1)) AS pos FROM checked)""")
def quality_issues(spark, sf_dir):
    return validated(spark, sf_dir).select(
        "event_id", F.posexplode("issues").alias("position", "i")
    ).select("event_id", (F.col("position") + 1).cast("long").alias("position"), "i.type", "i.field", "i.message")


@register("quality_flags", f"""WITH {READINGS}, {ISSUES}
  SELECT event_id, len(issues) = 0 AS passed, len(issues) AS issue_count FROM checked""")
def quality_flags(spark, sf_dir):
    return validated(spark, sf_dir).select(
        "event_id", "data_quality.passed", F.col("data_quality.issue_count").cast("long").alias("issue_count")
    )


@register("quality_split", f"""WITH {READINGS}, {ISSUES}
  SELECT 'passed' AS side, count(*) AS events FROM checked WHERE len(issues) = 0 UNION ALL
  SELECT 'failed', count(*) FROM checked WHERE len(issues) > 0""")
def quality_split(spark, sf_dir):
    rows = validated(spark, sf_dir)
    sides = [
        split(rows).agg(F.count(F.lit(1)).alias("events")).select(F.lit(name).alias("side"), "events")
        for name, split in (("passed", FL.passed), ("failed", FL.failed))
    ]
    return sides[0].unionByName(sides[1])


@register("quality_events", f"""WITH {READINGS}, {ISSUES}
  SELECT 'now' AS ts_utc, c.city, c.source, r.timestamp AS event_timestamp, len(issues) AS issue_count,
  issues[1].message AS first_message FROM checked c JOIN readings r USING (event_id) WHERE len(issues) > 0""")
def quality_events(spark, sf_dir):
    out = Q.quality_events(validated(spark, sf_dir), now="now")
    return out.select(
        "ts_utc", "city", "source", "event_timestamp", F.size("issues").cast("long").alias("issue_count"),
        F.col("issues")[0]["message"].alias("first_message"),
    )


@register("quality_summary", f"""WITH {READINGS}, {ISSUES}
  SELECT city, source, i.type AS type, i.field AS field, count(*) AS issue_count
  FROM (SELECT city, source, unnest(issues) AS i FROM checked) GROUP BY ALL""")
def quality_summary(spark, sf_dir):
    return Q.quality_summary(validated(spark, sf_dir))


@register("require_fields", f"""WITH {READINGS}, {JSON_EVENTS}
  SELECT event_id FROM json_events WHERE CASE WHEN json_valid(value) THEN
  json_type(value, '$.city') IS NOT NULL AND json_type(value, '$.temperature') IS NOT NULL
  AND json_type(value, '$.humidity') IS NOT NULL END""")
def require_fields(spark, sf_dir):
    rows = json_events(readings(spark, sf_dir))
    return FL.require_fields(rows, ["city", "temperature", "humidity"], "value").select("event_id")


# --- anomalies

_LONG_SQL = " UNION ALL ".join(
    f"SELECT event_id, event_ts, coalesce(city, 'unknown') AS city, source, '{f}' AS feature, {f} AS x "
    f"FROM readings WHERE {f} IS NOT NULL" for f in V.FEATURES
)
_FRAME = """OVER (PARTITION BY city, source, feature ORDER BY event_ts, event_id
  ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)"""
ZSCORES = f"""long AS ({_LONG_SQL}),
framed AS (SELECT *, count(x) {_FRAME} AS n, avg(x) {_FRAME} AS mean, stddev_samp(x) {_FRAME} AS sd FROM long),
zscores AS (SELECT event_id, city, source, feature, CASE WHEN n < 30 THEN NULL WHEN coalesce(sd, 0) <= 1e-12
  THEN 0.0e0 ELSE (x - mean) / sd END AS z FROM framed),
scores AS (SELECT r.event_id, max(abs(z)) AS score, coalesce(max(abs(z)) >= 3.5, false) AS is_anomaly
  FROM readings r LEFT JOIN zscores USING (event_id) GROUP BY r.event_id)"""

_LONG_Z = f"""WITH {READINGS}, {ZSCORES}
  SELECT event_id, city, source, feature, round(z, 6) AS z FROM zscores"""


@register("zscore_scores", _LONG_Z)
def zscore_scores(spark, sf_dir):
    out = A.zscore_long(readings(spark, sf_dir), hot_keys=False)
    return rounded(out.select("event_id", "city", "source", "feature", "z"), "z")


@register("zscore_scores_split", _LONG_Z)
def zscore_scores_split(spark, sf_dir):
    """The default, for keys of any size: work is cut into pieces, here small ones."""
    out = A.zscore_long(readings(spark, sf_dir), piece_rows=4000)
    return rounded(out.select("event_id", "city", "source", "feature", "z"), "z")


_FLAGS = f"""WITH {READINGS}, {ZSCORES}
  SELECT event_id, is_anomaly, 'zscore' AS method, round(score, 6) AS score FROM scores"""
_EACH = ", ".join(f"round(max(z) FILTER (feature = '{f}'), 6) AS z_{f}" for f in V.FEATURES)
_FLAGS_EACH = f"""WITH {READINGS}, {ZSCORES}, each AS (SELECT event_id, {_EACH} FROM zscores GROUP BY event_id)
  SELECT s.event_id, is_anomaly, 'zscore' AS method, round(score, 6) AS score, {', '.join(f'z_{f}' for f in V.FEATURES)}
  FROM scores s LEFT JOIN each USING (event_id)"""


def flags(df):
    return rounded(df.select("event_id", "anomaly.is_anomaly", "anomaly.method", "anomaly.score"), "score")


@register("anomaly_flags", _FLAGS_EACH)
def anomaly_flags(spark, sf_dir):
    columns = ["event_id", "event_ts", "city", "source", *V.FEATURES]
    out = A.detect(readings(spark, sf_dir).select(columns))
    each = {f"z_{f}": F.col("anomaly.feature_scores")[f] for f in V.FEATURES}
    return rounded(out.select(
        "event_id", "anomaly.is_anomaly", "anomaly.method", "anomaly.score", *[c.alias(n) for n, c in each.items()]
    ), "score", *each)


@register("anomaly_events", f"""WITH {READINGS}, {ZSCORES}
  SELECT 'now' AS ts_utc, city, source, timestamp AS event_timestamp, round(score, 6) AS score
  FROM readings JOIN scores USING (event_id) WHERE is_anomaly""")
def anomaly_events(spark, sf_dir):
    out = A.anomaly_events(A.detect(readings(spark, sf_dir)), now="now")
    return rounded(out.select("ts_utc", "city", "source", "event_timestamp", "anomaly.score"), "score")


_FOREST_VECTORS = """vectors AS (SELECT event_id, row_number() OVER (
    PARTITION BY coalesce(city, 'unknown'), source ORDER BY {order}) AS r FROM readings
    WHERE temperature IS NOT NULL AND humidity IS NOT NULL AND pressure IS NOT NULL AND wind_speed IS NOT NULL)"""


def forest_sql(order):
    """What is known of scores without the trees: which rows have one, and that the flag follows it."""
    return f"""WITH {READINGS}, {_FOREST_VECTORS.format(order=order)}
  SELECT event_id, 'isolation_forest' AS method, coalesce(r > 200, false) AS scored, true AS flag_follows
  FROM readings LEFT JOIN vectors USING (event_id)"""


def forest_checks(df):
    anomaly = F.col("anomaly")
    follows = anomaly["is_anomaly"].eqNullSafe(F.coalesce(anomaly["score"] < 0, F.lit(False)))
    return df.select("event_id", anomaly["method"].alias("method"), anomaly["score"].isNotNull().alias("scored"),
                     follows.alias("flag_follows"))


@register("iforest_scores", forest_sql("event_ts, event_id"))
def iforest_scores(spark, sf_dir):
    return forest_checks(A.detect(readings(spark, sf_dir, spread=True), method="isolation_forest", enabled=True))


#: A forest made by hand: two trees of depth two over eight samples. Nodes in level order.
_FIXED = I.Forest(
    np.array([[0, 1, -1, -1, -1, -1, -1], [3, -1, 2, -1, -1, -1, -1]], "int8"),
    np.array([[10.0, 50.0, 0, 0, 0, 0, 0], [20.0, 0, 1000.0, 0, 0, 0, 0]]),
    np.array([[8, 5, 3, 2, 3, 0, 0], [8, 6, 2, 0, 0, 1, 1]], "int32"), 8, -0.5,
)


def _c(n):
    """Mean path in a tree of n points, in SQL."""
    return {1: "0.0e0", 2: "1.0e0"}.get(n, f"(2.0e0 * (ln({n - 1}) + 0.5772156649015329e0) - 2.0e0 * {n - 1} / {n})")


_FIXED_SQL = f"""WITH {READINGS}, paths AS (SELECT event_id, event_ts, city,
    CASE WHEN temperature > 10 THEN 1 + {_c(3)} WHEN humidity > 50 THEN 2 + {_c(3)} ELSE 2 + {_c(2)} END AS one,
    CASE WHEN wind_speed > 20 THEN 2 + {_c(1)} ELSE 1 + {_c(6)} END AS two FROM readings
    WHERE temperature IS NOT NULL AND humidity IS NOT NULL AND pressure IS NOT NULL AND wind_speed IS NOT NULL)
  SELECT event_id, round(-power(2.0e0, -((one + two) / 2) / {_c(8)}) + 0.5e0, 9) AS score FROM paths
  WHERE event_ts > TIMESTAMP '2024-01-10' OR city = 'City 1'"""


@register("iforest_fixed", _FIXED_SQL)
def iforest_fixed(spark, sf_dir):
    """Scores of a forest whose paths SQL can follow; keys differ in where their training ended."""
    rows = readings(spark, sf_dir)
    start = F.when(F.col("city") == "City 1", F.timestamp_seconds(F.lit(0))).otherwise(
        F.timestamp_micros(F.lit(1704844800000000)))
    last = F.when(F.col("city") == "City 1", F.lit(-1)).otherwise(F.lit(2**62)).cast("long")
    keys = rows.select(A.key_text(F.col("city")).alias("city"), A.key_text(F.col("source")).alias("source")).distinct()
    models = materialise(keys.select(
        "city", "source", F.struct(start.alias("event_ts"), last.alias("event_id")).alias("cut"),
        F.lit(bytearray(_FIXED.to_bytes())).alias("model"),
    ), "fixed")
    return rounded(I.iforest_score(rows, models), "score", places=9)


@register("iforest_training", f"""WITH {READINGS}, {_FOREST_VECTORS.format(order="event_ts, event_id")},
  keyed AS (SELECT coalesce(city, 'unknown') AS city, source, count(*) AS n FROM readings JOIN vectors USING (event_id) GROUP BY ALL)
  SELECT city, source, {V.IFOREST_TREES}::BIGINT AS trees, {V.IFOREST_MIN_SAMPLES}::BIGINT AS samples, true AS sizes_add_up,
  true AS cuts_within, true AS few_flagged FROM keyed WHERE n >= {V.IFOREST_MIN_SAMPLES}""")
def iforest_training(spark, sf_dir):
    """Every key's fitted forest: its trees hold all samples, children add up to their node, cuts lie
    within the training values, and as many training rows are flagged as the contamination says."""
    rows = readings(spark, sf_dir)
    order, key = ["event_ts", "event_id"], ["city", "source"]
    models = materialise(I.iforest_fit(rows), "training")
    vectors = I._vectors(rows, "event_id", order, list(V.FEATURES), key)
    first = vectors.join(models.select(*key, "cut"), key).where(F.struct(*order) <= F.col("cut")).drop("cut")

    def look(pdf, model):
        if not len(model):
            return pd.DataFrame(columns=["city", "source", "trees", "samples", "sizes_add_up", "cuts_within", "few_flagged"])
        forest, x = I.Forest.from_bytes(bytes(model["model"].iloc[0])), pdf[list(V.FEATURES)].to_numpy("float64")
        inner = np.argwhere(forest.feature >= 0)
        t, n = inner[:, 0], inner[:, 1]
        f, cut = forest.feature[t, n], forest.threshold[t, n]
        below = forest.decision(x) < 0
        return pd.DataFrame([{
            "city": model["city"].iloc[0], "source": model["source"].iloc[0], "trees": len(forest.feature), "samples": len(x),
            "sizes_add_up": bool((forest.size[:, 0] == min(len(x), V.IFOREST_MAX_SAMPLES)).all()
                                 and (forest.size[t, n] == forest.size[t, 2 * n + 1] + forest.size[t, 2 * n + 2]).all()),
            "cuts_within": bool(((cut >= x.min(axis=0)[f]) & (cut < x.max(axis=0)[f])).all()),
            "few_flagged": bool(abs(below.mean() - V.IFOREST_CONTAMINATION) <= 1.5 / len(x)),
        }])

    schema = "city string, source string, trees long, samples long, sizes_add_up boolean, cuts_within boolean, few_flagged boolean"
    return first.groupBy(*key).cogroup(models.select(*key, "model").groupBy(*key)).applyInPandas(look, schema)


@register("iforest_scored_events", f"""WITH {READINGS}, {_FOREST_VECTORS.format(order="event_ts, event_id")}
  SELECT event_id, coalesce(r > 200, false) AS scored FROM readings LEFT JOIN vectors USING (event_id)""")
def iforest_scored_events(spark, sf_dir):
    out = A.detect(readings(spark, sf_dir, spread=True), method="isolation_forest", enabled=True)
    return out.select("event_id", F.col("anomaly.score").isNotNull().alias("scored"))


# --- stream metrics

_PROCESSED = """CASE WHEN event_id % 89 = 0 THEN event_ts - INTERVAL 1 SECOND
  ELSE event_ts + ((event_id * 37) % 5000) * INTERVAL 1 MILLISECOND END"""
_STAMP = """CASE WHEN event_id % 83 = 0 THEN 'not a time' WHEN event_id % 79 = 0 THEN NULL
  WHEN event_id % 2 = 0 THEN timestamp || 'Z' ELSE timestamp END"""
MESSAGES = f"""messages AS (SELECT event_id, event_id % 4 AS kafka_partition, event_id // 4 AS kafka_offset,
  {_PROCESSED} AS processed_at, CASE WHEN event_id % 83 <> 0 AND event_id % 79 <> 0
  THEN greatest(0.0e0, epoch_us({_PROCESSED}) / 1000.0e0 - epoch_us(event_ts) / 1000.0e0) END AS latency_ms
  FROM readings),
windows AS (SELECT kafka_partition, kafka_offset // 25 AS w, count(*) AS window_messages,
  epoch_us(arg_max(processed_at, kafka_offset)) / 1e6 AS closed, epoch_us(min(processed_at)) / 1e6 AS first,
  avg(latency_ms) AS avg_latency_ms, max(kafka_offset) AS kafka_offset FROM messages GROUP BY ALL),
metrics AS (SELECT *, greatest(1e-6, closed - coalesce(lag(closed) OVER (PARTITION BY kafka_partition ORDER BY w),
  first)) AS window_seconds FROM windows)"""


def messages(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumns({
        "timestamp": F.expr(_STAMP),
        "processed_at": F.timestamp_micros(F.unix_micros("event_ts") + F.when(
            F.col("event_id") % 89 == 0, -1_000_000
        ).otherwise((F.col("event_id") * 37) % 5000 * 1000)),
        "partition": (F.col("event_id") % 4).cast("int"),
        "offset": F.expr("event_id div 4"),
    })
    return M.with_latency(rows)


@register("latency", f"WITH {READINGS}, {MESSAGES} SELECT event_id, round(latency_ms, 3) AS latency_ms FROM messages")
def latency(spark, sf_dir):
    return rounded(messages(spark, sf_dir).select("event_id", "latency_ms"), "latency_ms", places=3)


@register("stream_metrics", f"""WITH {READINGS}, {MESSAGES}
  SELECT kafka_partition, kafka_offset, window_messages, round(window_seconds, 4) AS window_seconds,
  round(window_messages / window_seconds, 4) AS throughput_mps, round(avg_latency_ms, 4) AS avg_latency_ms
  FROM metrics""")
def stream_metrics(spark, sf_dir):
    out = M.stream_metrics(messages(spark, sf_dir)).drop("ts_utc").withColumn(
        "kafka_partition", F.col("kafka_partition").cast("long")
    )
    return rounded(out, "window_seconds", "throughput_mps", "avg_latency_ms", places=4)


@register("metrics_summary", f"""WITH {READINGS}, {MESSAGES}, t AS (SELECT *, window_messages / window_seconds
  AS throughput_mps FROM metrics) SELECT sum(window_messages)::BIGINT AS events, count(*) AS windows,
  round(quantile_cont(throughput_mps, 0.5), 4) AS median_throughput_mps,
  round(quantile_cont(throughput_mps, 0.95), 4) AS p95_throughput_mps,
  round(quantile_cont(avg_latency_ms, 0.5), 4) AS median_latency_ms,
  round(quantile_cont(avg_latency_ms, 0.95), 4) AS p95_latency_ms FROM t""")
def metrics_summary(spark, sf_dir):
    out = M.metrics_summary(M.stream_metrics(messages(spark, sf_dir)))
    return rounded(out, *[c for c in out.columns if c.endswith(("_mps", "_ms"))], places=4)


@register("monitoring_logs", f"""WITH {READINGS}, {ISSUES}, {ZSCORES}, {MESSAGES}
  SELECT 'quality' AS log, count(*) AS records, sum(len(issues))::BIGINT AS detail FROM checked WHERE len(issues) > 0
  UNION ALL SELECT 'anomaly', count(*), count(DISTINCT city) FROM scores JOIN readings USING (event_id) WHERE is_anomaly
  UNION ALL SELECT 'metrics', count(*), sum(window_messages)::BIGINT FROM metrics""")
def monitoring_logs(spark, sf_dir):
    """The three logs, appended as JSON Lines and read back."""
    base = new_path(spark, "logs")
    W.append_jsonl(Q.quality_events(validated(spark, sf_dir)), f"{base}/quality")
    W.append_jsonl(A.anomaly_events(A.detect(readings(spark, sf_dir))), f"{base}/anomaly")
    W.append_jsonl(M.stream_metrics(messages(spark, sf_dir)), f"{base}/metrics")
    details = (
        ("quality", QUALITY_EVENT, F.sum(F.size("issues"))),
        ("anomaly", ANOMALY_EVENT, F.count_distinct("city")),
        ("metrics", STREAM_METRIC, F.sum("window_messages")),
    )
    logs = [
        spark.read.schema(schema).json(f"{base}/{name}")
        .agg(F.count("ts_utc").alias("records"), detail.alias("detail"))
        .select(F.lit(name).alias("log"), "records", "detail")
        for name, schema, detail in details
    ]
    return logs[0].unionByName(logs[1]).unionByName(logs[2])


# --- streaming forms; their results must equal the batch forms


def _run_to_end(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _stateful(spark, sf_dir, detector, name):
    with ST.rocksdb(spark):
        path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
        scored = detector(reading_stream(spark, sf_dir), ["event_id"])
        out = scored.select("event_id", "anomaly.is_anomaly", "anomaly.method", "anomaly.score")
        _run_to_end(start_log_sink(out, path, checkpoint, "available_now"))
    schema = "event_id long, is_anomaly boolean, method string, score double"
    return spark.read.schema(schema).json(path)


@register("zscore_stream", _FLAGS)
def zscore_stream(spark, sf_dir):
    return rounded(_stateful(spark, sf_dir, ST.zscore_stream, "zscore"), "score")


@register("zscore_state", f"""WITH {READINGS}, long AS ({_LONG_SQL}),
  newest AS (SELECT * FROM long WHERE x IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY city, source, feature ORDER BY event_id DESC) <= {V.ZSCORE_WINDOW})
  SELECT city, source, feature, count(*) AS kept, round(sum(x), 4) AS total, round(max_by(x, event_id), 6) AS last FROM newest
  GROUP BY city, source, feature""")
def zscore_state(spark, sf_dir):
    """What the stream keeps per key when all events have passed."""
    with ST.rocksdb(spark):
        checkpoint = new_path(spark, "audited-checkpoint")
        scored = ST.zscore_stream(reading_stream(spark, sf_dir), ["event_id"])
        _run_to_end(start_log_sink(scored, new_path(spark, "audited"), checkpoint, "available_now"))
    found = ST.kept_values(spark, checkpoint).where(F.size("kept") > 0)
    total = F.aggregate("kept", F.lit(0.0), lambda a, x: a + x)
    return rounded(found.select(
        "city", "source", "feature", F.size("kept").cast("long").alias("kept"), F.round(total, 4).alias("total"),
        F.element_at("kept", -1).alias("last")), "last")


@register("iforest_stream", forest_sql("event_id"))
def iforest_stream(spark, sf_dir):
    out = _stateful(spark, sf_dir, ST.iforest_stream, "iforest")
    return forest_checks(out.select("event_id", F.struct("is_anomaly", "method", "score").alias("anomaly")))


@register("monitor_stream", f"""WITH {READINGS}, {ISSUES}, {ZSCORES}
  SELECT event_id, len(issues) = 0 AS passed, len(issues) AS issue_count, is_anomaly, round(score, 6) AS score
  FROM checked JOIN scores USING (event_id)""")
def monitor_stream(spark, sf_dir):
    stream = reading_stream(spark, sf_dir).withColumn("value", F.expr(JSON_VALUE))
    out, checkpoint = new_path(spark, "monitor"), new_path(spark, "monitor-checkpoint")
    _run_to_end(MO.start_monitor(
        stream, out, checkpoint, trigger="available_now", tasks=spark.sparkContext.defaultParallelism
    ))
    schema = """event_id long, data_quality struct<passed boolean, issue_count long>,
      anomaly struct<is_anomaly boolean, score double>"""
    events = spark.read.schema(schema).json(f"{out}/events")
    return rounded(events.select(
        "event_id", "data_quality.passed", "data_quality.issue_count", "anomaly.is_anomaly", "anomaly.score"
    ), "score")


@register("monitor_batch", f"""WITH {READINGS}, {ISSUES}, {ZSCORES}
  SELECT event_id, len(issues) = 0 AS passed, len(issues) AS issue_count, is_anomaly, round(score, 6) AS score
  FROM checked JOIN scores USING (event_id)""")
def monitor_batch(spark, sf_dir):
    rows = readings(spark, sf_dir, spread=True).withColumn("value", F.expr(JSON_VALUE))
    out = MO.monitor(rows, severity="combined")
    return rounded(out.select(
        "event_id", "data_quality.passed", F.col("data_quality.issue_count").cast("long").alias("issue_count"),
        "anomaly.is_anomaly", "anomaly.score",
    ), "score")


def _in_parts(spark, rows, name, parts=3):
    """The rows as a stream that arrives in parts, by event id: yields after landing each part."""
    path = new_path(spark, name)
    last = rows.agg(F.max("event_id")).first()[0] or 0
    for part in range(parts):
        low, high = (last + 1) * part // parts, (last + 1) * (part + 1) // parts
        rows.where(f"event_id >= {low} AND event_id < {high}").write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


@register("monitor_metrics", f"""WITH {READINGS}, {MESSAGES}
  SELECT kafka_partition, kafka_offset, window_messages, round(window_seconds, 4) AS window_seconds,
  round(window_messages / window_seconds, 4) AS throughput_mps, round(avg_latency_ms, 4) AS avg_latency_ms
  FROM metrics""")
def monitor_metrics(spark, sf_dir):
    """The metric log of a run in several micro-batches; windows go on from one to the next."""
    rows = messages(spark, sf_dir).drop("latency_ms").withColumnRenamed("processed_at", "stamp")
    rows = rows.withColumn("value", F.expr(JSON_VALUE))
    out, checkpoint = new_path(spark, "monitored"), new_path(spark, "monitored-checkpoint")
    for stream in _in_parts(spark, rows, "messages"):
        _run_to_end(MO.start_monitor(
            stream, out, checkpoint, trigger="available_now", tasks=spark.sparkContext.defaultParallelism,
            processed_at=F.col("stamp"),
        ))
    log = spark.read.schema(STREAM_METRIC).json(f"{out}/metrics").drop("batch").unionByName(
        spark.read.schema(STREAM_METRIC).json(f"{out}/open_metrics"))
    log = log.drop("ts_utc").withColumn("kafka_partition", F.col("kafka_partition").cast("long"))
    return rounded(log, "window_seconds", "throughput_mps", "avg_latency_ms", places=4)


@register("monitor_stream_iforest", forest_sql("event_id"))
def monitor_stream_iforest(spark, sf_dir):
    """The monitored stream with Isolation Forests, in several micro-batches."""
    rows = readings(spark, sf_dir).withColumn("value", F.expr(JSON_VALUE))
    out, checkpoint = new_path(spark, "forest"), new_path(spark, "forest-checkpoint")
    for stream in _in_parts(spark, rows, "forest-events"):
        _run_to_end(MO.start_monitor(
            stream, out, checkpoint, trigger="available_now", tasks=spark.sparkContext.defaultParallelism,
            method="isolation_forest", enabled=True,
        ))
    schema = "event_id long, anomaly struct<is_anomaly boolean, method string, score double>"
    return forest_checks(spark.read.schema(schema).json(f"{out}/events"))


@register("stream_progress", f"WITH {READINGS} SELECT sum(1)::BIGINT AS input_rows, true AS rates_known FROM readings")
def stream_progress(spark, sf_dir):
    """Rows and rates of a running query, as it reports them."""
    query = start_log_sink(
        reading_stream(spark, sf_dir).select("event_id"), new_path(spark, "progress"), new_path(spark, "progress-checkpoint"),
        "available_now",
    )
    _run_to_end(query)
    seen = [p for p in M.progress_metrics(query) if p["input_rows"]]
    rows = [(sum(p["input_rows"] for p in seen), all(p["throughput_mps"] > 0 for p in seen))]
    return spark.createDataFrame(rows, "input_rows long, rates_known boolean")
