"""The monitored event stream.

Events are scored on arrival with state in Spark's state store (``streaming.stateful``): the last
values of each key, or its training vectors and forest. Each micro-batch of scored events is then
enriched, validated, measured and written as one set of DataFrame jobs. A batch that runs again
after a failure starts from the state before it and overwrites its own output, so nothing is
lost or doubled. Message windows that are open go on from two small folders in turn.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from skygauge import fixed_values as V
from skygauge.operators import anomaly as A, iforest as I, metrics as M, quality as Q
from skygauge.operators.enrich import enrich
from skygauge.sources.sinks import with_address
from skygauge.streaming import stateful
from skygauge.streaming.sinks import _trigger

_ID = ("partition", "offset")
_KEY = ("city", "source")
#: Times keep their microseconds in a row's JSON text.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def monitor(
    df: DataFrame, id_col: str = "event_id", order=("event_ts", "event_id"),
    json_col: str = "value", severity: str = "combined", method: str = "zscore",
    enabled: bool = False, now=None, **options,
) -> DataFrame:
    """Batch form: readings with their JSON text, enriched, scored and validated.

    Scoring reads the frame more than once, so the costly validation comes after it.
    """
    events = A.detect(enrich(df, severity, now), method, enabled, id_col, order, **options)
    return Q.validate(events, json_col)


def clock() -> F.Column:
    """The wall clock when a row passes, in microseconds; read for every row."""
    return F.expr("reflect('java.time.Instant', 'now')").cast("timestamp")


def start_monitor(
    stream: DataFrame, out: str, checkpoint: str, trigger=None, severity: str = "combined",
    features=V.FEATURES, log_every: int = V.METRIC_WINDOW_MESSAGES, json_col: str = "value",
    now=None, tasks: int | None = None, method: str = "zscore", enabled: bool = False,
    processed_at: F.Column | None = None, **scoring,
) -> StreamingQuery:
    """Runs the monitored stream on parsed Kafka rows.

    ``stream`` has the reading columns, the JSON text, partition and offset. Output
    folders below ``out``: events, quality, anomalies, metrics, each by batch, and open_metrics
    with the message windows that are not full yet. ``tasks`` deals a scored micro-batch out to that
    many tasks, for streams with few keys. The Isolation Forest scores if it is the
    ``method`` and ``enabled``, else z-scores; ``scoring`` are options of ``stateful.iforest_stream`` or
    ``zscore_stream``. ``processed_at`` is the time a message counts as processed, by default a clock
    read for every row as it goes to its key's state: from there on a partition's rows are not in order.
    """
    spark = stream.sparkSession
    stream = stream.withColumn("processed_at", clock() if processed_at is None else processed_at)
    columns = [c for c in stream.columns if c != "anomaly"]
    detector = stateful.iforest_stream if method.lower() == I.METHOD and enabled else stateful.zscore_stream
    rows = stream.select(F.struct(*columns).alias("row"), *_ID, *_KEY, *features)
    scored = detector(rows, ["row"], _ID, features, _KEY, tasks=tasks, **scoring).select("row.*", "anomaly")

    def run(batch: DataFrame, batch_id: int) -> None:
        # kept: the state is read and written once, by the first that asks for the events
        events = Q.validate(enrich(batch, severity, now), json_col).persist()
        fresh = M.message_windows(M.with_latency(events), log_every).persist()
        try:
            windows = f"{checkpoint}/windows"
            before = batch.sparkSession.read.parquet(f"{windows}/{(batch_id - 1) % 2}") if batch_id else None
            records, still, carried = M.live_windows(fresh, before, log_every)
            carried.coalesce(1).write.mode("overwrite").parquet(f"{windows}/{batch_id % 2}")
            parts = {
                f"events/batch={batch_id}": with_address(events.drop("issues", json_col)),
                f"quality/batch={batch_id}": Q.quality_events(events, now),
                f"anomalies/batch={batch_id}": A.anomaly_events(events, now),
                f"metrics/batch={batch_id}": records,
                "open_metrics": still,
            }
            for name, frame in parts.items():
                frame.write.mode("overwrite").option("ignoreNullFields", False).json(f"{out}/{name}")
        finally:
            fresh.unpersist()
            events.unpersist()

    writer = scored.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    with stateful.rocksdb(spark):
        return _trigger(writer, trigger).start()
