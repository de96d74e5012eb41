"""Stream metrics: latency, throughput per message window, their summary."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from skygauge import fixed_values as V
from skygauge.functions.scalars import event_ts_ms, iso_utc
from skygauge.operators.ordered import bracket_counts, bracket_quantiles, quantile_brackets


def latency_ms(processed: Column, event: Column) -> Column:
    """max(0, processed - event) in ms; NULL if the event's text is no timestamp.

    ``event`` is ISO text or epoch milliseconds (any numeric column).
    """
    return F.greatest(F.lit(0.0), F.unix_micros(processed) / F.lit(1000.0) - event)


def with_latency(
    df: DataFrame, processed_col: str = "processed_at", timestamp_col: str = "timestamp",
) -> DataFrame:
    event = F.col(timestamp_col)
    if dict(df.dtypes)[timestamp_col] == "string":
        event = event_ts_ms(event)
    late = latency_ms(F.col(processed_col), event)
    # greatest() skips NULLs, so an unknown event time has to stay unknown here.
    return df.withColumn("latency_ms", F.when(event.isNotNull(), late))


def message_windows(
    df: DataFrame, n: int = V.METRIC_WINDOW_MESSAGES, processed_col: str = "processed_at",
    partition_col: str = "partition", offset_col: str = "offset",
) -> DataFrame:
    """Counts of every ``n`` messages of a Kafka partition, by floor(offset / n).

    Sums and extremes of primitives: hash aggregation, combined before the shuffle. Rows of
    one window from different frames merge with ``merge_windows``.
    """
    seconds = F.unix_micros(F.col(processed_col)) / F.lit(1e6)
    return df.groupBy(
        F.col(partition_col).alias("kafka_partition"), F.floor(F.col(offset_col) / n).cast("long").alias("_w"),
    ).agg(
        F.count(F.lit(1)).alias("window_messages"),
        F.max_by(seconds, F.col(offset_col)).alias("_closed"),
        F.min(seconds).alias("_first"),
        F.sum("latency_ms").alias("_latency"),
        F.count("latency_ms").alias("_timed"),
        F.max(offset_col).alias("kafka_offset"),
    )


def merge_windows(windows: DataFrame) -> DataFrame:
    return windows.groupBy("kafka_partition", "_w").agg(
        F.sum("window_messages").alias("window_messages"), F.max_by("_closed", "kafka_offset").alias("_closed"),
        F.min("_first").alias("_first"), F.sum("_latency").alias("_latency"), F.sum("_timed").alias("_timed"),
        F.max("kafka_offset").alias("kafka_offset"),
    )


def window_records(windows: DataFrame, start=None, before: DataFrame | None = None, step: int = 4096) -> DataFrame:
    """One record per window; its length is the time since the one before it closed.

    The first window of a partition counts from the close in ``before`` (kafka_partition,
    closed_before), else from ``start``, else from its first message. The look back runs in two
    levels, windows within a step and steps within the partition, so even a partition
    with most of the messages is not read by one task.
    """
    closed = windows.withColumn("_step", F.expr(f"_w div {step}"))
    earlier = Window.partitionBy("kafka_partition").orderBy("_step")
    steps = closed.groupBy("kafka_partition", "_step").agg(
        F.max_by("_closed", "_w").alias("_last"), F.min_by("_first", "_w").alias("_begin"),
    ).select(
        "kafka_partition", "_step",
        F.lag("_last").over(earlier).alias("_previous_step"),
        F.first("_begin").over(earlier).alias("_begin"),
    )
    opening = F.col("_begin") if start is None else F.unix_micros(start) / F.lit(1e6)
    if before is not None:
        steps = steps.join(before, "kafka_partition", "left")
        opening = F.coalesce("closed_before", opening)
    within = Window.partitionBy("kafka_partition", "_step").orderBy("_w")
    linked = closed.withColumn("_previous", F.lag("_closed").over(within)).join(
        steps, ["kafka_partition", "_step"]
    )
    since = F.coalesce("_previous", "_previous_step", opening)
    elapsed = F.greatest(F.lit(V.METRIC_MIN_SECONDS), F.col("_closed") - since)
    return linked.select(
        iso_utc(F.timestamp_micros((F.col("_closed") * 1e6).cast("long"))).alias("ts_utc"),
        "window_messages", elapsed.alias("window_seconds"),
        (F.col("window_messages") / elapsed).alias("throughput_mps"),
        (F.col("_latency") / F.when(F.col("_timed") > 0, F.col("_timed"))).alias("avg_latency_ms"),
        "kafka_partition", "kafka_offset",
    )


def stream_metrics(
    df: DataFrame, n: int = V.METRIC_WINDOW_MESSAGES, start=None,
    processed_col: str = "processed_at", partition_col: str = "partition",
    offset_col: str = "offset", step: int = 4096,
) -> DataFrame:
    """One record per ``n`` messages of a Kafka partition, over all messages at once.

    A window closes when its last message is processed. The last window may be partial and
    reports its true count.
    """
    windows = message_windows(df, n, processed_col, partition_col, offset_col)
    return window_records(windows, start, step=step)


def live_windows(new: DataFrame, past: DataFrame | None, n: int = V.METRIC_WINDOW_MESSAGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows that go on across micro-batches: records of the closed ones, of the open ones, and
    the state for the next micro-batch.

    ``new`` are the ``message_windows`` of a micro-batch, ``past`` the state (None at first): one row
    per partition, with its open window, if any, and when the one before closed. A window
    closes with its ``n``-th message, or when a later one of its partition has begun.
    """
    windows, before = new, None
    if past is not None:
        before = past.where("closed_before IS NOT NULL").select("kafka_partition", "closed_before")
        windows = merge_windows(new.unionByName(past.where("_w IS NOT NULL").drop("closed_before")))
    top = windows.groupBy(F.col("kafka_partition").alias("_p")).agg(F.max("_w").alias("_top"))
    marked = windows.join(top, F.col("kafka_partition") == F.col("_p")).drop("_p")
    is_open = (F.col("_w") == F.col("_top")) & (F.col("window_messages") < n)
    closed, still = marked.where(~is_open).drop("_top"), marked.where(is_open).drop("_top")
    last = closed.groupBy("kafka_partition").agg(F.max_by("_closed", "_w").alias("closed_before"))
    if before is not None:
        older = before.join(last.select("kafka_partition"), "kafka_partition", "left_anti")
        last = last.unionByName(older)
    state = still.join(last, "kafka_partition", "full")
    return window_records(closed, before=before), window_records(still, before=last), state


_SUMMARY = (
    ("throughput_mps", 0.5, "median_throughput_mps"), ("throughput_mps", 0.95, "p95_throughput_mps"),
    ("avg_latency_ms", 0.5, "median_latency_ms"), ("avg_latency_ms", 0.95, "p95_latency_ms"),
)


def metrics_summary(metrics: DataFrame, approximate: bool = False) -> DataFrame:
    """Events, median and 95th percentile of throughput and latency over the windows.

    Exact by default, in two passes over the windows (``exact_quantiles``). ``approximate`` takes one pass with
    mergeable sketches and is the choice for a live view of a large log.
    """
    sums = [F.sum("window_messages").alias("events"), F.count(F.lit(1)).alias("windows")]
    if approximate:
        return metrics.agg(*sums, *[F.percentile_approx(c, p, 10000).alias(name) for c, p, name in _SUMMARY])
    columns = ["throughput_mps", "avg_latency_ms"]
    brackets = quantile_brackets(metrics, columns, [0.5, 0.95])
    counted = bracket_counts(metrics, columns, brackets, F.sum("window_messages").alias("events"))
    # every window has one count under each metric
    mine = F.col("metric") == columns[0]
    row = bracket_quantiles(
        counted, brackets, F.sum(F.when(mine, F.col("events"))).alias("events"), F.coalesce(F.sum(F.when(mine, F.col("f"))), F.lit(0)).alias("windows"))
    place = {(c, p): f"{c}_{i}" for c, own in brackets.items() for i, (p, *_) in enumerate(own)}
    return row.select("events", "windows", *[
        (F.col(place[c, p]) if (c, p) in place else F.lit(None).cast("double")).alias(name) for c, p, name in _SUMMARY])


def zone_volume(files: DataFrame) -> DataFrame:
    """Records and bytes of a zone, from the file metadata of its scan."""
    per_file = files.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.max("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("records")
    )
    return per_file.agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


def progress_metrics(query) -> list[dict]:
    """Rows and rates of a running query's last micro-batches, as Spark reports them."""
    return [
        {
            "batch_id": p["batchId"], "ts_utc": p["timestamp"],
            "input_rows": p["numInputRows"],
            "input_mps": p["inputRowsPerSecond"],
            "throughput_mps": p["processedRowsPerSecond"],
        }
        for p in query.recentProgress
    ]
