"""Structured Streaming sinks. Each query has its own checkpoint in shared storage."""

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from skygauge import fixed_values as V
from skygauge.sources.kafka import to_kafka_value
from skygauge.sources.sinks import with_address


def _trigger(writer, trigger):
    """``available_now`` or an interval such as ``1 minute``; None is as fast as possible."""
    if trigger == "available_now":
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger) if trigger else writer


def _dealt(df: DataFrame, folders, files: int) -> DataFrame:
    """Rows of a folder meet in at most ``files`` tasks of a micro-batch, and so in as many files,
    not in one per task and folder; a hot folder is spread over that many."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.NumericType, T.TimestampType))]
    return df.repartition(*folders, F.pmod(F.xxhash64(*plain), F.lit(files)))


def start_kafka_sink(
    df: DataFrame, servers: str, checkpoint: str, topic: str = V.PROCESSED_TOPIC, trigger=None,
) -> StreamingQuery:
    """Whole rows as JSON to a topic; needs the Kafka connector."""
    writer = (
        to_kafka_value(df).writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, trigger).start()


def start_parquet_sink(
    df: DataFrame, path: str, checkpoint: str, trigger="1 minute", partition_by=(), files: int = 4,
) -> StreamingQuery:
    """Parquet, by folder if asked for, with at most ``files`` files per folder and micro-batch."""
    if partition_by:
        df = _dealt(df, partition_by, files)
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _trigger(writer, trigger).start(path)


def start_event_sink(
    df: DataFrame, path: str, checkpoint: str, trigger="1 minute", files: int = 4,
) -> StreamingQuery:
    """Processed events as JSON by city and day, in at most ``files`` files each per micro-batch."""
    writer = (
        _dealt(with_address(df), ["city_slug", "event_date"], files).writeStream.format("json").partitionBy("city_slug", "event_date")
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, trigger).start(path)


def start_log_sink(df: DataFrame, path: str, checkpoint: str, trigger="1 minute") -> StreamingQuery:
    """Quality, anomaly or metric records as JSON Lines."""
    writer = (
        df.writeStream.format("json").option("ignoreNullFields", False)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, trigger).start(path)
