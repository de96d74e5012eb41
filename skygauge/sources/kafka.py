"""Kafka-shaped frames: scan, parse, shape for writing, peek.

The scans need Spark's Kafka connector on the class path. Everything else works on
any frame with the columns key, value, topic, partition, offset, timestamp.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skygauge import fixed_values as V
from skygauge.functions.scalars import safe_double_sql
from skygauge.schemas import READING
from skygauge.sources.files import CORRUPT


def read_kafka_stream(
    spark: SparkSession, servers: str, topic: str = V.RAW_TOPIC,
    starting: str = "latest", max_offsets: int | None = None,
) -> DataFrame:
    """Streaming scan of a topic; ``starting`` is ``latest`` or ``earliest``.

    ``max_offsets`` bounds a micro-batch, and with it every per-key step in it.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()


def read_kafka_batch(spark: SparkSession, servers: str, topic: str = V.RAW_TOPIC) -> DataFrame:
    """Everything a topic holds now, as a batch."""
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )


def _as_text(dtype):
    """The schema with numbers read as text, so that one odd value spoils nothing."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in dtype.fields])
    return T.StringType() if isinstance(dtype, T.NumericType) else dtype


def _as_declared(x: str, dtype) -> str:
    """SQL that turns the text ``x`` into its declared type."""
    if isinstance(dtype, T.StructType):
        fields = ", ".join(
            f"'{f.name}', {_as_declared(f'{x}.`{f.name}`', f.dataType)}" for f in dtype.fields
        )
        return f"CASE WHEN {x} IS NOT NULL THEN named_struct({fields}) END"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return safe_double_sql(x)
    return f"try_cast({x} AS {dtype.simpleString()})" if isinstance(dtype, T.NumericType) else x


def parse_kafka_value(df: DataFrame, schema: T.StructType = READING, keep=()) -> DataFrame:
    """Key as text and the JSON value expanded to columns, in one pass.

    Numbers are read leniently: ``"12.5"`` counts, other text is NULL. A value that is
    no JSON object leaves the fields NULL and its text in ``_corrupt``. ``keep`` names
    columns of the frame to carry along, e.g. partition and offset.
    """
    fields = [f for f in schema.fields if f.name != CORRUPT]
    texts = T.StructType([
        *[T.StructField(f.name, _as_text(f.dataType)) for f in fields],
        T.StructField(CORRUPT, T.StringType()),
    ])
    parsed = F.from_json(
        F.col("value").cast("string"), texts,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    out = df.select(F.col("key").cast("string").alias("key"), *keep, parsed.alias("r"))
    return out.select(
        "key", *keep,
        *[F.expr(_as_declared(f"r.`{f.name}`", f.dataType)).alias(f.name) for f in fields],
        F.col("r")[CORRUPT].alias(CORRUPT),
    )


def to_kafka_records(df: DataFrame, key: str = "city", now=None) -> DataFrame:
    """(key, value) rows of readings, stamped with the time of ingestion.

    ``key`` is ``city`` or ``city_timestamp``; a missing city becomes ``unknown``.
    """
    stamp = F.current_timestamp() if now is None else now
    stamped = df.withColumn("ingest_ts_unix_ms", F.unix_millis(stamp))
    name = F.coalesce(F.col("city"), F.lit("unknown"))
    if key == "city_timestamp":
        seconds = F.unix_seconds(stamp).cast("string")
        name = F.concat_ws("_", name, F.coalesce(F.col("timestamp"), seconds))
    elif key != "city":
        raise ValueError(f"unknown key form: {key}")
    return stamped.select(name.alias("key"), F.to_json(F.struct("*")).alias("value"))


def to_kafka_value(df: DataFrame) -> DataFrame:
    """The whole row as JSON in ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def peek_topic(df: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` messages, without the bulky ``raw_data`` field.

    The limit is the feature: it runs as a bounded top-k in every task.
    """
    newest = df.orderBy(F.desc("timestamp"), F.desc("partition"), F.desc("offset")).limit(n)
    value = F.col("value").cast("string")
    keys = F.json_object_keys(value)
    has_raw = F.coalesce(F.array_contains(keys, "raw_data"), F.lit(False))
    variant = F.try_parse_json(value)
    slim = F.to_json(F.map_filter(
        variant.cast("map<string,variant>"), lambda k, _: k != "raw_data"
    ))
    return newest.select(
        "partition", "offset", F.col("key").cast("string").alias("key"), "timestamp",
        F.when(has_raw, slim).otherwise(value).alias("value"),
    )
