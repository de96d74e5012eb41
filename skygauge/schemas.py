"""Spark schemas of readings, provider payloads and monitoring records."""

from pyspark.sql import types as T


def _struct(**fields):
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _D = T.StringType(), T.DoubleType()

COORDINATES = _struct(lat=_D, lon=_D)

READING = _struct(
    timestamp=_S, source=_S, city=_S, country=_S, coordinates=COORDINATES,
    temperature=_D, humidity=_D, pressure=_D, wind_speed=_D, wind_direction=_D,
    clouds=_D, weather_condition=_S, weather_description=_S, description=_S,
    station_id=_S, station_name=_S, ingest_ts_unix_ms=T.LongType(), raw_data=_S,
)

OPENWEATHER_PAYLOAD = _struct(
    name=_S,
    sys=_struct(country=_S),
    coord=COORDINATES,
    main=_struct(temp=_D, humidity=_D, pressure=_D),
    wind=_struct(speed=_D, deg=_D),
    clouds=_struct(all=_D),
    weather=T.ArrayType(_struct(main=_S, description=_S)),
)

WEATHERAPI_PAYLOAD = _struct(
    location=_struct(name=_S, country=_S, lat=_D, lon=_D),
    current=_struct(
        temp_c=_D, humidity=_D, pressure_mb=_D, wind_kph=_D, wind_degree=_D,
        cloud=_D, condition=_struct(text=_S),
    ),
)

ISSUE = _struct(type=_S, field=_S, message=_S)

QUALITY_EVENT = _struct(
    ts_utc=_S, city=_S, source=_S, event_timestamp=_S, issues=T.ArrayType(ISSUE),
)

ANOMALY = _struct(
    is_anomaly=T.BooleanType(), method=_S, score=_D,
    feature_scores=T.MapType(_S, _D),
)

ANOMALY_EVENT = _struct(
    ts_utc=_S, city=_S, source=_S, event_timestamp=_S, anomaly=ANOMALY,
)

STREAM_METRIC = _struct(
    ts_utc=_S, window_messages=T.LongType(), window_seconds=_D, throughput_mps=_D,
    avg_latency_ms=_D, kafka_partition=T.IntegerType(), kafka_offset=T.LongType(),
)
