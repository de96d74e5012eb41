"""Provider payloads to the common reading schema, in one narrow pass."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from skygauge import fixed_values as V
from skygauge.functions.scalars import iso_utc, safe_double
from skygauge.functions.units import kelvin_to_c, kph_to_mps
from skygauge.schemas import OPENWEATHER_PAYLOAD, WEATHERAPI_PAYLOAD

CORRUPT = "_corrupt"
_TEXTS = ("city", "country", "weather_condition", "weather_description")
_ORDER = (
    "temperature", "humidity", "pressure", "wind_speed", "wind_direction", "clouds",
    "weather_condition", "weather_description",
)


#: Where a field lies in a payload: the object that holds it and its key there.
_OPENWEATHER = {
    "city": ("$", "name"), "country": ("$.sys", "country"), "lat": ("$.coord", "lat"), "lon": ("$.coord", "lon"),
    "temperature": ("$.main", "temp"), "humidity": ("$.main", "humidity"), "pressure": ("$.main", "pressure"),
    "wind_speed": ("$.wind", "speed"), "wind_direction": ("$.wind", "deg"), "clouds": ("$.clouds", "all"),
    "weather_condition": ("$.weather[0]", "main"), "weather_description": ("$.weather[0]", "description"),
}
_WEATHERAPI = {
    "city": ("$.location", "name"), "country": ("$.location", "country"), "lat": ("$.location", "lat"),
    "lon": ("$.location", "lon"), "temperature": ("$.current", "temp_c"), "humidity": ("$.current", "humidity"),
    "pressure": ("$.current", "pressure_mb"), "wind_speed": ("$.current", "wind_kph"),
    "wind_direction": ("$.current", "wind_degree"), "clouds": ("$.current", "cloud"),
    "weather_condition": ("$.current.condition", "text"), "weather_description": ("$.current.condition", "text"),
}


def _as_texts(kind: T.DataType) -> T.DataType:
    """A payload type with text in place of numbers, which are read leniently afterwards."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_texts(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_texts(kind.elementType))
    return T.StringType()


def _parse(payload: Column, kind: T.StructType) -> Column:
    schema = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    return F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def _clean(parsed: str) -> Column:
    """Whether all of a payload could be read as its type."""
    return F.col(parsed).isNotNull() & F.col(f"{parsed}.{CORRUPT}").isNull()


def _value(parsed: str, name: str, holder: str, key: str) -> Column:
    """The field of a parsed payload: as it was read with its type where all of the payload could be, else
    text, or the number that the text stands for."""
    path = holder.removeprefix("$").replace("[0]", "")
    typed, text = (f"get({p}{path}, 0).`{key}`" if holder.endswith("[0]") else f"{p}{path}.`{key}`" for p in (parsed, f"{parsed}_text"))
    if name in _TEXTS:
        lenient = F.expr(text)
    else:  # the parser puts numbers that are not finite into quotes where text is asked for
        quoted = """'"Infinity"', '"-Infinity"', '"NaN"'"""
        lenient = safe_double(f"""CASE WHEN {text} IN ({quoted}) THEN replace({text}, '"', '') ELSE {text} END""")
    return F.when(_clean(parsed), F.expr(typed)).otherwise(lenient)


def _absent(payload: Column, holder: str, key: str) -> Column:
    """Whether the key is not there, as opposed to null or no number; for fields without a value."""
    keys = F.json_object_keys(F.get_json_object(payload, holder))
    return ~F.coalesce(F.array_contains(keys, key), F.lit(False))


def normalize(
    df: DataFrame, source_col: str = "source", payload_col: str = "payload",
    city_col: str | None = None, country_col: str | None = None,
    timestamp_col: str | None = None, temp_unit: str = "metric", wind_to_mps: bool = True,
    defaults: bool = False, unknown: str = "drop", keep=(),
) -> DataFrame:
    """Payload texts of any mix of sources to readings.

    City and country come from the request columns, else from the payload. Numbers in quotes
    count; other text in their place is NULL. ``temp_unit`` is ``metric`` or ``kelvin`` and
    concerns OpenWeatherMap; ``wind_to_mps`` concerns WeatherAPI. ``defaults`` fills keys that
    are absent (numbers 0, texts Unknown) and keeps the payload in ``raw_data``. A payload that
    is no JSON object leaves the fields NULL and its text in ``_corrupt``. A source nobody knows
    is dropped, or with ``unknown="keep"`` stays as timestamp, source and ``raw_data``.
    """
    if unknown not in ("drop", "keep"):
        raise ValueError(f"unknown must be drop or keep: {unknown}")
    if temp_unit not in ("metric", "kelvin"):
        raise ValueError(f"unknown temperature unit: {temp_unit}")
    source, payload = F.col(source_col), F.col(payload_col)
    is_ow = source.isin(V.OPENWEATHER, V.OPENWEATHER_LEGACY)
    is_wa = source == V.WEATHERAPI
    known = F.coalesce(is_ow | is_wa, F.lit(False))
    # Only the payload of the row's own source is parsed, the other struct is NULL; and once more, with
    # text in place of numbers, only where something in it is not of its type.
    parsed = df if unknown == "keep" else df.where(known)
    for name, own, kind in (("_ow", is_ow, OPENWEATHER_PAYLOAD), ("_wa", is_wa, WEATHERAPI_PAYLOAD)):
        parsed = parsed.withColumn(name, F.when(own, _parse(payload, kind)))
        parsed = parsed.withColumn(f"{name}_text", F.when(own & ~_clean(name), _parse(payload, _as_texts(kind))))
    sound = F.when(is_ow, _clean("_ow") | _clean("_ow_text")).otherwise(_clean("_wa") | _clean("_wa_text"))
    fields = {}
    for name in _OPENWEATHER:
        sides = []
        for side, places in (("_ow", _OPENWEATHER), ("_wa", _WEATHERAPI)):
            value = _value(side, name, *places[name])
            if defaults:
                gap = F.lit("Unknown") if name in _TEXTS else F.lit(0.0)
                value = F.when(value.isNotNull(), value).when(sound & _absent(payload, *places[name]), gap)
            if name == "temperature" and side == "_ow" and temp_unit == "kelvin":
                value = kelvin_to_c(value)
            if name == "wind_speed" and side == "_wa" and wind_to_mps:
                value = kph_to_mps(value)
            sides.append(value)
        fields[name] = F.when(is_ow, sides[0]).otherwise(sides[1])
    if city_col:
        fields["city"] = F.col(city_col)
    if country_col:
        fields["country"] = F.col(country_col)
    if unknown == "keep":
        fields = {n: F.when(known, c) for n, c in fields.items()}
    columns = [
        (F.col(timestamp_col) if timestamp_col else iso_utc(F.current_timestamp())).alias("timestamp"),
        source.alias("source"),
        fields["city"].alias("city"),
        fields["country"].alias("country"),
        F.when(known, F.struct(fields["lat"].alias("lat"), fields["lon"].alias("lon"))).alias("coordinates"),
        *[fields[n].alias(n) for n in _ORDER],
    ]
    if defaults or unknown == "keep":
        columns.append((payload if defaults else F.when(~known, payload)).alias("raw_data"))
    columns.append(F.when(known & payload.isNotNull() & ~sound, payload).alias(CORRUPT))
    return parsed.select(*keep, *columns)


def normalize_openweather(
    df: DataFrame, payload_col: str = "payload", source: str = V.OPENWEATHER, **options,
) -> DataFrame:
    """OpenWeatherMap payload texts to readings; options as in ``normalize``."""
    return normalize(df.withColumn("_source", F.lit(source)), "_source", payload_col, **options)


def normalize_weatherapi(df: DataFrame, payload_col: str = "payload", **options) -> DataFrame:
    """WeatherAPI payload texts to readings; options as in ``normalize``."""
    return normalize(
        df.withColumn("_source", F.lit(V.WEATHERAPI)), "_source", payload_col, **options
    )


def union_sources(frames) -> DataFrame:
    """Bag union by column name; a column a source lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def flatten_coordinates(df: DataFrame) -> DataFrame:
    """``lat`` and ``lon`` next to the struct; absent means 0."""
    return df.withColumn("lat", F.coalesce(F.col("coordinates.lat"), F.lit(0.0))).withColumn(
        "lon", F.coalesce(F.col("coordinates.lon"), F.lit(0.0))
    )
