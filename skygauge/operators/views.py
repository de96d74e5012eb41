"""Dashboard tables: latest readings, series, cards, display forms."""

from pyspark.sql import DataFrame, Window, functions as F, types as T

from skygauge import fixed_values as V
from skygauge.functions.scalars import finite_or_null, temperature_size, utc_text
from skygauge.functions.severity import temperature_band, weather_icon
from skygauge.operators.filters import filter_cities, filter_days, filter_range, latest_day
from skygauge.operators.normalize import flatten_coordinates
from skygauge.operators.ordered import top_rows
from skygauge.operators.reports import severity_counts


def _one_per_city(df: DataFrame, latest: bool, order) -> DataFrame:
    """One whole row per city, the last or the first by ``order``.

    The first column of the order is aggregated alone: a hash aggregate on a number, combined before
    its shuffle. Rows with a city's extreme value are then picked by an equi-join whose other
    side has a row per city (adaptive execution broadcasts it while that is small), and only
    these few, ties among them, are ranked. Wide rows are neither sorted nor shuffled.
    """
    ends = df.groupBy(F.col("city").alias("_city")).agg((F.max if latest else F.min)(order[0]).alias("_end"))
    near = df.join(ends, df["city"].eqNullSafe(ends["_city"]) & df[order[0]].eqNullSafe(ends["_end"])).drop("_city", "_end")
    ranked = Window.partitionBy("city").orderBy(*[F.desc(o) if latest else F.asc(o) for o in order])
    return near.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def latest_per_city(df: DataFrame, order=("event_ts", "event_id")) -> DataFrame:
    """The newest reading of every city; ``order`` breaks ties in time."""
    return _one_per_city(df.where(F.col(order[0]).isNotNull()), True, order)


def first_per_city(df: DataFrame, order=("event_id",)) -> DataFrame:
    """The first record of every city, for data without a usable timestamp."""
    return _one_per_city(df, False, order)


def last_n_per_city(
    df: DataFrame, n: int = 5, order=("event_ts", "event_id"), id_col: str = "event_id",
) -> DataFrame:
    """The ``n`` newest readings of every city; ``rank`` 1 is the newest."""
    return top_rows(df, ["city"], [F.desc(o) for o in order], n, id_col)


def sorted_by_time(df: DataFrame, order=("event_ts", "event_id")) -> DataFrame:
    return df.orderBy(*order)


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows, for a look at the data."""
    return df.limit(n)


def metric_series(df: DataFrame, metric: str, cities=None, start=None, end=None) -> DataFrame:
    """(timestamp, metric, city) for a chart; empty if there is no such column."""
    if metric not in V.FEATURES:
        raise ValueError(f"no chart metric: {metric}")
    chosen = filter_range(filter_cities(df, cities), start, end)
    if metric not in df.columns:
        return chosen.select("timestamp", F.lit(None).cast("double").alias(metric), "city").limit(0)
    return chosen.select("timestamp", metric, "city")


def severity_chart(df: DataFrame, cities=None, start=None, end=None) -> DataFrame:
    """Severity counts per city of whole days."""
    return severity_counts(filter_days(filter_cities(df, cities), start, end))


def data_table(df: DataFrame) -> DataFrame:
    """Display strings of the main columns, N/A where a value is absent."""
    texts = ("city", "timestamp", "weather_condition")
    columns = ("city", "timestamp", *V.FEATURES, "weather_condition")
    missing = F.lit("N/A")

    def cell(name):
        value = F.col(name).cast("string")
        if name in texts:
            value = F.when(value != "", value)
        return F.coalesce(value, missing).alias(name)

    return df.select(*[cell(c) for c in columns])


def json_safe(df: DataFrame) -> DataFrame:
    """Values any JSON reader takes: no NaN or infinity, times as text.

    Works inside structs too; other types become text.
    """
    return df.select(*[
        _safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields
    ])


def _safe(c, dtype):
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite_or_null(c)
    if isinstance(dtype, T.TimestampType):
        return utc_text(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(dtype, T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.StringType)):
        return c
    if isinstance(dtype, T.StructType):
        fields = [_safe(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, (T.DoubleType, T.FloatType)):
        return F.transform_values(c, lambda _, v: finite_or_null(v))
    if isinstance(dtype, (T.MapType, T.ArrayType)):
        return F.to_json(c)
    return c.cast("string")


def city_cards(df: DataFrame, order=("event_ts", "event_id")) -> DataFrame:
    """The latest reading of every city with icon, colour and JSON-safe values."""
    latest = latest_per_city(df, order)
    cards = latest.withColumn("weather_icon", weather_icon(F.col("weather_condition")))
    return json_safe(cards.withColumn("temp_color", temperature_band(F.col("temperature"))))


def temperature_map(
    df: DataFrame, cities=None, end=None, order=("event_ts", "event_id"),
) -> DataFrame:
    """The latest reading of every city within the last day, placed and sized."""
    recent = latest_day(filter_cities(df, cities), end, order[0])
    placed = flatten_coordinates(latest_per_city(recent, order))
    return placed.withColumn("temperature_size", temperature_size(F.col("temperature")))
