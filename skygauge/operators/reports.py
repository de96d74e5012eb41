"""City reports: aggregates of readings.

Counts and means combine map-side, so a city with most of the rows shuffles as little
as any other. Rows without a city drop out and NaN counts as absent, as in a report
made with pandas.
"""

from pyspark.sql import DataFrame, Observation, Window, functions as F

from skygauge import fixed_values as V
from skygauge.functions.scalars import capitalize, fmt1, nan_to_null
from skygauge.operators.ordered import exact_quantiles


def _rows(df: DataFrame, *keys) -> DataFrame:
    return df.dropna(subset=list(keys))


def _stat(fn, column: str):
    return fn(nan_to_null(F.col(column).cast("double")))


def temperature_report(df: DataFrame) -> DataFrame:
    return _rows(df, "city").groupBy("city").agg(
        _stat(F.avg, "temperature").alias("avg_temp"),
        _stat(F.min, "temperature").alias("min_temp"),
        _stat(F.max, "temperature").alias("max_temp"),
    )


def daily_summary(df: DataFrame) -> DataFrame:
    return _rows(df, "city").groupBy("city").agg(
        _stat(F.avg, "temperature").alias("avg_temp"),
        _stat(F.min, "temperature").alias("min_temp"),
        _stat(F.max, "temperature").alias("max_temp"),
        _stat(F.avg, "humidity").alias("avg_humidity"),
    )


def display(df: DataFrame, columns) -> DataFrame:
    """Numbers as shown in a report: one decimal."""
    return df.select(*[fmt1(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def records_by_city(df: DataFrame) -> DataFrame:
    return _rows(df, "city").groupBy("city").agg(F.count(F.lit(1)).alias("records"))


def condition_counts(df: DataFrame) -> DataFrame:
    return _counts(df, "weather_condition")


def severity_counts(df: DataFrame) -> DataFrame:
    return _counts(df, "weather_severity")


def _counts(df: DataFrame, column: str) -> DataFrame:
    return _rows(df, "city", column).groupBy("city", column).agg(
        F.count(F.lit(1)).alias("count")
    )


def condition_report(df: DataFrame, conditions=None, group: int = 1000) -> DataFrame:
    """City by condition, 0 where a city has none.

    Without the list of conditions the distinct ones are looked up first, on the counted frame. A
    row's counts are gathered in a map, and the columns taken from it, in groups of ``group`` for one
    projection each; there is no limit to their number but that of columns.
    """
    return _condition_table(condition_counts(df), conditions, group)


def _condition_table(counts: DataFrame, conditions=None, group: int = 1000) -> DataFrame:
    if conditions is None:
        conditions = [r[0] for r in counts.select("weather_condition").distinct().orderBy("weather_condition").collect()]
    conditions = list(conditions)
    pairs = F.collect_list(F.struct("weather_condition", "count"))
    wide = counts.groupBy("city").agg(F.map_from_entries(pairs).alias("_counts"))
    taken = ["city"]
    for start in range(0, len(conditions), group):
        some = conditions[start:start + group]
        wide = wide.select("_counts", *taken, *[F.coalesce(F.try_element_at("_counts", F.lit(c)), F.lit(0)).alias(c) for c in some])
        taken += ["`" + c.replace("`", "``") + "`" for c in some]
    return wide.select(*taken)


def severity_report(df: DataFrame) -> DataFrame:
    """City by severity; all four levels are there even if none occurs."""
    return _pivot(severity_counts(df), "weather_severity", list(V.SEVERITY_LEVELS))


def _pivot(counts: DataFrame, column: str, values) -> DataFrame:
    wide = counts.groupBy("city").pivot(column, values).agg(F.sum("count"))
    return wide.fillna(0)


def describe_metrics(
    df: DataFrame, columns=("temperature", "humidity", "pressure"), quartiles: bool = False,
) -> DataFrame:
    """count, mean, stddev, min, max per metric, and the quartiles on request.

    Moments take one pass. Quartiles are exact and take two more (``exact_quantiles``).
    """
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "metric", "x")
    x = nan_to_null(F.col("x"))
    stats = long.groupBy("metric").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    if not quartiles:
        return stats
    names = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    wide = exact_quantiles(df, columns, list(names)).groupBy("metric").agg(*[
        F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n)
        for p, n in names.items()
    ])
    return stats.join(wide, "metric", "left")  # one row per metric on both sides


def dominant_condition(df: DataFrame) -> DataFrame:
    """Most common condition per city and the usual severity under it.

    Ties go to the name that sorts first. All ranking runs on counts, one row per city,
    condition and severity.
    """
    counted = _rows(df, "city", "weather_condition").groupBy(
        "city", "weather_condition", "weather_severity"
    ).agg(F.count(F.lit(1)).alias("n"))
    return _dominant(counted)


def _dominant(counted: DataFrame) -> DataFrame:
    by_condition = Window.partitionBy("city", "weather_condition")
    known = F.col("weather_severity").isNotNull()
    ranked = counted.withColumn("total", F.sum("n").over(by_condition)).withColumn(
        "rank", F.row_number().over(Window.partitionBy("city").orderBy(
            F.desc("total"), "weather_condition", F.desc(known), F.desc("n"), "weather_severity"
        ))
    )
    return ranked.where("rank = 1").select("city", "weather_condition", "weather_severity")


def condition_summary(df: DataFrame) -> DataFrame:
    """``dominant_condition`` as the report prints it."""
    return _printed(dominant_condition(df))


def _printed(dominant: DataFrame) -> DataFrame:
    return dominant.withColumn("weather_severity", capitalize(F.col("weather_severity")))


def report_counts(df: DataFrame) -> DataFrame:
    """One row per city, condition and severity, from which all tables of the daily report roll up.

    Counts, sums and extremes combine in the tasks before the one shuffle; rows without a city drop out.
    """
    numbers = [part for c in ("temperature", "humidity") for part in (
        _stat(F.sum, c).alias(f"{c}_sum"), _stat(F.count, c).alias(f"{c}_n"), _stat(F.min, c).alias(f"{c}_min"), _stat(F.max, c).alias(f"{c}_max"))]
    return _rows(df, "city").groupBy("city", "weather_condition", "weather_severity").agg(F.count(F.lit(1)).alias("n"), *numbers)


def rolled_up(counts: DataFrame, conditions=None) -> dict[str, DataFrame]:
    """The tables of the daily report, without the alerts, from ``report_counts``; the same as from the readings."""
    def mean(c):
        total = F.sum(f"{c}_n")
        return (F.sum(f"{c}_sum") / F.when(total > 0, total)).alias("avg_temp" if c == "temperature" else "avg_humidity")

    extremes = [F.min("temperature_min").alias("min_temp"), F.max("temperature_max").alias("max_temp")]
    by_city = counts.groupBy("city")

    def counted(column):
        return counts.dropna(subset=[column]).groupBy("city", column).agg(F.sum("n").alias("count"))

    named = counts.dropna(subset=["weather_condition"]).select("city", "weather_condition", "weather_severity", "n")
    return {
        "temperature_report": by_city.agg(mean("temperature"), *extremes),
        "weather_condition_report": _condition_table(counted("weather_condition"), conditions),
        "weather_severity_report": _pivot(counted("weather_severity"), "weather_severity", list(V.SEVERITY_LEVELS)),
        "daily_summary": by_city.agg(mean("temperature"), *extremes, mean("humidity")),
        "dominant_condition": _printed(_dominant(named)),
    }


def condition_share(df: DataFrame) -> DataFrame:
    """Percentage of each condition within its city, from the counts."""
    total = F.sum("count").over(Window.partitionBy("city"))
    return condition_counts(df).withColumn("percent", F.col("count") * 100.0 / total)


def cities(df: DataFrame, ordered: bool = True) -> DataFrame:
    names = _rows(df, "city").select("city").distinct()
    return names.orderBy("city") if ordered else names


def newest_timestamp(df: DataFrame, ts_col: str = "event_ts") -> DataFrame:
    return df.agg(F.max(ts_col).alias("newest"))


def run_counts(df: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The frame, and an observation that counts its rows while it is written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("records")), seen


def parse_counts(df: DataFrame, corrupt: str = "_corrupt") -> DataFrame:
    """Processed and failed messages of a parsed frame."""
    return df.agg(
        F.count_if(F.col(corrupt).isNull()).alias("processed"),
        F.count_if(F.col(corrupt).isNotNull()).alias("failed"),
    )


def observe_parse(
    df: DataFrame, name: str = "parse", corrupt: str = "_corrupt"
) -> tuple[DataFrame, Observation]:
    """Like ``parse_counts`` without a pass of its own."""
    seen = Observation(name)
    return df.observe(
        seen, F.count_if(F.col(corrupt).isNull()).alias("processed"),
        F.count_if(F.col(corrupt).isNotNull()).alias("failed"),
    ), seen
