"""Rolling z-score anomalies, method selection and anomaly records (batch)."""

from pyspark.sql import Column, DataFrame, functions as F

from skygauge import fixed_values as V
from skygauge.functions.scalars import iso_utc
from skygauge.operators.ordered import tasks_for, trailing_moments, trailing_moments_split
from skygauge.operators.rolling import zscore_rows

# Rows of one task where keys are cut into pieces.
PIECE_ROWS = 500_000


def key_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))


def zscore_expr(x: Column, n: Column, mean: Column, m2: Column, min_samples: int) -> Column:
    """z of x against n earlier values; NULL if they are too few, 0 if they are flat."""
    sd = F.sqrt(m2 / F.greatest(n - 1, F.lit(1.0)))
    return F.when(n >= min_samples, F.when(sd <= V.ZSCORE_FLAT_SD, 0.0).otherwise((x - mean) / sd))


def zscore_long(
    df: DataFrame, id_col: str = "event_id", order=("event_ts", "event_id"),
    features=V.FEATURES, key=("city", "source"), window: int = V.ZSCORE_WINDOW,
    min_samples: int = V.ZSCORE_MIN_SAMPLES, hot_keys: bool = True, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """(id, key..., feature, x, z): z against the last ``window`` earlier values.

    Long form, because a NULL does not enter its feature's window. Work is cut into pieces of
    ``piece_rows`` after a range-partitioned sort, so a key may hold most of the rows.
    ``hot_keys=False`` is for keys that fit one task each: one shuffle on key and feature, the same
    scores; keys are counted, and if one has more than ``piece_rows`` values, work is cut all the
    same. ``order`` must be unique per key.
    """
    keys, order = [*key, "feature"], list(order)
    carried = [id_col, *[o for o in order if o != id_col]]
    values = df.select(
        *carried, *[key_text(F.col(k)).alias(k) for k in key],
        *[F.col(f).cast("double").alias(f) for f in features],
    )
    long = values.unpivot([*carried, *key], list(features), "feature", "x").where("x IS NOT NULL")
    if not hot_keys:
        most = long.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if hot_keys or most > piece_rows:
        scored = trailing_moments_split(long, "x", keys, order, window, piece_rows)
    else:
        scored = trailing_moments(long, "x", keys, order, window, tasks_for(long))
    z = zscore_expr(F.col("x"), F.col("_n"), F.col("_mean"), F.col("_m2"), min_samples)
    return scored.select(*carried, *keys, "x", z.alias("z"))


def anomaly_struct(z: dict[str, Column], threshold: float = V.ZSCORE_THRESHOLD) -> Column:
    """Event result from the z of each feature.

    The score is the largest absolute z; a NaN z has been scored but never wins.
    """
    sizes = [F.nanvl(F.abs(c), F.lit(0.0)) for c in z.values()]
    score = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    scores = F.create_map(*[part for f, c in z.items() for part in (F.lit(f), c)])
    return F.struct(
        F.coalesce(score >= threshold, F.lit(False)).alias("is_anomaly"),
        F.lit("zscore").alias("method"), score.alias("score"), scores.alias("feature_scores"),
    )


def unscored(method: str, features=()) -> Column:
    """Result of an event that could not be scored."""
    pairs = [p for f in features for p in (F.lit(f), F.lit(None).cast("double"))]
    empty = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.struct(
        F.lit(False).alias("is_anomaly"), F.lit(method).alias("method"),
        F.lit(None).cast("double").alias("score"), empty.alias("feature_scores"),
    )


def attach(df: DataFrame, scores: DataFrame, id_col: str, default: Column) -> DataFrame:
    """Left join of the results on the unique event id."""
    joined = df.join(scores, id_col, "left")
    return joined.withColumn("anomaly", F.coalesce(F.col("anomaly"), default))


def detect(
    df: DataFrame, method: str = "zscore", enabled: bool = False, id_col: str = "event_id",
    order=("event_ts", "event_id"), features=V.FEATURES, threshold: float = V.ZSCORE_THRESHOLD,
    iforest_options: dict | None = None, **options,
) -> DataFrame:
    """Adds ``anomaly``. The Isolation Forest runs if asked for and enabled, else z-scores (``zscore_rows``).

    Z-scores are made on the event's own row, in one shuffle of the columns of ``df``.
    """
    if method.lower() == "isolation_forest" and enabled:
        from skygauge.operators.iforest import iforest_detect

        return iforest_detect(
            df, id_col=id_col, order=order, features=features, **(iforest_options or {})
        )
    scored = zscore_rows(df, order, features, **options)
    z = {f: F.col(f"z_{f}") for f in features}
    return scored.withColumn("anomaly", anomaly_struct(z, threshold)).drop(*[f"z_{f}" for f in features])


def anomaly_events(df: DataFrame, now=None, timestamp: str = "timestamp") -> DataFrame:
    """One record per anomalous event, for the anomaly log."""
    stamp = iso_utc(F.current_timestamp()) if now is None else F.lit(now)
    return df.where("anomaly.is_anomaly").select(
        stamp.alias("ts_utc"), "city", "source",
        F.col(timestamp).alias("event_timestamp"), "anomaly",
    )
