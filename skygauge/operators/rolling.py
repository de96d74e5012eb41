"""Rolling z-scores on the event's own row, in one pass over the sorted rows of a key.

The z of a value needs the last n values of its feature before it, and nothing else. Rows meet by
key in one shuffle, stream through their task in order, and the task carries n values per
feature along; no row is taken apart, grouped again or joined back. Window functions
can say the same with a sort per feature and direction, at about three times the CPU time.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from skygauge import fixed_values as V

#: Rows whose windows are laid out at once; slices of a piece; bounds looked at in one step.
_ROWS_AT_ONCE, SLICES, STEP = 4096, 4, 64
#: Pieces of all hot keys together at most; pieces grow beyond that.
PIECES = 1 << 18


def rolling_z(past, new, window: int, min_samples: int):
    """z of each new value against the up to ``window`` values before it.

    Returns the scores and which of them exist.
    """
    values = np.concatenate([past, new])
    padded = np.concatenate([np.zeros(window), values])
    z = np.zeros(len(new))
    counts = np.minimum(np.arange(len(past), len(values)), window)
    frames = np.lib.stride_tricks.sliding_window_view(padded, window)
    for at in range(0, len(new), _ROWS_AT_ONCE):
        rows = slice(at, min(at + _ROWS_AT_ONCE, len(new)))
        first = len(past) + at
        frame = frames[first:first + rows.stop - at]
        n = counts[rows]
        inside = np.arange(window)[None, :] >= window - n[:, None]
        with np.errstate(all="ignore"):
            mean = frame.sum(axis=1) / n
            off = np.where(inside, frame - mean[:, None], 0.0)
            sd = np.sqrt((off * off).sum(axis=1) / np.maximum(n - 1, 1))
            z[rows] = np.where(sd <= V.ZSCORE_FLAT_SD, 0.0, (new[rows] - mean) / sd)
    return z, counts >= min_samples


class Carried:
    """The last ``window`` values of each feature of the key at hand."""

    def __init__(self, features: int, window: int, min_samples: int):
        self.features, self.window, self.min_samples = features, window, min_samples
        self.past = [np.zeros(0)] * features

    def clear(self) -> None:
        self.past = [np.zeros(0)] * self.features

    def scored(self, feature: int, values: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """z of the next values in order, and which exist; values that are not there do not count."""
        z, exists = np.zeros(len(values)), np.zeros(len(values), bool)
        new = values[has]
        z[has], exists[has] = rolling_z(self.past[feature], new, self.window, self.min_samples)
        self.past[feature] = np.concatenate([self.past[feature], new])[-self.window:]
        return z, exists


def _as_number(c: Column, kind: str) -> Column | None:
    """A number in the order of the column; None for a type that has none."""
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else None


def _slice_of(t: Column, bounds: Column) -> Column:
    """How many of the sorted bounds are at most t, in two steps of some hundred comparisons; 0 for null."""
    first = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size(bounds) - 1) / STEP).cast("int")),
                                        lambda i: F.get(bounds, i * STEP)), lambda b: b <= t))
    start = F.greatest(first - 1, F.lit(0)) * STEP
    return start + F.size(F.filter(F.slice(bounds, start + 1, F.lit(STEP)), lambda b: b <= t))


def _cuts(rows: DataFrame, keys: list[str], t: Column, features, window: int, piece_rows: int) -> DataFrame | None:
    """(key, bounds, copies) for every key of more than ``piece_rows`` rows; None if there is none.

    ``bounds`` cut the key's rows by t into slices, about SLICES to a piece; ``copies`` names for each slice the
    piece that scores its rows, and then those that need them before their own because fewer
    than ``window`` values of some feature lie between. What is gathered are counts, one row per slice,
    and there are at most 2 * SLICES * PIECES of them.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # of a frame that holds every key, the hot ones only
    total = counts.agg(F.sum("n")).first()[0] or 0
    piece_rows = max(piece_rows, total // PIECES)
    hot = counts.where(F.col("n") > piece_rows).collect() if total > piece_rows else []
    if not hot:
        return None
    spark, made = rows.sparkSession, []
    schema = StructType([*(f for f in counts.schema if f.name in keys)])
    for parts in sorted({_parts(r.n, piece_rows) for r in hot}):
        mine = F.broadcast(spark.createDataFrame([tuple(r[k] for k in keys) for r in hot if _parts(r.n, piece_rows) == parts], schema))
        at = [i / parts for i in range(1, parts)]
        bounds = rows.select(*keys, t.alias("t")).join(mine, keys, "left_semi").groupBy(*keys).agg(
            F.coalesce(F.percentile_approx("t", at, 10 * parts), F.array().cast("array<double>")).alias("bounds"))
        made.append(bounds)
    bounds = made[0]
    for more in made[1:]:
        bounds = bounds.unionByName(more)
    found = bounds.collect()
    by_key = F.broadcast(spark.createDataFrame(found, bounds.schema))
    sliced = rows.select(*keys, t.alias("t"), *features).join(by_key, keys).withColumn("slice", _slice_of(F.col("t"), F.col("bounds")))
    sizes = sliced.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n"), *(F.count(f).alias(f"n_{i}") for i, f in enumerate(features)))
    seen: dict[tuple, dict[int, tuple]] = {}
    for r in sizes.collect():
        seen.setdefault(tuple(r[k] for k in keys), {})[r["slice"]] = tuple(r)[len(keys) + 1:]
    table = []
    for r in found:
        key = tuple(r[k] for k in keys)
        slices = [seen.get(key, {}).get(i, (0,) * (1 + len(features))) for i in range(len(r.bounds) + 1)]
        table.append((*key, r.bounds, copies_of(slices, window, piece_rows)))
    return spark.createDataFrame(table, StructType([*schema, *StructType.fromDDL("bounds array<double>, copies array<array<int>>")]))


def _parts(n: int, piece_rows: int) -> int:
    """Slices of a key of n rows: a power of two, so that few sets of quantiles are asked for."""
    return 1 << math.ceil(math.log2(SLICES * n / piece_rows))


def copies_of(slices: list[tuple], window: int, piece_rows: int) -> list[list[int]]:
    """For each slice (rows, values of each feature): its piece, then the later pieces that look back into it."""
    copies, piece, held, first = [], 0, 0, [0]
    for i, (rows, *_) in enumerate(slices):
        if held and held + rows > piece_rows:
            piece, held = piece + 1, 0
            first.append(i)
        held += rows
        copies.append([piece])
    for piece, start in enumerate(first):
        missing = [window] * (len(slices[0]) - 1)
        for i in range(start - 1, -1, -1):
            if max(missing, default=0) <= 0:
                break
            copies[i].append(piece)
            missing = [m - n for m, n in zip(missing, slices[i][1:])]
    return copies


def zscore_rows(
    df: DataFrame, order=("event_ts", "event_id"), features=V.FEATURES, key=("city", "source"),
    window: int = V.ZSCORE_WINDOW, min_samples: int = V.ZSCORE_MIN_SAMPLES, hot_keys: bool = True, piece_rows: int = 500_000,
) -> DataFrame:
    """``df`` with ``z_<feature>``: z of the row's value against the last ``window`` values of its key before it.

    Null where the row has no value or fewer than ``min_samples`` came before; a null value does not enter its
    feature's window, NaN does. ``order`` must be unique per key; a null key is one of its own, ``unknown``. All rows come
    back, with all their columns: select those that are wanted before, because Python is passed.

    One shuffle by key. Where ``hot_keys``, keys are counted first, and those of more than ``piece_rows``
    rows are cut by the first column of ``order`` (a time or a number; other types are not cut) into pieces
    that borrow the rows before them which hold the last ``window`` values of every feature, so
    each of them is scored by several tasks, with the same results. A task holds a batch
    of rows and ``window`` values per feature, whatever the size of a key.
    """
    order, features = list(order), list(features)
    keys = [f"_key{i}" for i in range(len(key))]
    kinds, t = dict(df.dtypes), None
    rows = df.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for k, c in zip(keys, key)})
    if hot_keys:
        t = _as_number(F.col(order[0]), kinds[order[0]])
    cuts = _cuts(rows.withColumns({f: F.col(f).cast("double") for f in features}), keys, t, features, window, piece_rows) if t is not None else None
    if cuts is None:
        rows = rows.withColumns({"_piece": F.lit(0), "_own": F.lit(True)})
    else:
        rows = rows.withColumn("_t", t).join(F.broadcast(cuts), keys, "left")
        copies = F.coalesce(F.get("copies", _slice_of(F.col("_t"), F.col("bounds"))), F.array(F.lit(0)))
        rows = rows.select(*df.columns, *keys, F.posexplode(copies).alias("_at", "_piece")).withColumn("_own", F.col("_at") == 0).drop("_at")
    numbers = [f"_x{i}" for i in range(len(features))]
    rows = rows.withColumns({n: F.col(f).cast("double") for n, f in zip(numbers, features)})
    dealt = rows.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", *order)
    schema = StructType([*df.schema, *(StructField(f"z_{f}", DoubleType()) for f in features)])
    arrow, wide = to_arrow_schema(schema), len(df.columns)
    group = [*keys, "_piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, last = Carried(len(numbers), window, min_samples), None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(c) for c in group]
            new = np.zeros(batch.num_rows, bool)
            for c in at:
                codes = c.dictionary_encode().indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = [0, *np.flatnonzero(new), batch.num_rows]
            scores = [(np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)) for _ in numbers]
            values = [(c.to_numpy(zero_copy_only=False), np.asarray(c.is_valid())) for c in map(batch.column, numbers)]
            for begin, end in zip(starts, starts[1:]):
                here = tuple(c[begin].as_py() for c in at)
                if here != last:
                    carried.clear()
                    last = here
                for i, ((x, has), (z, exists)) in enumerate(zip(values, scores)):
                    z[begin:end], exists[begin:end] = carried.scored(i, x[begin:end], has[begin:end])
            made = [pa.array(z, pa.float64(), mask=~exists, from_pandas=False) for z, exists in scores]
            whole = pa.RecordBatch.from_arrays([*batch.columns[:wide], *made], schema=arrow)
            own = batch.column("_own")
            yield whole if own.false_count == 0 else whole.filter(own)

    return dealt.select(*df.columns, *group, "_own", *numbers).mapInArrow(run, schema)
