"""Ordered computations that stay balanced when one key holds most of the rows.

A window over a key runs in one task. That is fine while groups are small; beyond
that the rows get a dense position in the global order instead, and work is cut into
pieces of equal size that do not care where a key starts or ends.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from skygauge.sources.shared import materialise

_PARTITION_BITS = 33  # monotonically_increasing_id keeps the task's partition above these


#: Rows of a task that sorts them, at about.
ROWS_PER_TASK = 500_000


def tasks_for(df: DataFrame) -> int | None:
    """How many tasks take ROWS_PER_TASK rows each; None where the session's shuffle partitions are enough."""
    tasks = -(-df.count() // ROWS_PER_TASK)
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def with_position(df: DataFrame, order, name: str = "position", tasks: int | None = None) -> DataFrame:
    """Dense position (0, 1, 2, ...) of every row in the global order.

    A range-partitioned sort balances the rows whatever the key distribution. The
    sorted rows are written to the shared folder, because the bounds of the range
    partitions must not change between counting the partitions and using the counts.
    ``order`` must be unique for the positions to be reproducible. ``tasks`` is the number of
    range partitions, by default the session's.
    """
    ordered = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if tasks else df.orderBy(*order)
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id())
    rows = materialise(numbered, "sorted")
    part = F.shiftright(F.col("_id"), _PARTITION_BITS)
    # One row per sort partition, so this window sees as many rows as there are tasks.
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    in_part = F.col("_id").bitwiseAND((1 << _PARTITION_BITS) - 1)
    return (
        rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + in_part)
        .drop("_part", "_start", "_id")
    )


def trailing_moments(df: DataFrame, value: str, keys, order, n: int, tasks: int | None = None) -> DataFrame:
    """count, mean and sum of squared deviations of the previous ``n`` values.

    Adds ``_n``, ``_mean`` and ``_m2`` over the rows before the current one, within the
    key. A sliding frame would add up n values for every row. Instead the sequence is
    cut into blocks of n: the previous n values are the tail of one block and the head
    of the next. Heads and tails are running aggregates, so a row costs the same for
    any n. Merging two parts by their means keeps the numerical quality of the two-pass
    formula, and a constant series has exactly zero deviation. ``tasks`` is the number of tasks the
    keys are dealt out to, by default the session's.
    """
    keys = list(keys)
    if tasks:
        df = df.repartition(tasks, *keys)
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    numbered = numbered.withColumn("_block", F.expr(f"(_rn - 1) div {n}"))
    block = Window.partitionBy(*keys, "_block")
    tail = block.orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = block.orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    # Same sort order as the head window needs, so one sort serves both.
    back = Window.partitionBy(*keys).orderBy("_block", "_rn")

    def moments(w, suffix):
        x = F.col(value)
        return [
            F.count(x).over(w).cast("double").alias("_n" + suffix),
            F.avg(x).over(w).alias("_mean" + suffix),
            F.var_pop(x).over(w).alias("_var" + suffix),
        ]

    out = numbered.select("*", *moments(tail, "_t"))
    out = out.select(
        "*", *[F.lag(c + "_t", n).over(back).alias(c + "_a") for c in ("_n", "_mean", "_var")]
    ).drop("_n_t", "_mean_t", "_var_t")
    out = out.select("*", *moments(head, "_b"))

    zero = F.lit(0.0)
    na, nb = F.coalesce("_n_a", zero), F.col("_n_b")
    gap = F.col("_mean_b") - F.col("_mean_a")
    both = (na > 0) & (nb > 0)
    mean = F.when(both, F.col("_mean_a") + gap * nb / (na + nb)).otherwise(
        F.coalesce("_mean_a", "_mean_b")
    )
    m2 = (
        na * F.coalesce("_var_a", zero) + nb * F.coalesce("_var_b", zero)
        + F.when(both, gap * gap * na * nb / (na + nb)).otherwise(zero)
    )
    out = out.select("*", (na + nb).alias("_n"), mean.alias("_mean"), m2.alias("_m2"))
    return out.drop(
        "_rn", "_block", "_n_a", "_mean_a", "_var_a", "_n_b", "_mean_b", "_var_b"
    )


def trailing_moments_split(
    df: DataFrame, value: str, keys, order, n: int, piece: int
) -> DataFrame:
    """``trailing_moments`` with every key cut into pieces of ``piece`` rows.

    In the order (keys, order) the previous n rows of a key lie within the previous n
    positions, so a piece needs the last n rows before it and nothing else. Each piece
    has exactly ``piece`` rows plus n borrowed ones, however large a key is.
    """
    piece = max(piece, n)
    tasks = tasks_for(df)
    placed = with_position(df, [*keys, *order], tasks=tasks)
    own = F.expr(f"_pos div {piece}")
    borrowed = (F.col("_pos") % piece) >= piece - n
    copies = F.when(borrowed, F.array(own, own + 1)).otherwise(F.array(own))
    placed = placed.withColumnRenamed("position", "_pos")
    cut = placed.withColumn("_piece", F.explode(copies))
    out = trailing_moments(cut, value, ["_piece", *keys], ["_pos"], n, tasks)
    return out.where(own == F.col("_piece")).drop("_piece", "_pos")


def top_rows(
    df: DataFrame, keys, order, n: int, id_col: str, salts: int = 32, tasks: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of every key in the given order.

    The rank limit runs before each shuffle. The first round ranks within
    (key, salt), so the survivors of a hot key spread over ``salts`` tasks; the second
    ranks at most n * salts rows per key. The result is exact. ``tasks`` fixes the number
    of tasks the keys end up in, for work that is heavy out of proportion to its bytes.
    """
    salt = F.pmod(F.xxhash64(id_col), F.lit(salts))

    def limit(frame, by):
        w = Window.partitionBy(*by).orderBy(*order)
        return frame.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)

    first = limit(df.withColumn("_salt", salt), [*keys, "_salt"]).drop("_rank", "_salt")
    if tasks:
        first = first.repartition(tasks, *keys)
    return limit(first, list(keys)).withColumnRenamed("_rank", "rank")


#: Steps from a quantile, as shares of the values, at which the sketch is asked for bounds.
_STEPS = (0.01, 0.1)
#: Points of the sketch of a bracket that is narrowed.
_POINTS = 256


def _number(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def quantile_brackets(
    df: DataFrame, columns, probabilities, accuracy: int = 10_000, bracket_rows: int = 1_000_000,
) -> dict[str, list[tuple]]:
    """For each column with values: (probability, rank, low, high), the values that hold the quantile's neighbours.

    One pass makes a mergeable sketch per column, whose ranks are known to err by less than the
    number of values over ``accuracy``; bounds four times that away are sure to hold the neighbours. Of
    very many values a bracket may still hold more than ``bracket_rows``: further passes count
    below and inside it and sketch its inside only, each time some hundred times narrower.
    """
    columns, probabilities = list(columns), list(probabilities)
    near = 8.0 / accuracy
    asked = sorted({min(1.0, max(0.0, p + sign * s)) for p in probabilities for s in (near, *_STEPS) for sign in (-1, 1)} | {0.0, 1.0})
    made = df.agg(*[part for i, c in enumerate(columns) for part in (
        F.count(_number(c)).alias(f"n{i}"), F.percentile_approx(_number(c), asked, accuracy).alias(f"s{i}"),
        F.min(_number(c)).alias(f"l{i}"), F.max(_number(c)).alias(f"h{i}"))]).first()
    out = {}
    for i, c in enumerate(columns):
        n = made[f"n{i}"]
        if n:
            out[c] = []
            at = dict(zip(asked, made[f"s{i}"]))
            step = next((s for s in (near, *_STEPS) if s >= 4.0 / accuracy + 2.0 / n), None)
            for p in probabilities:
                low = made[f"l{i}"] if step is None or p - step <= 0 else at[p - step]
                high = made[f"h{i}"] if step is None or p + step >= 1 else at[p + step]
                inside = n if step is None else 2 * step * n
                out[c].append((p, p * (n - 1), low, high) if inside <= bracket_rows else
                              _narrowed(df, c, p, p * (n - 1), low, high, accuracy, bracket_rows))
    return out


def _narrowed(df: DataFrame, column: str, p: float, rank: float, low: float, high: float, accuracy: int, bracket_rows: int) -> tuple:
    x = _number(column)
    while low < high:
        inside = F.when((x >= low) & (x <= high), x)
        points = [i / _POINTS for i in range(_POINTS + 1)]
        r = df.agg(F.count_if(x < low).alias("below"), F.count(inside).alias("n"), F.percentile_approx(inside, points, accuracy).alias("s")).first()
        if r.n <= bracket_rows:
            break
        share = (rank - r.below) / r.n
        first, last = int((share - 4.0 / accuracy) * _POINTS), int((share + 4.0 / accuracy) * _POINTS) + 2
        lower = low if first <= 0 else r.s[first]
        upper = high if last >= _POINTS else r.s[last]
        if (lower, upper) == (low, high):  # so many equal values that they are one or two counts
            break
        low, high = lower, upper
    return p, rank, low, high


def bracket_counts(df: DataFrame, columns, brackets: dict[str, list[tuple]], *extra: Column) -> DataFrame:
    """(metric, part, x, f, ...): counts of the values inside brackets, each value once, and one count for all those
    between two of them (x null). Values that are missing count in part -1. ``extra`` are more aggregates."""
    def cell(c):
        x, own = _number(c), brackets.get(c, [])
        part = F.lit(0)
        inside = F.lit(False)
        for low, high in sorted({(low, high) for _, _, low, high in own}, key=lambda b: b[1]):
            part, inside = part + (x > high).cast("int"), inside | ((x >= low) & (x <= high))
        return F.struct(F.lit(c).alias("metric"), F.coalesce(part, F.lit(-1)).alias("part") if own else F.lit(-1).alias("part"),
                        F.when(inside, x).alias("x"))

    kept = [c for c in df.columns if c not in ("metric", "part", "x")] if extra else []
    long = df.select(*kept, F.explode(F.array(*map(cell, columns))).alias("_cell")).select(*kept, "_cell.*")
    return long.groupBy("metric", "part", "x").agg(F.count(F.lit(1)).alias("f"), *extra)


def bracket_quantiles(counted: DataFrame, brackets: dict[str, list[tuple]], *extra: Column) -> DataFrame:
    """One row with the quantiles as <metric>_<i> by their place in ``brackets``, from ``bracket_counts``: only the
    counted values are put in order. ``extra`` are more aggregates over the counts."""
    before = Window.partitionBy("metric").orderBy("part", F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, -1)
    counts = F.when(F.col("part") >= 0, F.col("f")).otherwise(0)
    placed = counted.withColumn("first", F.coalesce(F.sum(counts).over(before), F.lit(0)))

    def at(metric, place):
        here = (F.col("metric") == metric) & (F.col("first") <= place) & (F.lit(place) < F.col("first") + F.col("f"))
        return F.max(F.when(here & (F.col("part") >= 0), F.col("x")))

    values = []
    for metric, own in brackets.items():
        for i, (_, rank, _, _) in enumerate(own):
            low, high = math.floor(rank), math.ceil(rank)
            lo, hi = at(metric, low), at(metric, high)
            mixed = F.lit(high - rank) * lo + F.lit(rank - low) * hi
            lost = F.raise_error(F.lit("a sketch erred by more than its bound: raise the accuracy")).cast("double")
            values.append(F.when(lo.isNull() | hi.isNull(), lost).when(lo == hi, lo).otherwise(mixed).alias(f"{metric}_{i}"))
    return placed.agg(F.count(F.lit(1)).alias("counts"), *values, *extra)


def exact_quantiles(
    df: DataFrame, columns, probabilities, few_values: bool = False, accuracy: int = 10_000, bracket_rows: int = 1_000_000,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per (metric, probability); NaN and null are left out.

    Two passes over ``df``: ``quantile_brackets`` (at once) finds two bounds for each quantile, then what lies
    below and each value inside them is counted, and only the brackets' values are sorted: no
    global sort, no files. ``few_values`` is for metrics that are known to have few distinct values: one
    pass, one aggregate over the counts, the same result.
    """
    columns = list(columns)
    if few_values:
        values = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "metric", "x")
        freq = values.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("metric", "x").agg(F.count(F.lit(1)).alias("f"))
        picked = freq.groupBy("metric").agg(F.percentile("x", list(probabilities), F.col("f")).alias("v"))
        at = F.array(*map(F.lit, probabilities))
        pairs = F.explode(F.arrays_zip(at.alias("probability"), F.col("v").alias("value")))
        return picked.select("metric", pairs.alias("p")).select("metric", "p.*")
    brackets = quantile_brackets(df, columns, probabilities, accuracy, bracket_rows)
    row = bracket_quantiles(bracket_counts(df, columns, brackets), brackets)
    cells = [F.struct(F.lit(c).alias("metric"), F.lit(float(p)).alias("probability"), F.col(f"{c}_{i}").alias("value"))
             for c, own in brackets.items() for i, (p, *_) in enumerate(own)]
    empty = F.lit(None).cast("array<struct<metric:string,probability:double,value:double>>")
    return row.select(F.explode(F.array(*cells) if cells else empty).alias("_cell")).select("_cell.*")
