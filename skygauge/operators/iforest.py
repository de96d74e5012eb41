"""Isolation Forest per key, after Liu, Ting and Zhou (2008).

The first ``min_samples`` complete vectors of a key train its forest once; they get no
score themselves. Later complete vectors are scored. Training sees a bounded number of
rows per key, scoring never puts a key's rows together.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skygauge import fixed_values as V
from skygauge.functions.scalars import finite_or_null
from skygauge.operators.anomaly import attach, key_text, unscored
from skygauge.operators.ordered import top_rows
from skygauge.sources.shared import materialise

METHOD = "isolation_forest"
BROADCAST_BYTES = 64 * 1024 * 1024
GROUP_ROWS = 1_000_000
_EULER = 0.5772156649015329
_CELLS_AT_ONCE = 200_000


def expected_path(n):
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype="float64")
    m = np.maximum(n, 3.0) - 1.0
    many = 2.0 * (np.log(m) + _EULER) - 2.0 * m / np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


class Forest:
    """Trees as complete binary arrays: children of node i are 2i+1 and 2i+2."""

    def __init__(self, feature, threshold, size, samples, offset=0.0):
        self.feature, self.threshold, self.size = feature, threshold, size
        self.samples, self.offset = samples, offset

    @classmethod
    def fit(cls, x, trees, contamination, seed, max_samples=V.IFOREST_MAX_SAMPLES):
        """All trees grow together, one level at a time."""
        rng = np.random.default_rng(seed)
        n, dims = x.shape
        samples = min(max_samples, n)
        depth = int(np.ceil(np.log2(max(samples, 2))))
        nodes = 2 ** (depth + 1) - 1
        feature = np.full((trees, nodes), -1, dtype="int8")
        threshold = np.zeros((trees, nodes))
        size = np.zeros((trees, nodes), dtype="int32")
        rows = np.argsort(rng.random((trees, n)), axis=1)[:, :samples]
        at = np.zeros((trees, samples), dtype="int64")
        tree = np.arange(trees)[:, None]
        for level in range(depth + 1):
            first, width = 2 ** level - 1, 2 ** level
            here = (at >= first).ravel()
            cell = (tree * width + at - first).ravel()[here]
            points = x[rows.ravel()[here]]
            count = np.bincount(cell, minlength=trees * width)
            size[:, first:first + width] = count.reshape(trees, width)
            if level == depth or not len(cell):
                break
            low = np.full((trees * width, dims), np.inf)
            high = np.full((trees * width, dims), -np.inf)
            np.minimum.at(low, cell, points)
            np.maximum.at(high, cell, points)
            usable = high > low
            split = (count > 1) & usable.any(axis=1)
            # A random one of the features that still vary in the node.
            draw = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)
            cells = np.arange(trees * width)
            lo, hi = low[cells, draw], high[cells, draw]
            with np.errstate(invalid="ignore"):
                cut = lo + (hi - lo) * rng.random(trees * width)
            cut = np.where(split, np.where(cut >= hi, lo, cut), 0.0)
            feature[:, first:first + width] = np.where(split, draw, -1).reshape(trees, width)
            threshold[:, first:first + width] = cut.reshape(trees, width)
            moving = split[cell]
            right = points[np.arange(len(cell)), draw[cell]] > cut[cell]
            flat, position = at.ravel(), np.flatnonzero(here)
            flat[position[moving]] = 2 * flat[position[moving]] + 1 + right[moving]
            at = flat.reshape(trees, samples)
            # Points in leaves stay behind: their node number is below the next level's.
        forest = cls(feature, threshold, size, samples)
        forest.offset = float(np.percentile(forest.score(x), 100.0 * contamination))
        return forest

    def score(self, x):
        """Raw score in (-1, 0): the lower, the easier a point is to isolate."""
        step = max(1, _CELLS_AT_ONCE // len(self.feature))
        parts = [self._paths(x[i:i + step]) for i in range(0, len(x), step)]
        mean = np.concatenate(parts) if parts else np.zeros(0)
        return -np.power(2.0, -mean / max(float(expected_path(self.samples)), 1e-12))

    def _paths(self, x):
        """Mean path length of each point, all trees walked at once."""
        trees, nodes = self.feature.shape
        base = np.arange(trees) * nodes
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        at = np.zeros((len(x), trees), dtype="int64")
        depth = np.zeros((len(x), trees), dtype="int64")
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(nodes + 1)) - 1):
            f = feature[base + at]
            inner = f >= 0
            right = x[rows, np.maximum(f, 0)] > threshold[base + at]
            at = np.where(inner, 2 * at + 1 + right, at)
            depth += inner
        lengths = expected_path(np.arange(self.samples + 1))
        return (depth + lengths[self.size.ravel()[base + at]]).mean(axis=1)

    def decision(self, x):
        """Raw score less the training quantile; below zero is an anomaly."""
        return self.score(x) - self.offset

    def to_bytes(self) -> bytes:
        """Real nodes only: which there are, their features, inner nodes' cuts, leaves' sizes."""
        real = self.size > 0
        inner = real & (self.feature >= 0)
        head = np.array([*self.feature.shape, self.samples], dtype="int64").tobytes()
        return head + np.array([self.offset]).tobytes() + b"".join((
            np.packbits(real).tobytes(), self.feature[real].tobytes(), self.threshold[inner].tobytes(),
            self.size[real].astype("uint16").tobytes(),
        ))

    @classmethod
    def from_bytes(cls, data: bytes) -> "Forest":
        trees, nodes, samples = (int(v) for v in np.frombuffer(data, "int64", 3))
        cells, shape, at = trees * nodes, (trees, nodes), 32 + -(-trees * nodes // 8)
        real = np.unpackbits(np.frombuffer(data, "uint8", at - 32, 32), count=cells).astype(bool).reshape(shape)
        feature = np.full(shape, -1, "int8")
        feature[real] = np.frombuffer(data, "int8", count := int(real.sum()), at)
        at += count
        threshold, inner = np.zeros(shape), feature >= 0
        threshold[inner] = np.frombuffer(data, "float64", cuts := int(inner.sum()), at)
        size = np.zeros(shape, "int32")
        size[real] = np.frombuffer(data, "uint16", count, at + 8 * cuts)
        return cls(feature, threshold, size, samples, float(np.frombuffer(data, "float64", 1, 24)[0]))


def _vectors(df, id_col, order, features, key):
    """Key, order and features of the vectors that are complete and finite."""
    typed = df.select(
        *dict.fromkeys([id_col, *order]), *[key_text(F.col(k)).alias(k) for k in key],
        *[finite_or_null(F.col(f).cast("double")).alias(f) for f in features],
    )
    return typed.dropna(subset=list(features))


def iforest_fit(
    df: DataFrame, id_col: str = "event_id", order=("event_ts", "event_id"),
    features=V.FEATURES, key=("city", "source"), min_samples: int = V.IFOREST_MIN_SAMPLES,
    trees: int = V.IFOREST_TREES, contamination: float = V.IFOREST_CONTAMINATION,
    seed: int = V.IFOREST_SEED,
) -> DataFrame:
    """(key..., cut, model): one forest per key that has ``min_samples`` vectors.

    ``cut`` is the order of the last training row, as a struct.
    """
    key, order, features = list(key), list(order), list(features)
    # Few bytes, much arithmetic: keep adaptive execution from joining these tasks.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = _vectors(df, id_col, order, features, key)
    first = top_rows(vectors, key, order, min_samples, id_col, tasks=tasks)
    types = dict(first.dtypes)
    columns = [*key, *order]
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", model binary"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_samples:
            return pd.DataFrame(columns=[*columns, "model"])
        pdf = pdf.sort_values("rank")
        forest = Forest.fit(pdf[features].to_numpy("float64"), trees, contamination, seed)
        return pdf[columns].tail(1).assign(model=forest.to_bytes())

    fitted = first.groupBy(*key).applyInPandas(fit, schema)
    return fitted.select(*key, F.struct(*order).alias("cut"), "model")


def iforest_score(
    df: DataFrame, models: DataFrame, id_col: str = "event_id",
    order=("event_ts", "event_id"), features=V.FEATURES, key=("city", "source"),
    broadcast_bytes: int = BROADCAST_BYTES, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(id, score) of every complete vector after its key's training rows.

    Which vectors are due is decided by a join with the models' cuts, the same way for both
    forms. ``models`` must be materialised. Models of up to ``broadcast_bytes`` in total travel
    to the tasks and no vector is shuffled to them. Beyond that, vectors meet their model by key
    in groups of about ``group_rows``: larger keys are salted and their model copied to every salt.
    """
    key, order, features = list(key), list(order), list(features)
    rows = _vectors(df, id_col, order, features, key)
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, score double"
    due = rows.join(models.select(*key, "cut"), key).where(F.struct(*order) > F.col("cut")).select(id_col, *key, *features)
    size = models.agg(F.sum(F.length("model") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        table = {tuple(r[k] for k in key): bytes(r["model"]) for r in models.select(*key, "model").collect()}
        shared = df.sparkSession.sparkContext.broadcast(table)

        def score(batches):
            forests = {}
            for pdf in batches:
                out = np.full(len(pdf), np.nan)
                for k, at in pdf.groupby(key, sort=False).indices.items():
                    if k not in forests:
                        forests[k] = Forest.from_bytes(shared.value[k])
                    out[at] = forests[k].decision(pdf[features].to_numpy("float64")[at])
                yield pd.DataFrame({id_col: pdf[id_col], "score": out})

        return due.mapInPandas(score, schema)

    counts = due.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.select(*key, F.ceil(F.col("n") / group_rows).alias("salts"))
    salted = due.join(hot, key).withColumn("salt", F.pmod(F.xxhash64(id_col), "salts")).drop("salts")
    copies = models.join(hot, key).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))
    ).select(*key, "salt", "model")

    def score_group(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(model):
            return pd.DataFrame({id_col: pdf[id_col][:0], "score": np.zeros(0)})
        forest = Forest.from_bytes(bytes(model["model"].iloc[0]))
        return pd.DataFrame({
            id_col: pdf[id_col], "score": forest.decision(pdf[features].to_numpy("float64")),
        })

    by = [*key, "salt"]
    return salted.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(score_group, schema)


def iforest_detect(
    df: DataFrame, id_col: str = "event_id", order=("event_ts", "event_id"),
    features=V.FEATURES, key=("city", "source"), **options,
) -> DataFrame:
    """Adds ``anomaly`` by Isolation Forest; training rows and gaps stay unscored."""
    names = ("broadcast_bytes", "group_rows")
    scoring = {k: options.pop(k) for k in names if k in options}
    models = materialise(iforest_fit(df, id_col, order, features, key, **options), "iforest")
    scores = iforest_score(df, models, id_col, order, features, key, **scoring)
    none = unscored(METHOD)
    result = F.struct(
        (F.col("score") < 0).alias("is_anomaly"), F.lit(METHOD).alias("method"),
        F.col("score"), none["feature_scores"].alias("feature_scores"),
    )
    return attach(df, scores.select(id_col, result.alias("anomaly")), id_col, none)
