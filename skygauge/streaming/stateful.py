"""Anomaly detection with state in the state store, one processor per key.

Rows go to their key's state in packs: compressed Arrow batches of one key's rows, made where the rows are
read and taken apart again behind the state, so the state's task spends nothing on what it only carries.

A key's rows of one micro-batch meet in one task, in chunks. The task holds the order columns and
feature values of all of them, some ten numbers a row; what is carried along waits in the
state store, one chunk at a time in memory.
"""

import ctypes
import pickle
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skygauge import fixed_values as V
from skygauge.operators.anomaly import anomaly_struct, key_text, unscored
from skygauge.operators.iforest import METHOD, Forest
from skygauge.operators.rolling import rolling_z

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that outgrows memory, which the stateful operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """``use_rocksdb`` for the queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    use_rocksdb(spark)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows of a key whose scores are made in one step.
_BLOCK = 1 << 16
#: Rows and bytes that a task packs at once, rows of a pack, and bytes of packs that wait together.
_AT_ONCE, _AT_ONCE_BYTES, _PACK, _WAIT_BYTES = 1 << 15, 64 << 20, 1 << 12, 4 << 20


def _give_back() -> None:
    """What a key's rows took goes back to the system: small pieces that are freed stay with the worker otherwise."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def _sorted_places(columns: list[np.ndarray]) -> np.ndarray:
    """Places of the rows in the order of the columns, equal ones as they came, missing values last."""
    if all(c.dtype.kind in "biufM" for c in columns):
        return np.lexsort(columns[::-1])
    frame = pd.DataFrame(dict(enumerate(columns)), copy=False)
    return frame.sort_values(list(frame.columns), kind="stable").index.to_numpy()


class _InArrivalOrder(StatefulProcessor):
    """Scores a key's rows of the micro-batch in arrival order, whatever chunks they come in.

    A chunk's carried columns are put into the state store when the next chunk comes, and taken out
    again when the scores are known; nothing of them stays after the micro-batch.
    """

    def __init__(self, carry, order, features):
        self.carry, self.order, self.features = carry, order, features

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "chunk int", "rows binary")

    def parts(self, chunk, names):
        """What of a chunk is carried along, its rows, and the columns that are looked at."""
        yield chunk[self.carry].reset_index(drop=True), len(chunk), {n: chunk[n].to_numpy(copy=True) for n in names}

    def joined(self, carried, scores):
        return carried.assign(**scores)

    def handleInputRows(self, key, rows, timerValues):
        names = list(dict.fromkeys([*self.order, *self.features, *(f"given_{f}" for f in self.features)]))
        numbers, sizes, last = {n: [] for n in names}, [], None
        for carried, size, columns in (part for chunk in rows for part in self.parts(chunk, names)):
            if last is not None:
                self.waiting.updateValue((len(sizes) - 1,), (pickle.dumps(last, protocol=5),))
            last = carried
            sizes.append(size)
            for n in names:
                numbers[n].append(columns[n])
        if last is None:
            return
        for n in names:  # one column at a time has two copies
            numbers[n] = np.concatenate(numbers[n])
        place = _sorted_places([numbers[n] for n in self.order])
        for n in set(self.order) - set(self.features):
            del numbers[n]
        _give_back()
        columns = []
        for f in self.features:
            columns.append((numbers.pop(f)[place].astype("float64", copy=False), numbers.pop(f"given_{f}")[place].astype(bool, copy=False)))
        scores, made = self.scored(columns), {}
        for name in list(scores):
            column = scores.pop(name)
            made[name] = np.empty_like(column)
            made[name][place] = column
        del column, place
        at = 0
        for chunk, size in enumerate(sizes):
            if chunk < len(sizes) - 1:
                carried = pickle.loads(bytes(self.waiting.getValue((chunk,))[0]))
                self.waiting.removeKey((chunk,))
            else:
                carried = last
            yield self.joined(carried, {name: column[at:at + size] for name, column in made.items()})
            at += size
        del made
        _give_back()

    def close(self) -> None:
        pass


class _ZScore(_InArrivalOrder):
    def __init__(self, carry, order, features, window, min_samples):
        super().__init__(carry, order, features)
        self.window, self.min_samples = window, min_samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        schema = ", ".join(f"f{i} array<double>" for i in range(len(self.features)))
        self.past = handle.getValueState("past", schema)

    def scored(self, columns):
        past = self.past.get()
        past = [[] for _ in self.features] if past is None else past
        out, kept = {}, []
        for i, (before, f) in enumerate(zip(past, self.features)):
            before = np.array([np.nan if v is None else v for v in before], dtype="float64")
            values, given = columns.pop(0)
            scores, flags = np.zeros(len(values)), np.zeros(len(values), dtype=bool)
            for at in range(0, len(values), _BLOCK):
                rows = slice(at, at + _BLOCK)
                has = given[rows]
                new = values[rows][has]
                scores[rows][has], flags[rows][has] = rolling_z(before, new, self.window, self.min_samples)
                before = np.concatenate([before, new])[-self.window:]
            out[f"z_{f}"], out[f"scored_{f}"] = scores, flags
            kept.append(before.tolist())
        self.past.update(tuple(kept))
        return out


class _IsolationForest(_InArrivalOrder):
    def __init__(self, carry, order, features, min_samples, trees, contamination, seed):
        super().__init__(carry, order, features)
        self.min_samples, self.trees = min_samples, trees
        self.contamination, self.seed = contamination, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.buffer = handle.getValueState("buffer", "flat array<double>")
        self.model = handle.getValueState("model", "bytes binary")

    def scored(self, columns):
        values, given = (np.stack(side, 1) for side in zip(*columns))
        columns.clear()
        due = np.flatnonzero(given.all(axis=1) & np.isfinite(values).all(axis=1))
        score, flags = np.zeros(len(values)), np.zeros(len(values), dtype=bool)
        model = self.model.get()
        forest = Forest.from_bytes(bytes(model[0])) if model is not None else None
        if forest is None:
            buffer = self.buffer.get()
            buffer = np.array([] if buffer is None else buffer[0]).reshape(-1, len(self.features))
            take = due[:self.min_samples - len(buffer)]
            due = due[len(take):]
            buffer = np.concatenate([buffer, values[take]])
            if len(buffer) >= self.min_samples:
                forest = Forest.fit(buffer, self.trees, self.contamination, self.seed)
                self.model.update((forest.to_bytes(),))
                self.buffer.clear()
            else:
                self.buffer.update((buffer.ravel().tolist(),))
        if forest is not None and len(due):
            score[due], flags[due] = forest.decision(values[due]), True
        return {"_score": score, "_scored": flags}


def _pack(batch: pa.RecordBatch) -> bytes:
    raw = batch.serialize()
    return struct.pack("<q", raw.size) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(pack: bytes, schema: pa.Schema) -> pa.RecordBatch:
    size, = struct.unpack_from("<q", pack)
    return pa.ipc.read_record_batch(pa.decompress(memoryview(pack)[8:], size, codec="zstd"), schema)


class _Packed:
    """Mixed into a processor whose rows come in packs, each with those columns of its rows that are looked at."""

    def packs(self, looked: pa.Schema, scores: pa.Schema):
        self.looked, self.scores = looked, scores
        return self

    def parts(self, chunk, names):
        packs, at, held = [], [], 0
        for pack, numbers in zip(chunk["pack"], chunk["numbers"]):
            packs.append(pack)
            at.append(_unpack(numbers, self.looked))
            held += len(pack)
            if held >= _WAIT_BYTES:
                yield self._part(packs, at, names)
                packs, at, held = [], [], 0
        if packs:
            yield self._part(packs, at, names)

    def _part(self, packs, at, names):
        table = pa.Table.from_batches(at)
        columns = {n: table[n] for n in self.looked.names}
        columns |= {f"given_{f}": columns[f].is_valid() for f in self.features}
        return (packs, [len(b) for b in at]), len(table), {n: columns[n].to_numpy() for n in names}

    def joined(self, carried, scores):
        packs, sizes = carried
        made, at = [], 0
        for size in sizes:
            columns = [pa.array(scores[n][at:at + size]) for n in self.scores.names]
            made.append(_pack(pa.RecordBatch.from_arrays(columns, schema=self.scores)))
            at += size
        return pd.DataFrame({"pack": packs, "scores": made})


class _PackedZScore(_Packed, _ZScore):
    pass


class _PackedIsolationForest(_Packed, _IsolationForest):
    pass


def _by_key(table: pa.Table, names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Each key's rows in the order they have, as many as a pack holds at a time."""
    code = np.zeros(len(table), dtype="int64")
    for n in names:
        own = table[n].combine_chunks().dictionary_encode()
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
    place = np.argsort(code, kind="stable")
    table, code = table.take(pa.array(place)).combine_chunks(), code[place]
    starts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    for begin, end in zip(starts, starts[1:]):
        key = tuple(table[n][begin].as_py() for n in names)
        for at in range(begin, end, _PACK):
            yield key, table.slice(at, min(_PACK, end - at))


def _through_state(stream, processor, carry, order, features, key, extra, tasks):
    """The ``carry`` columns of all rows with the processor's ``extra`` scores, rows passing the state in packs.

    ``tasks`` deals the packs out to that many tasks before they are taken apart.
    """
    for f in features:
        stream = stream.withColumn(f, F.col(f).cast("double"))
    names = [f"key{i}" for i in range(len(key))]
    looked = list(dict.fromkeys([*order, *features]))
    place = [f"carry{i}" for i in range(len(carry))]
    rows = stream.select(
        *[key_text(F.col(k)).alias(n) for n, k in zip(names, key)],
        *[F.col(c).alias(f"looked{i}") for i, c in enumerate(looked)], *[F.col(c).alias(n) for n, c in zip(place, carry)])
    arrow = to_arrow_schema(rows.schema)
    ends = len(names), len(names) + len(looked)
    numbers = pa.schema([f.with_name(n) for f, n in zip(list(arrow)[ends[0]:ends[1]], looked)])
    carried = pa.schema(list(arrow)[ends[1]:])
    scores = to_arrow_schema(T.StructType([T.StructField(n, t) for n, t in extra]))
    out_type = T.StructType([*rows.schema.fields[ends[1]:], *[T.StructField(n, t) for n, t in extra]])
    whole = pa.schema([*carried, *scores])

    def cut(held):
        for at, part in _by_key(pa.Table.from_batches(held).cast(arrow), names):
            batch = part.to_batches()[0]
            yield (*at, _pack(pa.RecordBatch.from_arrays(batch.columns[ends[1]:], schema=carried)),
                   _pack(pa.RecordBatch.from_arrays(batch.columns[ends[0]:ends[1]], schema=numbers)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held):
            columns = zip(*cut(held))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, packed.types)], schema=packed)

        held, n, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held, n, size = [*held, batch], n + batch.num_rows, size + batch.nbytes
            if n >= _AT_ONCE or size >= _AT_ONCE_BYTES:
                yield made(held)
                held, n, size = [], 0, 0
        if held:
            yield made(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, made in zip(batch.column(0), batch.column(1)):
                columns = [c for b, s in ((rows, carried), (made, scores)) for c in _unpack(b.as_py(), s).columns]
                yield pa.RecordBatch.from_arrays(columns, schema=whole)

    pack_type = T.StructType([
        *[T.StructField(n, T.StringType(), False) for n in names],
        T.StructField("pack", T.BinaryType(), False), T.StructField("numbers", T.BinaryType(), False)])
    packed = to_arrow_schema(pack_type)
    out = rows.mapInArrow(pack, pack_type).groupBy(*names).transformWithStateInPandas(
        statefulProcessor=processor.packs(numbers, scores), outputStructType="pack binary, scores binary",
        outputMode="Append", timeMode="None",
    )
    if tasks:  # a key's rows are together here, and no longer so where they are dealt out
        out = out.repartition(tasks)
    out = out.mapInArrow(unpack, out_type)
    return out.select(*[F.col(n).alias(c) for n, c in zip(place, carry)], *[n for n, _ in extra])


def zscore_stream(
    stream: DataFrame, carry, order=("partition", "offset"), features=V.FEATURES,
    key=("city", "source"), window: int = V.ZSCORE_WINDOW,
    min_samples: int = V.ZSCORE_MIN_SAMPLES, threshold: float = V.ZSCORE_THRESHOLD, tasks: int | None = None,
) -> DataFrame:
    """The ``carry`` columns of every event with ``anomaly``, scored on arrival.

    A key's micro-batches must come in order; within one, ``order`` sorts. State per key: the last ``window`` values of each feature.
    ``tasks`` deals the scored rows out to that many tasks.
    """
    carry, order, features = list(carry), list(order), list(features)
    extra = [("z_" + f, T.DoubleType()) for f in features]
    extra += [("scored_" + f, T.BooleanType()) for f in features]
    processor = _PackedZScore(carry, order, features, window, min_samples)
    out = _through_state(stream, processor, carry, order, features, key, extra, tasks)
    nan = F.lit(float("nan"))
    z = {f: F.when(F.col(f"scored_{f}"), F.coalesce(F.col(f"z_{f}"), nan)) for f in features}
    return out.select(*carry, anomaly_struct(z, threshold).alias("anomaly"))


def iforest_stream(
    stream: DataFrame, carry, order=("partition", "offset"), features=V.FEATURES,
    key=("city", "source"), min_samples: int = V.IFOREST_MIN_SAMPLES,
    trees: int = V.IFOREST_TREES, contamination: float = V.IFOREST_CONTAMINATION,
    seed: int = V.IFOREST_SEED, tasks: int | None = None,
) -> DataFrame:
    """Like ``zscore_stream`` by Isolation Forest; state is the buffer, then the forest."""
    carry, order, features = list(carry), list(order), list(features)
    extra = [("_score", T.DoubleType()), ("_scored", T.BooleanType())]
    processor = _PackedIsolationForest(carry, order, features, min_samples, trees, contamination, seed)
    out = _through_state(stream, processor, carry, order, features, key, extra, tasks)
    none = unscored(METHOD)
    result = F.struct(
        (F.col("_score") < 0).alias("is_anomaly"), F.lit(METHOD).alias("method"),
        F.col("_score").alias("score"), none["feature_scores"].alias("feature_scores"),
    )
    return out.select(*carry, F.when(F.col("_scored"), result).otherwise(none).alias("anomaly"))


def kept_values(spark: SparkSession, checkpoint: str, features=V.FEATURES, key=("city", "source")) -> DataFrame:
    """What ``zscore_stream`` has in its state after the last micro-batch, read from the checkpoint: one
    row per key and feature with ``kept``, its values from oldest to newest, for audits. A key's row
    has at most the window's values of each feature; keys are read where their state lies.
    """
    state = spark.read.format("statestore").option("stateVarName", "past").load(checkpoint)
    keys = [F.col(f"key.key{i}").alias(name) for i, name in enumerate(key)]
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"value.f{i}").alias("kept")) for i, f in enumerate(features)))
    return state.select(*keys, F.explode(each).alias("e")).select(*key, "e.feature", "e.kept")
