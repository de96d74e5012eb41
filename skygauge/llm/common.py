"""Helpers shared by the corpus operators."""

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skygauge.sources.shared import shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Compute a frame once and cut its lineage, in the folder of ``spark.checkpoint.dir``.

    The copy is on shared storage, so a lost executor costs a re-read; Spark removes it with
    the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def give_back() -> None:
    """Return what earlier tasks of this Python worker have freed to the system: workers are used again,
    and the memory they hold counts for the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def text_of(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def per_row(
    df: DataFrame, columns: dict[str, F.Column], schema: str,
    open_task: Callable[[], Callable[[list], tuple]], slice_bytes: int = 4 << 20,
) -> DataFrame:
    """One output row per input row: the first of ``columns`` (the id) and what the opened
    function makes of the list of the second's values, as a tuple of lists.

    Values reach the function in slices of about ``slice_bytes``, whatever the row sizes, so
    memory is bounded by that and the longest single value. No shuffle.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            if function is None:
                give_back()
                function = open_task()
            for part in slices(batch, slice_bytes):
                made = function(part.column(1).to_pylist())
                arrays = [part.column(0), *map(_typed, made, list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    picked = df.select(*(columns[n].alias(n) for n in names))
    made = StructType.fromDDL(schema)
    arrow = to_arrow_schema(StructType([picked.schema[0], *made.fields]))
    return picked.mapInArrow(run, StructType([picked.schema[0], *made.fields]))


def _typed(values, field: pa.Field) -> pa.Array:
    return values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type)


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch of (id, text or binary) rows where the second column reaches ``size`` bytes."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def local_roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for links between nodes 0..size-1."""
    root = np.arange(size)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root
