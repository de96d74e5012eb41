"""The shared folder that every executor can read and write."""

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a folder of the warehouse becomes the context's checkpoint folder, if that
    is storage which all executors reach: one machine holds them all, or the warehouse's path names a
    file system other than the local one. Else this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        _must_be_shared(context.master, warehouse, spark.conf.get("spark.hadoop.fs.defaultFS", "file:///"))
        context.setCheckpointDir(f"{warehouse}/checkpoints")
    return context.getCheckpointDir().rstrip("/")


def _must_be_shared(master: str, path: str, default: str) -> None:
    scheme = path.partition(":")[0] if ":/" in path else default.partition(":")[0]
    if scheme == "file" and not master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors reach; {path} is on a local disk")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/skygauge/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this application's part of the shared folder that nothing uses yet."""
    _once(spark)
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession):
    """What is put below ``new_path`` inside goes at the end, whether it ends well or not."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for path in made:
            remove(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back.

    Cuts the lineage: values that depend on how rows were spread over tasks are
    frozen, and a lost executor costs a re-read instead of a recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, on whatever storage it is; nothing happens if it is not there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has put below ``new_path``; runs by itself at its end."""
    remove(spark, _scratch(spark))


_KNOWN: set[str] = set()
_OPEN: list[list[str]] = []


def _once(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.applicationId not in _KNOWN:
        _KNOWN.add(context.applicationId)
        # after the context has stopped nothing can be reached, and a folder with a lifetime helps
        atexit.register(lambda: context._jsc and not context._jsc.sc().isStopped() and remove_scratch(spark))
