"""A small local session, shared by the tests, the check and the benchmark."""

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, **conf) -> SparkSession:
    """``spark.checkpoint.dir`` is a new temporary folder unless given: all of a local session
    runs on one machine, so that folder is shared."""
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("skygauge")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if "spark.checkpoint.dir" not in conf:
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="skygauge-")
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
