"""Tables that an application makes once and reads many times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple, tuple[str, object]] = {}


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.gettempdir()
    return f"{shared.rstrip('/')}/runlens-kept-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, build: Callable[[], DataFrame], *key: str) -> DataFrame:
    """What ``build`` gives, written to the folder that all nodes share when the application asks for the key first, and read from there.

    The folder goes when the application ends.
    """
    name = (spark.sparkContext.applicationId, *key)
    if name not in _made:
        path, df = _folder(spark), build()
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        df.write.parquet(path)
        fs.deleteOnExit(at)
        _made[name] = path, df.schema
    path, schema = _made[name]
    return spark.read.schema(schema).parquet(path)
