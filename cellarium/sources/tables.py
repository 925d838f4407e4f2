"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path below the folder in spark.checkpoint.dir.

    Without that setting a session of one machine uses a temporary folder; on a cluster it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that it is computed once and survives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_PLANNED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def measured_joins(f: Callable) -> Callable:
    """f(df, ...), in whose jobs a table is broadcast for what it takes in memory once it is shuffled, not for what it takes in Parquet,
    where millions of short rows are nearly nothing. Joins of a lazy result that runs after f are planned as the session says."""

    @functools.wraps(f)
    def measured(df: DataFrame, *args, **kwargs):
        conf = df.sparkSession.conf
        before = {k: conf.get(k, None) for k in (_PLANNED, _MEASURED)}
        conf.set(_MEASURED, before[_MEASURED] or conf.get(_PLANNED))
        conf.set(_PLANNED, "-1")
        try:
            return f(df, *args, **kwargs)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    return measured
