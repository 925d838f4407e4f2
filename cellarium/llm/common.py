"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch handed to Python, so that a batch of very long texts stays small.
BATCH_ROWS = 500
#: Keys that may be dealt to several tasks in a join, the rows of a key from which it is, and tasks at most.
MOST_HOT, HOT_ROWS, MOST_SALTS = 1024, 2000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch of this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that all executors share, which the cluster names in spark.checkpoint.dir.

    Without that setting a session of one machine gets a temporary folder; on a cluster, where every executor would write
    to its own disk, it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Folders that cut() has written, in order.
_written: list[str] = []
#: With it, what a query has shuffled is deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later work starts from files that survive a lost executor.

    What was shuffled on the way is deleted at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: set[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() wrote and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()})


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, by cut(). All tables that were cut on the way to it are deleted, for nothing reads them any more."""
    before = len(_written)
    out = cut(make())
    _delete(out.sparkSession, set(_written[before:-1]))
    del _written[before:-1]
    return out


def fresh_name(taken: list[str], name: str) -> str:
    """name with as many underscores in front as it takes to be none of the taken column names, in whatever case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def salted(counts: DataFrame, on: list[str]) -> DataFrame:
    """on and salts of the keys of counts (on, n) that many rows have: at most MOST_HOT, each with over HOT_ROWS rows.

    A key that is not listed has at most 1 / MOST_HOT of all rows, or HOT_ROWS.
    """
    most = counts.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *on).limit(MOST_HOT)
    kept = most.withColumn("salts", F.least(F.ceil(F.col("n") / HOT_ROWS), F.lit(MOST_SALTS)).cast("int")).select(*on, "salts")
    return counts.sparkSession.createDataFrame(kept.collect(), kept.schema)


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """What salted() says of the keys of rows."""
    return salted(rows.groupBy(*on).agg(F.count("*").alias("n")), on)


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined with facts, whose keys are unique. The rows of a hot key are dealt to several tasks by a salt.

    The salt is a hash of the row, so a row that is made again after a lost executor goes the same way; equal rows go together.
    hot: what salted() says of rows, if that is known.
    """
    if hot is None:
        hot = hot_keys(rows, on)
    if hot.isEmpty():
        return rows.join(facts, on, how)
    hot = F.broadcast(hot)  # at most MOST_HOT rows
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("salts"))).cast("int")).drop("salts")
    copied = facts.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")


def and_columns(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with the columns of ddl in place of columns of the same names."""
    fresh = StructType.fromDDL(ddl).fields
    return StructType([f for f in df.schema.fields if f.name not in {x.name for x in fresh}] + fresh)
