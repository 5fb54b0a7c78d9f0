"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine where a local one names none, as in tests.

    On a cluster such a folder would lose tables, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/tablewright-tables/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table of the shared folder: it cuts the lineage and survives lost executors."""
    path = f"{own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._shared_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_shared_path", None):
            _deleted(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote for the plans, once its results are stored."""
    _deleted(spark, own_dir(spark))


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dealt(df: DataFrame) -> DataFrame:
    """df's rows dealt evenly to as many tasks as the session has shuffle partitions, to two for each core at least.

    For steps whose rows cost much more to work on than to ship: the splits of a scan and
    the partitions of a shuffle go by bytes, and a small table of many rows may be one.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
