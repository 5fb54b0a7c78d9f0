"""Shared pieces of the training-data operators.

Every operator first selects the columns it needs under private names, so extra
columns of its input never clash with what it computes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The ASCII white space of the contracts, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), and in it this application's.

    Where a local session names none, as in tests, a folder of this machine is set; on a
    cluster that would lose tables, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tablewright/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: it cuts the
    lineage, survives lost executors and fixes values such as row numbers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._shared_path = path
    return back


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        deleted(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote to the shared folder, once its results are stored."""
    deleted(spark, shared_dir(spark))


def body(text: Column) -> Column:
    """A text, with null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters outside SPACE; null counts as empty."""
    whole = body(text)
    parts = F.size(F.split(whole, f"{SPACE}+"))
    before = F.when(whole.rlike(rf"\A{SPACE}"), 1).otherwise(0)
    after = F.when(whole.rlike(rf"{SPACE}\z"), 1).otherwise(0)
    return F.when(whole == "", 0).otherwise(parts - before - after).cast("long")


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; the held-out folds are its remainders."""
    return F.crc32(doc_id.cast("string").cast("binary"))


#: Buckets whose sums are taken together in the steps of a running sum.
_FAN = 4096


def running_start(
    df: DataFrame, group: str, order: list[str], value: Column, bucket: Column, out: str
) -> DataFrame:
    """Sum of value over the rows before each row, within group and by order.

    bucket must be monotone in order and split each group into small parts. The
    sum is taken in three steps, over blocks of buckets, over the buckets of a block
    and inside the bucket, so that a group with most of the rows still spreads over
    many tasks.
    """
    rows = df.withColumn("_bucket", bucket.cast("long")).withColumn("_value", value.cast("long"))
    block = F.floor(F.col("_bucket") / _FAN)
    sums = rows.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(F.sum("_value").alias("_sum"))
    sums = sums.withColumn("_block", F.floor(F.col("_b") / _FAN))
    blocks = sums.groupBy(F.col("_g").alias("_g2"), F.col("_block").alias("_k")).agg(F.sum("_sum").alias("_all"))

    def before(value: str, *keys: str, by: str) -> Column:
        own = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(own), F.lit(0))

    blocks = blocks.withColumn("_ahead", before("_all", "_g2", by="_k"))
    offsets = sums.join(blocks, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_block") == F.col("_k"))).select(
        "_g", "_b", (F.col("_ahead") + before("_sum", "_g", "_block", by="_b")).alias("_offset")
    )
    inside = (
        Window.partitionBy(group, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(
            offsets,
            F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")),
        )
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_bucket", "_value", "_g", "_b", "_offset")
    )


def running_sums(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """df with the sums of values over the rows before each row of the whole table, by order.

    The table is dealt by ranges of the order and written, summed inside each range,
    and the ranges' sums, one row for each, are what the driver adds up.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt.withColumns({f"_{k}": v for k, v in values.items()}), "ranges")
    sums = dealt.groupBy("_range").agg(*[F.sum(f"_{k}").alias(k) for k in values]).collect()
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for k in values:
        offset, total = {}, 0
        for r in sorted(sums, key=lambda r: r["_range"]):
            offset[r["_range"]], total = total, total + (r[k] or 0)
        ahead = F.element_at(F.create_map(*[F.lit(x) for kv in offset.items() for x in kv]), F.col("_range")) if offset else F.lit(0)
        dealt = dealt.withColumn(k, ahead + F.coalesce(F.sum(f"_{k}").over(own), F.lit(0)))
    return dealt.drop("_range", *[f"_{k}" for k in values])


def fresh(name: str, taken: list[str]) -> str:
    """A column name like name that taken doesn't hold."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
