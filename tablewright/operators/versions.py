"""Versions of documents in time: the one that held at a moment, and what its fetch gave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.sources.shared import written

#: What a fetch may have given instead of a page to read.
FAILURES = ("http-status", "not-html", "empty-page")


def as_of(asks: DataFrame, versions: DataFrame, keys: list[str], at: str, time: str, out: str = "version_time") -> DataFrame:
    """asks with the time of the last of versions (of the same keys) that isn't after at; null where there is none.

    Both tables are sorted together by keys and time, in ranges, and every ask takes the
    last version before it in its range; what a range begins with is carried over from
    the ranges before it, of which the driver sees a row each. So a key with most of all
    rows spreads over many tasks. Keys that hold a null match nothing.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    ask = asks.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_ask")
    )
    nothing = F.lit(None).cast(ask.schema["_ask"].dataType)
    seen = versions.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(time).alias("_t"), F.lit(0).alias("_side"), nothing.alias("_ask")
    )
    whole = reduce(Column.__and__, [F.col(n).isNotNull() for n in names])
    both = ask.unionByName(seen.where(whole & F.col("_t").isNotNull()).distinct())
    dealt = both.repartitionByRange(*names, "_t", "_side").withColumn("_range", F.spark_partition_id())
    dealt = written(dealt.withColumn("_seen", F.when(F.col("_side") == 0, F.col("_t"))), "as-of")
    key = F.struct(*names)
    ends = dealt.groupBy("_range").agg(F.min(key).alias("first"), F.max(F.struct(key.alias("key"), "_seen")).alias("last")).collect()

    carried, before = {}, None  # before: key that a range ends with, and the last version of it so far
    for r in sorted(ends, key=lambda r: r["_range"]):
        if before and before[0] == r["first"]:
            carried[r["_range"]] = before
        found = r["last"]["_seen"]
        if found is None and before and before[0] == r["last"]["key"]:
            found = before[1]
        before = (r["last"]["key"], found)
    kind = dealt.schema["_seen"].dataType
    entries = [x for n, (_, found) in carried.items() if found is not None for x in (F.lit(n), F.lit(found).cast(kind))]
    spark = asks.sparkSession
    own = Window.partitionBy("_range", *names).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn("_seen", F.last("_seen", ignorenulls=True).over(own))
    if entries:
        firsts = spark.createDataFrame([(r["_range"], r["first"]) for r in ends], f"_of int, _first {dealt.select(key.alias('k')).schema['k'].dataType.simpleString()}")
        dealt = dealt.join(F.broadcast(firsts), F.col("_range") == F.col("_of"))
        here = F.when(key == F.col("_first"), F.element_at(F.create_map(*entries), F.col("_range")))
        dealt = dealt.withColumn("_seen", F.coalesce("_seen", here))
    return dealt.where("_side = 1").select("_ask.*", F.when(whole, F.col("_seen")).alias(out))


def failure(documents: DataFrame) -> Column:
    """Why a version is no page to read, with its status or content type; null where it is one.

    Columns that documents lacks hold nothing against a version.
    """
    have = set(documents.columns)
    status = F.col("status").cast("int") if "status" in have else F.lit(None).cast("int")
    kind = F.lower(F.col("content_type")) if "content_type" in have else F.lit(None).cast("string")
    text = F.trim(F.concat(F.coalesce("html", F.lit("")), F.coalesce("markdown", F.lit(""))))
    return (
        F.when(~status.between(200, 299), F.concat(F.lit("http-status "), status))
        .when((F.col("renderer") == "static") & ~(kind.contains("text/html") | kind.contains("application/xhtml")), F.concat(F.lit("not-html "), kind))
        .when((F.col("renderer") == "static") & (text == "") & (status.isNotNull() | kind.isNotNull()), F.lit("empty-page"))
    )


def one_version(documents: DataFrame, moment=None) -> DataFrame:
    """documents with one row for each (url, renderer), and failure, why it can't be read.

    With a column fetched_at the last version counts that isn't after moment (any, if
    None); versions without a time count as the oldest, and documents without any such
    version don't exist at that moment. Of versions of the same time, or without times,
    the first by all their columns counts. Rows without url or renderer are left out.
    """
    docs = documents.where("url IS NOT NULL AND renderer IS NOT NULL")
    names, key = docs.columns, ["url", "renderer"]
    docs = docs.withColumn("failure", failure(docs))
    if "fetched_at" in names:
        old = F.lit("0001-01-01 00:00:00").cast("timestamp")
        docs = docs.withColumn("_time", F.coalesce(F.col("fetched_at").cast("timestamp"), old))
        late = F.lit(moment).cast("timestamp") if moment is not None else F.lit("9999-12-31 00:00:00").cast("timestamp")
        asks = docs.select(*key).distinct().withColumn("_at", late)
        held = as_of(asks, docs.select(*key, "_time"), key, "_at", "_time").where("version_time IS NOT NULL")
        held = held.select(F.col("url").alias("_u"), F.col("renderer").alias("_r"), "version_time")
        docs = docs.join(held, (F.col("url") == F.col("_u")) & (F.col("renderer") == F.col("_r")) & (F.col("_time") == F.col("version_time")))
        docs = docs.drop("_u", "_r", "version_time", "_time")
    if docs.groupBy(*key).count().where("count > 1").isEmpty():  # keys alone; texts only move where some repeat
        return docs
    rest = [c for c in docs.columns if c not in key]
    return docs.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_v")).select(*key, "_v.*")
