"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations.

The key of a document is the 64-bit hash of its normalised text. A directory of
2**g slots, one for each value of the first g bits, leads to buckets: a bucket that
holds more than ``capacity`` keys, or BYTES of text, is split on its next bit, and the directory doubles
when the split bucket was as deep as the directory. So a bucket's depth is the first
at which its keys fit, and the directory's depth that of its deepest bucket.

Rows are routed by their bucket, a contiguous range of keys, to the task that owns it.
The owner chains the texts whose hashes collide and compares whole texts byte by byte:
the text itself is a grouping key there, so two texts meet only if all their bytes are
equal. What the owners find is written bucket by bucket as the index (bucket, hash,
digest of the text, row that stays, copies), a Parquet table in the shared folder, and
every document looks its entry up in its bucket.

At scale: the text crosses the network once. A text with more than 1/HOT of all rows is
split by a salt, so no task gets more of it than that share, and the parts are merged
when they are without text; there are fewer than HOT such texts, and only their hashes
are broadcast. The directory grows with the table and is joined, not collected. What
is joined and sorted afterwards has about a hundred bytes a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import SPACE, body, fresh, table, written

#: Keys, and bytes of all their texts, that a bucket may hold before it is split; bits beyond the even split that splitting may use.
CAPACITY, BYTES, SPARE_BITS = 16384, 32 << 20, 4

#: A text with more than 1/HOT of all rows (and HOT_LEAST rows) is split among several tasks.
HOT, HOT_LEAST = 1024, 4096

#: Best row of a group as one number: code points first, then the smaller id, null ids last.
_UNIT = "36893488147419103232"  # 2**65, above any rank of an id


def normalised(text):
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(body(text), f"{SPACE}+", "")


def slot(hashed: Column, bits: int) -> Column:
    """The first bits of a hash."""
    return F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("long")


def directory(hashes: DataFrame, n: int, capacity: int, total: int = 0) -> tuple[DataFrame, int]:
    """(slots, depth): the bucket and local depth of each slot that leads to a key, and the directory's depth.

    hashes are the n distinct keys (column hash), with the bytes of text that meet at
    each (column bytes, total in all; none if it is absent). They are counted by leaves, their
    first bits up to the deepest split; the keys below every possible bucket are sums
    of leaves, and a leaf belongs to the first bucket on its way down that fits. A
    bucket is named by its first leaf, so names survive doubling. A leaf that holds
    more than capacity, as an uneven hash or one very long text makes it, stays one bucket.
    """
    bits = min(40, max(0, math.ceil(math.log2(max(n / capacity, total / BYTES, 1)))) + SPARE_BITS)
    if "bytes" not in hashes.columns:
        hashes = hashes.withColumn("bytes", F.lit(0))
    leaves = hashes.groupBy(slot(F.col("hash"), bits).alias("leaf")).agg(F.count("*").alias("keys"), F.sum("bytes").alias("bytes"))
    ways = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    ways = ways.withColumn("first", F.expr(f"(leaf >> ({bits} - depth)) << ({bits} - depth)"))
    fitting = ways.groupBy("depth", "first").agg(F.sum("keys").alias("held"), F.sum("bytes").alias("bytes"))
    fitting = fitting.where(((F.col("held") <= capacity) & (F.col("bytes") <= BYTES)) | (F.col("depth") == bits)).drop("bytes")
    # by a merge: Spark sizes ways as it was before its explode
    own = ways.hint("merge").join(fitting, ["depth", "first"]).groupBy("leaf").agg(F.min(F.struct("depth", "first")).alias("b"))
    leaves = written(own.select("leaf", F.col("b.first").alias("bucket"), F.col("b.depth").alias("local_depth")), "dedup-leaves")
    depth = leaves.agg(F.max("local_depth")).first()[0] or 0
    slots = leaves.select(F.shiftright("leaf", bits - depth).alias("slot"), "bucket", "local_depth").distinct()
    return written(slots, "dedup-directory"), depth


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hot_least: int = HOT_LEAST
) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when they are identical without ASCII white space. The row with
    the most code points stays, then the one with the smallest id. Null texts count
    as empty, and empty texts are copies of each other. Ids may be null (they come
    last) or repeat: of repeated best rows exactly one is kept. An empty table gives
    an empty result. Other columns of docs are ignored.
    """
    return found_in(index_of(docs, id_col, text_col, capacity, hot_least))


def index_of(docs: DataFrame, id_col: str, text_col: str, capacity: int, hot_least: int) -> tuple[DataFrame, DataFrame]:
    """(keys, index): every row with its key, bucket and salt, and the entries that the buckets' owners made."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(F.col(text_col)).alias("text"))
    norm = normalised(F.col("text"))
    keys = written(
        text.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", F.length("text").cast("long").alias("n_chars"), norm.alias("norm"),
        ).select(
            "row_id", "doc_id", "n_chars", F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("hash"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        ),
        "dedup-keys",
    )
    counts = written(keys.groupBy("hash").agg(F.count("*").alias("rows"), F.max("n_bytes").cast("long").alias("n_bytes")), "dedup-counts")
    n, distinct = counts.agg(F.sum("rows"), F.count("*")).first()
    share = max(hot_least, (n or 0) // HOT)
    weighed = counts.select("hash", (F.least("rows", F.lit(share)) * F.col("n_bytes")).alias("bytes"))  # of a hot text, those of one salt
    slots, depth = directory(weighed, distinct, capacity, weighed.agg(F.sum("bytes")).first()[0] or 0)
    hot = counts.where(F.col("rows") > share).select(F.col("hash").alias("hot"), F.ceil(F.col("rows") / share).alias("salts"))

    def routed(rows: DataFrame) -> DataFrame:
        """rows with the bucket of their hash, and a salt, which is 0 but for hot texts and comes from the row's number at the scan."""
        rows = rows.join(slots.select("slot", "bucket"), slot(F.col("hash"), depth) == F.col("slot")).drop("slot")
        rows = rows.join(F.broadcast(hot), F.col("hash") == F.col("hot"), "left")
        salt = F.when(F.col("salts").isNotNull(), F.pmod(F.col("row_id"), F.col("salts"))).otherwise(0)
        return rows.withColumn("salt", salt).drop("hot", "salts")

    rank = F.coalesce(
        F.lit(9223372036854775807).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)") + 1, F.lit(0)
    )
    unit = F.expr(f"{_UNIT}BD")
    rows = text.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.length("text").alias("n_chars"), norm.alias("norm")).select(
        "row_id", F.xxhash64("norm").alias("hash"), "norm", (F.col("n_chars").cast("decimal(10,0)") * unit + rank).alias("best")
    )
    owned = written(
        routed(rows)
        .repartition("bucket", "salt")
        .groupBy("bucket", "salt", "hash", "norm")
        .agg(F.count("*").alias("rows"), F.max("best").alias("best"))
        .select("bucket", "hash", F.sha2(F.col("norm").cast("binary"), 256).alias("digest"), "rows", "best"),
        "dedup-owned",
    )
    index = owned.repartition("bucket").groupBy("bucket", "hash", "digest").agg(F.sum("rows").alias("group_size"), F.max("best").alias("best"))
    index = index.withColumn("keep_chars", F.expr(f"best div {_UNIT}BD")).withColumn(
        "keep_rank", (F.col("best") - F.col("keep_chars").cast("decimal(10,0)") * unit).cast("decimal(20,0)")
    )
    keep_id = F.lit(9223372036854775807).cast("decimal(20,0)") - F.col("keep_rank") + 1
    index = written(
        index.join(F.broadcast(hot), F.col("hash") == F.col("hot"), "left").select(
            "bucket", "hash", "digest", "group_size", F.col("keep_chars").cast("long").alias("keep_chars"),
            F.when(F.col("keep_rank") > 0, keep_id).cast("long").alias("keep_id"), F.coalesce("salts", F.lit(1)).cast("int").alias("salts"),
        ).sortWithinPartitions("bucket", "hash"),
        "dedup-index",
    )
    return routed(keys), index


def found_in(made: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The rows of index_of() with what their entries say; an entry of a hot text stands for each of its salts."""
    keys, index = made
    entries = index.select(
        F.col("bucket").alias("at"), F.col("hash").alias("key"), "digest", "group_size", "keep_chars", "keep_id",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("turn"),
    )
    found = keys.join(
        entries,
        (F.col("bucket") == F.col("at")) & (F.col("salt") == F.col("turn")) & (F.col("hash") == F.col("key")) & (F.col("text_sha256") == F.col("digest")),
    )
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    found = written(
        found.select("row_id", "doc_id", "keep_id", "group_size", "text_sha256", "bucket", best.alias("best")), "dedup-found"
    )
    # of rows that repeat the best one's id and length the first stays
    first = found.where("best").groupBy("bucket", "text_sha256").agg(F.min("row_id").alias("first"))
    return found.join(first.select("first"), F.col("row_id") == F.col("first"), "left").select(
        "doc_id", "keep_id", "group_size", F.col("first").isNotNull().alias("kept"), "text_sha256", "bucket"
    )


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns.

    A repeated row (same id, equal text) stays once, in its longest form.
    """
    ids, sha, own, rn = (fresh(x, docs.columns) for x in ("kept_id", "text_key", "kept_key", "copy_no"))
    kept = (
        exact_dedup(docs, id_col, text_col)
        .where("kept")
        .select(F.col("doc_id").alias(ids), F.col("text_sha256").alias(own))
    )
    keyed = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    found = keyed.join(kept, F.col(id_col).eqNullSafe(F.col(ids)) & (F.col(sha) == F.col(own)), "left_semi")
    turn = Window.partitionBy(id_col, sha).orderBy(F.length(text_col).desc())
    return found.withColumn(rn, F.row_number().over(turn)).where(F.col(rn) == 1).select(*docs.columns)


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("bucket")


SQL = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
