"""Bounded samples of labelled documents, shared by the classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import crc32_of_id

#: Remainder of crc32(id) by FOLDS whose labels are never learned from.
FOLDS, HELD = 3, 1


def held_out(doc_id):
    return F.coalesce(crc32_of_id(doc_id) % FOLDS == HELD, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, dict[int, float]]:
    """text and label of at most most[v] documents with label v, outside the held-out fold,
    and the weight of each label: how many training labels one chosen stands for.

    Fits must weigh by it, or else the shares of the labels, and with them all scores,
    would depend on the size of the table.

    Chosen by a hash of the id, so a rerun chooses the same. Only ids are sorted; the
    chosen ones, sum(most) at most, are broadcast to the scan of the texts. A label
    row that is null or repeats an id with another label teaches nothing.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .drop("other")
    )
    chosen = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(n) for v, n in most.items()]
    ids = reduce(DataFrame.unionByName, chosen)
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    weights = {v: max(1.0, count.get(v, 0) / n) for v, n in most.items()}
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(ids), F.col("key") == F.col("id")).select(
        "id", F.coalesce("text", F.lit("")).alias("text"), "label"
    )
    return found, weights
