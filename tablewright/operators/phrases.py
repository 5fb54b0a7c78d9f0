"""Which phrase lists a text holds, by an index of phrases on their first word.

Lists are data: a table (list, phrase). Every word of a text, with the words behind it,
meets the phrases that begin with it by an equality join, and the rest of a phrase is
compared place by place. All lists are found in one pass, however many there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.text import token

#: Phrases up to which the index is sent to every task; a larger one is joined by a shuffle of the words.
BROADCAST = 50_000


def lists(spark: SparkSession, **phrases) -> DataFrame:
    """The table (list, phrase) of named lists."""
    return spark.createDataFrame([(name, p) for name, own in phrases.items() for p in own], "list string, phrase string")


def matches(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, list, phrase and times: the phrases in each text as whole words in token() form, and how often.

    Phrases without a word match nothing, nor do null texts; texts of the same id count together.
    """
    words = F.split(token(F.col("phrase")), " ")
    known = phrases.select("list", token(F.col("phrase")).alias("phrase"), words.alias("words")).where("phrase <> ''").distinct()
    count, most = known.agg(F.count("*"), F.max(F.size("words"))).first()
    most = most or 1
    index = known.select("list", "phrase", F.size("words").alias("n"), *[F.get("words", F.lit(i)).alias(f"p{i}") for i in range(most)])
    own = texts.select(F.col(id_col).alias("id"), F.split(token(F.col(text_col)), " ").alias("w"))
    shifted = [F.slice("w", F.lit(i + 1), F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(most)]
    placed = own.select("id", F.inline(F.arrays_zip(*shifted)))
    rest = [(F.col("n") <= i) | (F.col(f"p{i}") == F.col(f"w{i}")) for i in range(1, most)]
    met: Column = reduce(Column.__and__, rest, F.col("w0") == F.col("p0"))
    found = placed.join(F.broadcast(index) if count <= BROADCAST else index, met)
    return found.groupBy("id", "list", "phrase").agg(F.count("*").alias("times"))


def found_lists(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and lists: the names of the lists that each text holds a phrase of; texts without any are left out."""
    return matches(texts, phrases, id_col, text_col).groupBy("id").agg(F.array_sort(F.collect_set("list")).alias("lists"))
