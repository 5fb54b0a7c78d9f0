"""Language ID by rank-order profiles of character n-grams.

The profile of a language is its RANKS most frequent n-grams (one to three letters,
word edges included) in rank order. A document's own most frequent n-grams are
compared with each profile by the out-of-place distance: the sum of differences in
rank, RANKS for an n-gram that the profile lacks. The nearest profile wins.

Profiles are counted by Spark over a bounded sample of about SAMPLE documents a
language, of every language that occurs; what reaches the driver is RANKS rows a language. Scoring is one pass over whole
texts without any shuffle; the counting inside a text is vectorised.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import body, crc32_of_id, table, written

#: Length of a profile, and documents a language that profiles are counted over, about (twice as many at most).
RANKS, SAMPLE = 300, 3000

#: Most languages whose sample shares are broadcast.
BROADCAST = 100000

#: A letter is its code point, in SHIFT bits: an n-gram is one 64-bit number.
SHIFT = 21

#: A number that no code point has.
EDGE = (1 << SHIFT) - 1

FOLDS, HELD = 5, 0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point 0, or for a letter the code point of its lower case."""
    made = np.zeros(0x110000, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            made[i] = ord(c.lower()[0])
    return made


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, and how often each occurs.

    Edges of words are zeros; one edge before, inside or after, so n-grams of other
    lengths or places never share a number.
    """
    x = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    x = np.concatenate([[0], x, [0]]).astype(np.uint64)
    x = x[(x != 0) | np.concatenate([[True], x[:-1] != 0])]  # one edge between words
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = np.uint64(SHIFT), np.uint64(2 * SHIFT)
    # the highest digit of a pair is free for a mark that tells it from a letter and from a triple
    pairs = (x[:-1] << one) | x[1:] | (np.uint64(EDGE) << two)
    triples = ((x[:-2] << two) | (x[1:-1] << one) | x[2:])[x[1:-1] != 0]
    found, count = np.unique(np.concatenate([x[x != 0], pairs, triples]), return_counts=True)
    return found.astype(np.int64), count


class Profiles:
    """Ranks of n-grams by language: for each known n-gram the languages that have it, and where."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.names = sorted(ranked)
        gram = np.array([g for name in self.names for g in ranked[name]], np.int64)
        language = np.repeat(np.arange(len(self.names)), [len(ranked[name]) for name in self.names]).astype(np.int64)
        rank = np.array([i for name in self.names for i in range(len(ranked[name]))], np.int64)
        order = np.lexsort((language, gram))
        self.known, self.first = np.unique(gram[order], return_index=True)
        self.end = np.append(self.first[1:], len(gram))
        self.language, self.rank = language[order], rank[order]

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of each language to n-grams in rank order."""
        away = np.full(len(self.names), float(RANKS * len(own)))
        at = np.minimum(np.searchsorted(self.known, own), max(0, len(self.known) - 1))
        hit = np.flatnonzero(self.known[at] == own) if len(self.known) else np.zeros(0, int)
        size = self.end[at[hit]] - self.first[at[hit]]
        place = np.repeat(self.first[at[hit]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        np.add.at(away, self.language[place], np.abs(self.rank[place] - np.repeat(hit, size)) - RANKS)
        return away

    def nearest(self, text: str) -> tuple[str, float]:
        """The language, and 1 less its share in its own and the next distance; und without a letter."""
        found, count = grams(text)
        if not len(found) or not self.names:
            return "und", 0.0
        away = self.distances(found[np.lexsort((found, -count))[:RANKS]])
        order = np.argsort(away, kind="stable")
        if len(order) == 1:
            return self.names[0], 1.0
        best, next_ = float(away[order[0]]), float(away[order[1]])
        return self.names[order[0]], 1 - best / (best + next_) if next_ else 0.5


def held_out(doc_id):
    return F.coalesce(crc32_of_id(doc_id) % FOLDS == HELD, F.lit(False))


def profiles(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Profiles:
    """Profiles of all languages of docs outside the held-out fold."""
    doc_id = F.col(id_col).cast("long")
    known = docs.select(doc_id.alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    # a hash below SAMPLE / n of its range takes about SAMPLE of the n documents, the same ones each
    # time; where rows repeat it may take more, and the first 2 * SAMPLE of those count
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    below = sizes.select(F.col("lang").alias("of"), (F.lit(float(SAMPLE)) / F.col("n")).alias("share"))
    if sizes.count() <= BROADCAST:  # so that only sampled texts are shuffled; a longer list joins by shuffle
        below = F.broadcast(below)
    point = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / F.lit(float(1 << 53))
    chosen = known.join(below, F.col("lang") == F.col("of")).where(point < F.col("share"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", "text"))
    chosen = chosen.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= 2 * SAMPLE)

    def counted(batches):
        for part in batches:
            total: dict[str, dict[int, int]] = {}
            for lang, text in zip(part["lang"], part["text"], strict=True):
                own = total.setdefault(lang, {})
                for g, n in zip(*map(np.ndarray.tolist, grams(text)), strict=True):
                    own[g] = own.get(g, 0) + n
            rows = [(lang, g, n) for lang, own in total.items() for g, n in own.items()]
            yield pd.DataFrame(rows, columns=["lang", "gram", "n"])

    counts = chosen.select("lang", "text").mapInPandas(counted, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS)
    ranked: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "rank").collect():
        ranked.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(ranked)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score (0.5 to 1; 0 for und).

    lang_pred is und where the text is null or has no letter, or where no language
    could be learned. Rows without a language, or of the held-out fold, teach
    nothing. Ids may be null or repeat. An empty table gives an empty result. Other
    columns are ignored.
    """
    known = profiles(docs, id_col, text_col, lang_col)

    def run(batches):
        for part in batches:
            found = [known.nearest(t) for t in part["text"]]
            yield pd.DataFrame(
                {"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": [x[0] for x in found], "score": np.array([x[1] for x in found], float)}
            )

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), body(F.col(text_col)).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
