"""Exact top-k by multi-resolution segment statistics.

Queries meet all rows in blocks. For a pair of vectors cut into segments of length
L, the squared distance is at least the sum over segments of
L * ((mean - mean')**2 + (dev - dev')**2), so the inner product is at most the sum
of L * (mean * mean' + dev * dev'). Levels go from few segments to many: at each,
pairs whose bound stays below the query's fifth best exact score so far are
dropped, and only the survivors of the last level get exact scores.

Blocks of queries and of candidates are packed into single rows (a few hundred
kilobytes) and matched on the block numbers, so the work is a grid of independent
tasks. Every task returns k rows a query; a window takes the best of those.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import table, written

#: Rows of a block of queries and of candidates, and segments at each level.
QUERIES, CANDIDATES, LEVELS = 2048, 1024, (1, 4, 16)

#: Pairs that are bounded or scored at a time, and the share of survivors from which all are.
CHUNK, DENSE = 1 << 17, 0.25

_BLOCK = "dim int, block int, n int, ids binary, vectors binary"


def bounds_of(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products are the upper bounds: sqrt(L)-weighted means and deviations."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]) or 1)
    out = []
    for p in parts:
        own = x[:, p]
        out += [own.mean(1) * math.sqrt(len(p)), own.std(1) * math.sqrt(len(p))] if len(p) else []
    return np.stack(out, 1) if out else np.zeros((len(x), 0))


def products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), CHUNK):
        s = slice(a, a + CHUNK)
        out[s] = np.einsum("ij,ij->i", q[i[s]], c[j[s]])
    return out


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as exact whole numbers of any size."""
    return np.array([[math.floor(Fraction(v) * scale) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def best_pairs(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, scale: int = 1):
    """(query index, candidate index, score) of each query's k best candidates by floor(scale * x), ties to smaller ids."""
    given = q, c
    with np.errstate(over="ignore"):
        q, c = np.floor(q * scale), np.floor(c * scale)
    big = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if not big < 2**53:  # beyond exact doubles: whole numbers of any size, cut to a long
        exact = whole(given[0], scale) @ whole(given[1], scale).T
        return [
            (i, j, max(-(2**63), min(2**63 - 1, int(exact[i, j]))))
            for i in range(len(q))
            for j in sorted((j for j in range(len(c)) if cid[j] != qid[i]), key=lambda j: (-exact[i, j], cid[j]))[:k]
        ]
    slack = 1e-9 * big + 1e-6
    levels = [(bounds_of(q, n), bounds_of(c, n)) for n in LEVELS]
    found = []
    step = max(1, CHUNK // max(1, len(c)))
    for a in range(0, len(q), step):
        qs, own = q[a : a + step], qid[a : a + step, None] == cid[None, :]
        coarse = np.where(own, -np.inf, levels[0][0][a : a + step] @ levels[0][1].T)
        # the fifth best of some promising candidates is a floor for the query's fifth best
        seeds = min(len(c), k + 1)
        pick = np.argpartition(-coarse, seeds - 1, axis=1)[:, :seeds] if seeds else np.zeros((len(qs), 0), int)
        sure = np.where(np.take_along_axis(own, pick, 1), -np.inf, np.einsum("id,ijd->ij", qs, c[pick]))
        floor = np.sort(sure, axis=1)[:, ::-1][:, k - 1] if seeds >= k else np.full(len(qs), -np.inf)
        alive = (coarse + slack >= floor[:, None]) & ~own
        for lq, lc in levels[1:]:
            if alive.mean() > DENSE:
                alive &= lq[a : a + step] @ lc.T + slack >= floor[:, None]
            else:
                i, j = np.nonzero(alive)
                keep = products(lq[a : a + step], lc, i, j) + slack >= floor[i]
                alive[i[~keep], j[~keep]] = False
        i, j = np.nonzero(alive)
        score = (qs @ c.T)[i, j] if alive.mean() > DENSE else products(qs, c, i, j)
        order = np.lexsort((cid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        turn = np.arange(len(i)) - np.searchsorted(i, i)
        top = turn < k
        found += zip((i[top] + a).tolist(), j[top].tolist(), score[top].astype(np.int64).tolist(), strict=True)
    return found


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Components become floor(scale * x). Queries are the rows whose id is divisible
    by every, candidates all rows of other ids and of the same number of components;
    ties go to the smaller id. Rows take no part whose id or vector is null, or whose
    vector holds a null or non-finite component. Rows that repeat a query's id are
    one query, the first vector by its components; repeated candidates each count.
    With fewer than k candidates all are returned; an empty table gives an empty
    result. Scores beyond a long are cut to its ends. Other columns are ignored.
    """
    x = F.col("vector")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(F.col("id").isNotNull() & x.isNotNull() & fine)
    rows = written(rows.select("id", "vector", F.size(x).alias("dim")), "topk-rows")
    asks = rows.where(F.col("id") % every == 0)
    asks = asks.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("vector"))).where("turn = 1")
    n, m = rows.count(), rows.where(F.col("id") % every == 0).select("id").distinct().count()
    across, down = max(1, math.ceil(m / QUERIES)), max(1, math.ceil(n / CANDIDATES))

    def packed(key, part: pd.DataFrame) -> pd.DataFrame:
        at = np.array(part["vector"].tolist(), dtype=np.float64).reshape(len(part), -1)
        return pd.DataFrame(
            {"dim": [key[0]], "block": [key[1]], "n": [len(part)], "ids": [part["id"].to_numpy("int64").tobytes()], "vectors": [at.tobytes()]}
        )

    def blocks(df: DataFrame, count: int) -> DataFrame:
        part = F.pmod(F.xxhash64("id", F.lit(count)), F.lit(count)).cast("int")
        return df.select("dim", "id", "vector").groupBy("dim", part.alias("block")).applyInPandas(packed, _BLOCK)

    of_queries = blocks(asks, across).toDF("q_dim", "q_block", "q_n", "q_ids", "q_vectors")
    of_rows = blocks(rows, down)
    # every block of queries is matched with every block of rows: both sides carry the other's numbers. They meet by a
    # merge, by a hint: Spark sizes a block as a row of a hundred bytes and one copy of it, and would send all to the driver
    left = of_queries.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = of_rows.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    grid = left.hint("merge").join(
        right, (F.col("q_dim") == F.col("dim")) & (F.col("q_block") == F.col("r_block")) & (F.col("c_block") == F.col("block"))
    ).select("q_n", "q_ids", "q_vectors", "n", "ids", "vectors")

    def search(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                qid, cid = np.frombuffer(row.q_ids, "int64"), np.frombuffer(row.ids, "int64")
                q = np.frombuffer(row.q_vectors).reshape(row.q_n, -1)
                c = np.frombuffer(row.vectors).reshape(row.n, -1)
                found = best_pairs(qid, q, cid, c, k, scale)
                i, j, score = map(list, zip(*found, strict=True)) if found else ([], [], [])
                yield pd.DataFrame(
                    {"query_id": qid[np.array(i, int)], "vec_id": cid[np.array(j, int)], "score": np.array(score, "int64")}
                )

    best = grid.mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
