"""Embedding whitening by a compensated covariance.

Vectors become whole numbers far from zero, so sums of squares would lose all digits of
the covariance. Each vector is therefore centred first, by a mean that is kept as a
double-double (an unrounded pair of doubles), and the outer products of the centred
vectors are accumulated as double-doubles by error-free transformations:

* centred entries are split into slices of SLICE bits; with blocks of BLOCK rows the
  matrix product of two slices has no rounding at all, so the outer products of a
  whole block are exact sums and run at the speed of a matrix product;
* these products are added to the running pair (high, low) by Knuth's two-sum.

Every task emits the high and low part of its matrix, a row for each matrix row, and
groups of FAN tasks merge by the same addition, level by level, until one matrix is
left. That matrix (a square of the dimension, however many vectors there are) goes to the driver,
where ``numpy.linalg.eigh`` solves it: Householder reduction to tridiagonal form, then
divide and conquer (LAPACK's syevd). A last pass projects the vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import table, written

#: Scale and offset of the whole numbers, and the most components that are returned.
SCALE, OFFSET, COMPONENTS = 64, 1000000, 32

#: 2 * SLICE + log2(BLOCK) bits fit a double, so products of slices are exact; SLICES of them hold an entry.
BLOCK, SLICE, SLICES = 1024, 21, 4

#: Matrices that are merged at a time, and the largest whole number whose neighbours are doubles.
FAN, MOST = 64, 2**52


def two_sum(a, b):
    """(s, e): s is a + b rounded and s + e is a + b exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(high, low, high2, low2):
    """The sum of two double-doubles as a double-double."""
    s, e = two_sum(high, high2)
    t, f = two_sum(low, low2)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def divided(total: int, n: int) -> tuple[float, float]:
    """total / n as a double-double."""
    exact = Fraction(total, n)
    high = float(exact)
    return high, float(exact - Fraction(high))


def centred(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x minus the double-double mean, as a double-double."""
    s, e = two_sum(x, -high)
    return two_sum(s, e - low)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """The entries' leading SLICE bits, the next ones and so on, each a multiple of one unit for the whole block."""
    out, top = [], float(np.abs(high).max(initial=0))
    for _ in range(SLICES):
        if not top:
            break
        unit = np.ldexp(1.0, int(np.frexp(top)[1]) + 53 - SLICE)
        part = (high + unit) - unit  # rounded to a multiple of unit / 2**52
        high, low = two_sum(high - part, low)
        out.append(part)
        top = float(np.abs(high).max(initial=0))
    return out


def outer_sums(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over rows of the outer product of each row with itself, as a double-double matrix."""
    d = high.shape[1]
    total = np.zeros((d, d)), np.zeros((d, d))
    for a in range(0, len(high), BLOCK):
        parts = slices(high[a : a + BLOCK], low[a : a + BLOCK])
        for i, p in enumerate(parts):
            for q in parts[: SLICES - i]:
                total = added(*total, p.T @ q, np.zeros((d, d)))
    return total


@dataclass
class Fit:
    """What one pass over the vectors of a dimension has learned."""

    n: int
    sums: list[int]
    high: np.ndarray = None
    low: np.ndarray = None
    values: np.ndarray = None
    vectors: np.ndarray = None
    explained: list = field(default_factory=list)
    error: float | None = None

    def __post_init__(self):
        mean = [divided(s, self.n) for s in self.sums]
        self.high, self.low = np.array([m[0] for m in mean]), np.array([m[1] for m in mean])

    def solved(self, high: np.ndarray, low: np.ndarray) -> None:
        """Eigenvectors of the covariance, by falling eigenvalue; those without variance have none to be divided by."""
        v = high / self.n + low / self.n
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        trace, k = float(np.trace(v)), min(COMPONENTS, len(values))
        live = values > max(values.max(initial=0), 0) * len(values) * np.finfo(float).eps
        self.explained = [max(0.0, float(e)) / trace if trace > 0 else None for e in values[:k]]
        self.values = np.where(live, values, np.nan)[:k]
        self.vectors = vectors[:, :k]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x, centred, projected and scaled; NaN where a component has no variance."""
        high, low = centred(x.astype(float), self.high, self.low)
        return (high @ self.vectors + low @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n*x - S)**2, cut to a long."""
        most = max((self.n * abs(int(v)) + abs(s) for v, s in zip(np.abs(x).max(0, initial=0), self.sums, strict=True)), default=0)
        if most < 2**62:
            d = x * np.int64(self.n) - np.array(self.sums, np.int64)
            far = int(np.abs(d).max(initial=0))
            if far * far * max(1, d.shape[1]) < 2**63:
                return (d * d).sum(1).tolist()
        else:
            d = x.astype(object) * self.n - np.array(self.sums, object)
        return [min(2**63 - 1, int(v)) for v in (d.astype(object) ** 2).sum(1)] if d.shape[1] else [0] * len(x)


def _matrices(part: pd.DataFrame):
    """(dimension, vectors as a matrix of longs, rows of part) of each dimension in a batch."""
    for dim, own in part.groupby("dim"):
        yield int(dim), np.array(own["x"].tolist(), np.int64).reshape(len(own), int(dim)), own


_PARTS = "dim int, part long, row int, high array<double>, low array<double>"


def _accumulated(rows: DataFrame, made, tasks: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The double-double matrices that made(dim, x) sums to over all rows, by dimension: per task first, then by groups of FAN."""

    def local(batches):
        from pyspark import TaskContext

        totals: dict = {}
        for batch in batches:
            for dim, x, _ in _matrices(batch):
                new = made(dim, x)
                totals[dim] = added(*totals[dim], *new) if dim in totals else new
        part = TaskContext.get().partitionId()
        for dim, (high, low) in totals.items():
            yield pd.DataFrame({"dim": dim, "part": part, "row": range(len(high)), "high": high.tolist(), "low": low.tolist()})

    def merged(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("part")
        high, low = np.zeros(len(part["high"].iloc[0])), np.zeros(len(part["high"].iloc[0]))
        for h, v in zip(part["high"], part["low"], strict=True):
            high, low = added(high, low, np.asarray(h), np.asarray(v))
        return pd.DataFrame({"dim": [key[0]], "part": [key[2]], "row": [key[1]], "high": [high.tolist()], "low": [low.tolist()]})

    sums = rows.mapInPandas(local, _PARTS)
    while tasks > 1:
        tasks = -(-tasks // FAN)
        group = F.floor(F.col("part") / FAN)
        sums = sums.groupBy("dim", "row", group.alias("group")).applyInPandas(merged, _PARTS)
    found: dict = {}
    for r in sums.collect():
        found.setdefault(r["dim"], {})[r["row"]] = (r["high"], r["low"])
    return {
        dim: tuple(np.array([own[i][k] for i in sorted(own)]).reshape(len(own), -1) for k in (0, 1)) for dim, own in found.items()
    }


def _whole(vector):
    """floor(SCALE * c) + OFFSET of each component as a long; beyond MOST it is cut there."""
    cut = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))
    return F.transform(vector, lambda c: F.floor(cut(c)) + F.lit(OFFSET).cast("long"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component up to COMPONENTS: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out. Ids may
    be null or repeat: every row counts and is returned. Vectors of another number of
    components are fitted apart (a model for each is held by the driver and the tasks);
    empty vectors have no components and so no rows. A component without variance, as
    all have when there is one vector only, has a null whitened value, and explained is
    null where the trace is zero; identity_error is taken over the other components, and
    null without any. Deviations beyond a long are cut to its end, entries beyond
    2**52 to that. An empty table gives an empty result. Other columns are ignored.
    """
    x = F.col("vector")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(x.isNotNull() & fine & (F.size(x) > 0)).select("vec_id", F.size(x).alias("dim"), _whole(x).alias("x"))
    rows = written(rows, "whitening-rows")
    tasks = rows.rdd.getNumPartitions()

    def summed(batches):
        for batch in batches:
            for dim, m, own in _matrices(batch):
                total = [int(v) for v in m.sum(0)] if abs(m).max() < 2**40 else [sum(map(int, c)) for c in m.T]
                yield pd.DataFrame({"dim": dim, "place": range(dim), "n": len(own), "total": [str(v) for v in total]})

    sums = rows.select("dim", "x").mapInPandas(summed, "dim int, place int, n long, total string")
    sums = sums.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by_dim: dict = {}
    for r in sorted(sums, key=lambda r: (r["dim"], r["place"])):
        by_dim.setdefault(r["dim"], (r["n"], []))[1].append(int(r["total"]))
    fits = {dim: Fit(n, s) for dim, (n, s) in by_dim.items()}

    found = _accumulated(rows.select("dim", "x"), lambda dim, m: outer_sums(*centred(m.astype(float), fits[dim].high, fits[dim].low)), tasks)
    for dim, fit in fits.items():
        fit.solved(*found[dim])

    def with_ones(dim, m):
        """Outer sums of the whitened vectors, with a column of ones whose products are their sums."""
        w = np.c_[np.nan_to_num(fits[dim].whitened(m)), np.ones(len(m))]
        return outer_sums(w, np.zeros_like(w))

    for dim, (high, low) in _accumulated(rows.select("dim", "x"), with_ones, tasks).items():
        fit, whole = fits[dim], (high + low) / fits[dim].n
        mean, live = whole[:-1, -1], ~np.isnan(fit.values)
        off = np.abs(whole[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean)))[live][:, live]
        fit.error = float(off.max()) if off.size else None

    def projected(batches):
        for batch in batches:
            for dim, m, own in _matrices(batch):
                fit = fits[dim]
                white = fit.whitened(m)
                k = white.shape[1]
                yield pd.DataFrame({
                    "vec_id": own["vec_id"].astype("Int64").repeat(k).array, "component": np.tile(np.arange(1, k + 1), len(m)), "n": fit.n,
                    "deviation": np.repeat(fit.deviations(m), k), "whitened": white.ravel(),
                    "explained": np.tile(np.array(fit.explained, float), len(m)), "identity_error": np.nan if fit.error is None else fit.error,
                })

    out = rows.mapInPandas(projected, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    named = ["whitened", "explained", "identity_error"]
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in named})


def op11_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
