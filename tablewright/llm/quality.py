"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is described by
counts of its characters and words and encoded by one hidden layer; gated attention
weighs the passages, and the weighted representation of the document is scored.
Only documents have labels, so encoder, attention and scorer are learned together.

Training takes a bounded sample (GOOD and BAD documents, weighted so that both kinds
keep their shares), described in the map tasks and fitted on the driver; the model is a few kilobytes. Scoring is one pass
over whole texts without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import body, fresh, table
from tablewright.llm.labelled import held_out, sample

#: Most good and bad documents that are learned from, and words of a passage.
GOOD, BAD, PASSAGE = 5000, 3000, 64

#: Sizes of the encoding and of the attention, steps of the fit and documents of each.
HIDDEN, ATTENTION, STEPS, BATCH = 16, 8, 600, 256

THRESHOLD = 0.5

#: Classes of characters: letters, capitals, digits, sentence marks, other marks, bars, exclamations, white space.
LOWER, UPPER, DIGIT, MARK, ODD, BAR, SHOUT, SPACE = range(8)
FEATURES = 16


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point of the basic plane; others count as lower-case letters."""
    made = np.full(1 << 16, ODD, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            made[i] = SPACE
        elif c.isalpha():
            made[i] = UPPER if c.isupper() else LOWER
        elif c.isdigit():
            made[i] = DIGIT
    for c in ".,;:'\"()?-":
        made[ord(c)] = MARK
    made[ord("|")], made[ord("!")] = BAR, SHOUT
    return made


def passages(text: str) -> np.ndarray:
    """One row of features for each passage; a text without words is one empty passage."""
    words = text.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    starts = list(range(0, len(words), PASSAGE))
    if len(starts) > 1 and len(words) - starts[-1] < PASSAGE // 4:
        starts.pop()  # a short rest belongs to the last passage
    points = np.minimum(np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)
    kind = classes()[points]
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])[starts]
    share = np.stack([np.add.reduceat(kind == k, begin, dtype=np.int64) for k in range(8)], 1).astype(float)
    chars = np.maximum(1, share[:, :SPACE].sum(1))
    letters = share[:, LOWER] + share[:, UPPER]
    out = np.zeros((len(starts), FEATURES), np.float32)
    out[:, :6] = (share[:, [UPPER, DIGIT, MARK, ODD, BAR, SHOUT]].T / chars).T
    out[:, 6] = share[:, UPPER] / np.maximum(1, letters)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(words)], strict=True)):
        own = words[a:b]
        n, low = len(own), [w.lower() for w in own]
        lengths = size[a:b]
        out[i, 7:] = (
            len(set(low)) / n, len(set(zip(low, low[1:], strict=False))) / n, float(lengths.mean()) / 10, float(lengths.std()) / 10,
            float(lengths.max()) / 50, sum(w[-1] in ".!?" for w in own) / n, sum(w[0].isupper() for w in own) / n,
            sum(not any(c.isalpha() for c in w) for w in own) / n, min(n, 2 * PASSAGE) / PASSAGE,
        )
    return out


@dataclass
class Model:
    """Weights by name; all of them are fitted together."""

    mean: np.ndarray
    dev: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray):
        """Scores of bags whose passages begin at the rows first, and what the gradient needs."""
        w = self.w
        count = np.diff(np.append(first, len(x)))
        bag = np.repeat(np.arange(len(first)), count)
        h = np.tanh(((x - self.mean) / self.dev) @ w["W"] + w["b"])
        u, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-h @ w["U"]))
        s = (u * g) @ w["a"]
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        att = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(att[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return p, (bag, h, u, g, att, z)

    def gradient(self, x, first, y, weight=None) -> dict[str, np.ndarray]:
        w = self.w
        weight = np.ones(len(y)) if weight is None else weight
        p, (bag, h, u, g, att, z) = self.forward(x, first)
        o = weight * (p - y) / weight.sum()
        dz = (o[:, None] * w["c"])[bag]
        da = (dz * h).sum(1)
        ds = att * (da - np.add.reduceat(att * da, first)[bag])
        du = ds[:, None] * w["a"] * g * (1 - u**2)
        dg = ds[:, None] * w["a"] * u * g * (1 - g)
        dh = (att[:, None] * dz + du @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
        x = (x - self.mean) / self.dev
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ du, "U": h.T @ dg, "a": (u * g).T @ ds, "c": z.T @ o, "d": o.sum()}

    def score(self, texts: list[str]) -> np.ndarray:
        bags = [passages(t) for t in texts]
        if not bags:
            return np.zeros(0)
        first = np.cumsum([0, *map(len, bags)])[:-1]
        return self.forward(np.concatenate(bags).astype(float), first)[0]


def fit(
    bags: list[np.ndarray], labels: list[int], steps: int = STEPS, rate: float = 0.02, decay: float = 1e-4,
    weights: dict[int, float] | None = None,
) -> Model | None:
    """The model of labelled bags, weighted by label; None without both labels.

    Every step takes the next BATCH bags of a shuffled order, so the fit's time doesn't
    grow with the sample; steps get shorter to the end.
    """
    if len(set(labels)) < 2:
        return None
    x, y = np.concatenate(bags).astype(float), np.array(labels, float)
    weight = np.array([(weights or {}).get(v, 1.0) for v in labels])
    count = np.array(list(map(len, bags)))
    begin = np.cumsum(count) - count
    r = np.random.default_rng(0)
    w = {
        "W": r.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "U": r.normal(0, 0.3, (HIDDEN, ATTENTION)), "a": r.normal(0, 0.3, ATTENTION), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(()),
    }
    model = Model(x.mean(0), x.std(0) + 1e-6, w)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    order, at = r.permutation(len(y)), 0
    for t in range(1, steps + 1):
        if at >= len(y):
            order, at = r.permutation(len(y)), 0
        own, at = order[at : at + BATCH], at + BATCH
        first = np.cumsum(count[own]) - count[own]
        rows = np.repeat(begin[own] - first, count[own]) + np.arange(count[own].sum())
        step = rate * (1 - 0.9 * (t - 1) / steps)
        for k, d in model.gradient(x[rows], first, y[own], weight[own]).items():
            d = d + decay * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d**2
            w[k] = w[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model | None:
    chosen, weights = sample(docs, labels, label_col, {1: GOOD, 0: BAD}, id_col, text_col)

    def described(batches):
        for part in batches:
            yield pd.DataFrame(
                {"id": part["id"], "label": part["label"], "bag": [passages(t).tobytes() for t in part["text"]]}
            )

    rows = sorted(chosen.mapInPandas(described, "id long, label int, bag binary").collect())
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(bags, [r["label"] for r in rows], weights=weights)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 from THRESHOLD).

    A null text counts as empty, and an empty one is a single passage without words.
    Ids may be null or repeat. Without labels of both kinds every score is 1, so that
    nothing is rejected. An empty table gives an empty result. Other columns are ignored.
    """
    model = trained(docs, labels, id_col, text_col, label_col)

    def run(batches):
        for part in batches:
            texts = part["text"].tolist()
            score = model.score(texts) if model else np.ones(len(texts))
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": score})

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), body(F.col(text_col)).alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns, in one pass."""
    model = trained(docs, labels, id_col, text_col, "quality")
    name = fresh("quality_score", docs.columns)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        return pd.Series(model.score(texts) if model else np.ones(len(texts)))

    return docs.withColumn(name, score(F.col(text_col))).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def op9_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
