"""Toxicity by compression distance.

A text is cut into words, runs of digits and runs of signs. Each is written as a
chain of CODE-byte hashes, one for every STEP letters more of it, so that texts
that share a word, or the beginning of one, share whole codes, and the letter
statistics of a language don't blur the lengths. Windows of WINDOW codes are what
is compressed.

Two dictionaries are trained by zstandard on such windows: one on toxic documents,
one on ordinary ones. Every window of a text is compressed twice, with the ordinary
dictionary alone and with the toxic one before it; how many bytes the toxic one
saves is the window's distance. Most windows of a toxic document are ordinary, so
training goes two rounds: dictionaries of the first, fitted without the fold that
they judge, choose the windows of toxic documents that they shorten (the toxic
dictionary of the second round is trained on those), and the windows of ordinary
documents that they wrongly shorten (these train a part of the ordinary dictionary).
No word list is made anywhere. A logistic model turns a document's distances into a
score; it is calibrated on a third of the sample that trained no dictionary, and
weighs both kinds by their shares of all training labels.

Training takes a bounded sample of labelled rows on the driver: at most TOXIC and
ORDINARY documents, of which whole ones train in the order of a hash of their ids; one
that TRAINED characters of its label no longer have room for is passed over. No text
is cut. The model is about a hundred kilobytes. Scoring is one pass over
whole texts without any shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import body, table, written
from tablewright.llm.labelled import held_out, sample

#: Most toxic and ordinary documents that are learned from, and characters of each label that train dictionaries.
TOXIC, ORDINARY, TRAINED = 2000, 5000, {1: 4_000_000, 0: 8_000_000}

#: Codes of a window, letters of a step, bytes of a code and of the shortest match.
WINDOW, STEP, CODE, MATCH = 24, 4, 8, 6

#: Bytes of the dictionaries: first and last toxic one, ordinary one, wrongly shortened windows.
FIRST_BYTES, TOXIC_BYTES, ORDINARY_BYTES, HARD_BYTES = 16384, 8192, 65536, 32768

#: Part of a dictionary's bytes for which fillers train: four times what a header takes at most.
CUT = 2048

#: Parts of the sample that judge each other, and bytes saved that choose a window.
PARTS, SAVED = 4, 4

THRESHOLD = 0.7

_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_KNOWN: dict[str, bytes] = {}
_MOST_KNOWN = 300000


def code(piece: str) -> bytes:
    """The hashes of a piece's first STEP letters, the first 2 * STEP and so on."""
    import xxhash

    made = _KNOWN.get(piece)
    if made is None:
        last, out = b"", []
        for i in range(0, len(piece), STEP):
            last = xxhash.xxh64_digest(last + piece[i : i + STEP].encode("utf-8", "surrogatepass"))
            out.append(last)
        made = b"".join(out)
        if len(piece) <= 40:
            if len(_KNOWN) >= _MOST_KNOWN:
                _KNOWN.clear()
            _KNOWN[piece] = made
    return made


def windows(text: str) -> list[bytes]:
    """The coded windows of a whole text, in order."""
    whole, size = b"".join(map(code, _PIECE.findall(text.lower()))), WINDOW * CODE
    return [whole[i : i + size] for i in range(0, len(whole), size)]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary; of few samples, which can't be trained on, the samples.

    Training goes over the samples in order, and what it picks first, usually the most
    frequent codes, stands at the end of the content, of which as much is cut off as
    the dictionary's header takes. So windows of codes that no text has go first.
    """
    import xxhash
    import zstandard as zs

    fillers = [b"".join(xxhash.xxh64_digest(b"\xff%d" % (i * WINDOW + j)) for j in range(WINDOW)) for i in range(8)]
    n = math.ceil(len(samples) * CUT / (size - CUT)) if size > CUT else 0
    try:
        made = zs.train_dictionary(size, [fillers[i % 8] for i in range(n)] + samples, k=segment, d=CODE).as_bytes()
    except zs.ZstdError:
        made = b"".join(x for x, _ in reversed(Counter(samples).most_common()))
    return made[-size:]


def compressor(content: bytes):
    import zstandard as zs

    params = zs.ZstdCompressionParameters(
        window_log=18, chain_log=18, hash_log=18, search_log=5, min_match=MATCH, target_length=16,
        strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False,
    )
    held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=held, compression_params=params)


def savings(plain, toxic, parts: list[bytes]) -> np.ndarray:
    """Bytes that the compressor toxic saves over plain in each window."""
    return np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in parts], float)


def features(saved: np.ndarray, codes: int) -> list[float]:
    """What the scores see of a document: its windows' distances, normalised by its length too."""
    if not len(saved):
        return [0.0] * 7
    sure = np.maximum(0, saved - 2)
    return [
        float(np.log1p(sure.sum())), float(sure.sum() / (codes + 40) * 10), float(np.log1p(sure.max())),
        float(np.log1p((saved >= SAVED).sum())), float((saved >= SAVED).mean()), float(np.log1p(codes)),
        float(np.clip(saved.sum() / (codes + 40) * 10, -3, 5)),
    ]


@dataclass
class Model:
    """Two dictionaries, and the logistic model of the distances that they give."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray | None = None
    dev: np.ndarray | None = None
    weights: np.ndarray | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def savings(self, text: str) -> np.ndarray:
        return self._saved(windows(text))

    def _saved(self, parts: list[bytes]) -> np.ndarray:
        if "_made" not in self.__dict__:
            self._made = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        return savings(*self._made, parts)

    def features(self, text: str) -> list[float]:
        parts = windows(text)
        return features(self._saved(parts), sum(map(len, parts)) // CODE)

    def expanded(self, x: np.ndarray) -> np.ndarray:
        q = (x - self.mean) / self.dev
        return np.c_[np.ones(len(q)), q, q**2, q[:, [0]] * q[:, [5]]]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None or not len(texts):
            return np.zeros(len(texts))
        x = np.array([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.expanded(x) @ self.weights, -30, 30)))

    def calibrate(self, x: np.ndarray, labels: np.ndarray, weights: dict[int, float] | None = None, steps: int = 50) -> Model:
        """Fit the logistic model to features and labels, weighted by label."""
        self.mean, self.dev = x.mean(0), x.std(0) + 1e-9
        q = np.array([(weights or {}).get(int(v), 1.0) for v in labels])
        a = self.expanded(x)
        w = np.zeros(a.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            curve = (a * (q * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
            w += np.linalg.solve(curve, a.T @ (q * (labels - p)) - 0.1 * w)
        self.weights = w
        return self


def calibrates(key: int) -> bool:
    """Whether a document of the sample calibrates; the others train dictionaries."""
    return key % 3 == 0


def learn(rows: list[tuple[int, int, list[bytes]]]) -> Model | None:
    """Dictionaries from (key, label, windows) rows, in two rounds; None without both labels."""
    part = {v: [[w for k, y, own in rows if y == v and k // 3 % PARTS == f for w in own] for f in range(PARTS)] for v in (0, 1)}
    every = {v: [w for own in part[v] for w in own] for v in (0, 1)}
    if not every[0] or not every[1]:
        return None
    first = dictionary(every[0], ORDINARY_BYTES, 2 * CODE)
    plain, chosen, hard = compressor(first), [], []
    for f in range(PARTS):
        others = [w for g in range(PARTS) if g != f for w in part[1][g]] or every[1]
        toxic = compressor(dictionary(others, FIRST_BYTES, 2 * CODE) + first)
        for own, out in ((part[1][f], chosen), (part[0][f], hard)):
            saved = savings(plain, toxic, own)
            out += [own[i] for i in np.flatnonzero(saved >= SAVED)]
    ordinary = (dictionary(hard, HARD_BYTES, CODE) if hard else b"") + first
    return Model(ordinary, dictionary(chosen or every[1], TOXIC_BYTES, CODE))


def fit(rows: list[tuple[str, int]], weights: dict[int, float] | None = None) -> Model:
    """The model of (text, label) rows, weighted by label; without both labels one that scores 0."""
    found = [(i, label, text) for i, (text, label) in enumerate(rows)]
    model = learn([(i, label, windows(text)) for i, label, text in found if not calibrates(i)])
    held = [(text, label) for i, label, text in found if calibrates(i)]
    if model is None or len({label for _, label in held}) < 2:
        return Model(b"", b"")
    return model.calibrate(np.array([model.features(t) for t, _ in held]), np.array([float(v) for _, v in held]), weights)


def _key(doc_id: int) -> int:
    return zlib.crc32(f"toxicity {doc_id}".encode())


def fitting(sizes: list[tuple[int, int, int]], room: dict[int, int]) -> set[int]:
    """Ids of (id, label, characters) that train: whole documents in the order of their hash while their label has room."""
    left, out = dict(room), set()
    for doc_id, label, size in sorted(sizes, key=lambda r: (_key(r[0]), r)):
        if size <= left[label]:
            left[label] -= size
            out.add(doc_id)
    return out


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """The model of a bounded sample: its windows train on the driver, its features are made in tasks."""
    chosen, weights = sample(docs, labels, label_col, {1: TOXIC, 0: ORDINARY}, id_col, text_col)
    chosen = written(chosen, "toxicity-sample")

    sizes = chosen.select("id", "label", F.length("text").alias("n")).groupBy("id", "label").agg(F.sum("n").alias("n")).collect()
    fits = fitting([(r["id"], r["label"], r["n"]) for r in sizes if not calibrates(_key(r["id"]))], TRAINED)

    def cut(batches):
        for part in batches:
            own = part[part["id"].isin(fits)]
            yield pd.DataFrame({"id": own["id"], "label": own["label"], "parts": [windows(t) for t in own["text"]]})

    rows = chosen.mapInPandas(cut, "id long, label int, parts array<binary>").collect()
    model = learn([(_key(r["id"]), r["label"], list(map(bytes, r["parts"]))) for r in sorted(rows, key=lambda r: r["id"])])
    if model is None:
        return Model(b"", b"")

    def described(batches):
        for part in batches:
            part = part[[calibrates(_key(i)) for i in part["id"]]]
            yield pd.DataFrame({"id": part["id"], "label": part["label"], "x": [model.features(t) for t in part["text"]]})

    rows = sorted(chosen.mapInPandas(described, "id long, label int, x array<double>").collect(), key=lambda r: r["id"])
    if len({r["label"] for r in rows}) < 2:
        return Model(b"", b"")
    return model.calibrate(np.array([r["x"] for r in rows]), np.array([float(r["label"]) for r in rows]), weights)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 from THRESHOLD).

    A null text counts as empty, and an empty one gets the model's score of no
    saving. Ids may be null or repeat. Without labels of both kinds, for the
    dictionaries and for their calibration, every score is 0. An empty table gives an
    empty result. Other columns are ignored.
    """
    model = trained(docs, labels, id_col, text_col, label_col)

    def run(batches):
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": model.score(part["text"].tolist())})

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), body(F.col(text_col)).alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
