"""Personal data by high-recall generators and gradient-boosted trees.

Fixed patterns give the base spans, which always stay. Beside them, generators
propose further spans (obfuscated e-mail addresses, numbers without a plus sign or
in odd grouping); proposals may overlap. Boosted trees score every proposal from
its format and its context, and a threshold calibrated for each kind decides; of
overlapping accepted proposals the best score stays. The trees are trained on the
driver from a few thousand generated examples, which are a parameter, not on the
corpus; the fitted model is a few kilobytes.

Texts are taken one by one in the map tasks, whole. Every scan is linear in the
text: e-mail addresses are found from their @ signs and digits by whole runs.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import body, table

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base patterns (whole-run forms that match the same spans)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping matches: each is led by the run before an @."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            own = digits_of(m[0])
            if 12 <= len(own) <= 19 and luhn(own):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(digits_of(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


#: High-recall generators by kind; each is tried on its own, so spans may overlap.
GENERATORS = (
    (0, re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?[\[({]?\b(?:at|AT)\b[\])}]? ?[A-Za-z0-9-]{1,63}(?: ?[\[({]?\b(?:dot|DOT)\b[\])}]? ?[A-Za-z0-9-]{1,63}){1,4}")),
    (0, re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?[\[({](?:at|AT|@)[\])}] ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\[\.\] ?[0-9]{1,3}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])")),
    (3, re.compile(r"(?<![\w+])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}(?:[ ./-][0-9]{2,4}){1,3}(?!\w)")),
    (3, re.compile(r"(?<![\w+])00[1-9][0-9]{8,12}(?!\w)")),
    (3, re.compile(r"(?<![\w+.,/-])(?:\(0[0-9]{1,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{5,8}(?![\w/-])(?!\.[0-9])")),
)
_GATE = re.compile(r"[0-9]|\b(?:dot|DOT)\b|[\[({](?:at|AT|@)[\])}]")

#: Words that stand before personal data, or before numbers that are none.
NEAR = re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|contact|mail|e-?mail|write|reach|card|visa|credit|pay|ip|host|addr\w*|server)\b")
FAR = re.compile(r"(?i)\b(?:order|invoice|version|isbn|article|page|serial|part|total|price|year|date|id|no|nr|ref|case|law|room|score|table)\b")


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    own = digits_of(span)
    groups = re.findall("[0-9]+", span)
    near, far = list(NEAR.finditer(before)), list(FAR.finditer(before))
    last = max([(m.end(), 1.0) for m in near] + [(m.end(), -1.0) for m in far], default=(0, 0.0))[1]
    return [
        float(kind), float(end - start), float(len(own)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(span.startswith("(")), float(span.count("-")), float(span.count(".")), float(span.count("/")),
        float(span.count(" ")), float(sum(c in "[({" for c in span)), float(bool(re.search(r"(?i)\bdot\b", span))),
        float(luhn(own)) if own else -1.0, float(len(set(own))), float(own.startswith("0")),
        float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,4}.*", span))),
        last, float(len(near)), float(len(far)), float(before[-1:].isspace() or not before),
        float(after[:1] in "%$€£"), float(before.rstrip()[-1:] in "#$€£="),
        float(bool(re.search(r"(?i)(?:com|org|net|edu|de|fr|es|io|uk)$", span))),
    ]


@dataclass
class Tree:
    """A regression tree as flat lists; feature -1 marks a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def grow(self, x, grad, hess, rows, depth: int, least: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        here = len(self.value)
        for column, v in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.value, g / (h + 1))):
            column.append(v)
        best = (1e-6, None, None)
        if depth:
            for f in range(x.shape[1]):
                v = x[rows, f]
                for c in np.unique(np.quantile(v, np.linspace(0, 1, 17)[1:-1])):
                    low = v <= c
                    hl = hess[rows][low].sum()
                    if least <= hl <= h - least:
                        gl = grad[rows][low].sum()
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        if gain > best[0]:
                            best = (gain, f, float(c))
        if best[1] is not None:
            low = x[rows, best[1]] <= best[2]
            self.feature[here], self.cut[here] = best[1], best[2]
            self.left[here] = self.grow(x, grad, hess, rows[low], depth - 1, least)
            self.right[here] = self.grow(x, grad, hess, rows[~low], depth - 1, least)
        return here


def stacked(trees: list[Tree]) -> tuple[np.ndarray, ...]:
    """The trees' lists as arrays of one row a tree."""
    size = max((len(t.value) for t in trees), default=0)
    return tuple(
        np.array([[*getattr(t, name), *[0] * (size - len(t.value))] for t in trees]).reshape(len(trees), size)
        for name in ("feature", "cut", "left", "right", "value")
    )


def total(x: np.ndarray, trees: tuple[np.ndarray, ...]) -> np.ndarray:
    """The sum of the trees' values for each row of x: each step moves every row one level down in all trees."""
    feature, cut, left, right, value = trees
    tree, at, rows = np.arange(len(value)), np.zeros((len(x), len(value)), int), np.arange(len(x))[:, None]
    while len(value) and (inner := feature[tree, at] >= 0).any():
        low = x[rows, feature[tree, at]] <= cut[tree, at]
        at = np.where(inner, np.where(low, left[tree, at], right[tree, at]), at)
    return value[tree, at].sum(1)


@dataclass
class Boosted:
    """Gradient-boosted trees for the log-odds of a proposal, and a threshold for each kind."""

    trees: list[Tree] = field(default_factory=list)
    rate: float = 0.3
    thresholds: dict[int, float] = field(default_factory=dict)
    made: tuple | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.made is None:
            self.made = stacked(self.trees)
        return 1 / (1 + np.exp(-np.clip(total(x, self.made) * self.rate, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3) -> Boosted:
        known = np.zeros(len(y))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-known))
            tree = Tree()
            tree.grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, 0.5)
            self.trees.append(tree)
            known += self.rate * total(x, stacked([tree]))
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> Boosted:
        """For each kind the least threshold with at least that precision on held-out examples."""
        scores = self.scores(x)
        for kind in range(len(KINDS)):
            own = x[:, 0] == kind
            fine = [
                t for t in np.arange(0.3, 0.96, 0.05)
                if (m := own & (scores >= t)).any() and y[m].mean() >= precision
            ]
            self.thresholds[kind] = float(min(fine, default=2.0))
        return self


def examples(n: int, seed: int = 7) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, label) generated by rule: personal data and look-alikes."""
    r = random.Random(seed)
    letters = "abcdefghijklmnoprstuvw"

    def word(a=2, b=9):
        return "".join(r.choice(letters) for _ in range(r.randint(a, b)))

    def number(k):
        return "".join(r.choice("0123456789") for _ in range(k))

    def words(k):
        return " ".join(word() for _ in range(k))

    def phone():
        s = r.choice(" -./")
        return r.choice([
            f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}{s}{number(3)}{s}{number(4)}",
            f"0{number(3)}{s}{number(3)}{s}{number(3)}", f"0{number(1)}{s}{number(4)}{s}{number(4)}",
            f"00{r.randint(1, 9)}{number(10)}", f"0{number(2)}{r.choice(' /-')}{number(7)}", f"0{number(3)}{r.choice(' /-')}{number(r.randint(5, 8))}",
            f"(0{number(r.randint(2, 4))}) {number(r.randint(5, 8))}",
        ])

    def hidden_mail():
        a, o = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" AT ", " DOT ")])
        return f"{word()}{r.choice(['', '.' + word(), number(2)])}{a}{word()}{o}{r.choice(['com', 'org', 'net', 'de'])}"

    def luhn_groups():
        while True:
            d = number(16)
            if luhn(d):
                return [d[i : i + 4] for i in range(0, 16, 4)]

    def not_phone():
        return r.choice([
            f"{r.randint(1900, 2099)}-{number(3)}-{number(2)}", f"20{number(2)} {number(3)} {number(3)}",
            f"{number(3)}.{number(3)}.{number(2)}", f"{number(2)} {number(3)} {number(3)}",
            r.choice("-./ ").join(number(4) for _ in range(4)), r.choice("./").join(luhn_groups()), f"00{r.randint(1, 9)}{number(9)}",
        ])

    def not_mail():
        return r.choice([f"{word()} at {word()} dot {word()}", f"{word()} at the dot {word()}", f"look at {word()} dot {word()} dot {word()}"])

    def card():
        return r.choice("./_").join(luhn_groups())

    made = []
    good = ["phone", "tel", "call", "mobile", "contact", "reach me", "fax", "mail", "e-mail", "write to", "card", "visa", "host", ""]
    dials = ["phone", "tel", "call", "mobile", "contact", "reach me", "fax", "my phone is", "call me on", "telephone", "tel no", "my new number", ""]
    bad = ["order", "invoice", "version", "isbn", "article", "serial", "part", "ref", "id", "total", "table", "", ""]
    while len(made) < n:
        label = int(r.random() < 0.5)
        if label:
            kind = r.choice((0, 1, 2, 3, 3))
            span = (hidden_mail, lambda: "[.]".join(str(r.randint(0, 255)) for _ in range(4)), card, phone)[kind]()
            lead = r.choice(good if kind != 3 else dials) if kind != 3 or r.random() < 0.9 else ""
        else:
            kind = r.choice((0, 2, 3, 3, 3))
            span = (not_mail, None, lambda: r.choice("./_").join(number(4) for _ in range(4)), lambda: r.choice((not_phone, not_phone, phone))())[kind]()
            lead = r.choice(bad)
            if kind == 2 and luhn(digits_of(span)):
                continue
        before = f"{words(r.randint(1, 6))} {lead}{r.choice([' ', ': ', ' '])}"
        text = f"{before}{span}{r.choice([' ', '. ', ', '])}{words(3)}"
        made.append((text, kind, len(before), len(before) + len(span), label))
    return made


def trained(n: int = 3000, precision: float = 0.97, seed: int = 7) -> Boosted:
    """The model of n generated examples, of which every third only calibrates."""
    found = examples(n, seed)
    x = np.array([features(*e[:4]) for e in found])
    y = np.array([float(e[4]) for e in found])
    held = np.arange(n) % 3 == 0
    return Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held], precision)


def best_apart(found: list[tuple[float, int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of scored (score, start, kind, end) those that a choice by falling score takes, none
    overlapping another or a taken span; (start, kind, end) in order of start.

    Chosen spans never overlap, so a span's neighbours in a sorted list are all that it is held against.
    """
    starts = [a for a, _, _ in taken]
    spans = [(a, k, b) for a, k, b in taken]
    most = 0  # a taken span may overlap others, as base spans of several kinds do
    ends = [most := max(most, b) for _, _, b in taken]
    own: list[tuple[int, int, int]] = []
    for _, a, k, b in sorted(found, key=lambda x: (-x[0], x[1:])):
        at = bisect_left(starts, b)
        if at and ends[at - 1] > a:
            continue
        at = bisect_left(own, (a,))
        if (at and own[at - 1][2] > a) or (at < len(own) and own[at][0] < b):
            continue
        own.insert(at, (a, k, b))
    return sorted([*spans, *own])


def all_spans(text: str, model: Boosted) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and accepted spans together, each sorted.

    Base spans always stay, so a proposal that overlaps one can't be added, whatever its score.
    """
    base = base_spans(text)
    if not _GATE.search(text):
        return base, base
    proposed = [(kind, m.start(), m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text)]
    if not proposed:
        return base, base
    scores = model.scores(np.array([features(text, *p) for p in proposed]))
    fine = [
        (float(score), a, kind, b)
        for score, (kind, a, b) in zip(scores, proposed, strict=True) if score >= model.thresholds[kind]
    ]
    return base, best_apart(fine, base)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Boosted | None = None, with_text: bool = False
) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (kind:start:end in code points), n_added, and with_text the redacted text.

    A null text counts as empty. Ids may be null or repeat. An empty table gives an
    empty result. Other columns of docs are ignored.
    """
    model = model or trained()
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
    fields += [("redacted", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py()
                base, spans = all_spans(text, model)
                count = [0] * len(KINDS)
                for _, k, _ in base:
                    count[k] += 1
                own = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((doc_id, *count, own, joined(spans), len(spans) - len(base), *([redacted(text, spans)] * with_text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema
            )

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(F.col(text_col)).alias("text"))
    kinds = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return text.mapInArrow(run, kinds + ", redacted string" * with_text)


def op5_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
