"""Classifiers on held-out labels, their edge cases, and the pipeline against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tablewright.llm import labelled, language, quality, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"
LABELS = "doc_id long, quality int, toxic int, text string"
ODD = [(1, None, "en", "x", 0, None, 1), (2, "", None, None, 0, None, None), (2, "", None, None, 0, None, None), (None, "1 2 !", None, None, 0, 0.5, None), (5, "word " * 60000, "en", None, 0, None, None)]


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet").cache() for t in ("documents", "labels"))


def accuracy(rows, labels, name):
    known = {r.doc_id: r[name] for r in labels.collect()}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert len(held) > 80
    return Counter(held)


def check_scores(rows, docs):
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(0 <= r.score <= 1 and r.held_out == (crc(r.doc_id, 3) == 1) for r in rows)


def test_quality_on_held_out_labels(tables):
    docs, labels = tables
    rows = quality.score_quality(docs, labels).collect()
    check_scores(rows, docs)
    found = accuracy(rows, labels, "quality")
    assert (found[0, 0] + found[1, 1]) / sum(found.values()) > 0.95


def test_toxicity_on_held_out_labels(tables):
    docs, labels = tables
    rows = toxicity.score_toxicity(docs, labels).collect()
    check_scores(rows, docs)
    found = accuracy(rows, labels, "toxic")
    assert found[1, 0] <= 1 and found[1, 1] / (found[1, 1] + found[0, 1]) > 0.3  # 50 toxic texts teach three of ten


def plain_toxicity(model, text):
    """The score of a text from its compressed lengths, one window and one sum at a time."""
    codes = []
    for piece in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text.lower()):
        last = b""
        for i in range(0, len(piece), 4):
            last = xxhash.xxh64_digest(last + piece[i : i + 4].encode("utf-8", "surrogatepass"))
            codes.append(last)
    plain, toxic = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic + model.ordinary)
    saved = []
    for i in range(0, len(codes), 24):
        window = b"".join(codes[i : i + 24])
        saved.append(len(plain.compress(window)) - len(toxic.compress(window)))
    x = [0.0] * 7
    if saved:
        sure, hits = [max(0, v - 2) for v in saved], sum(v >= 4 for v in saved)
        x = [
            math.log1p(sum(sure)), 10 * sum(sure) / (len(codes) + 40), math.log1p(max(sure)), math.log1p(hits), hits / len(saved),
            math.log1p(len(codes)), min(5, max(-3, 10 * sum(saved) / (len(codes) + 40))),
        ]
    q = [(v - m) / d for v, m, d in zip(x, model.mean, model.dev, strict=True)]
    terms = [1.0, *q, *[v * v for v in q], q[0] * q[5]]
    return 1 / (1 + math.exp(-min(30, max(-30, sum(t * w for t, w in zip(terms, model.weights, strict=True))))))


def test_toxicity_equals_a_plain_version(tables):
    docs, labels = tables
    model = toxicity.trained(docs, labels, "doc_id", "text", "toxic")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    for r in docs.collect():
        want = plain_toxicity(model, r.text or "")
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (want >= 0.7)


def test_whole_documents_train_while_there_is_room():
    sizes = [(i, i % 2, 100 + i) for i in range(50)] + [(99, 1, 10**9)]
    kept = toxicity.fitting(sizes, {0: 1000, 1: 5000})
    used = {v: sum(n for i, y, n in sizes if y == v and i in kept) for v in (0, 1)}
    assert 800 < used[0] <= 1000 and kept >= {i for i in range(50) if i % 2} and 99 not in kept
    assert toxicity.fitting(sizes[::-1], {0: 1000, 1: 5000}) == kept and toxicity.fitting([], {0: 1}) == set()


def test_language_on_the_held_out_fold(tables):
    docs, _ = tables
    known = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    held = [r.lang_pred == known[r.doc_id] for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows) and np.mean(held) > 0.98


def test_language_distance_equals_a_plain_version():
    texts = {"en": "the cat and the dog " * 5, "fr": "le chat et le chien dans la rue " * 5}

    def plain(text, k=language.RANKS):
        words = re.findall(r"[^\W\d_]+", text.lower())
        own = Counter()
        for w in words:
            p = f"_{w}_"
            own.update(w)
            own.update(p[i : i + 2] for i in range(len(p) - 1))
            own.update(p[i : i + 3] for i in range(len(p) - 2))
        return own

    def named(gram):
        """The n-gram of a number, spelled as plain() does."""
        digits = [gram >> (2 * language.SHIFT), gram >> language.SHIFT & language.EDGE, gram & language.EDGE]
        if digits[0] == language.EDGE:
            digits = digits[1:]
        elif not digits[0] and not digits[1]:
            digits = digits[2:]
        return "".join(chr(d) if d else "_" for d in digits)

    for text in (*texts.values(), "Ðə a\u3042\u4e2d \U00020000x 1 éÉ"):
        assert {named(int(g)): int(n) for g, n in zip(*language.grams(text), strict=True)} == dict(plain(text))
        got = sorted(language.grams(text)[1].tolist())
        assert got == sorted(plain(text).values())
    ranked = {name: [g for g, _ in sorted(zip(*map(np.ndarray.tolist, language.grams(t)), strict=True), key=lambda x: (-x[1], x[0]))] for name, t in texts.items()}
    known = language.Profiles(ranked)
    for text in ("the dog and cat", "le chien", "xyz the le"):
        found, count = language.grams(text)
        own = [int(g) for g, _ in sorted(zip(found, count, strict=True), key=lambda x: (-x[1], x[0]))][: language.RANKS]
        want = [
            sum(abs(i - ranked[name][: len(ranked[name])].index(g)) if g in ranked[name] else language.RANKS for i, g in enumerate(own))
            for name in known.names
        ]
        assert known.distances(np.array(own)).tolist() == want
    assert known.nearest("the dog and cat")[0] == "en" and known.nearest("le chien et la rue")[0] == "fr"
    assert known.nearest(" 12 !")[0] == "und" and known.nearest(texts["en"]) == ("en", 1.0)


def test_one_language_and_many(frame):
    one = frame([(i, "a text of one language", "xx", "s", 0, None, None) for i in range(9)], DOCS)
    assert {(r.lang_pred, r.score) for r in language.identify(one).collect()} == {("xx", 1.0)}
    # more languages than any cap, each with letters of its own
    rows = [(i, f"{chr(0x4E00 + i // 4)}{chr(0x6E00 + i // 4)} " * 5, f"l{i // 4:03}", "s", 0, None, None) for i in range(1000)]
    got = language.identify(frame(rows, DOCS)).collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 4:03}" for r in got) >= 995
    same = frame([(None, "the same text", "en", "s", 0, None, None)] * 50, DOCS)
    assert {r.lang_pred for r in language.identify(same).collect()} == {"en"}


def test_classifiers_on_odd_rows(frame):
    docs, empty = frame(ODD, DOCS), frame([], DOCS)
    labels, none = frame([(2, 1, 0, "x"), (5, 0, 1, None), (None, 1, 1, None), (7, None, None, None)], LABELS), frame([], LABELS)
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert len(score(docs, labels).collect()) == len(score(docs, none).collect()) == len(ODD)
        assert score(empty, labels).collect() == []
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {1.0}
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[None].lang_pred == "und"
    assert language.identify(empty).collect() == []
    assert quality.good_documents(docs, none).columns == docs.columns
    assert quality.good_documents(empty, labels).collect() == []


def test_attention_learns_from_one_bad_passage():
    r = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(300):
        bag = r.normal(0, 1, (r.integers(1, 8), quality.FEATURES)).astype(np.float32)
        if i % 2:
            bag[r.integers(len(bag)), 3] += 6
        bags.append(bag)
        labels.append(1 - i % 2)
    model = quality.fit(bags[:200], labels[:200])
    first = np.cumsum([0, *map(len, bags[200:])])[:-1]
    p = model.forward(np.concatenate(bags[200:]).astype(float), first)[0]
    assert ((p >= 0.5) == np.array(labels[200:])).mean() > 0.9


def test_quality_gradient():
    r = np.random.default_rng(1)
    bags, labels = [r.normal(size=(n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 2)], [1, 0, 1]
    model = quality.fit(bags, labels, steps=1)
    x, first, y = np.concatenate(bags).astype(float), np.array([0, 1, 4]), np.array(labels, float)

    def loss():
        p = model.forward(x, first)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = model.gradient(x, first, y)
    for name in ("W", "V", "U", "a", "c"):
        w = model.w[name]
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_quality_forward_equals_a_plain_version():
    r = np.random.default_rng(2)
    bags = [r.normal(size=(n, quality.FEATURES)).astype(np.float32) for n in (1, 4, 2, 9)]
    model = quality.fit(bags, [1, 0, 1, 0], steps=5)
    w = model.w
    first = np.cumsum([0, *map(len, bags)])[:-1]
    got = model.forward(np.concatenate(bags).astype(float), first)[0]
    for bag, p in zip(bags, got, strict=True):
        coded, strength = [], []
        for x in bag.astype(float):
            h = [math.tanh(sum((x[i] - model.mean[i]) / model.dev[i] * w["W"][i, j] for i in range(len(x))) + w["b"][j]) for j in range(quality.HIDDEN)]
            u = [math.tanh(sum(h[j] * w["V"][j, k] for j in range(len(h)))) for k in range(quality.ATTENTION)]
            g = [1 / (1 + math.exp(-sum(h[j] * w["U"][j, k] for j in range(len(h))))) for k in range(quality.ATTENTION)]
            coded.append(h)
            strength.append(math.exp(sum(u[k] * g[k] * w["a"][k] for k in range(len(u)))))
        mean = [sum(s * h[j] for s, h in zip(strength, coded, strict=True)) / sum(strength) for j in range(quality.HIDDEN)]
        assert p == pytest.approx(1 / (1 + math.exp(-sum(m * c for m, c in zip(mean, w["c"], strict=True)) - w["d"])))


def made_texts(n, seed, share=0.5, words=("vile", "slurry", "scoundrel")):
    """Texts of invented words, toxic ones with some of a few words that others lack."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abdeiklmnorstu") for _ in range(r.randint(3, 8))) for _ in range(300)]
    r, out = random.Random(seed + 100), []
    for _ in range(n):
        label, own = int(r.random() < share), r.choices(vocabulary, k=r.randint(60, 120))
        for _ in range(4 * label):
            own.insert(r.randint(0, len(own)), r.choice(words))
        out.append((" ".join(own), label))
    return out


def test_windows_hold_the_whole_text():
    text = "Some vile, VILER words; and 12345 signs!!! " * 40
    whole = b"".join(toxicity.windows(text))
    pieces = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text.lower())
    assert len(whole) == toxicity.CODE * sum(-(-len(p) // toxicity.STEP) for p in pieces)
    assert toxicity.code("viler")[: toxicity.CODE] == toxicity.code("vile") and toxicity.windows("") == []
    assert len(toxicity.code("x" * 1000000)) == toxicity.CODE * 250000


def test_compressed_lengths_tell_toxic_texts():
    rows = made_texts(600, 1)
    model = toxicity.fit(rows)
    plain, toxic = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic + model.ordinary)
    for text, _ in rows[:5]:
        want = [len(plain.compress(w)) - len(toxic.compress(w)) for w in toxicity.windows(text)]
        assert model.savings(text).tolist() == want, "every window is compressed with both dictionaries"
    # another seed of the texts' order, the same words: the distances alone tell them
    fresh = made_texts(600, 1)[300:] + [(t, 0) for t, v in made_texts(300, 1, share=0)]
    scores = model.score([t for t, _ in fresh])
    right = (scores >= 0.5) == np.array([v for _, v in fresh])
    assert right.mean() > 0.95
    # without what the toxic dictionary holds nothing is told
    blank = toxicity.Model(model.ordinary, b"", model.mean, model.dev, model.weights)
    none = blank.score([t for t, _ in fresh])
    assert none.max() < 0.5


def test_pipeline_stages(spark, tables):
    docs, _ = tables
    names = docs.columns
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == names, name
            ids = [r.doc_id for r in after.select("doc_id").collect()]
            assert set(ids) <= before and ids
            if name == "exact_dedup":
                texts = [re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in after.collect()]
                plain = {re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in docs.collect()}
                assert len(texts) == len(set(texts)) == len(plain)
            if name == "mixing":
                assert max(Counter(ids).values()) <= 3 < len(ids)
            before = set(ids)
        else:
            length = Counter()
            for r in after.collect():
                length[r.sequence_id] += r.length
            assert max(length.values()) <= 1024 and len(length) <= 1.02 * -(-sum(length.values()) // 1024) + 1
        docs = after


def test_run_equals_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, sf)
    rows = [sorted(tuple(r[n] for n in names) for r in df.collect()) for df in (docs, got)]
    assert rows[0] == rows[1] and rows[0]
    mixed = Counter(r[0] for r in rows[0] if not r[1])
    assert 1 <= max(mixed.values()) <= 3


def test_pipeline_stages_with_texts_without_words(spark, frame, tmp_path):
    frame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    blank = [(10 + i, t, "en", s, 0, None, None) for i, (t, s) in enumerate([(None, "x"), ("", "y"), (" \n\t", "x"), (None, None)])]
    docs = frame([(1, "one two three " * 30, "en", "x", 0, None, None), (2, "four five six " * 30, "en", "y", 0, None, None), *blank], DOCS)
    mixed = corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} == {1, 2}
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} == {1, 2}


def test_sampled_labels_stand_for_all(frame):
    labels = frame([(i, int(i % 4 == 0), 0, None) for i in range(600)], LABELS)
    docs = frame([(i, "a", "en", "x", 0, None, None) for i in range(600)], DOCS)
    found, weights = labelled.sample(docs, labels, "quality", {1: 1000, 0: 50})
    n = Counter(r.label for r in found.collect())
    known = Counter(int(i % 4 == 0) for i in range(600) if crc(i, 3) != 1)
    assert n == {1: known[1], 0: 50} and {v: n[v] * weights[v] for v in n} == pytest.approx(dict(known))


def test_scores_keep_the_shares_of_the_labels():
    y = np.array([1] * 1200 + [0] * 200)
    told = np.array([i % 10 < (7 if v else 3) for i, v in enumerate(y)])
    bags = [np.full((1, quality.FEATURES), t, np.float32) for t in told]
    few = [i for i in range(1400) if i >= 1200 or i // 10 % 6 == 0]
    x, first = np.concatenate(bags).astype(float), np.arange(1400)
    weighted = quality.fit([bags[i] for i in few], y[few].tolist(), weights={1: 6.0, 0: 1.0}).forward(x, first)[0]
    assert weighted.mean() == pytest.approx(y.mean(), abs=0.02)
