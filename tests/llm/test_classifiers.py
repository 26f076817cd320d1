"""The two classifiers against plain versions over the whole corpus, without Spark."""

import math
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from kindred.llm import quality, toxicity

from .test_texts import labelled_corpus


def training_rows(docs, labels, column, parts, held):
    """Text and label by id, of the training fold; the smallest text and the largest label of an id."""
    y = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r[column] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts != held:
            y[r["doc_id"]] = max(r[column], y.get(r["doc_id"], 0))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    return [(texts[i], y[i]) for i in sorted(y) if i in texts]


def plain_features(text):
    words = (text or "").split()
    if not words:
        return [0.0] * 16
    text, n, lines = text, len(words), text.split("\n")
    pairs = [(words[i], words[i + 1]) for i in range(n - 1)]
    odd = [c for c in text if c in string.punctuation and c not in ".,;:'\"()-?!|"]
    letters = [c for c in text if c.isalpha()]
    return [
        sum(c.isupper() for c in letters) / len(letters), len(letters) / len(text), sum(c in string.digits for c in text) / len(text), len(odd) / n, text.count("!") / n, text.count("|") / n,
        sum(a == b for a, b in pairs) / n, len(set(words)) / n, len(set(pairs)) / n, sum(map(len, words)) / n / 20, max(map(len, words)) / 100, (text.count(".") + text.count(",")) / n,
        len(lines) / n, len(set(lines)) / len(lines), math.log(1 + n) / 15, text.count("?") / n,
    ]


def test_quality_equals_a_plain_fit(spark):
    docs, labels = labelled_corpus(spark)
    rows = training_rows(docs, labels, "quality", 5, 0)
    x, y = np.array([plain_features(t) for t, _ in rows]), np.array([v for _, v in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    cuts = [np.quantile(x, q, axis=0) for q in (0.2, 0.4, 0.6, 0.8, 0.01, 0.05, 0.95, 0.99)]

    def wide(f):
        return np.concatenate([np.clip((f - mean) / scale, -6, 6), *[(f > c).astype(float) for c in cuts]])

    z = np.array([wide(f) for f in x])
    rng = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, quality.PAIRS)] - z[rng.choice(bad, quality.PAIRS)]
    w = np.zeros(d.shape[1])
    for _ in range(40):  # Newton on the mean logistic loss of the preferences
        lose = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve(d.T @ (d * (lose * (1 - lose))[:, None]) / len(d) + 1e-3 * np.eye(len(w)), 1e-3 * w - d.T @ lose / len(d))
        w -= step
        if abs(step).max() < 1e-6:
            break
    want = {r["doc_id"]: wide(np.array(plain_features(r["text"]))) @ w for r in docs.collect()}
    got = quality.quality_scores(docs, labels).collect()
    assert {r["doc_id"]: r["strength"] for r in got} == pytest.approx(want, rel=1e-7, abs=1e-7)
    # The threshold has the best balanced accuracy that any strength gives, and scores follow the strength.
    own = [(w @ wide(f), v) for f, v in zip(x, y, strict=True)]
    gain = lambda at: sum(s >= at for s, v in own if v) / len(good) + sum(s < at for s, v in own if not v) / len(bad)
    least = min(r["strength"] for r in got if r["predicted"])
    assert max(r["strength"] for r in got if not r["predicted"]) < least and gain(least) == pytest.approx(max(gain(s) for s, _ in own))
    order = sorted(got, key=lambda r: r["strength"])
    assert all(a["score"] <= b["score"] for a, b in zip(order, order[1:], strict=False))


def plain_grams(text):
    text = f" {(text or '').lower()} "
    return {text[i : i + n] for n in (4, 5, 6) for i in range(len(text) - n + 1)}


@pytest.mark.parametrize("most", [40, None])
def test_toxicity_equals_a_plain_fit(spark, most):
    docs, labels = labelled_corpus(spark)
    docs = docs.filter("length(coalesce(text, '')) < 10000")
    rows = training_rows(docs, labels, "toxic", 4, 2)
    have, y = [plain_grams(t) for t, _ in rows], np.array([v for _, v in rows], dtype=float)
    p, q = Counter(), Counter()
    for g, v in zip(have, y, strict=True):
        (p if v else q).update(g)
    n, m = int(y.sum()), int(len(y) - y.sum())

    def z(g):
        share = (p[g] + q[g]) / (n + m)
        return abs((p[g] / n - q[g] / m) / math.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-12))

    chosen = sorted((g for g in p.keys() | q.keys() if p[g] + q[g] >= 5 and z(g) > 4), key=lambda g: (-z(g), g))[:most]
    ratio = np.array([math.log((p[g] + 1) / (n + 2)) - math.log((q[g] + 1) / (m + 2)) for g in chosen])
    x = np.array([[g in h for g in chosen] for h in have]) * ratio
    w, b, step = np.zeros(len(chosen)), 0.0, 4 / ((x**2).sum(axis=1).max() + 2)
    vw, vb = w.copy(), b
    for k in range(300):  # Nesterov's steps on the logistic loss, towards equal weights
        e = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - y
        nw, nb = vw - step * (x.T @ e / len(y) + 1e-3 * (vw - 1 / len(chosen))), vb - step * 50 * e.mean()
        vw, vb, w, b = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b), nw, nb
    want = {r["doc_id"]: 1 / (1 + math.exp(-(b + sum(a * c for g, a, c in zip(chosen, w, ratio, strict=True) if g in plain_grams(r["text"]))))) for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels, most=most).collect()}
    assert got == pytest.approx(want, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize(("run", "column"), [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_labels_of_one_class(spark, run, column):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(40)], "doc_id long, text string, key string")
    for v in (0, 1):
        labels = spark.createDataFrame([(i, v) for i in range(40)], f"doc_id long, {column} int")
        parts, held = (5, 0) if column == "quality" else (4, 2)
        n = sum(zlib.crc32(str(i).encode()) % parts != held for i in range(40))
        rows = run(docs, labels).collect()
        assert {round(r["score"], 9) for r in rows} == {round((n * v + 1) / (n + 2), 9)} and {r["predicted"] for r in rows} == {v}
    none = {r["score"] for r in run(docs, labels.limit(0)).collect()}
    assert none == ({0.5} if column == "quality" else {0.0})
