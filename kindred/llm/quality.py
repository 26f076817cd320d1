"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features. Preference pairs
(a labelled good document is preferred to a labelled bad one) give a logistic
loss on the difference of their features, so no intercept is learnt and the
classes need no balancing. Features are shares and ratios over the whole text
(capitals, symbols, separators, repetition, word shape), each with some
indicator steps at quantiles of the fitting sample.

Fitting uses at most ``sample`` labelled rows, the first in the order of a
hash of their id, and ``pairs`` preference pairs drawn from them with a fixed
seed (parameters, by default ``SAMPLE`` and ``PAIRS``). The threshold covers all data: strengths of all documents give
a grid of score quantiles, all labelled training rows are counted between
them, and the quantile with the best balanced accuracy becomes the threshold.
Scores are the logistic of the strength, shifted so that the threshold has the
score ``CUT``.

Defined results: a null or empty text has all-zero features and a score like
any other; a label row that is null, or whose document is missing, is ignored;
of labels that repeat an id the largest counts, of documents that repeat one
the fit takes that of the smallest features; equal texts have equal scores,
whatever their ids; extra columns are not read, whatever their names; with
labels of one class only every score is that class's smoothed share, (good +
1) / (labels + 2), which without any label is 0.5; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, text_key, utf8, without, written

SAMPLE = 20_000
PAIRS = 60_000
CUT = 0.3
STEPS = 4
GRID = 2000

_ASCII_UPPER, _ASCII_LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_SYMBOLS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?!|")


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def features(text: str | None) -> list[float]:
    """Shares and ratios of a whole text; all zero for a text without words."""
    text = text or ""
    raw = utf8(text)
    words = raw.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * 16
    distinct = set(words)
    upper = sum(map(str.isupper, text)) if not raw.isascii() else len(raw) - len(raw.translate(None, _ASCII_UPPER))
    letters = sum(map(str.isalpha, text)) if not raw.isascii() else len(raw) - len(raw.translate(None, _ASCII_UPPER + _ASCII_LOWER))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = raw.split(b"\n")
    pairs = set(zip(words, words[1:], strict=False))
    return [
        _share(upper, letters),
        _share(letters, chars),
        _share(digits, chars),
        _share(symbols, n),
        _share(raw.count(b"!"), n),
        _share(raw.count(b"|"), n),
        _share(repeats, n),
        _share(len(distinct), n),
        _share(len(pairs), n),
        sum(map(len, words)) / n / 20,
        max(map(len, distinct)) / 100,
        _share(raw.count(b".") + raw.count(b","), n),
        _share(len(lines), n),
        _share(len(set(lines)), len(lines)),
        np.log1p(n) / 15,
        _share(raw.count(b"?"), n),
    ]


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(parts))


class Ranker:
    """Feature steps and their Bradley-Terry weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> None:
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(16), np.ones(16))
        qs = np.linspace(0, 1, STEPS + 2)[1:-1]
        tails = np.concatenate((qs, [0.01, 0.05, 0.95, 0.99]))
        self.cuts = np.quantile(x, tails, axis=0) if len(x) else np.zeros((len(tails), 16))
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.share, self.both = (len(good) + 1) / (len(y) + 2), len(good) > 0 and len(bad) > 0
        self.weights = np.zeros(16 * (1 + len(tails)))
        if self.both:
            rng = np.random.default_rng(seed)
            z = self.expand(x)
            self._fit(z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)])

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and their indicator steps."""
        steps = [(x > c).astype(np.float64) for c in self.cuts]
        return np.hstack([np.clip((x - self.mean) / self.scale, -6, 6), *steps])

    def _fit(self, d: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> None:
        """Newton's method for the mean of log(1 + exp(-w.d)) with a ridge."""
        w = self.weights
        for _ in range(rounds):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = -(d.T @ p) / len(d) + ridge * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights


def labelled(labels: DataFrame, column: str, parts: int, held: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id and y (0 or 1) of the training fold, one row per document."""
    ok = labels.filter(F.col(column).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col), parts) != held))
    return ok.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))


def bounded_sample(train: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, the first by a hash of the id."""
    return train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, train: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, pairs: int = PAIRS) -> Ranker:
    chosen = written(bounded_sample(train, sample), "quality-sample")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [features(t) for t in pdf["text"]]})

    # The sample has at most ``sample`` rows of 12 bytes, hence the broadcast.
    rows = map_pandas(plain.join(F.broadcast(chosen), "doc_id"), run, "doc_id long, y int, x array<double>")
    # One row per id before anything reaches the driver: an id may repeat without bound.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.y", "r.x").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, 16)
    return Ranker(x, rows["y"].to_numpy(np.int64), pairs)


def strengths(docs: DataFrame, ranker: Ranker, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([features(t) for t in pdf["text"]], dtype=np.float64).reshape(-1, 16)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "key": pdf["key"], "strength": ranker.strength(x)})

    text = F.col(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    return map_pandas(plain, run, "doc_id long, key binary, strength double")


def threshold(scored: DataFrame, train: DataFrame, grid: int = GRID) -> float:
    """The score quantile over all documents that best separates the labels."""
    points = [i / grid for i in range(grid + 1)]
    cuts = sorted(set(scored.agg(F.percentile_approx("strength", points, 20_000)).first()[0] or [0.0]))
    # train holds one small row per labelled document and is joined by id.
    at = F.when(F.col("strength") < cuts[0], 0).otherwise(F.array_size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col("strength"))))
    rows = scored.join(train, "doc_id").select(at.alias("k"), "y").groupBy("k", "y").count().collect()
    counts = np.zeros((len(cuts) + 1, 2))
    for r in rows:
        counts[r["k"], r["y"]] += r["count"]
    total = np.maximum(counts.sum(axis=0), 1)
    below = np.cumsum(counts, axis=0)  # below[k]: labelled rows with strength < cuts[k]
    gain = below[:-1, 0] / total[0] + (total[1] - below[:-1, 1]) / total[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", parts: int = 5, held: int = 0, cut: float = CUT, sample: int = SAMPLE, pairs: int = PAIRS) -> DataFrame:
    """doc_id, held_out, score, predicted, strength and key (of the text): one row per document."""
    train = written(labelled(labels, label_col, parts, held), "quality-labels")
    ranker = fit(docs, train, id_col, text_col, sample, pairs)
    scored = written(strengths(docs, ranker, id_col, text_col), "quality-strengths")
    if ranker.both:
        at = threshold(scored, train)
        shifted = F.col("strength") - F.lit(at) + F.lit(float(np.log(cut / (1 - cut))))
        score = F.when(F.col("strength") >= at, F.greatest(F.lit(cut), 1 / (1 + F.exp(-shifted)))).otherwise(F.least(F.lit(float(np.nextafter(cut, 0))), 1 / (1 + F.exp(-shifted))))
    else:
        score = F.lit(float(ranker.share))
    held_out = F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), F.when(score >= cut, 1).otherwise(0).alias("predicted"), "strength", "key")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier accepts, with all columns."""
    bad = quality_scores(docs, labels, **options).filter("predicted = 0").select("doc_id", "key")
    return without(docs, bad, options.get("id_col", "doc_id"), options.get("text_col", "text"))
