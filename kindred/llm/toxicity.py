"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

Features are the character n-grams of a lower-cased text, present or not. From
labelled training rows each n-gram gets the log-count ratio of naive Bayes,
log((p + a) / |p|) - log((q + a) / |q|), with its document counts p and q in
the two classes. N-grams whose counts differ significantly between the classes
become the features of a logistic regression; their values are the ratios, so
a weight near 1 is the naive Bayes answer and training moves it from there.

Fitting uses at most ``sample`` labelled rows, the first in the order of a
hash of their id. Counts stay distributed: each task counts its own rows and
the sums meet by n-gram. The regression takes the n-grams of a z value of at
least ``least_z`` that ``least_docs`` rows of the sample hold, the ``most``
most significant ones (parameters of the fit). Scoring runs an Aho-Corasick automaton of the
features over whole texts.

Defined results: a null or empty text has no feature and the score of the
intercept; null labels, and labels without a document, are ignored; of labels
that repeat an id the largest counts, of documents that repeat one the fit
takes the smallest text; repeated rows and null ids are scored like any other;
extra columns are not read, whatever their names; with labels of one class
only every score is that class's smoothed share, (toxic + 1) / (labels + 2),
and without any label it is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, written
from .quality import bounded_sample, fold, labelled

SAMPLE = 20_000
SIZES = (4, 5, 6)
FEATURES = 3000
MIN_DOCS = 5
LEAST_Z = 4.0
CUT = 0.3
#: Tasks that count the n-grams of the sample, at most.
_TASKS = 96
_ALPHA = 1.0


def grams(text: str | None, sizes: tuple[int, ...] = SIZES) -> set[str]:
    """The distinct n-grams of the lower-cased text between two spaces."""
    text = f" {(text or '').lower()} "
    return {text[i : i + n] for n in sizes for i in range(len(text) - n + 1)}


def gram_counts(sample: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """gram, p, q: documents of either class with the n-gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # Counted in pieces: what a task holds stays bounded, sums meet by gram.
            for a in range(0, len(pdf), 200):
                counts: tuple[Counter, Counter] = (Counter(), Counter())
                part = pdf.iloc[a : a + 200]
                for text, y in zip(part["text"], part["y"], strict=True):
                    counts[y].update(grams(text, sizes))
                keys = list(counts[0].keys() | counts[1].keys())
                yield pd.DataFrame({"gram": keys, "p": [counts[1][k] for k in keys], "q": [counts[0][k] for k in keys]})

    found = map_pandas(sample.select("text", "y"), run, "gram string, p long, q long")
    return found.groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def chosen_grams(counts: DataFrame, positives: int, negatives: int, most: int | None = FEATURES, least_docs: int = MIN_DOCS, least_z: float = LEAST_Z) -> list[tuple[str, float]]:
    """The n-grams whose shares differ most, by the z value of two proportions, with their ratios."""
    n, m = max(1, positives), max(1, negatives)
    share = (F.col("p") + F.col("q")) / F.lit(float(n + m))
    z = (F.col("p") / F.lit(float(n)) - F.col("q") / F.lit(float(m))) / F.sqrt(share * (1 - share) * F.lit(1 / n + 1 / m) + F.lit(1e-12))
    best = counts.filter((F.col("p") + F.col("q")) >= least_docs).select("gram", "p", "q", F.abs(z).alias("z")).filter(F.col("z") > least_z).orderBy(F.desc("z"), "gram")
    rows = (best if most is None else best.limit(most)).collect()
    return [(r["gram"], math.log((r["p"] + _ALPHA) / (n + 2 * _ALPHA)) - math.log((r["q"] + _ALPHA) / (m + 2 * _ALPHA))) for r in rows]


class Scanner:
    """Finds which features a text has."""

    def __init__(self, features: list[str]) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for i, g in enumerate(features):
            self.machine.add_word(g, i)
        if features:
            self.machine.make_automaton()
        self.empty = not features

    def present(self, text: str | None) -> list[int]:
        if self.empty:
            return []
        return sorted({i for _, i in self.machine.iter(f" {(text or '').lower()} ")})


def _regression(owner: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence, by accelerated gradient steps.

    ``owner`` and ``col`` are row and feature of each entry that is present.
    """
    value = ratio[col]
    norm = np.bincount(owner, value**2, minlength=len(y)).max() + 1 if len(y) else 1.0
    w, b = np.zeros(len(ratio)), 0.0
    vw, vb = w.copy(), b
    step = 4 / (norm + 1)
    for k in range(rounds):
        z = np.bincount(owner, value * vw[col], minlength=len(y)) + vb
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(col, value * e[owner], minlength=len(ratio)) / len(y) + ridge * (vw - 1 / max(1, len(ratio)))
        nw, nb = vw - step * gw, vb - step * 50 * e.mean()
        t = k / (k + 3)
        vw, vb, w, b = nw + t * (nw - w), nb + t * (nb - b), nw, nb
    return w, b


def fit(docs: DataFrame, train: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, **choice) -> tuple[list[str], np.ndarray, float]:
    """Features, their weights (times ratio) and the intercept."""
    chosen = written(bounded_sample(train, sample), "toxicity-sample")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The sample has at most ``sample`` rows of 12 bytes, hence the broadcast. Of rows that repeat an id one is taken;
    # equal ones collapse before the shuffle. A fixed number of files keeps the tasks that count many and small.
    rows = plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = written(rows.repartition(max(1, min(_TASKS, chosen.count() // 200)), "doc_id"), "toxicity-rows")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return [], np.zeros(0), math.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)) if sizes else -np.inf
    found = chosen_grams(gram_counts(rows), sizes[1], sizes[0], **choice)
    features, ratio = [g for g, _ in found], np.array([r for _, r in found])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(features)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [np.array(scanner.present(t), dtype="<i4").tobytes() for t in pdf["text"]]})

    table = map_pandas(rows, run, "doc_id long, y int, x binary").toPandas().sort_values("doc_id", kind="stable")
    col = np.frombuffer(b"".join(table["x"]), dtype="<i4")
    owner = np.repeat(np.arange(len(table), dtype=np.int32), [len(x) // 4 for x in table["x"]])
    w, b = _regression(owner, col, table["y"].to_numpy(np.float64), ratio)
    return features, w * ratio, b


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", parts: int = 4, held: int = 2, cut: float = CUT, sample: int = SAMPLE, most: int | None = FEATURES, least_docs: int = MIN_DOCS, least_z: float = LEAST_Z) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    train = written(labelled(labels, label_col, parts, held), "toxicity-labels")
    features, weights, intercept = fit(docs, train, id_col, text_col, sample, most=most, least_docs=least_docs, least_z=least_z)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(features)
        for pdf in batches:
            z = np.array([weights[scanner.present(t)].sum() + intercept for t in pdf["text"]], dtype=np.float64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": np.where(np.isneginf(z), 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = map_pandas(plain, run, "doc_id long, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
