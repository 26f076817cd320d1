"""The whole experiment as separate steps: train on a split, tune, predict, check, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import DEFAULT, Config
from ..functions.text import normalized
from ..operators.blocking import STRATEGIES, S, T, candidates
from ..sources import records
from . import evaluation as E
from . import model as M
from . import validation
from .boosting import Trees
from .features import FEATURES, pairwise_features


@dataclass
class Trained:
    model: Trees
    threshold: float
    sweep: DataFrame
    scores: DataFrame
    recall: DataFrame


def train(s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame, config: Config = DEFAULT, strategies=STRATEGIES, threshold: float | None = None, **override) -> Trained:
    """Blocks train and validation records apart, fits, and tunes the threshold unless one is given."""
    s1, targets = normalized(s1).persist(), normalized(s2.unionByName(s3)).persist()
    split = E.entity_split(s1, config.val_split_ratio, config.random_seed).persist()
    fit, check = E.only(s1, split.filter("not is_validation")), E.only(s1, split.filter("is_validation"))
    held = truth.join(check.select(check["entity_id"].alias(S)), S, "left_semi")
    known = E.label_pairs(candidates(fit, targets, config.blocking, strategies), truth)
    drawn = E.random_negatives(fit, targets, truth).join(known.select(S, T), [S, T], "left_anti")
    features = pairwise_features(known.unionByName(drawn), fit, targets, keep=("label",)).persist()
    fitted = M.train(features, config.model, **override)
    found = candidates(check, targets, config.blocking, strategies).persist()
    scored = M.score(fitted, pairwise_features(found, check, targets)).select(S, T, "match_probability").persist()
    sweep = E.threshold_sweep(scored, held, config.threshold_grid)
    chosen = E.choose_threshold(sweep, config.default_threshold) if threshold is None else threshold
    scores = E.macro_scores(scored.filter(scored["match_probability"] >= chosen), held)
    return Trained(fitted, chosen, sweep, scores, E.blocking_recall(found, held))


def predict(model: Trees | None, threshold: float, s1: DataFrame, s2: DataFrame, s3: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(matching results, candidate pairs) of test tables; both static in schema, empty input included."""
    n1, targets = normalized(s1).persist(), normalized(s2.unionByName(s3)).persist()
    found = candidates(n1, targets, config.blocking).persist()
    scored = M.score(model, pairwise_features(found, n1, targets)).select(S, T, "match_probability")
    return records.matching_results(E.predictions(scored, n1, threshold), n1), records.candidate_pairs(found)


def check(results: DataFrame, pairs: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    return validation.violations(results, pairs, s1, s2.unionByName(s3))


def metadata(version: str, day: int, kind: str, trained: Trained, change: str, passed: bool) -> dict:
    s, r = trained.scores.first(), trained.recall.first()
    return {
        "version": version, "day": day, "model_type": kind, "best_threshold": trained.threshold, "val_f05": s["macro_f05"], "val_precision": s["macro_precision"],
        "val_recall": s["macro_recall"], "candidate_recall": r["recall"], "features_count": len(FEATURES), "change_desc": change, "validator_passed": passed,
        "decision": "Accepted" if s["macro_f05"] > 0.70 else "Iterate",
    }
