"""Markdown reports. Aggregates are DataFrames; only bounded rows are rendered."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from . import profiling
from .evaluation import S, T

# The names under which reports are served.
REPORTS = ("data_profile", "validation_report", "error_analysis", "methodology", "readme")


def _table(df: DataFrame, limit: int = 100) -> list[str]:
    rows = df.limit(limit).collect()
    text = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(text, r)) + " |" for r in rows), ""]


def validation_report(version: str, scores: DataFrame, sweep: DataFrame, recall: DataFrame, importances: list[tuple[str, float]], threshold: float) -> str:
    lines = [f"# Validation report {version}", "", f"Chosen threshold: {threshold:.2f}", "", "## Scores", "", *_table(scores), "## Candidate recall", "", *_table(recall)]
    lines += ["## Thresholds", "", *_table(sweep.orderBy("threshold")), "## Feature importances", ""]
    return "\n".join(lines + [f"{i}. {name}: {value:.4f}" for i, (name, value) in enumerate(importances, 1)]) + "\n"


def error_report(errors: DataFrame, records: DataFrame, n: int = 5) -> str:
    """Numbers of false positives and negatives, and the first n of each by id with both records."""
    shown = records.select("entity_id", "business_name", "business_address", "country")
    left = shown.toDF(S, "name", "address", "country")
    right = shown.toDF(T, "candidate_name", "candidate_address", "candidate_country")
    lines = ["# Error analysis", "", *_table(errors.groupBy("error", "blocked").count().orderBy("error", "blocked"))]
    for kind in ("FP", "FN"):
        first = errors.filter(errors["error"] == kind).orderBy(S, T).limit(n)
        lines += [f"## First {kind}", "", *_table(first.join(left, S, "left").join(right, T, "left").orderBy(S, T))]
    return "\n".join(lines)


def profile_report(tables: dict[str, DataFrame], truth: DataFrame) -> str:
    first = next(iter(tables.values()))
    parts = {
        "Rows and duplicates": profiling.duplicates(tables), "Matches per record": profiling.cardinality(truth), "Matches by source": profiling.source_split(truth).orderBy("source"),
        "Countries of the first table": profiling.countries(first), "Missing values": profiling.missing(tables), "Lengths": profiling.lengths(tables),
    }
    return "\n".join(["# Data profile", ""] + [x for title, df in parts.items() for x in (f"## {title}", "", *_table(df))])


def fetch_report(folder: str, name: str) -> str | None:
    """A stored report by its name in any case; None for a name that is not served or not there."""
    name = name.lower()
    path = Path(folder) / f"{name}.md"
    return path.read_text() if name in REPORTS and path.is_file() else None
