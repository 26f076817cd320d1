"""Licence scan by a positional rare-token index, in native expressions only.

Each template is a list of key phrases. One pass over the corpus writes the
positional index: per file the number of words and the postings (term,
position) of the words that templates hold. The index gives in how many
documents every template word occurs; the counts (one row per template word, a
constant number) give inverse document frequencies. Per phrase the words of
highest IDF are its look-up words. Files that hold them all get each word's
offset in the phrase subtracted from its positions, the lists are intersected
from the rarest word on, and the phrase's other words verify what is left.
Everything happens within one row: no shuffle, no join on documents, and no
group can become hot.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows give repeated results, and a null id is like any other; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, lower_ascii_safe, written


@dataclass(frozen=True)
class Template:
    """A label and the key phrases of which each is mandatory."""

    label: str
    phrases: tuple[str, ...]
    base: bool = False


#: The base phrases and their labels.
BASE = (
    Template("mit", ("mit license",), True),
    Template("apache", ("apache license",), True),
    Template("gpl", ("general public license",), True),
)

#: Labels of the method's own, by words that the public licence texts hold.
FAMILIES = (
    Template("apache-2.0", ("apache license version 2 0",)),
    Template("gpl-2.0", ("general public license version 2",)),
    Template("gpl-3.0", ("general public license version 3",)),
    Template("lgpl", ("lesser general public license",)),
    Template("agpl", ("affero general public license",)),
    Template("mpl", ("mozilla public license",)),
    Template("cc-by", ("cc by",)),
    Template("cc-by-nc", ("cc by nc",)),
    Template("cc-by-sa", ("cc by sa",)),
    Template("cc0", ("cc0 1 0 universal",)),
    Template("mit-text", ("permission is hereby granted free of charge to any person obtaining a copy", "the software is provided as is without warranty of any kind")),
    Template("bsd-text", ("redistribution and use in source and binary forms", "this software is provided by the copyright holders")),
    Template("isc-text", ("permission to use copy modify and or distribute this software for any purpose",)),
    Template("unlicense", ("free and unencumbered software released into the public domain",)),
)

TEMPLATES = BASE + FAMILIES


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii_safe(text), WORD_GAP), "")


def template_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for t in templates for p in t.phrases for w in p.split()})


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words and postings ``hits`` (c: number of the template word, i: position from 0), as a written table."""
    vocabulary = template_words(templates)
    # ``isin`` is a hash look-up; only the few words that pass get their number.
    code = lambda w: (F.array_position(F.array(*(F.lit(v) for v in vocabulary)), w) - 1).cast("int")
    numbered = lambda w, i: F.when(w.isin(vocabulary), F.struct(code(w).alias("c"), i.alias("i")))
    words = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    return written(words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_compact(F.transform("w", numbered)).alias("hits")), "licence-index")


def document_frequencies(index: DataFrame, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of documents, and of documents with each template word.

    The result has one row per template word, whatever the corpus holds.
    """
    vocabulary = template_words(templates)
    rows = index.select(F.explode(F.array_append(F.array_distinct("hits.c"), -1)).alias("c")).groupBy("c").count().collect()
    df = {r["c"]: r["count"] for r in rows}
    return df.get(-1, 0), {w: df.get(c, 0) for c, w in enumerate(vocabulary)}


def idf(n_docs: int, df: dict[str, int]) -> dict[str, float]:
    return {w: math.log((1 + n_docs) / (1 + d)) + 1 for w, d in df.items()}


def look_up_words(phrase: str, weights: dict[str, float], most: int = 3) -> list[tuple[str, int]]:
    """Rarest words of a phrase with their offsets, rarest first."""
    return sorted(((w, i) for i, w in enumerate(phrase.split())), key=lambda x: (-weights[x[0]], x[1]))[:most]


def _starts(places: list[tuple[int, int]], first: str = "") -> str:
    """SQL for the starts that all words (number, offset in the phrase) agree on, and that the array ``first`` holds if it is given."""
    lists = [first] * bool(first) + [f"transform(filter(hits, h -> h.c = {c}), h -> h.i - {o})" for c, o in places]
    return reduce(lambda a, b: f"array_intersect({a}, {b})", lists)


def _quoted(label: str) -> str:
    return label.replace("\\", "\\\\").replace("'", "\\'")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 for a verified template, else half the largest share of
    look-up weight among templates whose rarest words align, else 0.
    """
    index = positional_index(docs, id_col, text_col, templates)
    weights = idf(*document_frequencies(index, templates))
    number = {w: c for c, w in enumerate(template_words(templates))}
    plans = [(t, p, look_up_words(p, weights)) for t in templates for p in t.phrases]

    none = "cast(array() as array<int>)"
    aligned, verified, names = [], [], {}
    for k, (t, p, rare) in enumerate(plans):
        holds = " and ".join(f"array_contains(_terms, {number[w]})" for w, _ in rare)
        starts = _starts([(number[w], o) for w, o in rare])
        aligned.append(f"case when {holds} then filter({starts}, s -> s >= 0) else {none} end _a{k}")
        others = [(number[w], o) for o, w in enumerate(p.split()) if (w, o) not in rare]
        verified.append(f"case when size(_a{k}) > 0 then {_starts(others, f'_a{k}')} else {none} end _v{k}")
        names.setdefault(t, []).append(k)
    out = index.select("doc_id", "n_words", "hits", F.array_distinct("hits.c").alias("_terms"))
    out = out.selectExpr("doc_id", "n_words", "hits", *aligned)
    out = out.selectExpr("doc_id", "n_words", *(f"_a{k}" for k in range(len(plans))), *verified)

    def full(t: Template) -> str:
        return "(" + " and ".join(f"size(_v{k}) > 0" for k in names[t]) + ")"

    def labels(chosen) -> str:
        found = ", ".join(f"case when {full(t)} then '{_quoted(t.label)}' end" for t in chosen)
        return f"array_join(array_sort(array_distinct(array_compact(array({found})))), ',')" if found else "''"

    base = [t for t in templates if t.base]
    places = f"flatten(array({', '.join(f'_v{k}' for t in base for k in names[t])}))" if base else none
    shares = [(k, sum(weights[w] for w, _ in rare) / sum(weights[w] for w in p.split())) for k, (_, p, rare) in enumerate(plans)]
    share = ", ".join(f"case when size(_a{k}) > 0 then {x!r}D else 0D end" for k, x in shares)
    return out.selectExpr(
        "doc_id", "n_words", f"cast(size({places}) as long) n_base", f"cast(array_min({places}) as long) first_word", f"cast(array_max({places}) as long) last_word",
        f"{labels(base)} base_labels", f"{labels(templates)} labels", f"case when {' or '.join(map(full, names)) or 'false'} then 1D else 0.5D * greatest(0D, 0D, {share or '0D'}) end score",
    )
