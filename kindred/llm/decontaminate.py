"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in segments of some megabytes. A segment is one row: the
sorted terms, for each term the ascending global word positions at which it
occurs (its posting list), and the document borders. Segments are built by the
tasks that read the documents and stored as a table in the shared folder, so
no text and no posting is shuffled and a hot source or a common word only
makes longer lists.

A look-up takes the benchmark in blocks of bounded size. For each window of
consecutive item words it starts from the term that is rarest in the corpus
(term counts over all segments), shifts posting lists by the term's offset in
the window and intersects them in order of rarity. Exact matches need all
terms at their offsets within one document; proximity matches need them
within a span.

Defined results: a null or empty text has no words and is clean; an item
without words never occurs; an item of fewer words than the window is one
window; an item with a null id hits words, but no item is named for it; rows
that repeat an id (of documents or items) and null ids are looked up row by
row; extra columns are not read, whatever their names; empty tables give an
empty result or clean documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, map_pandas, sub_batches, text_sizes, utf8, without, written

WINDOW = 10
#: Benchmark words of one look-up block. It bounds what goes to each task.
BLOCK_WORDS = 500_000

SEGMENT_SCHEMA = "segment string, ids array<long>, keys array<binary>, starts array<long>, terms binary, term_ends array<int>, positions binary"


def _segment(ids: list, texts: list) -> dict:
    """Positional postings of some documents.

    A document's words take consecutive global positions, and one position
    stays empty after each document, so that no run of words spans two.
    """
    vocabulary: dict[bytes, int] = {}
    put = vocabulary.setdefault
    codes: list[int] = []
    starts = [0]
    for text in texts:
        codes += [put(w, len(vocabulary)) for w in alnum_words(text)]
        codes.append(-1)
        starts.append(len(codes))
    flat = np.array(codes, dtype=np.int32)
    order = np.argsort(flat, kind="stable").astype(np.int32)
    order = order[len(texts):]  # without the gaps, which have code -1
    terms = list(vocabulary)
    counts = np.bincount(flat[flat >= 0], minlength=len(terms))
    return {
        "segment": uuid.uuid4().hex,
        "ids": ids,
        "keys": [hashlib.md5(utf8(t)).digest() for t in texts],
        "starts": starts,
        "terms": b" ".join(terms),
        "term_ends": np.cumsum(counts).astype(np.int32),
        "positions": order.astype("<i4").tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20) -> DataFrame:
    """The index as a table of segments, one row each (``SEGMENT_SCHEMA``)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sub_batches(batches, text_sizes, segment_bytes):
            yield pd.DataFrame([_segment([None if pd.isna(x) else int(x) for x in pdf["id"]], list(pdf["text"]))])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(map_pandas(plain, build, SEGMENT_SCHEMA), "positions")


class Segment:
    """A segment in memory: posting lists by term."""

    def __init__(self, row) -> None:
        self.segment = row["segment"]
        self.ids, self.keys = list(row["ids"]), list(row["keys"])
        self.starts = np.asarray(row["starts"], dtype=np.int64)
        terms = row["terms"].split()
        self.ends = np.asarray(row["term_ends"], dtype=np.int64)
        self.positions = np.frombuffer(row["positions"], dtype="<i4")
        self.place = {t: i for i, t in enumerate(terms)}

    def postings(self, term: bytes) -> np.ndarray:
        i = self.place.get(term)
        if i is None:
            return self.positions[:0]
        return self.positions[self.ends[i - 1] if i else 0 : self.ends[i]]

    def phrase(self, window: tuple[bytes, ...], order: tuple[int, ...]) -> np.ndarray:
        """Global starts of a phrase; ``order``: its offsets, rarest term first."""
        if any(w not in self.place for w in window):
            return self.positions[:0]
        first, *rest = order
        starts = self.postings(window[first]) - first
        for offset in rest:
            if not len(starts):
                break
            other = self.postings(window[offset])
            at = np.searchsorted(other, starts + offset)
            starts = starts[other[np.minimum(at, len(other) - 1)] == starts + offset]
        return starts

    def near(self, window: tuple[bytes, ...], order: tuple[int, ...], span: int) -> np.ndarray:
        """Positions of the rarest term with every other term within ``span`` words, in the same document."""
        if any(w not in self.place for w in window):
            return self.positions[:0]
        anchor = self.postings(window[order[0]]).astype(np.int64)
        doc = np.searchsorted(self.starts, anchor, "right") - 1
        for offset in order[1:]:
            if not len(anchor):
                break
            other = self.postings(window[offset]).astype(np.int64)
            low = np.maximum(anchor - span, self.starts[doc])
            high = np.minimum(anchor + span, self.starts[doc + 1] - 1)
            ok = np.searchsorted(other, low, "left") < np.searchsorted(other, high, "right")
            anchor, doc = anchor[ok], doc[ok]
        return anchor


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of consecutive words; fewer words are one window, none is none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def term_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Occurrences of the given terms over all segments."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[bytes, int] = dict.fromkeys(terms, 0)
        for pdf in batches:
            for row in pdf.to_dict("records"):
                ends = np.asarray(row["term_ends"], dtype=np.int64)
                sizes = np.diff(ends, prepend=0)
                for i, t in enumerate(row["terms"].split()):
                    if t in total:
                        total[t] += int(sizes[i])
        found = [(t, n) for t, n in total.items() if n]
        yield pd.DataFrame({"term": [t for t, _ in found], "n": [n for _, n in found]})

    rows = map_pandas(index.select("terms", "term_ends"), count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["term"]): r["n"] for r in rows}


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with words, in blocks of at most ``limit`` words (or one item)."""
    block, total = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = alnum_words(r["t"])
        if not words:
            continue
        if block and total + len(words) > limit:
            yield block
            block, total = [], 0
        block.append((r["i"], words))
        total += len(words)
    if block:
        yield block


Query = tuple[tuple[bytes, ...], tuple[int, ...], list]


def _queries(block, counts: dict[bytes, int], size: int) -> dict[bytes, list[Query]]:
    """Distinct windows by their rarest term, with their order of rarity and the items that have them."""
    by_window: dict[tuple[bytes, ...], set] = {}
    for item, words in block:
        for w in windows(words, size):
            by_window.setdefault(w, set()).update(() if item is None else (item,))
    found: dict[bytes, list[Query]] = {}
    for w, items in by_window.items():
        if all(counts.get(t, 0) for t in w):
            order = tuple(sorted(range(len(w)), key=lambda i: (counts[w[i]], i)))
            found.setdefault(w[order[0]], []).append((w, order, sorted(items)))
    return found


def matches(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, span: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document.

    Columns: id, key (of the text), segment and row (a key of the row), n_words, hits (array of start and end word, half
    open, merged), items (sorted array of item ids as strings). With ``span`` a match is a proximity match and the hit is
    its rarest word. The benchmark is read once, in blocks; the rows of a document meet again by segment and row.
    """
    found = []
    for block in _blocks(benchmark, item_col, text_col, block_words):
        counts = term_counts(index, {w for _, words in block for w in words})
        found.append(_look_up(index, _queries(block, counts, window), span))
    if not found:
        found.append(_look_up(index, {}, span))
    return found[0] if len(found) == 1 else _merged(reduce(DataFrame.unionByName, found))


def _merged(found: DataFrame) -> DataFrame:
    """One row per document again, with hits merged over blocks."""
    all_ = found.groupBy("segment", "row").agg(
        F.max("id").alias("id"), F.max("key").alias("key"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def step(done, x):
        last = F.element_at(done, -1)
        longer = F.array(last[0], F.greatest(last[1], x[1]))
        return F.when((F.size(done) > 0) & (last[1] >= x[0]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.array_append(done, x))

    hits = F.aggregate("hits", F.expr("cast(array() as array<array<bigint>>)"), step)
    return all_.select("id", "key", "segment", "row", "n_words", hits.alias("hits"), "items")


def _look_up(index: DataFrame, queries: dict[bytes, list[Query]], span: int | None) -> DataFrame:
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                seg = Segment(row)
                at, length, items = [], [], []
                # Only windows whose rarest term the segment holds are looked at.
                for term in queries.keys() & seg.place.keys():
                    for w, order, names in queries[term]:
                        starts = seg.phrase(w, order) if span is None else seg.near(w, order, span)
                        if len(starts):
                            at.append(starts.astype(np.int64))
                            length.append(len(w) if span is None else 1)
                            items.append(names)
                yield _by_document(seg, at, length, items)

    return map_pandas(index, look, "id long, key binary, segment string, row long, n_words long, hits array<array<long>>, items array<string>")


def _by_document(seg: Segment, at: list[np.ndarray], length: list[int], items: list[list]) -> pd.DataFrame:
    n = len(seg.ids)
    out = {
        "id": pd.array(seg.ids, dtype="Int64"),
        "key": seg.keys,
        "segment": seg.segment,
        "row": np.arange(n),
        "n_words": np.diff(seg.starts) - 1,
        "hits": [[] for _ in range(n)],
        "items": [[] for _ in range(n)],
    }
    if at:
        starts = np.concatenate(at)
        ends = starts + np.repeat(length, [len(x) for x in at])
        query = np.repeat(np.arange(len(at)), [len(x) for x in at])
        doc = np.searchsorted(seg.starts, starts, "right") - 1
        order = np.lexsort((ends, starts, doc))
        starts, ends, query, doc = starts[order], ends[order], query[order], doc[order]
        borders = np.flatnonzero(np.diff(doc, prepend=-1, append=n))
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            d = int(doc[a])
            reach = np.maximum.accumulate(ends[a:b])
            new = np.flatnonzero(np.concatenate(([True], starts[a + 1 : b] > reach[:-1])))
            last = np.append(new[1:] - 1, b - a - 1)
            base = seg.starts[d]
            out["hits"][d] = [[int(s - base), int(e - base)] for s, e in zip(starts[a:b][new], reach[last], strict=True)]
            out["items"][d] = sorted({str(i) for q in np.unique(query[a:b]) for i in items[q]})
    return pd.DataFrame(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array of strings), spans and key (of the text): one row per document."""
    found = matches(build_index(docs, id_col, text_col), benchmark, item_col, item_text_col, window, block_words=block_words)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), "items", F.col("hits").alias("spans"), "key")


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_hit_share: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which at most this share of words is benchmark text."""
    bad = decontaminate(docs, benchmark, id_col, text_col).filter(F.col("n_hit") > max_hit_share * F.col("n_words")).select("doc_id", "key")
    return without(docs, bad, id_col, text_col)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
