"""Similarities of strings and sets.

Set similarities are Column expressions. The four edit ratios have no native
counterpart (Spark's ``levenshtein`` counts a substitution once, these count
it twice), so one Arrow UDF returns all four for a pair of columns. It finds
longest common subsequences bit-parallel over whole batches: one 64-bit state
per pair, advanced by one text position for all of them at a time. What hangs
on one text (codes, bit masks, sorted tokens) is made once per text of a batch.
The partial ratio reads heads and tails off the states of one pass each, and
takes one pass per window of full length. Texts of over 64 characters, of
other than ASCII or of many tokens go pair by pair: subsequences by Python's
long integers, windows by combing the strands of the pair's grid once
(semi-local alignment).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(a == b, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one long integer."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u) | (s - u)
    return (~s & full).bit_count()


_CODES = 256


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Character codes by row, 0 after the end."""
    out = np.zeros((len(texts), max(1, width)), dtype=np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("latin-1"), dtype=np.uint8)
    return out


def _masks(patterns: list[str]) -> np.ndarray:
    """For each pattern (at most 64 characters) the positions of each code."""
    out = np.zeros((len(patterns), _CODES), dtype=np.uint64)
    codes = _codes(patterns, max(map(len, patterns), default=0))
    for i in range(codes.shape[1]):
        out[np.arange(len(patterns)), codes[:, i]] |= np.uint64(1 << i)
    out[:, 0] = 0
    return out


def _advance(masks: np.ndarray, rows: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """LCS lengths of patterns ``rows`` with the texts in ``codes``."""
    s = np.full(len(rows), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for t in range(codes.shape[1]):
            u = s & masks[rows, codes[:, t]]
            s = (s + u) | (s - u)
    keep = np.where(lengths[rows] >= 64, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(lengths[rows], 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~s & keep).astype(np.int64)


def _simple(a: str) -> bool:
    return a.isascii() and "\x00" not in a


def lcs_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """LCS lengths of many pairs."""
    out = np.zeros(len(pairs), dtype=np.int64)
    fast = []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            out[i] = len(a)
        elif a and b:
            if min(len(a), len(b)) <= 64 and _simple(a) and _simple(b):
                fast.append((i, *((a, b) if len(a) <= len(b) else (b, a))))
            else:
                out[i] = lcs_length(a, b)
    fast.sort(key=lambda x: len(x[2]))
    for k in range(0, len(fast), 4096):
        part = fast[k : k + 4096]
        patterns, texts = [p for _, p, _ in part], [t for *_, t in part]
        found = _advance(_masks(patterns), np.arange(len(part)), _codes(texts, max(map(len, texts))), np.array([len(p) for p in patterns]))
        out[[i for i, *_ in part]] = found
    return out


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """2 LCS / (sum of lengths); 1 for two empty texts."""
    total = np.array([len(a) + len(b) for a, b in pairs], dtype=np.float64)
    return np.where(total == 0, 1.0, 2 * lcs_lengths(pairs) / np.maximum(total, 1))


def _code_points(texts: list[str], length: int, fill: int) -> np.ndarray:
    """Code points, a column per text, ``fill`` after the end."""
    out = np.full((length, len(texts)), fill, dtype=np.uint32)
    for k, t in enumerate(texts):
        out[: len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out


def window_starts(short: list[str], long: list[str]) -> np.ndarray:
    """For each position of a longer text (rows) of each pair (columns) where the strand that ends there starts, -1 if not in that text.

    Strands enter a pair's grid from the left, one per character of the
    shorter text, and from above. Two that meet cross unless they did before or the
    characters agree. Of the window [i, j) of the longer text, as many
    characters are in no common subsequence as strands start at i or later and
    end before j. Cells of an anti-diagonal don't depend on each other, so all
    of them, of all pairs, take one step together.
    """
    n, m = max(map(len, short)), max(map(len, long))
    kind = np.int16 if n + m < 32_000 else np.int32
    x, y = _code_points(short, n, 0x110000), _code_points(long, m, 0x110001)[::-1]
    size = np.array([len(t) for t in short])
    left = (size - np.arange(n)[:, None]).clip(0).astype(kind)  # 0 past the end never crosses
    above = (size + 1 + np.arange(m)[::-1, None]).astype(kind)
    for d in range(n + m - 1):
        i, end = max(0, d - m + 1), min(n, d + 1)
        k = m - 1 - d + i
        h, v = left[i:end], above[k : k + end - i]
        swap = (x[i:end] == y[k : k + end - i]) | (h > v)
        h[:], v[:] = np.where(swap, v, h), np.where(swap, h, v)
    return np.maximum(above[::-1].astype(np.int64) - size - 1, -1)


def _best_windows(short: list[str], long: list[str]) -> np.ndarray:
    """The best ratio of each shorter text with a window of its length, a shorter head or a shorter tail of the longer one."""
    starts = window_starts(short, long)
    m, pairs = starts.shape
    n, size = np.array([len(t) for t in short]), np.array([len(t) for t in long])
    at = np.arange(m)[:, None]
    real = (starts >= 0) & (at < size)
    end, pair = np.nonzero(real)
    start = starts[end, pair]

    def total(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(rows * pairs + of, minlength=(m + 1) * pairs).reshape(m + 1, pairs)

    head = at + 1 - np.cumsum(real, axis=0)  # subsequence with the first at + 1 characters
    heads = np.where(at + 1 < np.minimum(n, size + 1), 2 * head / (n + at + 1), 0)
    later = np.cumsum(total(start, pair)[m - 1 :: -1], axis=0)[::-1]
    tails = np.where((size - at < n) & (at < size), 2 * (size - at - later) / np.maximum(n + size - at, 1), 0)
    low, high = np.maximum(0, end - n[pair] + 1), np.minimum(start, (size - n)[pair])
    some = low <= high
    gone = np.cumsum(total(low[some], pair[some]) - total(high[some] + 1, pair[some]), axis=0)[:m]
    inner = np.where(at <= size - n, (n - gone) / n, 0)
    return np.maximum(np.maximum(heads, tails), inner).max(axis=0)


#: Cells of the grids of one batch.
_CELLS = 1 << 23


def partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The best ratio of the shorter text with a window of the longer one; of texts of equal length, either way."""
    out = np.zeros(len(pairs))
    todo: list[tuple[int, str, str]] = []
    for i, (a, b) in enumerate(pairs):
        if not a or not b:
            out[i] = float(not a and not b)
        elif a in b or b in a:
            out[i] = 1.0
        else:
            todo.append((i, *((a, b) if len(a) <= len(b) else (b, a))))
            if len(a) == len(b):
                todo.append((i, b, a))
    todo.sort(key=lambda t: (len(t[2]), len(t[1])))
    while todo:
        # Longest first: the batch's grids are as large as its first pair's.
        cells = len(todo[-1][1]) * len(todo[-1][2])
        part = todo[-max(1, min(8192, _CELLS // cells)) :]
        del todo[-len(part) :]
        np.maximum.at(out, [i for i, *_ in part], _best_windows([a for _, a, _ in part], [b for *_, b in part]))
    return out


def token_sort_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    return ratios([(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for a, b in pairs])


def token_set_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Ratio of shared and remaining tokens; 0 if a side has none."""
    out = np.zeros(len(pairs))
    rest, shared, where = [], [], []
    for i, (a, b) in enumerate(pairs):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            continue
        both = x & y
        if both and (x <= y or y <= x):
            out[i] = 1.0
            continue
        where.append(i)
        rest.append((" ".join(sorted(x - y)), " ".join(sorted(y - x))))
        shared.append(len(" ".join(sorted(both))))
    for i, (p, q), common, s in zip(where, rest, lcs_lengths(rest), shared, strict=True):
        gap = s + 1 if s else 0
        left, right = gap + len(p), gap + len(q)
        best = 1 - (len(p) + len(q) - 2 * common) / (left + right)
        if s:
            best = max(best, 1 - (1 + len(p)) / (s + left), 1 - (1 + len(q)) / (s + right))
        out[i] = best
    return out


class _Table:
    """Distinct texts of at most 64 ASCII characters: sizes, character codes by place (0 after the end) and, by code, the places as bits."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.size = texts, np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("ascii"), dtype=np.uint8)
        known = np.flatnonzero(np.bincount(points, minlength=128))
        number = np.zeros(128, dtype=np.int64)
        number[known] = np.arange(1, len(known) + 1)
        self.kinds, self.width = len(known) + 1, max(1, int(self.size.max(initial=1)))
        codes = np.zeros((len(texts), self.width), dtype=np.int64)
        first = np.cumsum(self.size) - self.size
        codes[np.repeat(np.arange(len(texts)), self.size), np.arange(len(points)) - np.repeat(first, self.size)] = number[points]
        masks, at = np.zeros((len(texts), self.kinds), dtype=np.uint64), np.arange(len(texts))
        for i in range(self.width):
            masks[at, codes[:, i]] |= np.uint64(1 << i)
        masks[:, 0] = 0
        self.codes, self.masks = codes.ravel(), masks.ravel()
        self.full = np.iinfo(np.uint64).max >> (64 - np.maximum(self.size, 1)).astype(np.uint64)

    def reverse(self) -> _Table:
        return _Table([t[::-1] for t in self.texts])

    def states(self, patterns: np.ndarray, texts: np.ndarray, start: np.ndarray | int, steps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(how many, their states) after each character; the steps, by which pairs are sorted, descend."""
        base, at = patterns * self.kinds, texts * self.width + start
        s = np.full(len(patterns), np.iinfo(np.uint64).max, dtype=np.uint64)
        n = len(s)
        with np.errstate(over="ignore"):
            for t in range(int(steps[0]) if n else 0):
                if steps[n - 1] <= t:
                    n = int(np.searchsorted(-steps, -t, "left"))
                x = s[:n]
                u = x & self.masks[base[:n] + self.codes[at[:n] + t]]
                np.bitwise_or(x + u, x - u, out=x)
                yield n, s

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """LCS lengths of pairs of texts, given by number."""
        out = np.zeros(len(a), dtype=np.int64)
        a, b = np.where(self.size[a] < self.size[b], b, a), np.where(self.size[a] < self.size[b], a, b)
        order = np.argsort(-self.size[b], kind="stable")
        for k in range(0, len(order), _PART):
            rows = order[k : k + _PART]
            s = np.full(len(rows), np.iinfo(np.uint64).max, dtype=np.uint64)
            for _, s in self.states(a[rows], b[rows], 0, self.size[b[rows]]):  # noqa: B007
                pass
            out[rows] = np.bitwise_count(~s & self.full[a[rows]])
        return np.where(self.size[b] == 0, 0, out)

    def heads(self, short: np.ndarray, long: np.ndarray) -> np.ndarray:
        """The best ratio of each shorter text with a shorter head of the longer one."""
        out = np.zeros(len(short))
        order = np.argsort(-self.size[short], kind="stable")
        for k in range(0, len(order), _PART):
            rows = order[k : k + _PART]
            n, full, best = self.size[short[rows]], self.full[short[rows]], np.zeros(len(rows))
            for t, (many, s) in enumerate(self.states(short[rows], long[rows], 0, n - 1), 1):
                x = 2 * np.bitwise_count(~s[:many] & full[:many]).astype(np.int64) / (n[:many] + t)
                np.maximum(best[:many], x, out=best[:many])
            out[rows] = best
        return out

    def inner(self, short: np.ndarray, long: np.ndarray) -> np.ndarray:
        """The best ratio of each shorter text with a window of its length."""
        out = np.zeros(len(short))
        order = np.argsort(-self.size[short], kind="stable")
        windows = (self.size[long] - self.size[short] + 1)[order]
        parts = np.flatnonzero(np.diff(np.cumsum(windows) // _PART, prepend=-1))
        for rows in np.split(order, parts[1:]):
            times = self.size[long[rows]] - self.size[short[rows]] + 1
            which = np.repeat(np.arange(len(rows)), times)
            start = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            at = rows[which]
            s = np.full(len(at), np.iinfo(np.uint64).max, dtype=np.uint64)
            for _, s in self.states(short[at], long[at], start, self.size[short[at]]):  # noqa: B007
                pass
            found = np.bitwise_count(~s & self.full[short[at]]).astype(np.int64)
            if len(rows):
                out[rows] = np.maximum.reduceat(found, np.cumsum(times) - times) / self.size[short[rows]]
        return out


#: Pairs that advance together.
_PART = 8192
#: Tokens of a text of the fast way at most.
_TOKENS = 12


def _ratio(common: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(x + y == 0, 1.0, 2 * common / np.maximum(x + y, 1).astype(np.float64))


def _short_ratios(texts: list[str], tokens: list[list[str]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All four ratios of pairs of short ASCII texts, given by number: what depends on one text is made once per text."""
    table = _Table(texts)
    out = np.zeros((len(a), 4))
    x, y = table.size[a], table.size[b]
    out[:, 0] = _ratio(table.common(a, b), x, y)

    filled = np.flatnonzero((x > 0) & (y > 0))
    out[:, 1] = (x + y == 0).astype(float)
    short, long = np.where(x <= y, a, b)[filled], np.where(x <= y, b, a)[filled]
    twice = np.flatnonzero((x == y)[filled])
    one, two = np.concatenate([short, long[twice]]), np.concatenate([long, short[twice]])
    ends = np.maximum(table.heads(one, two), table.reverse().heads(one, two))
    best = np.maximum(ends[: len(filled)], table.inner(short, long))
    best[twice] = np.maximum(best[twice], ends[len(filled) :])
    out[filled, 1] = best

    number, ordered = pd.factorize(np.array([" ".join(sorted(t)) for t in tokens], dtype=object))
    table, p, q = _Table(list(ordered)), number[a], number[b]
    out[:, 2] = _ratio(table.common(p, q), table.size[p], table.size[q])

    sets = [sorted(set(t)) for t in tokens]
    most = max(map(len, sets), default=0)
    ids: dict[str, int] = {}
    words = np.full((len(texts), max(1, most)), -1, dtype=np.int64)
    for k, t in enumerate(sets):
        words[k, : len(t)] = [ids.setdefault(w, len(ids)) for w in t]
    left, right = words[a], words[b]
    mask = np.zeros((2, len(a)), dtype=np.int64)
    for i in range(most):
        for j in range(most):
            same = (left[:, i] == right[:, j]) & (left[:, i] >= 0)
            mask[0] |= same.astype(np.int64) << i
            mask[1] |= same.astype(np.int64) << j
    keys, at = np.unique(np.concatenate([a, b]) << most | mask.ravel(), return_inverse=True)
    rest, shared = [], []
    for k in keys.tolist():
        own, gone = sets[k >> most], k & ((1 << most) - 1)
        rest.append(" ".join([w for i, w in enumerate(own) if not gone >> i & 1]))
        shared.append(sum([len(w) + 1 for i, w in enumerate(own) if gone >> i & 1]))  # as many as with a space after them
    number, ordered = pd.factorize(np.array(rest, dtype=object))
    table, p, q = _Table(list(ordered)), number[at[: len(a)]], number[at[len(a) :]]
    gap, common = np.array(shared, dtype=np.int64)[at[: len(a)]], table.common(p, q)
    x, y, s = table.size[p], table.size[q], np.maximum(gap - 1, 0)
    total = np.maximum(2 * gap + x + y, 1)
    best = 1 - (x + y - 2 * common) / total
    some = np.maximum(1 - (1 + x) / np.maximum(s + gap + x, 1), 1 - (1 + y) / np.maximum(s + gap + y, 1))
    best = np.where(gap > 0, np.maximum(best, some), best)
    best = np.where((gap > 0) & ((x == 0) | (y == 0)), 1.0, best)
    empty = np.array([not t for t in sets])
    out[:, 3] = np.where(empty[a] | empty[b], 0.0, best)
    return out


def four_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Ratio, partial, token-sort and token-set ratio of pairs; each distinct pair and text is looked at once."""
    number, texts = pd.factorize(np.array([*a, *b], dtype=object))
    texts = list(texts)
    keys, at = np.unique(number[: len(a)] * max(1, len(texts)) + number[len(a) :], return_inverse=True)
    p, q = keys // max(1, len(texts)), keys % max(1, len(texts))
    tokens = [t.split() for t in texts]
    plain = np.array([len(t) <= 64 and len(w) <= _TOKENS and _simple(t) for t, w in zip(texts, tokens, strict=True)], dtype=bool)
    out = np.zeros((len(keys), 4))
    fast = plain[p] & plain[q]
    if fast.any():
        kept = np.flatnonzero(plain)
        place = np.cumsum(plain) - 1
        out[fast] = _short_ratios([texts[k] for k in kept], [tokens[k] for k in kept], place[p[fast]], place[q[fast]])
    if not fast.all():
        rest = [(texts[i], texts[j]) for i, j in zip(p[~fast], q[~fast], strict=True)]
        out[~fast] = np.column_stack([ratios(rest), partial_ratios(rest), token_sort_ratios(rest), token_set_ratios(rest)])
    return out[at]


RATIO_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")])


@F.pandas_udf(RATIO_TYPE)
def edit_ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All four ratios (0 to 1) of two text columns; each distinct pair is computed once."""
    return pd.DataFrame(four_ratios(a.fillna("").tolist(), b.fillna("").tolist()), columns=["ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio"])
