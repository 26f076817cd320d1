"""Sequence packing by lexical retrieval.

Documents are tokenised where they are read. Whole windows of a document
become sequences of their own at once; only the tails, shorter than a window,
travel on, as two bytes a token. Tails go to shards of a bounded token count
by a lexical key, the least hash of their words that are not stop words, so two
tails share a shard with the probability with which their words agree,
however many shards there are. A key that fills half a shard or more has shards
of its own, among which a running number deals, which repeated rows don't share.
Each shard builds a BM25 inverted index over its tails. A seed's words retrieve
unused neighbours; these fill the seed's window
greedily, the best first, and the last one is cut so that the window is full.
A cut-off rest stays in the pool. When nothing unused matches, the next unused
tail follows, so every token is packed. What is left at a shard's end goes
into sequences of a power of two, which need no padding.

Each tail carries its ``LEAST`` least word hashes. Those that over
``STOP_SHARE`` of all tails carry are stop words, counted over all of them;
they decide on the routing alone, never on what is packed.

Tokens are those of the public byte-level BPE vocabulary. Text is split at
spaces, where the vocabulary's pattern splits as well unless white space
stands on both sides, and each distinct chunk is encoded once per worker;
other texts are encoded whole.

Defined results: a null or empty text is one piece with the end token alone;
repeated rows and null ids are packed like any other row; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import group_pandas, map_pandas, sub_batches, text_sizes, written

WINDOW = 1024
END = 0
#: Tail tokens of one shard at most, give or take a key; half as many as a rule.
SHARD_TOKENS = 1_500_000
#: Word hashes that a tail carries at most for its routing, and the share of all tails over which one of them is a stop word.
LEAST, STOP_SHARE = 12, 0.02
K1, B = 1.2, 0.75
_CACHE = 200_000
_SPACE = re.compile(r" (?:\s|\Z)")
_RUN = re.compile(r"\s (?:\s|\Z)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of texts as little-endian 16-bit numbers, with a chunk cache."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        # Tokens that can only start a word, for the lexical index.
        self.opens = np.zeros(len(self.lengths), dtype=bool)
        for token, i in ranks.items():
            self.opens[i] = not (token[:1].isalpha() or token[:1] >= b"\x80")
        # Ids of a space and the chunk that follows it, by the chunk.
        self.cache: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def forget(self) -> None:
        """Gives the cache's memory back."""
        self.cache = {}
        pa.default_memory_pool().release_unused()

    def _flat(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u2")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Chunks that the cache lacks are encoded together."""
        if len(self.cache) > _CACHE:
            self.cache.clear()
        # Most texts have no space before white space, which is quick to see; others are encoded whole.
        whole = [bool(_SPACE.search(t) and _RUN.search(t)) for t in texts]
        split = [t for t, w in zip(texts, whole, strict=True) if not w]
        found = iter(self._split(split) if split else ())
        return [self._flat(t).tobytes() if w else next(found) for t, w in zip(texts, whole, strict=True)]

    def _split(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by their chunks. Arrow splits and numbers them, so that only distinct ones are looked up."""
        parts = pc.split_pattern(pa.array([_valid(t) for t in texts], pa.large_string()), " ")
        ends = parts.offsets.to_numpy()[1:].astype(np.int64)
        begin = np.concatenate([[0], ends[:-1]])
        coded = parts.values.dictionary_encode()
        chunks, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        # What stands before a text's first space has no space in front of it.
        inner = np.ones(len(code), dtype=bool)
        inner[begin] = False
        asked = np.bincount(code[inner], minlength=len(chunks)) > 0
        have = self.cache
        self._learn([c for c, a in zip(chunks, asked.tolist(), strict=True) if a and c not in have])
        ids = [have[c] if a else b"" for c, a in zip(chunks, asked.tolist(), strict=True)]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 2
        first, n = np.cumsum(size) - size, np.where(inner, size[code], 0)
        to = np.cumsum(n)
        place = np.repeat(first[code] - (to - n), n) + np.arange(to[-1])
        raw = np.frombuffer(b"".join(ids), dtype="<u2")[place].tobytes()
        heads = [chunks[k] for k in code[begin].tolist()]
        spans = zip(heads, (2 * (to - n)[begin]).tolist(), (2 * to[ends - 1]).tolist(), strict=True)
        return [(self._flat(h).tobytes() if h else b"") + raw[a:b] for h, a, b in spans]

    def _learn(self, chunks: list[str]) -> None:
        """Encodes distinct chunks in one run each of those with no white space at their ends.

        Between two of them the pattern always splits, so the ids of the
        joined text are theirs one after the other.
        """
        joined = [c for c in chunks if c and c.strip() == c]
        for i in range(0, len(joined), 20_000):
            part = joined[i : i + 20_000]
            text = " " + " ".join(part)
            ids = self.bpe.encode_to_numpy(text, disallowed_special=()).astype("<u2")
            ends = np.cumsum([1 + n for n in map(len, part)] if text.isascii() else [1 + (len(c) if c.isascii() else len(c.encode("utf-8"))) for c in part])
            cut = (2 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            self.cache.update(zip(part, map(raw.__getitem__, map(slice, [0, *cut], cut)), strict=True))
        if len(joined) < len(chunks):
            for c in set(chunks).difference(joined):
                self.cache[c] = self._flat(" " + c).tobytes()


def _valid(text: str) -> str:
    """The text with lone surrogates replaced, as the vocabulary's encoder does."""
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_MIX = np.random.default_rng(1).integers(1, 2**63, size=1 << 16, dtype=np.uint64)


def word_codes(documents: list[np.ndarray], opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code per word (tokens from one that opens a word to the next) of all documents, and each document's number of words."""
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    if not lengths.sum():
        return np.empty(0, dtype=np.uint64), np.zeros(len(documents), dtype=np.int64)
    ids = np.concatenate(documents)
    first = np.cumsum(lengths) - lengths
    starts = opens[ids]
    starts[first[lengths > 0]] = True
    at = np.flatnonzero(starts)
    word = np.cumsum(starts) - 1
    place = np.arange(len(ids)) - at[word]
    with np.errstate(over="ignore"):
        codes = np.add.reduceat(_MIX[ids] * (2 * place.astype(np.uint64) + np.uint64(1)), at)
    return codes, np.bincount(np.searchsorted(first + lengths, at, "right"), minlength=len(documents))


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def least_codes(documents: list[np.ndarray], opens: np.ndarray, most: int = LEAST) -> list[np.ndarray]:
    """The least distinct codes of each document in order: its least one, and up to ``most`` of those that are small for its number of words."""
    codes, sizes = word_codes(documents, opens)
    if not len(codes):
        return [codes] * len(documents)
    some, of = np.flatnonzero(sizes), np.repeat(np.arange(len(documents)), sizes)
    least = np.zeros(len(documents), dtype=np.uint64)
    least[some] = np.minimum.reduceat(codes, (np.cumsum(sizes) - sizes)[some])
    # Only these few are sorted. Codes of single tokens are below 2^63, and some repeat.
    limit = np.maximum(least, (2.0**63 * np.minimum(1.0, 3.0 * most / np.maximum(sizes, 1))).astype(np.uint64))
    at = np.flatnonzero(codes <= limit[of])
    at = at[np.lexsort((codes[at], of[at]))]
    code, doc = codes[at], of[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    code, ends = code[new], np.cumsum(np.bincount(doc[new], minlength=len(documents)))
    return [code[a : min(b, a + most)] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def tokenised(docs: DataFrame, id_col: str, text_col: str, window: int, vocabulary: str) -> DataFrame:
    """Whole-window pieces (``ids`` null) and one tail per document (``ids`` set) with its least word codes and a running number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, number = Encoder.of(vocabulary), 0
        for pdf in sub_batches(batches, text_sizes, 4 << 20):
            rows = []
            texts = [t if t is not None else "" for t in pdf["text"]]
            coded = [np.frombuffer(raw, dtype="<u2") for raw in encoder.encode(texts)]
            least = least_codes([x[(len(x) + 1) // window * window :] for x in coded], encoder.opens)
            for doc, x, codes in zip(pdf["doc_id"], coded, least, strict=True):
                doc = None if pd.isna(doc) else int(doc)
                ids = np.append(x, np.uint16(END))
                n = len(ids)
                whole = n - n % window
                rows += [(doc, i, window, crc_of(ids[i : i + window]), n, None, None, None) for i in range(0, whole, window)]
                if n > whole:
                    rows.append((doc, whole, n - whole, None, n, ids[whole:].astype("<u2").tobytes(), codes.view(np.int64), number))
                    number += 1
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "codes", "number"])
            yield out.astype({"doc_id": "Int64", "ids_crc32": "Int64", "number": "Int64"})
        # Spark keeps the worker for other stages, which need the memory.
        Encoder.of(vocabulary).forget()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_pandas(plain, run, f"{_PIECE}, ids binary, codes array<long>, number long")


class Bm25:
    """An inverted index over the words of some documents."""

    def __init__(self, documents: list[np.ndarray]) -> None:
        self._build(np.concatenate(documents) if documents else np.empty(0, np.uint64), np.array([len(d) for d in documents], dtype=np.int64))

    @classmethod
    def of_words(cls, codes: np.ndarray, lengths: np.ndarray) -> Bm25:
        """From all documents' words in a row and the number of words of each."""
        out = cls.__new__(cls)
        out._build(codes, lengths)
        return out

    def _build(self, words: np.ndarray, lengths: np.ndarray) -> None:
        documents = range(len(lengths))
        doc = np.repeat(np.arange(len(documents)), lengths)
        terms, code = np.unique(words, return_inverse=True)
        key, tf = np.unique(code.astype(np.int64) * len(documents) + doc, return_counts=True)
        term = key // max(1, len(documents))
        self.doc = (key % max(1, len(documents))).astype(np.int64)
        self.ends = np.cumsum(np.bincount(term, minlength=len(terms)))
        df = np.diff(self.ends, prepend=0)
        idf = np.log(1 + (len(documents) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if len(lengths) else 1.0))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        by_doc = np.lexsort((-self.weight, self.doc))
        self.term_of = term[by_doc]
        self.doc_ends = np.cumsum(np.bincount(self.doc, minlength=len(documents)))
        self.df = df
        self.spans = [slice(a, b) for a, b in zip((self.ends - df).tolist(), self.ends.tolist(), strict=True)]
        # Common words as rows over all documents: adding rows costs far less than their long lists do.
        # A row has a posting in every 16th place at least, so they are 16 times the lists at most.
        common = np.flatnonzero(df > max(1, len(documents) / 16))
        self.row = np.full(len(terms), -1, dtype=np.int64)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(documents)))
        of = self.row[term] >= 0
        self.dense[self.row[term[of]], self.doc[of]] = self.weight[of]

    def scores(self, d: int, most_words: int | None = None) -> np.ndarray:
        """Of all documents, by the words of ``d`` (all, or its ``most_words`` heaviest) that another one has."""
        terms = self.term_of[self.doc_ends[d - 1] if d else 0 : self.doc_ends[d]][:most_words]
        rows = self.row[terms]
        spans = [self.spans[t] for t in terms[(rows < 0) & (self.df[terms] > 1)].tolist()]
        out = np.zeros(self.dense.shape[1])
        if spans:
            out += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(out))
        for r in rows[rows >= 0].tolist():
            out += self.dense[r]
        return out

    def ranked(self, d: int, most_words: int | None = None) -> Iterator[int]:
        """Documents that share words of ``d``, best first, ties by number."""
        score = self.scores(d, most_words)
        rest = np.flatnonzero(score)
        while len(rest):  # a few are wanted mostly, so the rest stays unsorted until then
            found = score[rest]
            first = found >= (np.partition(found, -64)[-64] if len(rest) > 64 else 0)
            best, rest = rest[first], rest[~first]
            yield from best[np.argsort(-score[best], kind="stable")].tolist()

    def neighbours(self, d: int, most_words: int | None = None) -> np.ndarray:
        return np.fromiter(self.ranked(d, most_words), dtype=np.int64)


def fill(lengths: np.ndarray, index: Bm25, window: int, query_words: int | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, from, to). All but the last are full."""
    n = len(lengths)
    used = np.zeros(n, dtype=np.int64)  # tokens taken already
    open_from = 0
    rest: int | None = None  # a cut document, which seeds the next window
    while True:
        while open_from < n and used[open_from] >= lengths[open_from]:
            open_from += 1
        seed = rest if rest is not None else open_from
        if seed >= n:
            return
        pieces, room, rest = [], window, None
        order, follow = index.ranked(seed, query_words), seed
        nxt = open_from
        while room:
            if follow is None:
                follow = next((d for d in order if used[d] < lengths[d]), None)
            if follow is None:
                while nxt < n and used[nxt] >= lengths[nxt]:
                    nxt += 1
                if nxt >= n:
                    break
                follow = nxt
            take = int(min(room, lengths[follow] - used[follow]))
            if take:
                pieces.append((follow, int(used[follow]), int(used[follow]) + take))
                used[follow] += take
                room -= take
                rest = follow if used[follow] < lengths[follow] else None
            follow = None
        yield pieces


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Splits a sequence into sequences whose lengths are powers of two."""
    left = sum(b - a for _, a, b in pieces)
    todo = list(pieces)
    while left:
        size = room = 1 << (left.bit_length() - 1)
        out = []
        while room:
            d, a, b = todo.pop(0)
            take = min(room, b - a)
            out.append((d, a, a + take))
            if take < b - a:
                todo.insert(0, (d, a + take, b))
            room -= take
        left -= size
        yield out


def lexical_keys(tails: DataFrame, number: int) -> DataFrame:
    """Tails with ``key``: the least of their codes that at most ``STOP_SHARE`` of all tails carry, else a hash of the two that the fewest carry; a hash of its own for a tail without words."""
    counts = tails.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    # At most LEAST / STOP_SHARE rows.
    stops = sorted((r["n"], r["code"]) for r in counts.filter(F.col("n") > STOP_SHARE * number).collect())
    common = F.array(*(F.lit(c) for _, c in stops)).cast("array<long>")  # the rarest first
    own = F.get(F.array_except("codes", common), F.lit(0))
    two = F.when(F.size("codes") > 0, F.xxhash64(F.slice(F.array_intersect(common, F.col("codes")), 1, 2)))
    return tails.withColumn("key", F.coalesce(own, two, F.xxhash64("doc_id", "number")))


def dealt(tails: DataFrame, shard_tokens: int) -> DataFrame:
    """Tails with ``shard``: by lexical key; those of a key that fills half a shard or more get shards of their own, by the running number."""
    r = tails.agg(F.sum("length").alias("total"), F.count("codes").alias("n")).first()
    shards = max(1, round(2 * (r["total"] or 0) / shard_tokens))
    keyed = lexical_keys(tails, r["n"])
    # One row per hot key; there are at most as many as shards.
    hot = keyed.groupBy("key").agg(F.sum("length").alias("n")).filter(F.col("n") > shard_tokens / 2)
    hot = hot.select("key", F.ceil(2 * F.col("n") / F.lit(shard_tokens)).alias("splits"))
    hot = written(hot.withColumn("first", shards + F.sum("splits").over(Window.orderBy("key")) - F.col("splits")), "hot-keys")
    home = F.when(F.col("splits").isNull(), F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(F.col("first") + F.pmod(F.xxhash64("number"), F.col("splits")))
    return keyed.join(hot, "key", "left").select("doc_id", "start", "doc_tokens", "ids", "number", home.alias("shard"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS, query_words: int | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    ``query_words`` limits a seed's query to its heaviest words; None asks with all.
    """
    vocabulary = vocabulary or default_vocabulary()
    pieces = written(tokenised(docs, id_col, text_col, window, vocabulary), "pieces")
    whole = pieces.filter("ids is null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        encoder = Encoder.of(vocabulary)
        pdf = pdf.sort_values(["doc_id", "start", "number"], kind="stable", ignore_index=True)
        ids = [np.frombuffer(x, dtype="<u2") for x in pdf["ids"]]
        index = Bm25.of_words(*word_codes(ids, encoder.opens))
        first, rows, k = int(pdf["shard"].iloc[0]) << 32, [], 0
        for sequence in fill(np.array([len(x) for x in ids]), index, window, query_words):
            full = sum(b - a for _, a, b in sequence) == window
            for part in [sequence] if full else powers(sequence):
                offset = 0
                for d, a, b in part:
                    rows.append((d, a, b - a, crc_of(ids[d][a:b]), first + k, offset))
                    offset += b - a
                k += 1
        out = pd.DataFrame(rows, columns=["d", "from", "length", "ids_crc32", "sequence_id", "offset"])
        of = pdf.iloc[out["d"].to_numpy()].reset_index(drop=True)
        return pd.DataFrame({
            "doc_id": of["doc_id"].astype("Int64"), "start": of["start"] + out["from"], "length": out["length"], "ids_crc32": out["ids_crc32"],
            "doc_tokens": of["doc_tokens"], "sequence_id": out["sequence_id"], "offset": out["offset"],
        })

    packed = group_pandas(dealt(pieces.filter("ids is not null"), shard_tokens), "shard", one, f"{_PIECE}, sequence_id long, offset long")
    return whole.unionByName(packed)
