"""SimHash near-duplicates by vantage-point trees.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64
hashes of a text's word shingles. Equal fingerprints collapse to one row by a
map-side combine before anything else. The distinct ones go to the leaves of
a vantage-point tree: a node holds a fingerprint v and a radius m; those at a
distance of at most m go inside, the others outside. By the triangle
inequality a pair that links across the border has its inner end at a
distance of over m - r, so exactly those inner fingerprints visit the outer
side as well, and every pair within r meets in some leaf.

The upper levels of the tree are fitted on a bounded sample of fingerprints
(``TREE_SAMPLE``) and sent to all tasks (at most ``MAX_LEAVES`` nodes of 16
bytes); the choice affects balance only, never results. Each leaf goes on
splitting locally, and returns a spanning forest of its links, not its pairs:
a large group of near copies gives one edge per member.

The pipeline's similarity mode (``similar_groups``) uses no tree: it compares
all sketches of a min-wise bucket and confirms by exact shingle sets.

Defined results: a null or empty text has fingerprint zero, linked like any
other; fewer words than a shingle are one shingle; repeated rows share their
component; a row with a null id gets a fingerprint and the component of that
fingerprint if another row with an id has it, else null; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_pandas, map_pandas, space_words, sub_batches, text_sizes, written
from .components import connected_components

SEED = 42
TREE_SAMPLE = 8192
LEAF_SIZE = 2048
MAX_LEAVES = 4096
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included."""
    words = space_words(text)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit majority of hashes; a tie and no hash at all give 0 bits."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = np.ascontiguousarray(hashes[i : i + _BLOCK]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long): one row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_pandas(plain, run, "doc_id long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(points: np.ndarray, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The candidate whose border at the median radius is thinnest."""
    best = None
    for v in points[:: max(1, len(points) // tries)][:tries]:
        d = distance(points, v)
        m = int(np.median(d))
        if m >= d.max():
            m = int(d.max()) - 1
        inside = int((d <= m).sum())
        if m < 0 or not 0 < inside < len(points):
            continue
        border = int(((d <= m) & (d > m - 3)).sum()) + abs(2 * inside - len(points)) // 2
        if best is None or border < best[0]:
            best = (border, v, m)
    return best and best[1:]


def build_tree(sample: np.ndarray, leaves: int) -> list:
    """Nodes ``(v, m, inside, outside)`` by index; leaves are None."""
    nodes: list = []

    def grow(points: np.ndarray, left: int) -> int:
        at = len(nodes)
        nodes.append(None)
        if left > 1 and len(points) > 1 and (found := _vantage(points)):
            v, m = found
            d = distance(points, v)
            nodes[at] = (v, m, grow(points[d <= m], (left + 1) // 2), grow(points[d > m], left // 2))
        return at

    grow(sample, leaves)
    return nodes


def route(nodes: list, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indices) such that each pair within ``radius`` shares a leaf."""
    todo = [(0, np.arange(len(fps)))]
    while todo:
        at, which = todo.pop()
        if not len(which):
            continue
        if nodes[at] is None:
            yield at, which
            continue
        v, m, inside, outside = nodes[at]
        d = distance(fps[which], v).astype(np.int64)
        todo += [(inside, which[d <= m]), (outside, which[d > m - radius])]


def forest(fps: np.ndarray, radius: int, leaf_size: int = LEAF_SIZE) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints, as index pairs."""
    edges: list[tuple[int, int]] = []
    todo = [np.arange(len(fps))]
    while todo:
        which = todo.pop()
        points = fps[which]
        if len(which) > leaf_size and (found := _vantage(points)):
            v, m = found
            d = distance(points, v).astype(np.int64)
            inner, outer = which[d <= m], which[d > m - radius]
            if max(len(inner), len(outer)) < 0.95 * len(which):
                todo += [inner, outer]
                continue
        edges += [(int(which[a]), int(which[b])) for a, b in _leaf(points, radius)]
    return edges


def _leaf(points: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Breadth-first search over one leaf; each point is expanded once."""
    linked = [i + np.flatnonzero((distance(points[i : i + 64, None], points[None, :]) <= radius).sum(axis=1) > 1) for i in range(0, len(points), 64)]
    rest = np.concatenate(linked) if linked else np.empty(0, dtype=np.int64)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            at, front = front[0], front[1:]
            near = distance(points[rest], points[at]) <= radius
            for b in rest[near]:
                yield at, b
            front, rest = np.concatenate((front, rest[near])), rest[~near]


def links(distinct: DataFrame, radius: int, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """Spanning edges (u, v) of the nodes of ``distinct`` (fp, node), within the radius.

    Together with transitivity no link between different fingerprints is lost.
    """
    n = distinct.count()
    leaves = min(MAX_LEAVES, max(1, math.ceil(n / leaf_size)))
    sample = [r["fp"] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()] if leaves > 1 else []
    nodes = build_tree(np.array(sample, dtype=np.int64).view(np.uint64), leaves)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps, ids = pdf["fp"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
            for leaf, which in route(nodes, fps.view(np.uint64), radius):
                yield pd.DataFrame({"leaf": leaf, "fp": fps[which], "node": ids[which]})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, ids = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["node"].to_numpy(np.int64)
        found = np.array(forest(fps, radius, leaf_size), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": ids[found[:, 0]], "v": ids[found[:, 1]]})

    dealt = map_pandas(distinct, deal, "leaf int, fp long, node long")
    return group_pandas(dealt, "leaf", search, "u long, v long")


#: Similarity mode: min-wise permutations, bands and sketch bins.
ROWS, BANDS, BINS = 4, 12, 256
GROUP, ANCHORS = 1000, 32
#: A sketch's estimate only selects candidates; at a similarity of 0.8 it is hardly ever below 0.7.
LOOSE = 0.6
#: Distinct shingles that a group confirmed by its texts holds, but for anchors.
GROUP_SHINGLES = 4_000_000
#: Bins of a sketch's segment, and groups' worth of unlike members from which a bucket is split by segments.
SEGMENT, MANY = 6, 8
_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """A one-permutation sketch (a byte per bin, 0 where empty) and band keys."""
    out = np.zeros(BINS, dtype=np.uint8)
    if not len(hashes):
        return out, []
    u = np.unique(hashes)
    bins = (u >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = 1 + (u[first] % np.uint64(255)).astype(np.uint8)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(u), 8192):
            least = np.minimum(least, ((u[i : i + 8192, None] ^ _XOR) * _ODD).min(axis=0))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return out, np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def jaccard(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches (rows) to one sketch."""
    same = ((sketches == one) & (one > 0)).sum(axis=1)
    return same / np.maximum(1, ((sketches > 0) | (one > 0)).sum(axis=1))


def loose_forest(sketches: np.ndarray, least: float = LOOSE) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sketches with this estimate."""
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(sketches))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = jaccard(sketches[rest], sketches[at]) >= least
            if not sketches[at].any():
                near |= ~sketches[rest].any(axis=1)
            edges += [(at, int(b)) for b in rest[near]]
            front += rest[near].tolist()
            rest = rest[~near]
    return edges


def exact_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sets (sorted, distinct) have this Jaccard similarity; two empty sets are alike."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.empty(0, dtype=np.int64)
    starts, held = np.cumsum(sizes) - sizes, np.zeros(len(codes) + 1, dtype=bool)
    edges: list[tuple[int, int]] = []
    rest, left = np.arange(len(sets)), codes  # the points not reached yet, and their codes
    while len(rest):
        front, left, rest = [int(rest[0])], left[sizes[rest[0]] :], rest[1:]
        while front and len(rest):
            at = front.pop()
            own = codes[starts[at] : starts[at] + sizes[at]]
            held[own] = True
            common = np.diff(np.concatenate(([0], np.cumsum(held[left])))[np.concatenate(([0], np.cumsum(sizes[rest])))])
            held[own] = False
            either = sizes[rest] + sizes[at] - common
            near = (common / np.maximum(1, either) >= similarity) | (either == 0)
            if near.any():
                edges += [(at, int(b)) for b in rest[near]]
                front += rest[near].tolist()
                left, rest = left[np.repeat(~near, sizes[rest])], rest[~near]
    return edges


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, digest and number n of the distinct shingles, sketch and bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sub_batches(batches, text_sizes):
            rows = []
            for t in pdf["text"]:
                u = np.unique(shingle_hashes(t, size))
                bins, keys = sketch(u)
                rows.append((xxhash.xxh3_128_digest(u.tobytes()), len(u), bins.tobytes(), keys))
            out = pd.DataFrame(rows, columns=["digest", "n", "sketch", "bands"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    return map_pandas(_texts(docs, id_col, text_col), run, "doc_id long, digest binary, n long, sketch binary, bands array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _met(light: DataFrame, of: DataFrame, search, name: str, segments: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) that ``search`` finds among the nodes of equal keys; light has (node, key, n), ``of`` what is looked at.

    A key of more than ``GROUP`` nodes, or of more than ``GROUP_SHINGLES``
    (the sum of n), is dealt into groups that share the key's anchors; what
    they leave apart meets in a second round, which goes by ``segments`` (node,
    segment) where it would be long. Group and anchors follow from the
    node alone and the number of groups is a power of two, so keys that hold
    the same nodes, such as the bands of many near copies, deal them alike and
    find the same edges, which collapse.
    """
    groups = F.greatest(F.col("m") / F.lit(float(GROUP)), F.least(F.col("m"), F.col("shingles") / F.lit(float(GROUP_SHINGLES))))
    groups = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(groups)), F.lit(0))).cast("int")
    shared = light.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")).filter("m > 1")
    shared = written(shared.select("key", "m", groups.alias("groups")), f"{name}-shared")
    anchor = F.pmod(F.xxhash64("node"), F.lit(1 << 31)) * F.col("m") < F.lit(ANCHORS << 31)
    group = F.when(anchor, F.sequence(F.lit(0), F.col("groups") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int")))
    members = light.join(shared, "key").select("node", "key", F.explode(group).alias("part")).select("node", F.xxhash64("key", "part").alias("bucket"))
    edges = group_pandas(members.join(of, "node"), "bucket", search, "u long, v long")
    large = shared.filter(F.col("groups") > 1)
    if not large.isEmpty():
        edges = written(edges, f"{name}-edges")
        left = _left_apart(light, large, edges)
        apart = _second_round(left if segments is None else left.filter(F.col("chunks") <= MANY)).join(of, "node")
        out = edges.unionByName(group_pandas(apart, "bucket", search, "u long, v long"))
        many = left.filter(F.col("chunks") > MANY)
        if segments is not None and not many.isEmpty():
            finer = many.join(segments, "node").select("node", F.xxhash64("key", "segment").alias("key"), "n")
            out = out.unionByName(_met(finer, of, search, f"{name}-split"))
        edges = out
    return edges


def _left_apart(light: DataFrame, large: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of the large buckets that the first round did not join into one component.

    Columns: key, node, n, c (the member's component), main (the bucket's
    largest one), and in how many chunks and parts those outside it and all
    members are dealt.
    """
    found = connected_components(edges, "similar-first")
    inside = written(light.join(large, "key").join(found, "node", "left").select("key", "m", "groups", "node", "n", F.coalesce("component", "node").alias("c")), "similar-large")
    sizes = inside.groupBy("key", "m", "groups", "c").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("key", "m", "groups").agg(F.max(F.struct("k", "c")).alias("x")).filter("x.k < m")
    main = main.select("key", F.col("x.c").alias("main"), F.ceil((F.col("m") - F.col("x.k")) * F.col("groups") / F.col("m")).cast("int").alias("chunks"), F.col("groups").alias("parts"))
    return written(inside.select("key", "node", "n", "c").join(main, "key"), "similar-apart")


def _second_round(left: DataFrame) -> DataFrame:
    """(node, bucket) in which the members of large buckets meet that the first round left apart.

    Of two members in different components at least one is outside the
    bucket's largest component. Those outside, in chunks, meet all members of
    the bucket, in parts, so a group holds about twice ``GROUP`` members. In a
    bucket of near copies next to nothing is outside. A bucket of many unlike
    members does not come here: it is split by the segments of the members'
    sketches. Of a pair of similarity 0.8 six bins agree with a probability of
    0.26, one of 42 segments with 0.999997; unlike members hardly meet.
    """
    chance = F.xxhash64("node", "key", F.lit(2))
    chunk, part = F.pmod(chance, F.col("chunks")).cast("int"), F.pmod(chance, F.col("parts")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = left.filter("c <> main").select("key", "node", chunk.alias("chunk"), every("parts").alias("part"))
    asked = left.select("key", "node", every("chunks").alias("chunk"), part.alias("part"))
    return asking.unionByName(asked).select("node", F.xxhash64("key", "chunk", "part", F.lit(2)).alias("bucket"))


def _segments(distinct: DataFrame) -> DataFrame:
    """(node, segment): hashes of the runs of ``SEGMENT`` bins of a sketch, with their places; empty runs are left out."""
    runs = F.transform(F.sequence(F.lit(0), F.lit(BINS // SEGMENT - 1)), lambda k: F.struct(k.alias("k"), F.substring("sketch", k * SEGMENT + 1, F.lit(SEGMENT)).alias("run")))
    found = distinct.select("node", F.explode(runs).alias("x")).filter(F.col("x.run") != F.lit(bytes(SEGMENT)))
    return found.select("node", F.xxhash64("x.k", "x.run").alias("segment"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id of near duplicates by shingle similarity.

    Fingerprints take no part: they count repeats, which the similarity of
    sets does not. Documents first meet in buckets of equal min-wise bands (12
    bands of 4: a pair of similarity 0.8 shares one with probability 0.998),
    where those whose sketches have an estimate of ``LOOSE`` or more are
    candidates. The components of these candidate
    pairs read their texts again, and only pairs whose shingle sets have the
    similarity are links. Equal shingle sets collapse beforehand. A bucket or
    component of more than ``GROUP`` members is dealt into groups of that size,
    which all hold its ``ANCHORS`` random anchors; a group of near copies
    becomes one component through them. What this leaves apart meets in a
    second round (``_second_round``), so that no link is lost.
    """
    prints = written(sketches(docs, id_col, text_col, size), "sketches")
    distinct = written(prints.groupBy("digest", "n", "sketch", "bands").agg(F.min("doc_id").alias("node")), "sketches-distinct")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")  # the least node is the first to link
        ids = pdf["node"].to_numpy(np.int64)
        bins = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint8).reshape(-1, BINS)
        found = np.array(loose_forest(bins), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": ids[found[:, 0]], "v": ids[found[:, 1]]})

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy(np.int64)
        found = np.array(exact_forest([np.unique(shingle_hashes(t, size)) for t in pdf["text"]], similarity), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": ids[found[:, 0]], "v": ids[found[:, 1]]})

    light = distinct.select("node", F.explode("bands").alias("key"), F.lit(0).cast("long").alias("n"))
    segments = _segments(distinct)
    near = written(connected_components(_met(light, distinct.select("node", "sketch"), search, "bands", segments), "similar-candidates"), "similar-near")
    texts = _texts(docs, id_col, text_col).withColumnRenamed("doc_id", "node")
    sizes = distinct.groupBy("node").agg(F.sum("n").alias("n"))
    light = near.join(sizes, "node").select("node", F.col("component").alias("key"), "n")
    found = connected_components(_met(light, texts, confirm, "similar", segments), "similar-components")
    to_component = written(distinct.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id")), "similar-groups")
    return prints.select("doc_id", "digest").join(to_component, "digest").select("doc_id", "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of which each near-duplicate group keeps one, that of the smallest id.

    Rows that share an id are one document and stay or go together; a row with
    a null id can't be named and stays. Extra columns stay, whatever their names.
    """
    gone = similar_groups(docs, id_col, text_col, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias("doc_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per document."""
    prints = written(fingerprints(docs, id_col, text_col, size), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-distinct")
    found = connected_components(links(distinct.filter("node is not null"), radius, leaf_size), "simhash-components")
    to_component = written(
        distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "simhash-groups"
    )
    return prints.join(to_component, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
