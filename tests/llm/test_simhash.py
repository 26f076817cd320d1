import random

import numpy as np
import pytest
import xxhash

from kindred.llm import components, simhash

DOCS = "doc_id long, text string, fp string"


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    for t in texts[:30]:
        words = t.split()
        words[rng.randrange(len(words))] = "Changed"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), "", None, " \n", "one", "one two", "Été\u00a0x y", "w1 " * 5000]
    return list(enumerate(texts, 10))


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame([(*r, "clash") for r in rows], DOCS), leaf_size=8).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b c d", ""), (1, "a b c d", ""), (None, "a b c d", ""), (None, "other words here", "")], DOCS)
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_tree_loses_no_pair(radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64))
    dense = np.uint64(12345) ^ np.arange(200, dtype=np.uint64)
    fps = np.unique(np.concatenate((base, near, dense)))
    want = plain_components(range(len(fps)), lambda a, b: int(fps[a] ^ fps[b]).bit_count() <= radius)
    edges = simhash.forest(fps, radius, leaf_size=16)
    assert all(int(fps[a] ^ fps[b]).bit_count() <= radius for a, b in edges)
    linked = {frozenset(e) for e in edges}
    assert plain_components(range(len(fps)), lambda a, b: frozenset((a, b)) in linked) == want
    nodes = simhash.build_tree(fps[::3], 16)
    homes = [set(w.tolist()) for _, w in simhash.route(nodes, fps, radius)]
    for a in range(0, len(fps), 5):
        for b in range(len(fps)):
            if int(fps[a] ^ fps[b]).bit_count() <= radius:
                assert any(a in h and b in h for h in homes)


@pytest.mark.parametrize("shape", ["path", "star", "mixed", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(7, i) for i in range(100)],
        "mixed": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(1, 1), (None, 3)],
        "none": [],
    }[shape]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
    nodes = sorted({x for e in real for x in e})
    assert got == plain_components(nodes, lambda a, b: frozenset((a, b)) in real)


def test_similar_groups(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows, want = [], {}
    for g in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(100, 400))]
        for c in range(4):
            copy = list(words)
            if c:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy), ""))
            want[len(rows) - 1] = len(rows) - 1 - c
    half = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(20):  # half of the words shared: not similar enough
        rows.append((len(rows), " ".join(half + [rng.choice(vocabulary) for _ in range(200)]), ""))
        want[len(rows) - 1] = len(rows) - 1
    rows += [(len(rows), "", ""), (len(rows) + 1, None, "")]
    want |= {len(rows) - 2: len(rows) - 2, len(rows) - 1: len(rows) - 2}
    df = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()} == want
    kept = simhash.first_of_groups(df)
    assert kept.columns == ["doc_id", "text", "fp"] and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_hot_bucket_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 20)
    monkeypatch.setattr(simhash, "ANCHORS", 5)
    words = [f"v{i}" for i in range(600)]
    rows = [(i, " ".join(words[:100] + [f"own{i}"] + words[100:]), "") for i in range(120)]
    assert {r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, DOCS)).collect()} == {0}


def test_large_bucket_keeps_its_small_groups(spark, monkeypatch):
    rng = random.Random(4)
    passage = [f"v{i}" for i in range(150)]
    rows = []
    for g in range(10):  # all share a passage and many a band, but only copies are similar enough
        words = passage + [f"g{g}w{i}" for i in range(60)]
        for c in range(2):
            rows.append((len(rows), " ".join(words + [f"c{c}"]), ""))
    rows += [(len(rows) + i, " ".join(passage + [f"own{i}"]), "") for i in range(12)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS)
    want = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    assert all(want[g] == g - g % 2 for g in range(20)) and {want[g] for g in range(20, 32)} == {20}
    monkeypatch.setattr(simhash, "GROUP", 1)  # about one member a group
    monkeypatch.setattr(simhash, "ANCHORS", 0)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()} == want
    monkeypatch.setattr(simhash, "GROUP", 4)
    monkeypatch.setattr(simhash, "MANY", 0)  # all that is left apart is split by segments
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()} == want


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)))
    (x, _), (y, _) = simhash.sketch(a), simhash.sketch(b)
    assert simhash.jaccard(x[None, :], y)[0] == pytest.approx(0.8, abs=0.1)


def shingle_jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_similarity_is_decided_by_the_shingle_sets(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for g in range(60):  # a tail of other words: pairs just at and just below 0.8
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(500)]
        for tail in (0, 55 if g % 2 else 57):
            at = len(rows)
            rows.append((at, " ".join(words[: 500 - tail] + [f"g{g}t{i}" for i in range(tail)]), ""))
        a, b = rows[-2][1], rows[-1][1]
        assert abs(shingle_jaccard(a, b) - 0.8) < 0.01
        want |= {at - 1: at - 1, at: at - 1 if shingle_jaccard(a, b) >= 0.8 else at}
    assert {want[i] == i for i in range(1, 120, 2)} == {True, False}
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, DOCS)).collect()} == want


def test_exact_forest_matches_all_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(12, rng.integers(0, 12))).astype(np.uint64) for _ in range(80)]
    edges = {frozenset(e) for e in simhash.exact_forest(sets, 0.8)}
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    assert all(alike(*e) for e in edges)
    assert plain_components(range(80), lambda a, b: frozenset((a, b)) in edges) == plain_components(range(80), alike)


def test_repeats_do_not_part_equal_shingle_sets(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(20):  # the padding's repeats sway the fingerprint, not the set of shingles
        words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))
        rows += [(len(rows), words + " pad" * 5, ""), (len(rows) + 1, words + " pad" * 100, "")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i - i % 2 for i in range(40)}
