import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity, text

# Names with their normalised and core forms, addresses with their normalised form.
NAMES = [
    ("Acme Tech Pvt. Ltd.", "acme technologies pvt ltd", "acme technologies"),
    ("Müller GmbH & Co. KG", "muller gmbh", "muller"),
    ("Corp. Solns Intl", "corporation solutions international", "solutions international"),
    ("BlueSky-Sys K.K.", "bluesky systems kk", "bluesky systems kk"),
    ("Taylor & Associates S.A.R.L.", "taylor associates sa r l", "taylor associates r l"),
    ("Joe's A Class", "joe sa class", "joe class"),
    ("Foo Limited Liability Company", "foo llc", "foo"),
    ("Nova (Pty) Ltd", "nova pty ltd", "nova"),
    ("Sterling SAS", "sterling sa", "sterling"),
    ("株式会社", "", ""),
    (None, "", ""),
    ("", "", ""),
]
ADDRESSES = [
    ("12 Main St., Apt. 5", "12 main street apartment 5"),
    ("Dist. No. 4, MG Rd", "district number 4 mg road"),
    ("St. Mary's Ave #400", "street mary s avenue 400"),
]


def test_names_and_addresses(spark):
    rows = [(f"n{i}", n, "", "") for i, (n, *_) in enumerate(NAMES)] + [(f"a{i}", "", a, " us. ") for i, (a, _) in enumerate(ADDRESSES)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    got = {r["entity_id"]: r for r in text.normalized(df).collect()}
    for i, (_, norm, core) in enumerate(NAMES):
        assert (got[f"n{i}"]["business_name_norm"], got[f"n{i}"]["business_name_core"]) == (norm, core)
    for i, (_, norm) in enumerate(ADDRESSES):
        assert got[f"a{i}"]["business_address_norm"] == norm
        assert got[f"a{i}"]["country_norm"] == "US"


def test_tokens_numbers_and_ngrams(spark):
    df = spark.createDataFrame([("the a bc of x bc", "no 12, b34 56 12 ٣")], "n string, a string")
    r = df.select(text.content_tokens(F.col("n")).alias("t"), text.numbers(F.col("a")).alias("d"), text.ngrams(F.lit("abcab")).alias("g"), text.ngrams(F.lit("ab")).alias("h"), text.ngrams(F.lit("")).alias("e")).first()
    assert r["t"] == ["bc", "bc"]
    assert r["d"] == ["12", "56", "٣"]
    assert (r["g"], r["h"], r["e"]) == (["abc", "bca", "cab"], ["ab"], [])


def lcs(a, b):
    @lru_cache(None)
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return go(i + 1, j + 1) + 1 if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def plain_ratio(a, b):
    return 1.0 if not a + b else 2 * lcs(a, b) / (len(a) + len(b))


def plain_partial(a, b):
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    best = max(plain_ratio(a, b[max(0, i) : min(m, i + n)]) for i in range(1 - n, m))
    return best


def pairs(n, most, letters="abc d"):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    return [(word(), word()) for _ in range(n)]


def test_lcs_matches_recursion():
    data = [*pairs(300, 14), ("", ""), ("", "x"), ("é1", "1é"), ("a" * 70 + "b", "b" + "a" * 80)]
    assert similarity.lcs_lengths(data).tolist() == [lcs(a, b) for a, b in data]
    assert [similarity.lcs_length(a, b) for a, b in data] == [lcs(a, b) for a, b in data]


def test_partial_ratio_matches_all_windows():
    data = pairs(200, 9)
    got = similarity.partial_ratios(data)
    for (a, b), x in zip(data, got, strict=True):
        want = plain_partial(a, b)
        if len(a) == len(b):
            want = max(want, plain_partial(b, a))
        assert x == pytest.approx(want), (a, b)


@pytest.mark.parametrize(
    ("a", "b", "ratio", "sort", "token_set", "jac", "over"),
    [
        ("abcd", "abxd", 0.75, 0.75, 0.75, 0, 0),
        ("acme technologies", "technologies acme", 12 / 17, 1, 1, 1, 1),
        ("acme global technologies", "acme technologies", 34 / 41, 34 / 41, 1, 2 / 3, 1),
        ("", "", 1, 1, 0, 0, 0),
        ("", "x", 0, 0, 0, 0, 0),
    ],
)
def test_similarities(spark, a, b, ratio, sort, token_set, jac, over):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    parts = text.tokens(F.col("a")), text.tokens(F.col("b"))
    r = df.select(similarity.edit_ratios("a", "b").alias("e"), similarity.jaccard(*parts).alias("j"), similarity.overlap(*parts).alias("o")).first()
    assert r["e"]["ratio"] == pytest.approx(ratio)
    assert r["e"]["token_sort_ratio"] == pytest.approx(sort)
    assert r["e"]["token_set_ratio"] == pytest.approx(token_set)
    assert (r["j"], r["o"]) == (pytest.approx(jac), pytest.approx(over))


def test_ratios_are_bounded_and_symmetric():
    data = pairs(200, 20, "ab cde")
    back = [(b, a) for a, b in data]
    for f in (similarity.ratios, similarity.token_sort_ratios, similarity.token_set_ratios):
        x, y = f(data), f(back)
        assert ((x >= 0) & (x <= 1)).all()
        assert x.tolist() == pytest.approx(y.tolist())


def test_partial_ratio_is_the_best_window():
    rng = random.Random(3)

    def brute(a, b):
        if not a or not b:
            return float(not a and not b)
        best, sides = 0, [(a, b), (b, a)] if len(a) == len(b) else [sorted((a, b), key=len)]
        for s, t in sides:
            n = len(s)
            windows = [t[i : i + n] for i in range(len(t) - n + 1)] + [t[:k] for k in range(1, n)] + [t[len(t) - k :] for k in range(1, n)]
            best = max(best, *(2 * similarity.lcs_length(s, w) / (n + len(w)) for w in windows))
        return best

    pairs = [("x" * 70 + "abc", "y" * 100 + "bcz"), ("", ""), ("", "a"), ("é株", "xé株y")]
    for _ in range(600):
        letters = rng.choice(["ab", "abc ", "abcdefgh é"])
        pairs.append(tuple("".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice([3, 12, 40])))) for _ in range(2)))
    assert similarity.partial_ratios(pairs) == pytest.approx([brute(*p) for p in pairs], abs=1e-12)


def test_ratios_by_table_equal_those_by_pair():
    rng = random.Random(7)
    data = [("", ""), ("", "a"), ("é", "e"), ("a" * 64, "a" * 63 + "b"), ("x" * 65, "x" * 64), ("a b c d e f g h i j k l m", "m l"), ("a\tb", "b a"), ("a b", "a b")]
    for _ in range(3000):
        letters = rng.choice(["ab ", "abcdefgh  ", " \ta"])
        data.append(tuple("".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice([3, 12, 40, 70])))) for _ in range(2)))
    got = similarity.four_ratios([a for a, _ in data], [b for _, b in data])
    for k, f in enumerate((similarity.ratios, similarity.partial_ratios, similarity.token_sort_ratios, similarity.token_set_ratios)):
        assert got[:, k].tolist() == f(data).tolist()
    assert similarity.four_ratios([], []).shape == (0, 4)
