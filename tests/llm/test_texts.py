import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.llm import decontaminate, license_scan, line_dedup, packing, quality, queries, toxicity, url_filter

from ..conftest import SF, same_rows

DOCS = "doc_id long, text string, hits string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- decontamination ---------------------------------------------------------


def brute_hits(texts, items, size):
    out = {}
    for i, t in texts:
        w, hit, names = words(t), set(), set()
        for name, item in items:
            iw = words(item)
            for k in range(max(1, len(iw) - size + 1)) if iw else ():
                win = iw[k : k + size]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        names.add(str(name))
        out[i] = (len(w), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("block_words", [5, 10_000])
def test_decontaminate_matches_brute_force(spark, block_words):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(n))
    items = [(1, say(6)), (2, say(2)), (3, say(9)), (10, "ab, CD!ef"), (4, ""), (5, None), (6, "never occurs here"), (7, "É a")]
    texts = [(i, say(rng.randrange(60))) for i in range(40)] + [(100, None), (101, ""), (102, "..."), (103, "x é A y"), (104, "ab " * 3000)]
    docs, bench = spark.createDataFrame([(*t, "x") for t in texts], DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs, bench, window=4, block_words=block_words).collect()}
    assert got == brute_hits(texts, items, 4)
    left = decontaminate.clean_documents(docs, bench)
    assert left.columns == ["doc_id", "text", "hits"] and {r["doc_id"] for r in left.collect()} == {i for i, x in brute_hits(texts, items, decontaminate.WINDOW).items() if not x[1]}


@pytest.mark.parametrize("block_words", [2, 10_000])
def test_decontaminate_keeps_repeated_and_null_ids_apart(spark, block_words):
    docs = spark.createDataFrame([(1, "a b", ""), (1, "a b", ""), (1, "x c d", ""), (None, "c d", ""), (None, "z", "")], DOCS)
    bench = spark.createDataFrame([(7, "a b"), (8, "c d")], "item_id long, text string")
    bench = bench.unionByName(spark.createDataFrame([(None, "z")], bench.schema))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs, bench, block_words=block_words).collect())
    assert got == [("1", 2, 2, ["7"]), ("1", 2, 2, ["7"]), ("1", 3, 2, ["8"]), ("None", 1, 1, []), ("None", 2, 2, ["8"])]


def test_decontaminate_of_nothing(spark):
    docs, bench = spark.createDataFrame([(1, "a b", "")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.decontaminate(docs, bench).collect()] == [(1, 2, 0, [])]
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta", ""), (2, "alpha x x x x x x beta", ""), (3, "beta", ""), (4, "alpha", "")], DOCS)
    index = decontaminate.build_index(docs)
    found = decontaminate.matches(index, spark.createDataFrame([(9, "beta alpha")], "item_id long, text string"), span=3)
    assert {r["id"]: r["items"] for r in found.collect()} == {1: ["9"], 2: [], 3: [], 4: []}


def test_op5_digests(spark):
    r = queries.op5_decontaminate(spark, SF).filter("n_items = 0").first()
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest() and not r["contaminated"]


# --- packing -----------------------------------------------------------------


def check_packing(rows, texts, window):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[i])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


TRICKY = ["a  b", "a   b", " lead", "trail ", "x\n\n y", " \n z", "don't we'll", "1234 ab12", "é ü\u00a0ß 株式", "<|endoftext|> x", "\x1c\x1d a", "a \t b", "😀 😀😀", "\u2028 q  \u3000r"]


def test_packing_is_an_exact_round_trip(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta's", "x,", "Ünï"]) for _ in range(n))
    texts = [(i, say(rng.randrange(400))) for i in range(60)] + [(100, ""), (101, None), (102, say(5000))] + list(enumerate(TRICKY, 200))
    docs = spark.createDataFrame([(*t, "x") for t in texts], DOCS)
    check_packing(packing.pack(docs, window=128, shard_tokens=3000).collect(), texts, 128)
    assert packing.pack(docs.limit(0)).count() == 0


def test_encoder_equals_whole_text_encoding():
    rng = random.Random(8)
    encoder = packing.Encoder.of(packing.default_vocabulary())
    texts = TRICKY + ["".join(rng.choice(" \t\n\r\u00a0ab1.'é\u2003") for _ in range(rng.randrange(30))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [encoder.bpe.encode_ordinary(t) for t in texts]


def test_bm25_prefers_shared_rare_words():
    docs = [np.array(x, dtype=np.uint64) for x in ([1, 1, 2, 9], [1, 3], [9, 4, 1], [5])]
    assert packing.Bm25(docs).neighbours(0).tolist()[:2] == [0, 2]
    assert packing.Bm25(docs).neighbours(3).tolist() == []


def test_windows_hold_the_best_unused_neighbours():
    """The greedy fill against plain BM25 scores over all words."""
    rng = random.Random(2)
    docs = [np.array([rng.randrange(40) if rng.random() < 0.5 else 100 + 10 * (k % 6) + rng.randrange(10) for _ in range(rng.randrange(5, 30))], dtype=np.uint64) for k in range(60)]
    sets, mean = [d.tolist() for d in docs], sum(map(len, docs)) / len(docs)

    def score(q, d):
        total = 0
        for w in set(sets[q]):
            df = sum(w in s for s in sets)
            tf = sets[d].count(w)
            total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) if tf and df > 1 else 0
        return total

    index = packing.Bm25(docs)
    for q in range(0, 60, 7):
        want = sorted((d for d in range(60) if score(q, d)), key=lambda d: (-round(score(q, d), 9), d))
        assert index.neighbours(q).tolist() == want
    used = [0] * 60
    for pieces in packing.fill(np.array([len(d) for d in docs]), index, 64):
        seed, at = pieces[0][0], 0
        for d, a, b in pieces[1:]:  # no unused neighbour that scores higher is passed over
            free = [x for x in range(60) if used[x] < len(docs[x]) and x not in {p[0] for p in pieces[: at + 1]}]
            if score(seed, d):
                assert score(seed, d) >= max(score(seed, x) for x in free) - 1e-9
            at += 1
        for d, _, b in pieces:
            used[d] = b
    assert used == [len(d) for d in docs]


def test_lexical_routing_brings_copies_together(spark):
    rng = random.Random(5)
    words = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = [t for t in (words() for _ in range(100)) for t in (t, t + " own end")]
    pieces = packing.tokenised(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOCS), "doc_id", "text", 1024, packing.default_vocabulary())
    home = {r["doc_id"]: r["shard"] for r in packing.dealt(pieces, 2000).collect()}
    assert len(set(home.values())) > 15 and sum(home[i] == home[i + 1] for i in range(0, 200, 2)) > 85
    same = spark.createDataFrame([(None, texts[0], "")] * 300, DOCS)  # one hot key, null ids
    shards = packing.dealt(packing.tokenised(same, "doc_id", "text", 1024, packing.default_vocabulary()), 10_000).groupBy("shard").count().collect()
    assert len(shards) >= 6 and max(r["count"] for r in shards) < 100


def test_stop_words_are_counted_over_all_tails(spark):
    """Tails carry their least word codes; the key is the least one that few of all tails carry."""
    rng = random.Random(9)
    texts = [" ".join(["the", "of", *(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40))), "and"]) for _ in range(400)] + ["the of and", "", "w1"]
    encoder = packing.Encoder.of(packing.default_vocabulary())
    ids = [np.frombuffer(x, dtype="<u2") for x in encoder.encode(texts)]
    words = [sorted(set(packing.word_codes([d], encoder.opens)[0].tolist())) for d in ids]
    for got, own in zip(packing.least_codes(ids, encoder.opens), words, strict=True):
        assert got.tolist() == own[: len(got)] and len(got) >= min(1, len(own))
    tails = packing.tokenised(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOCS), "doc_id", "text", 1024, packing.default_vocabulary())
    signed = lambda c: c - 2**64 if c >= 2**63 else c
    carried = [[signed(c) for c in got.tolist()] for got in packing.least_codes(ids, encoder.opens)]
    count = collections.Counter(c for x in carried for c in x)
    few = lambda x: next((c for c in x if count[c] <= packing.STOP_SHARE * len(texts)), None)
    keys = {r["doc_id"]: r["key"] for r in packing.lexical_keys(tails, len(texts)).collect()}
    assert max(count.values()) > 100 and all(keys[i] == few(x) for i, x in enumerate(carried) if few(x) is not None) and None not in keys.values()


# --- licences ----------------------------------------------------------------


def test_license_scan(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "mit  LICENSE, Apache-License version 2.0 and the General Public\nLicense"), (3, None), (4, ""), (5, "permit license"),
        (6, "mit license mit license"), (7, "licensed MİT License K"), (8, "x " * 20000 + "apache license"),
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame([(*r, "x") for r in rows], DOCS)).collect()}
    base = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for i, t in rows:
        w = words(t)
        places = sorted((p, n) for n, ph in base.items() for p in range(len(w)) if w[p : p + len(ph)] == ph)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places)), i
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({n for _, n in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "apache-2.0" in got[2]["labels"] and got[3]["score"] == 0
    assert license_scan.license_scan(spark.createDataFrame([], DOCS)).count() == 0


# --- classifiers -------------------------------------------------------------


def labelled_corpus(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["stone", "river", "walks", "under", "green", "light", "often"]) for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = say(rng.randrange(20, 80))
        if bad:
            text = text.upper().replace(" ", "!! ")
        if toxic:
            text += " you vile worm " + say(5)
        docs.append((i, text, "x"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, "x"), (1001, "", "x"), (0, docs[0][1], "x"), (None, "stone", "x"), (1002, "river " * 50_000, "x")]
    labels += [(None, 1, 1), (5000, 1, 0), (1, None, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "column", "parts", "held"), [(quality.quality_scores, "quality", 5, 0), (toxicity.toxicity_scores, "toxic", 4, 2)])
def test_classifiers_on_the_held_out_fold(spark, run, column, parts, held):
    docs, labels = labelled_corpus(spark)
    rows = run(docs, labels).collect()
    assert len(rows) == docs.count()
    y = {r["doc_id"]: r[column] for r in labels.collect()}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == held)
    test = [r for r in rows if r["held_out"] and y.get(r["doc_id"]) is not None]
    assert len(test) > 30 and sum(r["predicted"] == y[r["doc_id"]] for r in test) / len(test) > 0.95
    assert run(docs.limit(0), labels).count() == 0
    assert run(docs.limit(5), labels.limit(0)).count() == 5


def test_quality_ignores_labels_of_the_held_out_fold(spark):
    docs, labels = labelled_corpus(spark)
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == ["doc_id", "text", "hits"]


# --- URLs and lines ----------------------------------------------------------


def test_url_filter(spark):
    url = lambda u, html=None: (u, html)
    rows = [
        url("https://a.example.com/en/1"), url("http://www.example.com/en/77?x#y"), url("HTTP://Example.COM/EN/1"), url("https://example.net/de/81"), url("x://net/de/"),
        url("https://notcom/en/1"), url("no scheme"), url(None), url(""), url("https://user@h.org/es/"), url("https://h.org?q=/es/"),
        url("https://free.info/a", '<link href="https://bad.com/en/9" rel="canonical">'), url("https://free.info/b", '<LINK REL=canonical HREF="https://free.info/a">'),
        url("https://free.info/b#top"), url("https://mixed.info/c", '<link rel="canonical" href="https://example.com/en/7"><meta http-equiv="refresh" content="0; url=https://bad.com/en/3">'),
        url("https://alone.info/", "<p>none</p>"),
    ]
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "page_id long, url string, html string, node string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got == {
        0: ("com/en/", "block"), 1: ("example.com/en/7", "allow"), 2: (None, "allow"), 3: ("example.net/de/8", "block"), 4: ("net/de/", "allow"), 5: (None, "allow"),
        6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("org/es/", "block"), 10: (None, "allow"), 11: (None, "block"), 12: (None, "block"), 13: (None, "block"),
        14: (None, "allow"), 15: (None, "allow"),
    }
    redirects = spark.createDataFrame([("https://alone.info/", "https://bad.com/en/9")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, redirects=redirects).collect()}[15] == "block"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def linked_pages(rng, n=150):
    hosts, paths = ["bad.com", "a.example.com", "x.net", "free.info", "h.org", "z.io"], ["/en/1", "/en/", "/de/81", "/de/", "/es/", "/a/b/c", "/a/", "", "/q", "/en/77"]
    url = lambda: rng.choice(["https://", "http://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "", "/", "?id=1", "?utm_source=x&id=1", "#top"])
    odd = ["w1.html", "w2.html", "../x", "?q=1", "/go?u=http://h/x", "//bad.com/en/", "mailto:x@y", "#f", "./a/../b/..", "?a=1&amp;b=2", "../../../../en/1", "https://bad.com/en/", "https://bad.com/en/z"]
    rows = []
    for i in range(n):
        t, html = rng.choice([url(), url(), rng.choice(odd)]), None
        if rng.random() < 0.5:
            html = "<p>x</p>" + rng.choice([f'<link href="{t}" rel="canonical">', f"<LINK REL=canonical HREF='{t}'/>", f'<meta http-equiv="refresh" content="0; url={t}">', f'<a href="{t}">', f'<link rel="stylesheet" href="{t}">'])
        rows.append((i, url() if rng.random() < 0.95 else rng.choice([None, "", "no scheme"]), html))
    return [*rows, rows[0], (None, rows[1][1], rows[1][2])]


@pytest.mark.parametrize("seed", [1, 2])
def test_url_filter_matches_its_sql_on_linked_pages(spark, seed):
    rows = linked_pages(random.Random(seed))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert ((got["verdict"] == "block") & got["rule"].isna()).any()  # blocked by an alias alone
    same_rows(got, con.execute(queries.ORACLE_SQL["op8_url_filter"]).df())


def test_link_targets_resolve_as_in_browsers(spark):
    from urllib.parse import urljoin

    pages = ["https://h.org/a/b?x=1", "http://h.org", "https://h.org/a/b/"]
    targets = ["w.html", "../x", "../../../x", "./y/", "?q=2", "/z?u=http://h/x", "//o.net/k", "https://o.net/k", "..", "a/./b/../c", "&amp;x"]
    df = spark.createDataFrame([(p, t) for p in pages for t in targets], "p string, t string")
    got = {(r["p"], r["t"]): r["u"] for r in df.select("p", "t", url_filter.absolute(F.col("t"), F.col("p")).alias("u")).collect()}
    assert got == {(p, t): urljoin(p, t.replace("&amp;", "&")) if p.count("/") > 2 or t[0] != "?" else p + "/" + t for p in pages for t in targets}
    none = df.limit(1).select(*(url_filter.absolute(F.lit(t), F.lit(pages[0])).alias(f"c{i}") for i, t in enumerate(["", "#x", "mailto:a@b", "javascript:void(0)"])))
    assert set(none.first()) == {None}


def test_line_dedup(spark):
    rows = [(i, "a", f"Menu\nown {i}\n menu2 \n\nMenu\nend") for i in range(18)] + [(100, "a", None), (101, "a", "plain"), (102, "b", "Menu\nx"), (103, None, "Menu\n"), (104, "a", "Menu")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n", F.lit(1))
    out = line_dedup.drop_boilerplate(df, F.col("source"), ratio=0.5, count_as="cut")
    got = {r["doc_id"]: (r["text"], r["cut"]) for r in out.collect()}
    assert got[3] == ("own 3\n", 4) and got[100] == (None, 0) and got[101] == ("plain", 0) and got[102] == ("Menu\nx", 0) and got[103] == ("Menu\n", 0) and got[104] == ("", 1)
    assert out.columns == ["doc_id", "source", "text", "n", "cut"]
    assert line_dedup.drop_boilerplate(df.limit(0), F.col("source")).count() == 0
    three = spark.createDataFrame([(i, "s", f"line {i}") for i in range(3)], "doc_id long, source string, text string")
    assert {r["text"] for r in line_dedup.drop_boilerplate(three, F.col("source"), ratio=0.2, least=1).collect()} == {""}
    assert {r["text"] for r in line_dedup.drop_boilerplate(three, F.col("source"), ratio=0.2).collect()} == {"line 0", "line 1", "line 2"}


@pytest.mark.parametrize("least", [1, 2])
def test_line_dedup_matches_brute_force_on_sites_of_all_sizes(spark, least):
    rng, rows = random.Random(8), []
    for size in range(1, 31):
        for _ in range(size):
            lines = [rng.choice(["Menu", "About us", " padded\t", "", f"own {rng.randrange(40)}"]) for _ in range(rng.randrange(7))]
            rows.append((len(rows), f"site{size}", "\n".join(lines)))
    rows.append((len(rows), "site30", "\n".join(f"line {k}" for k in range(30_000)) + "\nMenu"))
    pages, seen = {}, {}
    for _, s, t in rows:
        pages[s] = pages.get(s, 0) + 1
        for line in {x.strip(" \t") for x in t.split("\n")} - {""}:
            seen[s, line] = seen.get((s, line), 0) + 1
    bad = {k for k, n in seen.items() if n >= least and n > 0.1 * pages[k[0]]}
    want = {i: "\n".join(x for x in t.split("\n") if (s, x.strip(" \t")) not in bad) for i, s, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(df, F.col("source"), least=least).collect()} == want
