import random

import pytest

from kindred.llm import decontaminate, line_dedup
from kindred.llm.common import space_words, table

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ..conftest import SF  # noqa: E402
from .test_texts import brute_hits, check_packing  # noqa: E402


def similarity(a, b):
    def shingles(text):
        w = space_words(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0  # texts without words are copies of each other


def without_boilerplate(docs):
    """Brute force of the second stage."""
    pages, seen = {}, {}
    for r in docs:
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for line in {x.strip(" \t\x0b\f\r") for x in r["text"].split("\n")} - {""}:
            seen[r["source"], line] = seen.get((r["source"], line), 0) + 1
    bad = {(s, line) for (s, line), n in seen.items() if n >= line_dedup.LEAST and n > line_dedup.RATIO * pages[s]}
    return {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" \t\x0b\f\r")) not in bad) for r in docs}


def test_stages_match_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    before = docs.collect()
    rows = [before]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows.append(docs.collect())
    text = [{r["doc_id"]: r["text"] for r in x} for x in rows]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    right = sum((i in text[1]) == bool(q) for i, q in labels.items() if i in text[0])
    assert right > 0.95 * len(labels)

    assert text[2] == without_boilerplate(rows[1])
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2])

    ids = sorted(text[2])
    partners = {i: [j for j in ids if i != j and similarity(text[2][i], text[2][j]) >= 0.76] for i in ids}
    for i in ids:
        if i not in text[3]:
            assert partners[i] and min(partners[i]) != i
        elif any(j in text[3] and j != i and similarity(text[2][i], text[2][j]) >= 0.84 for j in ids):
            pytest.fail(f"{i} has a near copy left")

    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    hits = brute_hits(text[3].items(), items, decontaminate.WINDOW)
    assert set(text[4]) == {i for i, (_, n, _) in hits.items() if not n}

    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), list(text[4].items()), 1024)


def test_run_is_the_chain_of_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def odd_documents(spark, columns):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns named like the operators' own."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["stone", "river", "walks", "under", "green", "light", "often"]) + str(rng.randrange(50)) for _ in range(n))
    rows = []
    for i in range(120):
        text = say(rng.randrange(20, 90))
        rows.append((i, text.upper().replace(" ", "!! ") if i % 5 == 0 else text, "en", f"s{i % 3}"))
    one = say(60)
    rows += [(200, one, "en", "s0"), (201, one, "en", "s1"), (202, one + " more", "en", "s0"), (203, None, None, None), (204, "", "", ""), (205, "river " * 30_000, "en", "s0")]
    rows += [rows[3], rows[3], (None, say(50), "en", "s0"), (None, None, None, None), (None, say(50).upper().replace(" ", "!! "), "en", "s0")]
    rows += [(300, "Menu\n" + say(20), "en", "small"), (301, "Menu\n" + say(20), "en", "small"), (302, say(9), "en", "alone")]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in columns)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *(f"{c}{k}" for c in columns)) for k, r in enumerate(rows)], schema)


CLASHES = ["key", "row", "site", "page", "bad", "parts", "kept", "hits", "dropped", "__bad", "__gone", "__site", "__kept", "__dropped", "node", "u", "v", "component_id", "score", "predicted", "a.b"]


def test_stages_on_odd_tables(spark, tmp_path):
    docs = odd_documents(spark, CLASHES)
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(120)] + [(None, 1, 1), (5, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    late = docs.filter("doc_id = 7").first()["text"]
    spark.createDataFrame([(1, late), (None, docs.filter("doc_id = 8").first()["text"]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extras = [f"`{c}`" for c in CLASHES]
    before = {tuple(r) for r in docs.select(*extras).collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert {tuple(r) for r in now.select(*extras).collect()} <= before  # no column of the user's is touched
        texts = {r["text"] for r in now.filter("doc_id is null").collect()}
        ids, was = ([r["doc_id"] for r in x.select("doc_id").collect()] for x in (now, docs))
        if k == 0:  # the text decides: of the null ids the shouting one goes and the plain one stays, as do repeats
            assert not any(t and t.isupper() for t in texts) and any(t and "!!" not in t for t in texts) and ids.count(3) == 3 and not any(i % 5 == 0 for i in ids if i is not None and i < 120)
        if k == 1:
            text = {r["doc_id"]: r["text"] for r in now.collect()}
            assert len(ids) == len(was) and text.get(203) is None and not text.get(300, "").startswith("Menu") and text.get(302, "x")
        if k == 2:
            assert {200, 201, 202}.intersection(ids) == {min({200, 201, 202}.intersection(was))} and len({203, 204}.intersection(ids)) == min(1, len({203, 204}.intersection(was))) and ids.count(3) == 3 and ids.count(None) == was.count(None)
        if k == 3:  # an item without id hits as well
            assert 7 in was and 7 not in ids and 8 in was and 8 not in ids and ids.count(None) == was.count(None)
        docs = now
    assert stage(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
