import duckdb
import pytest
from pyspark.sql import functions as F

from kindred.llm import chat_format, exact_dedup, queries

from ..conftest import SF, same_rows

DOCS = "doc_id long, text string, group_size string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    same_rows(queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df())


ROWS = [(3, "a b", "x"), (1, "ab", "x"), (2, "a\tb\n", None), (4, None, "x"), (5, "", "x"), (6, " \r\x0b\x0c", "x"), (7, "a\u00a0b", "x"), (7, "a\u00a0b", "x"), (None, "ab", "x"), (8, "z" * 200_000, "x"), (None, "q", "x")]


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        norm = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {norm: (min(g)[3], len(g)) for norm, g in groups.items()}, groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    """Weak hashes collide and change nothing."""
    hashes = {"hash128": lambda n: F.length(n) % 2, "check": lambda n: F.lit("same")} if weak else {}
    got = exact_dedup.exact_dedup(spark.createDataFrame(ROWS, DOCS), **hashes).collect()
    keep, groups = brute(ROWS)
    want = sorted((str(x[3]), str(keep[n][0]), keep[n][1], x[3] == keep[n][0]) for n, g in groups.items() for x in g)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == want


def test_exact_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.kept_documents(spark.createDataFrame(ROWS, DOCS))
    assert kept.columns == ["doc_id", "text", "group_size"] and {r["doc_id"] for r in kept.collect()} == {2, 6, 7, 8, None}


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "bot", "yo"),
        (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "bot", "no"),
        (4, 5, "user", "hi"), (4, 6, "bot", "no"),
        (5, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"),
        (6, 0, "userh", "i"),
        (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, pos string")
    got = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    assert set(got) == {2, 3, 5, 6}
    assert got[3]["n_copies"] == 2 and got[5]["n_turns"] == 3
    assert got[2]["chat"] == "<|user|>\nhi\n<|bot|>\nyo\n<|user|>\nmore\n"
    assert got[5]["chat"] == "<||>\n\n<|user|>\nx\n<|user|>\nx\n"
    assert chat_format.format_chats(df.limit(0)).count() == 0
