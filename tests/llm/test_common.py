import os

from kindred.llm import common


def test_written_tables_and_release(spark):
    df = common.written(spark.range(3), "t")
    path = common._written[-1]
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    common.release(spark)
    assert not os.path.isdir(path.removeprefix("file:"))


def test_words_are_those_of_the_pattern():
    import re

    for text in ("A-b c\x00d É1_x\x7f~", "", None, "K İ", "\ud800 lone"):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        assert common.alnum_words(text) == [w.encode("utf-8", "surrogatepass") for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)]
