"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ensure_shipped

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))

#: ``bytes.translate`` table: A-Z to a-z, nothing else.
LOWER_TABLE = bytes.maketrans(_UPPER, _LOWER)

#: ``bytes.translate`` table for alphanumeric words: A-Z to a-z, every ASCII
#: character that is neither letter nor digit to a space. Bytes of 0x80 and
#: more (all bytes of non-ASCII characters) stay, so that splitting the result
#: at white space gives the runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORD_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)

#: The delimiters of alphanumeric words, as a Java and RE2 character class.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between two such words; splitting at it is cheaper than extracting the words.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Paths of the tables that ``written`` made.
_written: list[str] = []


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty and lone surrogates survive."""
    return (text or "").encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased alphanumeric words of a text (see ``WORD_TABLE``)."""
    return utf8(text).translate(WORD_TABLE).split()


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return utf8(text).translate(LOWER_TABLE).split()


def lower_ascii_safe(text: Column) -> Column:
    """Lower-cases natively so that ASCII letters come from ASCII letters only.

    Two characters outside ASCII have a lower case with an ASCII letter, the
    Kelvin sign and the dotted capital I. They turn into letters that have
    none, so words keep their borders and no ASCII word appears from nothing.
    """
    text = F.coalesce(text, F.lit(""))
    text = F.replace(text, F.lit("K"), F.lit("ĸ"))
    return F.lower(F.replace(text, F.lit("İ"), F.lit("ı")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a local master has none (tests on one machine) one is set; on a
    cluster its absence is an error, as executors would write to their own disks.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kindred-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again.

    It cuts the lineage: later stages read replicated files, so a lost
    executor costs the tasks it ran and not the whole history. The files go
    with ``release``, and else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marks(spark: SparkSession) -> int:
    """How many tables ``written`` has made so far, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes the tables that ``written`` made after the first ``since``, but the last ``but``; their frames are void then."""
    for path in _written[since : len(_written) - but]:
        _written.remove(path)
        fs, at = _file_system(spark, path)
        fs.delete(at, True)


def text_key(text: Column) -> Column:
    """128 bits of a text, null like empty, which tell rows of one id apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def without(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are not in ``bad`` (doc_id, key); null ids and rows that repeat an id are told by their texts.

    ``bad`` comes from a written table or from Python, so its columns can't be
    confused with those of ``docs``, whatever their names.
    """
    bad = bad.select(F.col("doc_id").alias("doc_id"), F.col("key").alias("key")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(bad["doc_id"]) & (text_key(docs[text_col]) == bad["key"])
    return docs.join(bad, same, "left_anti")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that the frame lacks, whatever the case."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def map_pandas(df: DataFrame, run, schema: str) -> DataFrame:
    ensure_shipped(df.sparkSession)
    return df.mapInPandas(run, schema)


def group_pandas(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    """Groups go to as many tasks as the session has shuffle partitions: their work is more than their bytes say, so these must not be coalesced."""
    spark = df.sparkSession
    ensure_shipped(spark)
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).groupBy(key).applyInPandas(run, schema)


def sub_batches(batches, size_of, limit: int = 8 << 20):
    """Splits pandas batches so that none holds much over ``limit`` bytes.

    One very long text forms a batch of its own.
    """
    for pdf in batches:
        start = total = 0
        for i, n in enumerate(size_of(pdf)):
            if total and total + n > limit:
                yield pdf.iloc[start:i]
                start, total = i, 0
            total += n
        if start < len(pdf):
            yield pdf.iloc[start:]


def text_sizes(pdf) -> list[int]:
    return [len(x) if x is not None else 0 for x in pdf["text"]]
