"""Sources and sinks of record linkage: tab-separated tables, truth, results, logs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")
RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in RECORD_COLUMNS])
# The columns of the two logs.
EXPERIMENT_COLUMNS = (
    "version", "day", "timestamp", "change", "normalization", "blocking", "features", "model", "threshold", "candidate_recall",
    "validation_precision", "validation_recall", "validation_f05", "leaderboard_score", "submission_path", "decision", "notes",
)
LEADERBOARD_COLUMNS = ("submission_version", "day", "submission_time", "public_score", "private_score", "validation_f05", "change", "notes")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_tsv(spark: SparkSession, path: str, expected: Sequence[str] = ()) -> DataFrame:
    """A tab-separated table of strings; quotes are text, missing is empty.

    The header decides the columns, in any order, and extra ones pass.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    found = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("inferSchema", False).csv(path)
    if missing := [c for c in expected if c not in found.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return found.na.fill("")


def write_tsv(df: DataFrame, path: str, single: bool = False, compression: str = "none") -> None:
    """Writes strings as they are: quotes, outer spaces and empty fields survive. ``read_tsv`` reads any compression."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("compression", compression)
    out.option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def repeated_ids(df: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """(id, n) of ids that occur more than once."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, id_col: str, what: str) -> DataFrame:
    if bad := repeated_ids(df, id_col).limit(5).collect():
        raise ValueError(f"{what} repeats ids, such as {', '.join(str(r[0]) for r in bad)}")
    return df


def read_train(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The three train tables and the truth, with unique ids."""
    tables = [require_unique(read_tsv(spark, f"{folder}/train_source{i}.tsv", RECORD_COLUMNS), "entity_id", f"train source {i}") for i in (1, 2, 3)]
    return (*tables, read_tsv(spark, f"{folder}/train_ground_truth.tsv", TRUTH_COLUMNS))


def read_test(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three test tables, with unique ids in all of them."""
    s1, s2, s3 = (require_unique(read_tsv(spark, f"{folder}/test_source{i}.tsv", RECORD_COLUMNS), "entity_id", f"test source {i}") for i in (1, 2, 3))
    return s1, s2, s3


def id_list(text: Column) -> Column:
    """Comma-separated ids as an array: trimmed, distinct in order; nothing for "", nan and none."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.trim(text), ","), lambda x: F.trim(x)), lambda x: x != ""))
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.lower(F.trim(text)).isin("", "nan", "none") | text.isNull(), none).otherwise(parts)


def parse_truth(truth: DataFrame, check: bool = True) -> DataFrame:
    """(source1_entity_id, matched): one row per record, singletons with an empty array."""
    if check:
        require_unique(truth, "source1_entity_id", "the truth")
    return truth.select("source1_entity_id", id_list(F.col("matched_entity_ids")).alias("matched"))


def truth_pairs(parsed: DataFrame) -> DataFrame:
    return parsed.select("source1_entity_id", F.explode("matched").alias("candidate_entity_id"))


def target_base(*tables: tuple[str, DataFrame]) -> DataFrame:
    """Named target tables as one, with ``source``; of equal ids the first table's record stays."""
    out = None
    for k, (name, df) in enumerate(tables):
        part = df.select(*RECORD_COLUMNS, F.lit(name).alias("source"), F.lit(k).alias("__k"))
        out = part if out is None else out.unionByName(part)
    first = Window.partitionBy("entity_id").orderBy("__k", *RECORD_COLUMNS[1:])
    return out.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__k", "__r")


def matching_results(predictions: DataFrame, s1: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids): one row per record, ids comma-joined, empty for none."""
    joined = s1.select(F.col("entity_id").alias("source1_entity_id")).distinct().join(predictions, "source1_entity_id", "left")
    return joined.select("source1_entity_id", F.coalesce(F.array_join(F.array_distinct("matched"), ","), F.lit("")).alias("matched_entity_ids"))


def write_matching_results(predictions: DataFrame, s1: DataFrame, path: str, single: bool = False) -> None:
    write_tsv(matching_results(predictions, s1).orderBy("source1_entity_id"), path, single)


def write_matching_groups(lists: DataFrame, members: DataFrame, path: str, compression: str = "none") -> None:
    """``write_matching_results`` of lists by group, (group, matched), for the records of ``members``, (source1_entity_id, group).

    Ids alone are dealt into ranges; a list travels once per group and range,
    not once per record.
    """
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.repartitionByRange(parts, "source1_entity_id").select("source1_entity_id", "group", F.spark_partition_id().alias("at"))
    dealt = ranged.groupBy("at", "group").agg(F.collect_list("source1_entity_id").alias("ids"))
    joined = dealt.join(lists.select("group", F.array_join(F.array_distinct("matched"), ",").alias("m")), "group", "left").repartitionById(parts, "at")
    rows = joined.select(F.explode("ids").alias("source1_entity_id"), F.coalesce("m", F.lit("")).alias("matched_entity_ids"))
    write_tsv(rows.sortWithinPartitions("source1_entity_id"), path, compression=compression)


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    return candidates.select("source1_entity_id", "candidate_entity_id").distinct()


def write_candidate_pairs(candidates: DataFrame, path: str, single: bool = False) -> None:
    write_tsv(candidate_pairs(candidates), path, single)


def archive(results: DataFrame, candidates: DataFrame, folder: str, day: int, version: str, metadata: dict) -> str:
    """Stores both results and a JSON of metadata under day{d}/{version}."""
    at = f"{folder}/day{day}/{version}"
    write_tsv(results, f"{at}/matching_results.tsv")
    write_tsv(candidates, f"{at}/candidate_pairs.tsv")
    spark = results.sparkSession
    text = json.dumps(metadata | {"day": day, "version": version}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/metadata.json")
    return at


def append_log(spark: SparkSession, path: str, row: dict, columns: Sequence[str] = EXPERIMENT_COLUMNS) -> None:
    """Appends one row to a CSV log of strings; fields that lack are empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    stamped = {"timestamp": None} | row
    df = spark.createDataFrame([tuple(None if stamped.get(c) is None else str(stamped[c]) for c in columns)], schema)
    if "timestamp" in columns:
        df = df.withColumn("timestamp", F.coalesce("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")))
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, columns: Sequence[str] = EXPERIMENT_COLUMNS) -> DataFrame:
    """A CSV log as strings, empty for missing; a log that is not there is empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path).na.fill("")
