"""Dataset profile: cardinality, sources, countries, missing values, lengths, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import RECORD_COLUMNS


def cardinality(truth: DataFrame) -> DataFrame:
    n = F.size("matched")
    return truth.agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(n == 0).alias("matches_0"), F.count_if(n == 1).alias("matches_1"),
        F.count_if(n == 2).alias("matches_2"), F.count_if(n >= 3).alias("matches_3_plus"), F.coalesce(F.sum(n), F.lit(0)).alias("total_pairs"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_matches"),
    )


def source_of(entity_id: Column) -> Column:
    """The source that an id names: S2 before S3, else null."""
    return F.when(entity_id.contains("S2"), "S2").when(entity_id.contains("S3"), "S3")


def source_split(truth: DataFrame) -> DataFrame:
    pairs = truth.select(F.explode("matched").alias("t")).select(source_of(F.col("t")).alias("source"))
    return pairs.filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("positives"))


def countries(records: DataFrame, n: int | None = 10) -> DataFrame:
    """Countries by falling count, ties by name; an empty one is MISSING."""
    name = F.when(F.coalesce(F.col("country"), F.lit("")) == "", "MISSING").otherwise(F.col("country"))
    counted = records.groupBy(name.alias("country")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "country")
    return counted if n is None else counted.limit(n)


def _per_table(tables: dict[str, DataFrame], of) -> DataFrame:
    return reduce(DataFrame.unionByName, (of(df).select(F.lit(name).alias("table"), "*") for name, df in tables.items()))


def missing(tables: dict[str, DataFrame]) -> DataFrame:
    """Empty (or null) values per table and column."""
    return _per_table(tables, lambda df: df.agg(*(F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(c) for c in RECORD_COLUMNS)))


def lengths(tables: dict[str, DataFrame], columns=("business_name", "business_address")) -> DataFrame:
    """Characters and words (white-space runs plus one), over all rows."""

    def of(df: DataFrame) -> DataFrame:
        def one(c: str) -> DataFrame:
            words = F.regexp_count(c, F.lit(r"\s+")) + 1
            return df.agg(
                F.avg(F.length(c)).alias("avg_char_len"), F.max(F.length(c)).alias("max_char_len"), F.avg(words).alias("avg_word_count"), F.max(words).alias("max_word_count")
            ).select(F.lit(c).alias("column"), "*")

        return reduce(DataFrame.unionByName, map(one, columns))

    return _per_table(tables, of)


def duplicates(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, distinct ids and surplus rows per table."""
    counted = _per_table(tables, lambda df: df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_id").alias("distinct_ids")))
    return counted.withColumn("duplicates", F.col("rows") - F.col("distinct_ids"))
