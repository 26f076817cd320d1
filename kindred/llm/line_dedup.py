"""Line deduplication by site-relative frequency.

A line is boilerplate of its site when the share of the site's pages that hold
it exceeds a ratio. Lines are made distinct within a page and travel as
128-bit hashes; counts per site and line combine map-side before the shuffle,
so a site with a third of all pages sends one row per line and task. Page
totals come from the same pass, under the empty hash.

A line that a single page holds repeats nothing, so ``least`` (2) pages have to
hold it; with ``least`` 1 the ratio alone decides, and a site of one page
loses its text. There is no least size of a site otherwise.

A page has finitely many lines, so a site has at most (lines per page) / ratio
boilerplate lines. Each site's set of them is one row of a written table, which
pages look up by site; a page's text is filtered in place and never regrouped.

Defined results: a null text stays null and has no lines; an empty line is
never boilerplate; pages without site (null or empty) form a site of their own;
a text all of whose lines go becomes empty; repeated rows and rows with a null
id are pages each; other columns stay as they are, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RATIO = 0.1
LEAST = 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    """The hash (hexadecimal) of a line without white space around it; null for a blank one."""
    bare = F.trim(F.regexp_replace(line, r"[\t\x0B\f\r]", " "))
    return F.when(bare != "", F.md5(bare))


def _hashes(text: Column) -> Column:
    return F.array_compact(F.array_distinct(F.transform(lines_of(text), line_hash)))


def boilerplate(pages: DataFrame, site: Column, text: Column, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """site, key, n, pages: the lines that too many pages of a site hold."""
    total = F.lit(b"")
    rows = pages.select(F.coalesce(site, F.lit("")).alias("site"), F.explode(F.array_append(F.coalesce(_hashes(text), F.array().cast("array<string>")), "")).alias("key"))
    rows = rows.select("site", F.unhex("key").alias("key"))
    counts = rows.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.filter((F.col("n") >= least) | (F.col("key") == total)), "line-counts")
    sites = counts.filter(F.col("key") == total).select("site", F.col("n").alias("pages"))
    lines = counts.filter(F.col("key") != total)
    # One row per site; the planner broadcasts it only if it is small.
    return written(lines.join(sites, "site").filter(F.col("n") > F.lit(ratio) * F.col("pages")), "boilerplate")


def drop_boilerplate(pages: DataFrame, site: Column, text_col: str = "text", ratio: float = RATIO, least: int = LEAST, count_as: str | None = None) -> DataFrame:
    """The pages with boilerplate lines cut from the text; ``count_as`` adds (or replaces) a column with their number."""
    bad = boilerplate(pages, site, F.col(text_col), ratio, least)
    # One row per site with boilerplate, bounded by (lines per page) / ratio
    # hashes. Written, so that the planner knows its size: it broadcasts a
    # small one, and else both sides are dealt by site and skew is split.
    per_site = written(bad.groupBy("site").agg(F.collect_set(F.lower(F.hex("key"))).alias("bad")), "boilerplate-sites")
    # A page travels as one field, so that no name of its columns can clash.
    packed = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page"), F.coalesce(site, F.lit("")).alias("site"), F.col(text_col).alias("text"))
    joined = packed.join(per_site, "site", "left")
    # The lines to cut, by one hash set of the site's list; most pages have none and keep their text untouched.
    hit = joined.withColumn("hits", F.when(F.col("bad").isNotNull(), F.array_intersect(_hashes(F.col("text")), F.col("bad"))))
    kept = hit.withColumn("parts", F.when(F.size("hits") > 0, lines_of(F.col("text"))))
    kept = kept.withColumn("kept", F.filter("parts", lambda x: ~F.coalesce(F.array_contains("hits", line_hash(x)), F.lit(False))))
    cut = F.when(F.col("parts").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    dropped = F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts") - F.size("kept")).cast("long")
    new = {text_col: cut} | ({count_as: dropped} if count_as else {})
    return kept.select(*(new.pop(c, F.col("page").getField(c)).alias(c) for c in pages.columns), *(x.alias(c) for c, x in new.items()))
