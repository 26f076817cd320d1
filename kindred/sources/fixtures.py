"""Synthetic business records, generated by hashes of row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST = ("Apex", "Summit", "Clearwater", "Evergreen", "Pioneer", "Sterling", "Nova", "Blue Ridge", "Harbor", "Crescent", "Atlas", "Juniper", "Redwood", "Lakeside", "Beacon", "Orchid")
_SECOND = ("Logistics", "Analytics", "Technologies", "Foods", "Solutions", "Systems", "Enterprises", "Services", "Holdings", "Manufacturing", "Engineering", "Group")
_STREETS = ("Elm Street", "Oak Avenue", "Harbor Road", "Main Street", "Lake Drive", "Park Lane", "Mill Road", "Church Street", "Station Road", "Garden Avenue", "King Street", "Queen Street")
#: Countries with a legal form of each; a choice of this library's own.
_SUFFIXES = {"US": "Inc.", "IE": "Ltd", "AT": "GmbH", "BE": "SA", "ZA": "Pty Ltd", "NZ": "Limited", "ES": "S.L.", "IT": "S.r.l.", "SE": "AB", "PL": "Sp. z o.o."}
_COUNTRIES = tuple(_SUFFIXES)


def _draw(seed: int, what: str, n: int, *keys: Column) -> Column:
    """A number below n, the same for the same keys on every cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *keys), F.lit(n)).cast("int")


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def _noisy_name(name: Column, seed: int, *keys: Column) -> Column:
    """Of 20: 5 lose the legal form, 3 each abbreviate, change case, drop a letter, move the first word or stay."""
    k = _draw(seed, "noise", 20, *keys)
    words = F.split(name, " ")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "Technologies", "Tech"), "Solutions", "Soln"), "Services", "Svcs")
    return (
        F.when(k < 5, F.array_join(F.slice(words, 1, 3), " ")).when(k < 8, short).when(k < 11, F.upper(F.regexp_replace(name, r"\.", "")))
        .when(k < 14, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 200))).when(k < 17, F.concat_ws(" ", F.slice(words, 2, 20).getItem(0), words[0], F.array_join(F.slice(words, 3, 20), " ")))
        .otherwise(name)
    )


def _noisy_address(address: Column, seed: int, *keys: Column) -> Column:
    k = _draw(seed, "layout", 5, *keys)
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(address, "Street", "St."), "Road", "Rd"), "Avenue", "Ave")
    return F.when(k == 0, short).when(k == 1, F.upper(address)).when(k == 2, F.concat(F.lit("Suite 4, "), address)).when(k == 3, F.regexp_replace(address, ",", "")).otherwise(address)


def generate(spark: SparkSession, n: int = 2500, split: str = "TRAIN", seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Source 1, sources 2 and 3 and the truth.

    Of 100 records 20 have no match, 45 have one, 25 one in each source and 10
    two in source 2 and one in source 3; each target source gets 30 %
    strangers and every tenth country is blank.
    """
    seed += 0 if split == "TRAIN" else 1
    i = F.col("i")
    base = spark.range(n).select(F.col("id").alias("i"))
    country = _pick(_COUNTRIES, _draw(seed, "country", len(_COUNTRIES), i))
    named = base.select(
        i, country.alias("c"), _pick(_FIRST, _draw(seed, "first", len(_FIRST), i)).alias("f"), _pick(_SECOND, _draw(seed, "second", len(_SECOND), i)).alias("s"),
        (_draw(seed, "number", 9999, i) + 1).cast("string").alias("k"), _pick(_STREETS, _draw(seed, "street", len(_STREETS), i)).alias("st"),
        (_draw(seed, "house", 9999, i) + 1).cast("string").alias("h"), (_draw(seed, "post", 90000, i) + 10000).cast("string").alias("p"), _draw(seed, "mix", 100, i).alias("mix"),
    )
    suffix = F.element_at(F.create_map(*(F.lit(x) for kv in _SUFFIXES.items() for x in kv)), F.col("c"))
    full = named.select(i, "c", "mix", F.concat_ws(" ", "f", "s", "k", suffix).alias("name"), F.concat_ws(", ", F.concat_ws(" ", "h", "st"), "p").alias("address"))
    blank = lambda *keys: F.when(_draw(seed, "blank", 10, *keys) == 0, "").otherwise(F.col("c"))
    number = lambda c: F.lpad(c.cast("string"), 6, "0")
    s1 = full.select(F.concat(F.lit(f"S1_{split}_"), number(i)).alias("entity_id"), F.col("name").alias("business_name"), F.col("address").alias("business_address"), blank(i).alias("country"))

    mix = F.col("mix")
    slots = F.when(mix < 20, F.array()).when(mix < 65, F.array(F.when(mix % 2 == 0, "S2").otherwise("S3"))).when(mix < 90, F.array(F.lit("S2"), F.lit("S3"))).otherwise(F.array(F.lit("S2"), F.lit("S2"), F.lit("S3")))
    copies = full.select(i, "c", "name", "address", F.posexplode(slots.cast("array<string>")).alias("j", "source"))
    j = F.col("j")
    matched = copies.select(
        i, "source", F.concat(F.col("source"), F.lit(f"_{split}_"), number(i * 4 + j)).alias("entity_id"), _noisy_name(F.col("name"), seed, i, j).alias("business_name"),
        _noisy_address(F.col("address"), seed, i, j).alias("business_address"), blank(i, j).alias("country"),
    )

    def target(source: str) -> DataFrame:
        own = matched.filter(F.col("source") == source).select("entity_id", "business_name", "business_address", "country")
        strange = full.filter(_draw(seed, source + "stranger", 10, i) < 3).select(
            F.concat(F.lit(f"{source}_{split}_9"), number(i)).alias("entity_id"),
            F.concat_ws(" ", _pick(_FIRST, _draw(seed, source + "sf", len(_FIRST), i)), _pick(_SECOND, _draw(seed, source + "ss", len(_SECOND), i)), F.lit("X"), i.cast("string")).alias("business_name"),
            F.concat_ws(" ", (_draw(seed, source + "sh", 9999, i) + 1).cast("string"), _pick(_STREETS, _draw(seed, source + "st", len(_STREETS), i))).alias("business_address"),
            F.col("c").alias("country"),
        )
        return own.unionByName(strange)

    lists = matched.groupBy("i").agg(F.array_join(F.sort_array(F.collect_list("entity_id")), ",").alias("m"))
    truth = full.select(i).join(lists, "i", "left").select(F.concat(F.lit(f"S1_{split}_"), number(i)).alias("source1_entity_id"), F.coalesce("m", F.lit("")).alias("matched_entity_ids"))
    return s1, target("S2"), target("S3"), truth
