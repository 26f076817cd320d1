import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import queries
from kindred.config import BlockingConfig
from kindred.functions.text import normalized
from kindred.operators import blocking as B
from kindred.plans import evaluation as E
from kindred.plans import features as X
from kindred.plans import boosting, model, profiling, resolve, service, validation
from kindred.sources import records

from .conftest import SF, same_rows

TABLES = ("documents",)
RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched array<string>"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize(
    "name",
    ["er_normalize", "er_block_exact_name", "er_block_name_country", "er_block_address_token", "er_block_rare_token", "er_block_tfidf", "er_candidates_union",
     "er_features_native", "er_negatives", "er_entity_split", "er_threshold_sweep", "er_predictions", "er_validate_violations", "er_compare_pair", "er_hard_negatives", "er_dataset_stats", "er_feature_groups"],
)
def test_query_matches_sql(spark, oracle, name):
    same_rows(queries.QUERIES[name](spark, SF).toPandas(), oracle.sql(queries.ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def business(spark):
    s1 = [("S1_1", "Acme Tech Inc.", "12 Elmwood St, 90210", "US"), ("S1_2", "Blue Sky Systems", "7 Harbor Rd", ""), ("S1_3", "", "", "DE"), ("S1_4", "Zeta", "400 Oak Ave", "FR")]
    tg = [("S2_1", "ACME Technologies, Inc", "12 Elmwood Street", "us"), ("S2_2", "Blue Sky Sys", "7 Harbour Rd", "US"), ("S3_1", "Acme Technologies", "99 Elm St", "US"),
          ("S3_2", "", "", "DE"), ("S3_3", None, None, None), ("S3_4", "Acme Global Technologies", "12 Elmwood St", "IN")]
    return normalized(spark.createDataFrame(s1, RECORD)).persist(), normalized(spark.createDataFrame(tg, RECORD)).persist()


def pair_set(df):
    return {(r[B.S], r[B.T]) for r in df.collect()}


def test_blocks_match_all_pairs(spark, business):
    s1, tg = business
    left, right = s1.collect(), tg.collect()
    config = BlockingConfig()
    both = [(a, b) for a, b in itertools.product(left, right)]
    want = {(a.entity_id, b.entity_id) for a, b in both if a.business_name_norm and a.business_name_norm == b.business_name_norm}
    assert pair_set(B.exact_name(s1, tg, config)) == want
    want = {(a.entity_id, b.entity_id) for a, b in both if a.business_name_core and a.country_norm and (a.business_name_core, a.country_norm) == (b.business_name_core, b.country_norm)}
    assert pair_set(B.name_country(s1, tg, config)) == want
    key = lambda r: [t for t in r.business_address_tokens if t not in B.ADDRESS_STOPS and (len(t) > 3 or t.isdigit())][:4]
    want = {(a.entity_id, b.entity_id) for a, b in both if set(key(a)) & set(key(b))}
    assert pair_set(B.address_token(s1, tg, config)) == want


def test_block_cap_leaves_out_large_blocks(spark, business):
    s1, tg = business
    capped = B.address_token(s1, tg, BlockingConfig(address_block_cap=1))
    assert pair_set(capped) < pair_set(B.address_token(s1, tg, BlockingConfig()))


def test_tfidf_matches_all_pairs(spark, business):
    s1, tg = business
    rows = [(r.entity_id, r.business_name_norm) for r in s1.collect() + tg.collect()]

    def grams(name):
        out = {}
        for w in name.split():
            w = f" {w} "
            for n in (2, 3, 4):
                for i in range(len(w) - n + 1):
                    out[w[i : i + n]] = out.get(w[i : i + n], 0) + 1
        return out

    counts = {i: grams(n) for i, n in rows}
    df = {}
    for g in counts.values():
        for k in g:
            df[k] = df.get(k, 0) + 1
    vectors = {}
    for i, g in counts.items():
        v = {k: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + df[k])) + 1) for k, c in g.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors[i] = {k: x / norm for k, x in v.items()}
    want = {}
    for a in s1.collect():
        for b in tg.collect():
            sim = sum(x * vectors[b.entity_id].get(k, 0) for k, x in vectors[a.entity_id].items())
            if sim >= 0.25:
                want[a.entity_id, b.entity_id] = round(sim, 6)
    got = {(r[B.S], r[B.T]): round(r["sim"], 6) for r in B.tfidf_pairs(s1, tg, BlockingConfig()).collect()}
    assert got == want

    B_BLOCK, B_SHARD = B.BLOCK, B.SHARD
    try:
        B.BLOCK, B.SHARD = 2, 3  # several blocks and shards
        again = B.tfidf_pairs(s1, tg, BlockingConfig()).collect()
        best = B.top_k(B.tfidf_pairs(s1, tg, BlockingConfig(), 1), 1).collect()
    finally:
        B.BLOCK, B.SHARD = B_BLOCK, B_SHARD
    assert len(again) == len(want) and {(r[B.S], r[B.T]): round(r["sim"], 6) for r in again} == want
    for r in best:
        assert round(r["sim"], 6) == max(x for (s, _), x in want.items() if s == r[B.S])
    assert {r[B.S] for r in best} == {s for s, _ in want}


def test_union_flags_and_empty_result(spark, business):
    s1, tg = business
    for r in B.candidates(s1, tg).collect():
        assert r["num_blocks_hit"] == sum(r[f] for f in B.FLAGS.values()) > 0
    none = B.candidates(s1.limit(0), tg)
    assert none.count() == 0 and set(B.FLAGS.values()) < set(none.columns)
    assert B.candidates(s1, tg, strategies=()).count() == 0
    extra = B.candidates(s1, tg, strategies=(), extra={"country": B.custom_strategy(F.col("country_norm"))})
    assert {r["blocked_by_country"] for r in extra.collect()} == {1}


def test_features_of_empty_and_missing_records(spark, business):
    s1, tg = business
    cands = spark.createDataFrame([("S1_3", "S3_2", 0, 0, 0, 0, 0, 0.0, 1), ("S1_1", "nobody", 0, 0, 0, 0, 0, 0.0, 1)], f"{B.S} string, {B.T} string, {', '.join(f + ' int' for f in B.FLAGS.values())}, tfidf_similarity double, num_blocks_hit int")
    rows = {r[B.S]: r for r in X.pairwise_features(cands, s1, tg).collect()}
    assert rows["S1_3"].asDict().keys() == {B.S, B.T, *X.FEATURES} and len(X.FEATURES) == 41
    assert [rows["S1_3"][f"f_addr_{x}"] for x in ("fuzz_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "jaccard")] == [1, 1, 1, 0, 0]
    assert rows["S1_3"]["f_country_match"] == 1 and rows["S1_1"]["f_country_missing"] == 1 and rows["S1_1"]["f_name_fuzz_ratio"] == 0


def test_metrics_fixture(spark):
    truth = spark.createDataFrame([("A", ["x", "y"]), ("B", []), ("C", []), ("D", ["z"])], TRUTH)
    pred = spark.createDataFrame([("A", "x"), ("C", "q")], f"{B.S} string, {B.T} string")
    r = E.macro_scores(pred, truth).first()
    assert (r["macro_precision"], r["macro_recall"]) == (0.5, 0.625) and r["macro_f05"] == pytest.approx(11 / 24)
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 2) and r["micro_f05"] == pytest.approx(5 / 11)
    nothing = E.pair_scores(pred.limit(0), truth.limit(0)).first()
    assert (nothing["precision"], nothing["recall"]) == (1.0, 1.0)


def test_threshold_ties_take_the_lowest(spark):
    truth = spark.createDataFrame([("A", ["x"])], TRUTH)
    scored = spark.createDataFrame([("A", "x", 0.4), ("A", "y", 0.1)], f"{B.S} string, {B.T} string, match_probability double")
    sweep = E.threshold_sweep(scored, truth, (0.3, 0.4, 0.5))
    assert {r["threshold"]: r["macro_f05"] for r in sweep.collect()} == {0.3: 1.0, 0.4: 1.0, 0.5: 0.0}
    assert E.choose_threshold(sweep) == 0.3
    assert E.choose_threshold(E.threshold_sweep(scored, truth, ())) == 0.65


def test_split_negatives_and_predictions(spark):
    s1 = spark.createDataFrame([(f"S1_{i}",) for i in range(100)], "entity_id string")
    tg = spark.createDataFrame([(f"S2_{i}",) for i in range(50)], "entity_id string")
    split = E.entity_split(s1)
    assert split.filter("is_validation").count() == 20 and split.count() == 100
    assert E.entity_split(s1, 1.0).filter("is_validation").count() == 100 and E.entity_split(s1.limit(0)).count() == 0
    truth = spark.createDataFrame([(f"S1_{i}", [f"S2_{j}" for j in range(50) if j % 2]) for i in range(100)], TRUTH)
    drawn = E.random_negatives(s1, tg, truth)
    assert all(int(r[B.T][3:]) % 2 == 0 for r in drawn.collect()) and drawn.groupBy(B.S).count().agg(F.max("count")).first()[0] <= 2
    scored = spark.createDataFrame([("S1_0", "b", 0.5), ("S1_0", "a", 0.5), ("S1_0", "c", 0.9), ("S1_1", "d", 0.49)], f"{B.S} string, {B.T} string, match_probability double")
    lists = {r[B.S]: r["matched"] for r in E.predictions(scored, s1.limit(100), 0.5).collect()}
    assert len(lists) == 100 and lists["S1_0"] == ["c", "a", "b"] and lists["S1_1"] == []
    assert E.class_weight(spark.createDataFrame([(1,)] + [(0,)] * 10, "label int")) == 8.0


def test_tsv_round_trip_and_truth(spark, tmp_path):
    rows = [('S"1', ' lead "q" ', "NA", ""), ("S2", "tail ", "", "x'y")]
    path = str(tmp_path / "t.tsv")
    records.write_tsv(spark.createDataFrame(rows, RECORD), path)
    assert sorted(map(tuple, records.read_tsv(spark, path, records.RECORD_COLUMNS).collect())) == sorted(rows)
    with pytest.raises(FileNotFoundError):
        records.read_tsv(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="other"):
        records.read_tsv(spark, path, ("other",))
    truth = spark.createDataFrame([("1", "a, b,,a"), ("2", "NaN"), ("3", " none "), ("4", "")], "source1_entity_id string, matched_entity_ids string")
    assert {r[0]: r[1] for r in records.parse_truth(truth).collect()} == {"1": ["a", "b"], "2": [], "3": [], "4": []}
    with pytest.raises(ValueError, match="repeats"):
        records.parse_truth(truth.unionByName(truth))
    results = records.matching_results(spark.createDataFrame([("S2", ["x", "y", "x"])], TRUTH), spark.createDataFrame(rows, RECORD))
    assert {r[0]: r[1] for r in results.collect()} == {'S"1': "", "S2": "x,y"}


def test_logs_and_archive(spark, tmp_path):
    log = str(tmp_path / "log")
    assert records.read_log(spark, log).count() == 0
    for v in ("V1", "V2"):
        records.append_log(spark, log, {"version": v, "day": 1, "validation_f05": 0.5})
    found = records.read_log(spark, log).orderBy("version").collect()
    assert [r["version"] for r in found] == ["V1", "V2"] and len(found[0]["timestamp"]) == 19 and found[0]["notes"] == ""
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    at = records.archive(df, df, str(tmp_path), 2, "V3", {"note": "n"})
    assert at.endswith("day2/V3") and '"note": "n"' in spark.read.text(f"{at}/metadata.json").first()[0]


def test_violations_of_lacking_columns_and_files(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "x string")
    assert {r["rule"] for r in validation.violations(df, df, df, df).collect()} == {"missing_column"}
    assert {r["rule"] for r in validation.validate_files(spark, *[str(tmp_path / x) for x in "abc"]).collect()} == {"missing_file"}


def test_service_replies(spark, business):
    s1, tg = business
    assert service.health(tg, False).first()["target_records"] == 6
    matching = s1.select(F.col("entity_id").alias(B.S), F.lit("S2_1").alias("matched_entity_ids"))
    pairs = matching.select(B.S, F.lit("S2_1").alias(B.T))
    ok, bad = service.validation_reply(matching, pairs, s1, tg).first(), service.validation_reply(matching.limit(3), pairs, s1, tg).first()
    assert ok["is_valid"] and ok["errors"] == [] and ok["total_pairs"] == 4
    assert not bad["is_valid"] and any(e.startswith("missing_entity") for e in bad["errors"])
    signals = spark.range(1).select(service.active_signals(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(0))).alias("m")).first()["m"]
    assert signals == {"a": 1}


def test_target_base_keeps_first(spark):
    a = spark.createDataFrame([("1", "first", "", "")], RECORD)
    b = spark.createDataFrame([("1", "second", "", ""), ("2", "other", "", "")], RECORD)
    assert {r["entity_id"]: (r["business_name"], r["source"]) for r in records.target_base(("A", a), ("B", b)).collect()} == {"1": ("first", "A"), "2": ("other", "B")}


def test_profile_counts_real_duplicates(spark):
    a = spark.createDataFrame([("1", "x  y", "", ""), ("1", "", "", "US")], RECORD)
    assert profiling.duplicates({"a": a}).first()["duplicates"] == 1
    assert {r["country"]: r["n"] for r in profiling.countries(a).collect()} == {"MISSING": 1, "US": 1}
    lengths = {r["column"]: r for r in profiling.lengths({"a": a}).collect()}
    assert lengths["business_name"]["max_word_count"] == 2 and lengths["business_address"]["avg_word_count"] == 1.0


def test_resolve_and_compare(spark, business):
    _, tg = business
    q = spark.createDataFrame([("Q1", "Acme Technologies Inc", "12 Elmwood Street", "US"), ("Q2", "Totally Unique Nothing", "Mars Colony", "US")], RECORD)
    scorer = lambda f: f.withColumn("match_probability", F.col("f_name_addr_mean"))
    got = {r[B.S]: r for r in resolve.resolve(q, tg, scorer, 0.9).collect()}
    assert got["Q1"]["matched_ids"][0] == "S2_1" and not got["Q1"]["is_singleton"] and got["Q2"]["is_singleton"] and got["Q2"]["candidates_count"] == 0
    probabilities = [m["match_probability"] for m in got["Q1"]["matches"]]
    assert probabilities == sorted(probabilities, reverse=True) and set(got["Q1"]["matches"][0]["similarity_summary"]) == set(resolve.SUMMARY)
    left = spark.createDataFrame([("me", "Clearwater Analytics Inc.", "1 Lake Rd", "US")], RECORD)
    right = spark.createDataFrame([("you", "Clearwater Analytics", "1 Lake Road", "")], RECORD)
    r = resolve.compare_pairs(left, right, spark.createDataFrame([("me", "you")], f"{B.S} string, {B.T} string")).first()
    assert r["features"]["f_name_core_exact"] == 1 and r["features"]["f_num_blocks"] == 5 and r["match_probability"] == 0.5 and len(r["features"]) == 41


def test_model_round_trip(spark, tmp_path):
    rows = [(str(i), str(i), *(float((i * (k + 3)) % 7) for k in range(40)), float(i % 2), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, f"{B.S} string, {B.T} string, {', '.join(f + ' double' for f in X.FEATURES)}, label int")
    fitted = model.train(df, maxIter=2, maxDepth=2, minInstancesPerNode=1)
    assert model.importances(fitted)[0][0] == X.FEATURES[-1]
    model.save(fitted, str(tmp_path / "m"), 0.3, {"version": "V1"})
    loaded, threshold, metadata = model.load(spark, str(tmp_path / "m"))
    assert (threshold, metadata["features_count"]) == (0.3, 41)
    a, b = (m.orderBy(B.S).select("match_probability").collect() for m in (model.score(fitted, df), model.score(loaded, df)))
    assert a == b and model.score(None, df).first()["match_probability"] == 0.5


def test_match_model_trains_with_the_preset(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.model, "train", lambda features, config, **override: seen.append(model.PRESETS[config.kind] | override))
    queries.QUERIES["er_match_model"](spark, SF)
    assert seen == [model.PRESETS["lightgbm"]]


def test_parsed_truth_keeps_its_order(spark, tmp_path):
    docs = [(k, t, "en") for k, t in ((21, "a b"), (22, "a b"), (23, "a b"), (33, "c"), (24, "d"), (31, "e"))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries.QUERIES["er_truth_parse"](spark, str(tmp_path)).toPandas()
    assert "x,y,S2_22,S3_23" in set(got["matched_ids"])
    same_rows(got, c.sql(queries.ORACLE_SQL["er_truth_parse"]).df())


def test_name_search_equals_all_products():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 6))) for _ in range(60)]
    names = sorted({"".join(f" {w} " for w in rng.choice(words, rng.integers(1, 5))) for _ in range(400)})
    grams = np.unique(B.gram_codes(names, 2, 4)[1])
    idf = 1 + rng.random(len(grams)) * 4
    ends, gram, weight = B.vectors(names, grams, idf, 2, 4)
    dense = np.zeros((len(names), len(grams)))
    dense[np.repeat(np.arange(len(names)), np.diff(ends, prepend=0)), gram] = weight
    index = B.NameIndex(ends, gram, weight, idf)
    for k in range(0, len(names), 7):
        span = slice(ends[k] - (dense[k] > 0).sum(), ends[k])
        exact = np.round(dense @ dense[k], 9)
        at, sims = index.search(gram[span], weight[span], 0.25, 10)
        want = [i for i in np.lexsort((np.arange(len(names)), -exact)) if exact[i] >= 0.25][:10]
        assert sorted(at.tolist()) == sorted(want) and np.allclose(sims, exact[at], atol=1e-8)


def copies(spark):
    rows = [(f"S{1 + (i % 3 > 0)}_{i}", "Acme Tech Inc.", "12 Elmwood St", "US") for i in range(90)] + [("S1_x", "Acme Tech", "9 Oak Rd", "US"), ("S2_x", "Acme Tech Ltd", "8 Elm Ave", "US")]
    rows = normalized(spark.createDataFrame(rows, RECORD)).persist()
    return rows.filter("entity_id like 'S1%'"), rows.filter("entity_id like 'S2%'")


def test_copies_meet_as_names(spark):
    s1, tg = copies(spark)
    found, _ = B._matches(s1, tg, BlockingConfig(), 10)
    assert found.count() == 4  # two names a side instead of 31 x 61 records
    best = B.tfidf_ngram(s1, tg, BlockingConfig()).groupBy(B.S).count().collect()
    assert len(best) == 31 and {r["count"] for r in best} == {10}


def test_candidates_of_groups(spark, monkeypatch):
    s1, tg = copies(spark)
    want = sorted(map(tuple, B._union(s1, tg, BlockingConfig(), B.STRATEGIES, {}).select(sorted(B.candidates(s1, tg).columns)).collect()))
    for group, pairs in ((B.GROUP, B.PAIRS), (4, 7)):  # one task, and many
        monkeypatch.setattr(B, "GROUP", group)
        monkeypatch.setattr(B, "PAIRS", pairs)
        found = B.linked(s1, tg)
        got = B.candidates(s1, tg)
        assert sorted(map(tuple, got.select(sorted(got.columns)).collect())) == want
        assert found.members.count() == 31 and found.rows.count() * 3 < len(want)
    few = {r[B.S] for r in B.candidates(s1, tg, strategies=("name_country",)).collect()}
    assert len(few) == 31
    twice = B.candidates(s1.unionByName(s1), tg)  # repeated ids are one record
    assert twice.count() == len({(r[B.S], r[B.T]) for r in twice.collect()})


def test_first_pairs_by_hash(spark):
    pairs = spark.range(3000).select(F.concat(F.lit("a"), "id").alias(B.S), F.lit("b").alias(B.T))
    want = [r[0] for r in pairs.orderBy(F.xxhash64(B.S, B.T)).limit(700).collect()]
    assert sorted(r[0] for r in model.first_pairs(pairs, 700).collect()) == sorted(want)
    assert model.first_pairs(pairs, 3000).count() == 3000


def test_queries_on_groups_equal_those_on_pairs(spark):
    s1, tg = copies(spark)
    found = B.linked(s1, tg)
    pairs = B.candidates(s1, tg).withColumn("match_probability", F.col("num_blocks_hit") / 5.0)
    rows = found.rows.withColumn("match_probability", F.col("num_blocks_hit") / 5.0)
    truth = spark.createDataFrame([(f"S1_{i}", ["S2_1", f"S2_{i + 1}", "S2_lost"]) for i in range(0, 90, 3)] + [("S1_x", [])], TRUTH)
    same_rows(E.label_groups(rows, truth, found.members).select(B.S, B.T, "label").toPandas(), E.label_pairs(pairs, truth).select(B.S, B.T, "label").toPandas())
    same_rows(E.blocked_negatives_of_groups(rows, truth, found.members).select(B.S, B.T).toPandas(), E.blocked_negatives(E.label_pairs(pairs, truth)).select(B.S, B.T).toPandas())
    same_rows(E.threshold_sweep(rows, truth, members=found.members).toPandas(), E.threshold_sweep(pairs, truth).toPandas())
    same_rows(E.blocking_recall(rows, truth, members=found.members).toPandas(), E.blocking_recall(pairs, truth).toPandas())
    wrong = E.errors(E.predictions(pairs, s1, 0.7), truth, pairs)
    same_rows(E.errors_of_groups(rows, truth, rows, found.members, 0.7).toPandas(), wrong.toPandas())


def test_truth_given_to_the_blocks_marks_rows(spark, monkeypatch):
    """Counts, labels and errors come from the rows as they are, which the truth marks, without a join of pairs."""
    s1, tg = copies(spark)
    truth = spark.createDataFrame([(f"S1_{i}", ["S2_1", f"S2_{i + 1}", "S2_lost", "S2_1"]) for i in range(0, 90, 3)] + [("S1_x", ["S2_x", "S2_40"])], TRUTH)
    pairs = B.candidates(s1, tg).withColumn("match_probability", F.col("num_blocks_hit") / 5.0)
    labeled, over = E.label_pairs(pairs, truth), F.col("match_probability") >= 0.7
    found = B.linked(s1, tg, truth=truth)
    rows, members = found.rows.withColumn("match_probability", F.col("num_blocks_hit") / 5.0), found.members
    monkeypatch.setattr(E, "true_of_groups", None)
    assert rows.count() * 3 < pairs.count()
    assert E.class_weight_of_groups(rows, truth, members) == E.class_weight(labeled)
    same_rows(E.label_groups(rows, truth, members).select(B.S, B.T, "label").toPandas(), labeled.select(B.S, B.T, "label").toPandas())
    same_rows(E.blocked_negatives_of_groups(rows, truth, members).select(B.S, B.T).toPandas(), E.blocked_negatives(labeled).select(B.S, B.T).toPandas())
    same_rows(E.pair_scores(rows.filter(over), truth, members).toPandas(), E.pair_scores(pairs.filter(over), truth).toPandas())
    same_rows(E.macro_scores(rows.filter(over), truth, members).toPandas(), E.macro_scores(pairs.filter(over), truth).toPandas())
    same_rows(E.threshold_sweep(rows, truth, members=members).toPandas(), E.threshold_sweep(pairs, truth).toPandas())
    same_rows(E.errors_of_groups(rows, truth, rows, members, 0.7).toPandas(), E.errors(E.predictions(pairs, s1, 0.7), truth, pairs).toPandas())
    twice = B.linked(s1.unionByName(s1), tg, truth=truth)  # repeated ids are one record
    assert E.class_weight_of_groups(twice.rows, truth, twice.members) == E.class_weight(E.label_pairs(B.candidates(s1.unionByName(s1), tg), truth))


def test_records_take_the_heads_of_texts(spark, tmp_path):
    texts = [None, "", " \t\n", "a", "\n a\tb\r\nc ", " ".join(f"w{i}" for i in range(30)), "x" * 5000 + "\u2003y z" * 20, "\u00a0p q"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r["entity_id"].split("_")[1]): (r["business_name"], r["business_address"]) for r in queries.bridge(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        words = [w for w in re.split(r"[ \t\n\r]+", t or "") if w]
        assert got[i] == (" ".join(words[:4]), " ".join(words[4:12]))


def test_target_sets_hold_all_pairs(spark, monkeypatch):
    """Files of pairs in any order: the same pairs, repeats once; records in the same runs are one class."""
    monkeypatch.setattr(validation, "FOLD", 7)
    runs = [(f"S1_{i}", f"S2_{t}") for t in range(40) for i in range(5)] + [(f"S1_{i}", f"S3_{t}") for i in (3, 7, 8) for t in range(9)] + [("", "S2_1"), ("S1_9", "")]
    for pairs in (runs, runs + runs[::-1] + runs[3:50:7], sorted(runs)):
        df = spark.createDataFrame(pairs, "source1_entity_id string, candidate_entity_id string").coalesce(2)
        sets, members = validation.target_sets(df)
        got = members.join(sets.withColumnRenamed("source1_entity_id", "group"), "group").select("source1_entity_id", F.explode("candidate_entity_id")).collect()
        assert sorted(tuple(r) for r in got) == sorted(set(pairs))
    sets, members = validation.target_sets(spark.createDataFrame(runs[:200], "source1_entity_id string, candidate_entity_id string").coalesce(1))
    assert sets.count() == 1 and members.count() == 5
    assert validation.target_sets(df.limit(0))[0].count() == 0


def test_violations_of_sets_equal_those_of_pairs(spark):
    pairs = spark.createDataFrame([("S1_1", "S2_1"), ("S1_2", "S2_1"), ("S1_1", "S3_2"), ("S1_2", "S3_2"), ("S1_3", "S2_4")], "source1_entity_id string, candidate_entity_id string")
    listed = [("S1_1", "S2_1,S3_2"), ("S1_2", "S2_1, S2_1,S2_4"), ("S1_3", "S9_1,S2_4"), ("S1_3", "S9_1,S2_4"), ("S1_5", None), ("X1", "S2_4"), ("S1_6", "S2_1,S2_4")]
    matching = spark.createDataFrame(listed, "source1_entity_id string, matched_entity_ids string")
    s1, targets = (spark.createDataFrame([(x,) for x in ids], "entity_id string") for ids in (["S1_1", "S1_2", "S1_3", "S1_4", "S1_5", "S1_6"], ["S2_1", "S3_2", "S2_4"]))
    sets, members = validation.target_sets(pairs)
    plain, by_set = validation.violations(matching, pairs, s1, targets), validation.violations(matching, sets, s1, targets, members)
    same_rows(by_set.toPandas(), plain.toPandas())
    found = {(r.rule, r.entity_id, r.detail) for r in plain.collect()}
    assert {("unknown_match", "S1_3", "S9_1"), ("match_not_candidate", "S1_2", "S2_4"), ("match_not_candidate", "X1", "S2_4"), ("match_not_candidate", "S1_6", "S2_1"), ("duplicate_match", "S1_2", "")} <= found
    assert validation.statistics(matching, sets, members).first() == validation.statistics(matching, pairs).first()


def test_results_of_groups_as_those_of_records(spark, tmp_path):
    """The same file in the same order, and lists are not dealt by record."""
    lists = spark.createDataFrame([("a", ["y", "x", "y"]), ("b", [])], "group string, matched array<string>")
    members = spark.createDataFrame([(f"S1_{i}", "abc"[i % 3]) for i in range(60)], "source1_entity_id string, group string")
    records.write_matching_groups(lists, members, f"{tmp_path}/groups", "gzip")
    records.write_matching_results(members.join(lists, "group").select("source1_entity_id", "matched"), members.withColumnRenamed("source1_entity_id", "entity_id"), f"{tmp_path}/rows")
    assert [x for x in (tmp_path / "groups").iterdir() if x.name.endswith(".csv.gz")]
    ids = [r[0] for p in sorted((tmp_path / "groups").glob("part*")) for r in records.read_tsv(spark, str(p)).collect()]
    assert ids == sorted(f"S1_{i}" for i in range(60))
    same_rows(records.read_tsv(spark, f"{tmp_path}/groups").toPandas(), records.read_tsv(spark, f"{tmp_path}/rows").toPandas())


def test_matching_results_file_shuffles_no_pairs(spark, oracle, monkeypatch):
    """The validator gets sets of targets by class, and the files are compressed."""
    seen, reply = [], service.validation_reply
    monkeypatch.setattr(service, "validation_reply", lambda m, c, *a, **k: seen.append((m, c)) or reply(m, c, *a, **k))
    same_rows(queries.er_matching_results_file(spark, SF).toPandas(), oracle.sql(queries.ORACLE_SQL["er_matching_results_file"]).df())
    assert dict(seen[0][1].dtypes)["candidate_entity_id"] == "array<string>" and all(f.endswith(".gz") for f in seen[0][0].inputFiles())


def test_replies_without_details_compute_no_edit_ratios(spark, business):
    _, tg = business
    q = spark.createDataFrame([("Q1", "Acme Technologies Inc", "12 Elmwood Street", "US"), ("Q2", "Totally Unique Nothing", "Mars Colony", "US"), ("Q3", "Acme Technologies Inc", "12 Elmwood Street", "US")], RECORD)
    whole, brief = (resolve.resolve(q, tg, model.deterministic_score, 0.2, details=d) for d in (True, False))
    assert brief.columns == [c for c in whole.columns if c != "matches"]
    assert sorted(map(tuple, brief.collect())) == sorted(map(tuple, whole.drop("matches").collect()))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "edit_ratios" in plan(whole) and "edit_ratios" not in plan(brief)


def test_entries_are_those_of_the_replies(spark, business):
    _, tg = business
    tg = tg.withColumn("source", F.substring("entity_id", 1, 2))
    q = spark.createDataFrame([("Q1", "Acme Technologies Inc", "12 Elmwood Street", "US"), ("Q2", "Totally Unique Nothing", "Mars Colony", "US"), ("Q3", "Acme Technologies Inc", "12 Elmwood Street", "US")], RECORD)
    for rows in (tg, tg.unionByName(tg.limit(1).withColumn("entity_id", F.lit(None).cast("string")))):  # null ids take the other way
        want = []
        for r in resolve.resolve(q, rows, model.deterministic_score, 0.2).collect():
            for place, m in enumerate(r["matches"] or []):
                own = (r[B.S], r["threshold_applied"], place, m[B.T], *(m[c] for c in resolve.SHOWN), m["match_probability"], m["is_match"], m["num_blocks_hit"])
                want.append((*own, *(m["blocking_signals"][n] for n in B.FLAGS), *(m["similarity_summary"][n] for n in resolve.SUMMARY)))
        assert len(want) >= 6 and sorted(map(tuple, resolve.entries(q, rows, model.deterministic_score, 0.2).collect())) == sorted(want)


def test_training_takes_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((600, len(X.FEATURES))), 1)
    y = ((x[:, 0] + x[:, 5] > 1) ^ (rng.random(600) < 0.1)).astype(int)
    n = rng.integers(1, 4, 600)
    schema = f"label int, pairs int, {', '.join(f + ' double' for f in X.FEATURES)}"
    df = spark.createDataFrame([(int(b), int(c), *map(float, a)) for a, b, c in zip(x, y, n, strict=True)], schema)
    got = model.train(df, maxIter=6, subsamplingRate=1.0, featureSubsetStrategy="all")
    every, labels = np.repeat(x, n, axis=0), np.repeat(y, n)
    weight = max(1.0, 0.8 * (labels == 0).sum() / labels.sum())
    p = model.PRESETS["lightgbm"]
    want = boosting.fit(every, labels, np.where(labels == 1, weight, 1.0), 6, p["stepSize"], p["maxDepth"], p["leaves"], p["minInstancesPerNode"], 1.0, 1.0, p["ridge"], 42)
    assert got.probability(x) == pytest.approx(want.probability(x), abs=1e-9)
    again = model.train(df.repartition(3), maxIter=3)
    assert (again.probability(x) == model.train(df, maxIter=3).probability(x)).all()


def test_match_model_gives_the_fit_every_labelled_pair(spark, monkeypatch):
    seen = {}

    def train(features, config, **override):
        seen.update({r["label"]: r["n"] for r in features.groupBy("label").agg(F.sum("pairs").alias("n")).collect()})

    monkeypatch.setattr(queries.model, "train", train)
    queries.QUERIES["er_match_model"](spark, SF)
    s1, tg = queries.sources(spark, SF)
    true = queries.truth(spark, SF)
    fit = E.only(s1, E.entity_split(s1).filter("not is_validation"))
    known = E.label_pairs(B.candidates(fit, tg), true)
    drawn = E.random_negatives(fit, tg, true).join(known.select(B.S, B.T), [B.S, B.T], "left_anti")
    assert seen == {r["label"]: r["n"] for r in known.select("label").unionByName(drawn.select("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
