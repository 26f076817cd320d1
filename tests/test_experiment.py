import pytest
from pyspark.sql import functions as F

from kindred.functions.text import normalized
from kindred.operators.blocking import S
from kindred.plans import evaluation as E
from kindred.plans import experiment, report
from kindred.sources import fixtures, records
from kindred.streaming.resolve import resolve_stream


@pytest.fixture(scope="module")
def data(spark):
    s1, s2, s3, truth = (df.persist() for df in fixtures.generate(spark, 250))
    return s1, s2, s3, records.parse_truth(truth)


def test_generated_records(data):
    s1, s2, s3, truth = data
    assert s1.count() == truth.count() == 250 and not records.repeated_ids(s2).count() and not records.repeated_ids(s3).count()
    ids = s2.unionByName(s3).select(F.col("entity_id").alias("candidate_entity_id"))
    assert records.truth_pairs(truth).join(ids, "candidate_entity_id", "left_anti").count() == 0
    shares = [r[0] for r in truth.groupBy(F.size("matched").alias("n")).count().orderBy("n").select("count").collect()]
    assert len(shares) == 4 and shares[1] == max(shares)


def test_experiment_end_to_end(spark, data, tmp_path):
    s1, s2, s3, truth = data
    trained = experiment.train(s1, s2, s3, truth, maxIter=4, maxDepth=3, minInstancesPerNode=2)
    scores = trained.scores.first()
    assert trained.recall.first()["recall"] > 0.9 and scores["macro_f05"] > 0.8
    text = report.validation_report("V1", trained.scores, trained.sweep, trained.recall, [("f", 1.0)], trained.threshold)
    assert "Thresholds" in text and f"{trained.threshold:.2f}" in text
    t1, t2, t3, _ = fixtures.generate(spark, 60, "TEST")
    results, pairs = experiment.predict(trained.model, trained.threshold, t1, t2, t3)
    assert results.count() == 60 and experiment.check(results, pairs, t1, t2, t3).count() == 0
    meta = experiment.metadata("V1", 1, "lightgbm", trained, "first", True)
    assert meta["decision"] == "Accepted" and meta["features_count"] == 41
    (tmp_path / "data_profile.md").write_text(report.profile_report({"S1": s1, "S2": s2}, truth))
    assert "Missing values" in report.fetch_report(str(tmp_path), "DATA_PROFILE") and report.fetch_report(str(tmp_path), "../secret") is None


def test_error_report(spark, data):
    s1, s2, s3, truth = data
    predicted = truth.select(S, F.array(F.lit("S2_TRAIN_000000")).alias("matched"))
    wrong = E.errors(predicted, truth, spark.createDataFrame([], f"{S} string, candidate_entity_id string"))
    assert "First FN" in report.error_report(wrong, s1.unionByName(s2).unionByName(s3))


def test_stream_resolves_micro_batches(spark, data, tmp_path):
    s1, s2, _, _ = data
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    s1.limit(5).coalesce(1).write.parquet(source)
    targets = normalized(s2).persist()
    scorer = lambda f: f.withColumn("match_probability", F.col("f_name_addr_mean"))
    q = resolve_stream(spark.readStream.schema(s1.schema).parquet(source), targets, out, str(tmp_path / "cp"), scorer=scorer, threshold=0.9)
    q.awaitTermination(120)
    assert q.exception() is None and spark.read.parquet(out).count() == 5
