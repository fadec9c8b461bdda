from pyspark.sql import functions as F

from quaestor.operators import metrics as M
from quaestor.operators import pipeline
from quaestor.plans import all_queries


def test_report_counts_what_was_scored(spark):
    q = spark.createDataFrame([("q1", "Define osmosis."), ("q2", "Why?"), ("q3", None), (None, "x")], "id string, text string")
    long, errors = pipeline.run(q, names=["word_count", "bloom_level"])
    assert tuple(pipeline.report(q, errors, long).first()) == (4, 2, 2, 0.5)
    lost = long.withColumn("score", F.when((F.col("question_id") != "q2") | (F.col("metric") != "bloom_level"), F.col("score")))
    assert tuple(pipeline.report(q, errors, lost).first()) == (4, 1, 3, 0.25)
    assert [tuple(r) for r in pipeline.unscored(q, lost).collect()] == [("q2", "not scored")]
    assert tuple(pipeline.report(q.limit(0), errors.limit(0), long.limit(0)).first()) == (0, 0, 0, 0.0)


def test_registered_runner_evaluates_all_metrics(spark, tmp_path, monkeypatch):
    q = spark.createDataFrame([("q1", "Define osmosis."), ("q2", None)], "q_id string, text string")
    q.write.parquet(str(tmp_path / "questions_raw.parquet"))
    ran = []
    evaluate = M.evaluate
    monkeypatch.setattr(M, "evaluate", lambda df, key, names=None, *a: ran.append(names) or evaluate(df, key, ["word_count"], *a))
    assert tuple(all_queries()["pipeline_run"](spark, str(tmp_path)).first()) == (2, 1, 1, 0.5)
    assert [tuple(r) for r in all_queries()["error_capture"](spark, str(tmp_path)).collect()] == [("q2", "missing text")]
    assert ran == [None, None]
