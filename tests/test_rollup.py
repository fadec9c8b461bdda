import pytest
from pyspark.sql import functions as F

from quaestor.operators import analytics as A
from quaestor.operators import rollup as R


@pytest.fixture
def long(spark):
    rows = [("q", "pedagogical", "cognitive_demand", "a", 0.2, False), ("q", "pedagogical", "cognitive_demand", "b", 0.4, False), ("q", "pedagogical", "cognitive_demand", "c", 0.9, True), ("q", "pedagogical", "cognitive_demand", "d", 1.0, False), ("r", "fairness_ethics", "privacy_risk", "p", None, False)]
    return spark.createDataFrame(rows, "question_id string, aspect string, dimension string, metric string, score double, flagged boolean")


def one(df):
    return {r["question_id"]: r["score"] for r in df.collect()}


def test_strategies(long):
    assert one(R.aggregate_dimension(long, R.percentile_rank(50)))["q"] == pytest.approx(0.65)
    assert one(R.aggregate_dimension(long, "min_gate")) == {"q": 0.2, "r": 0.0}
    with pytest.raises(ValueError):
        R.percentile_rank(101)
    with pytest.raises(ValueError):
        R.strategy("median")
    assert R.available_strategies() == ["min_gate", "percentile_rank", "weighted_average"]


def test_weights(spark):
    x = spark.createDataFrame([("q", "pedagogical", "cognitive_demand", "a", 0.5, False), ("q", "pedagogical", "cognitive_demand", "b", 1.0, False)], "question_id string, aspect string, dimension string, metric string, score double, flagged boolean")
    assert one(R.aggregate_dimension(x, weights={"b": 3.0}))["q"] == pytest.approx(0.875)
    assert one(R.aggregate_dimension(x, weights={"a": 0.0, "b": 0.0}))["q"] == 0.0


def test_empty_dimensions(long):
    zero = {(r["question_id"], r["aspect"]): r["score"] for r in R.aggregate_aspect(long).collect()}
    assert zero["q", "pedagogical"] == pytest.approx(0.625 / 4) and zero["q", "psychometric"] == 0.0
    skip = {(r["question_id"], r["aspect"]): r["score"] for r in R.aggregate_aspect(long, empty_dims="skip").collect()}
    assert skip == {("q", "pedagogical"): pytest.approx(0.625), ("r", "fairness_ethics"): 0.0}
    with pytest.raises(ValueError):
        R.aggregate_aspect(long, empty_dims="drop")


def test_nesting_round_trip(spark, long):
    flat = R.nest_scores(long)
    back = flat.select("question_id", F.explode("scores").alias("a", "d")).select("question_id", "a", F.explode("d").alias("dim", "m")).select("question_id", "a", "dim", F.explode("m").alias("metric", "score"))
    assert back.count() == 4
    assert R.flatten_scores(spark.createDataFrame([], "question_id string, course_id string, source_type string, scores map<string,map<string,map<string,struct<score:double,flagged:boolean,rationale:string>>>>")).count() == 0


def test_flags(long):
    assert R.flagged_dimensions(long).count() == 1 and R.flagged_metrics(long).count() == 1


def test_ranks_and_mann_whitney(spark):
    rows = [("d", "x", v) for v in (1.0, 2.0, 2.0, 5.0)] + [("d", "y", v) for v in (2.0, 3.0, 4.0)] + [("d", "x", None)]
    df = spark.createDataFrame(rows, "dimension string, g string, score double")
    ranks = sorted(r["rank"] for r in A.average_ranks(df.where("score is not null"), ["dimension"], "score").collect())
    assert ranks == [1.0, 3.0, 3.0, 3.0, 5.0, 6.0, 7.0]
    r = A.mann_whitney(df, ["dimension"], "g", "x", "y").first()
    assert (r["u"], r["n1"], r["n2"]) == (4.0, 4, 3) and 0.4 < r["p"] < 0.8
    assert A.mann_whitney(df.where("g = 'x'"), ["dimension"], "g", "x", "y").count() == 0


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,), (2.0,)], "v double")
    assert {r["bin"]: r["n"] for r in A.histogram(df, "v", 0.0, 1.0, 2).collect()} == {0: 1, 1: 2}


def test_partition_independence(long):
    a = one(R.aggregate_evaluation(long))
    assert a == one(R.aggregate_evaluation(long.repartition(7, "metric").orderBy(F.desc("score"))))


def test_percentiles_are_exact_over_partitions(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.normal(size=997)] + [("b", 1.0)] * 500 + [("b", 2.0)] + [(None, float(v)) for v in range(4)] + [("c", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in A.describe(df, ["g"], "v").collect()}
    for g in ("a", "b", None):
        want = np.quantile([v for k, v in rows if k == g and v is not None], [0.25, 0.5, 0.75])
        assert np.allclose([got[g]["p25"], got[g]["p50"], got[g]["p75"]], want)
    assert got["c"]["count"] == 0 and got["c"]["p50"] is None
    assert A.describe(df.limit(0), ["g"], "v").count() == 0
