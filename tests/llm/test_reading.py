import numpy as np
from pyspark.sql import functions as F

from quaestor.llm import reading
from quaestor.llm.holdout import GRADED


def corpus(spark):
    rows = [(float(g), f"{t} {t}" if i % 2 else t) for i in range(10) for g, t in GRADED]
    return spark.createDataFrame(rows, "grade double, text string")


def test_graded_passages_are_ordered(spark):
    r = reading.score(corpus(spark)).select("grade", "latent", "level").collect()
    g, f = np.array([x["grade"] for x in r]), np.array([x["latent"] for x in r])
    rank = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(rank(g), rank(f))[0, 1] > 0.9
    assert all(x["level"] == 0 for x in r if x["grade"] <= 2) and all(x["level"] == 4 for x in r if x["grade"] == 17)
    assert all(0 < x["level"] < 4 for x in r if 7 <= x["grade"] <= 12)


def test_bands_and_edge_rows(spark):
    extra = [(-1.0, None), (-1.0, ""), (-1.0, " \n"), (-1.0, "Why?"), (-1.0, "12 34 56 ||"), (-2.0, "The cat ran to the red box. " * 4000)]
    df = corpus(spark).unionByName(spark.createDataFrame(extra, "grade double, text string")).withColumn("n_words", F.lit("clash")).withColumn("_t", F.lit("clash"))
    got = reading.bands(df).collect()
    assert {r["band"] for r in got} == {"easy", "hard"}
    assert not [r for r in got if r["grade"] == -1.0] and [r["band"] for r in got if r["grade"] == -2.0] == ["easy"]
    assert reading.bands(spark.createDataFrame([], "text string")).count() == 0


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 3))
    y = np.digitize(2 * x[:, 0] - x[:, 1], [-2, -0.5, 0.5, 2])
    m = reading.fit_ordinal(x, y, np.ones(len(y)))
    assert (np.abs(np.digitize(m.latent(x), m.cuts) - y) <= 1).mean() > 0.97 and (np.diff(m.cuts) > 0).all()


def test_passages_that_the_fit_never_saw(spark):
    from quaestor.llm.queries import _fields

    texts = _fields(spark, "/root/testdata/sf0.01")[1]
    common = reading.common_words(texts)
    held = reading.holdout(reading.fit(texts, common), common, spark)
    print(held)
    assert held["texts"] >= 8 and held["rank_agreement"] > 0.8 and held["bands_right"] >= 0.75
