import numpy as np
from pyspark.sql import functions as F

from quaestor.llm import gbt, quality
from quaestor.llm.holdout import PROSE_OR_NOT


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = gbt.fit(x[:400], y[:400], ["a", "b", "c"]).calibrate(x[400:500], y[400:500])
    p = m.probability(x[500:])
    assert ((p > 0.5) == y[500:]).mean() > 0.93 and p.min() > 0 and p.max() < 1


def texts(spark):
    rows = [(f"{t} {i}" if y == 0 else f"{t}\n{i} rivet", y) for i in range(12) for t, y in PROSE_OR_NOT]
    return spark.createDataFrame(rows, "text string, label int")


def test_holdout_accuracy(spark):
    got = quality.score(texts(spark)).select("label", "p_structural").collect()
    assert sum((r["p_structural"] >= 0.5) == bool(r["label"]) for r in got) >= 0.95 * len(got)


def test_edge_rows(spark):
    extra = spark.createDataFrame([(None, 7), ("", 7), ("  \n\t ", 7), ("word " * 50_000, 7), ("###", 7), ("A dog sat on the mat and ran. " * 3, 7), ("A dog sat on the mat and ran. " * 3, 7)], "text string, label int")
    df = texts(spark).unionByName(extra).withColumn("n_words", F.lit("clash")).withColumn("_lines", F.lit("kept out"))
    got = quality.score(df).where("label = 7").select("text", "p_structural").collect()
    by = {r["text"]: r["p_structural"] for r in got}
    assert len(got) == 7 and by[None] is None and by[""] is None and by["  \n\t "] is None and by["###"] == 1.0
    assert by["A dog sat on the mat and ran. " * 3] < 0.5


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string")
    assert quality.structural(df).count() == 0


def test_introduction_and_partitioning_change_nothing(spark):
    lst = "1. Osmosis\n2. Cells\n3. Enzymes\n4. Plasma\n5. Nucleus"
    df = texts(spark).unionByName(spark.createDataFrame([("The table of all the terms that we need for this week is given below.\n" + lst, 9)], "text string, label int"))
    a = {r["text"]: round(r["p_structural"], 9) for r in quality.score(df).collect()}
    b = {r["text"]: round(r["p_structural"], 9) for r in quality.score(df.repartition(9, "text")).collect()}
    assert a == b and [p for t, p in a.items() if t.startswith("The table of all")][0] > 0.5


def test_whole_texts_are_measured(spark):
    rows = [("one two\nthree four\nfive six\nseven eight", 8), ("one two\nthree four\nfive six seven", 7), ("A lead-in of five words:\na\nb\nc", 9)]
    got = quality.with_stats(spark.createDataFrame(rows, "text string, n int")).select("n", "n_words").collect()
    assert all(r["n"] == r["n_words"] for r in got)


def test_only_an_introduction_is_set_aside(spark):
    prose = "The rate grows with the load.\nWe see this in the first table of the\nreport. It falls at once when the load\nis taken off. Show why."
    rows = [("Here are the terms of this week:\nheap\nstack\nqueue", "heap\nstack\nqueue"), (prose, prose), ("Terms\nheap\nstack\nqueue", "Terms\nheap\nstack\nqueue")]
    got = quality.without_introduction(spark.createDataFrame(rows, "text string, want string"), "text", "out").collect()
    assert all(r["out"] == r["want"] for r in got)


def test_texts_that_training_never_saw(spark):
    from quaestor.llm.corpus import item_rows, keys_and_texts

    held = quality.holdout(quality.fit(keys_and_texts(item_rows(spark, "/root/testdata/sf0.01"))[1]), spark)
    print(held)
    assert held["texts"] >= 14 and held["accuracy"] >= 0.9 and held["calibration_error"] < 0.15
