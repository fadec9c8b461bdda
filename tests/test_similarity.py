import math

import pytest
from pyspark.sql import functions as F

from quaestor.functions.stem import stem
from quaestor.operators import align
from quaestor.operators import similarity as S

A, B = "identify prime numbers in a list", "describe the water cycle and evaporation"
REF = ["identify prime numbers", "explain the sieve"]


@pytest.mark.parametrize("name", ["bleu", "rouge_l", "meteor", "chrf", "tfidf", "bm25"])
def test_related_beats_unrelated(name):
    f = S.SCORERS[name]
    refs = [*REF, "draw a graph", "state a theorem"]
    assert f(A, refs) > f(B, refs) >= 0.0
    assert 0.0 <= f(A, refs) <= 1.0


@pytest.mark.parametrize("name", ["bleu", "rouge_l", "chrf", "tfidf"])
def test_identity(name):
    assert S.SCORERS[name](A, [A]) == pytest.approx(1.0)


def test_bm25_single_reference_is_negative():
    assert S.bm25_raw("identify prime numbers", ["identify prime numbers"]) == pytest.approx(-0.8239592165010822)
    assert S.bm25("identify prime numbers", ["identify prime numbers"]) == 0.0


def test_lcs_against_table():
    import random

    rnd = random.Random(3)
    for _ in range(50):
        a, b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert S.lcs(a, b) == t[-1][-1]


def test_porter_examples():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "digitizer": "digit", "hopefulness": "hope", "triplicate": "triplic", "revival": "reviv", "adoption": "adopt", "controll": "control", "probate": "probat", "rate": "rate"}
    assert {w: stem(w) for w in want} == want


def test_bleu_smoothing_shape():
    h = "a b c d e f"
    # one shared word of six, nothing longer: 1/6, 0.1/5, 0.1/4, 0.1/3
    assert S.bleu(h, ["a x y z q w"]) == pytest.approx((1 / 6 * 0.1 / 5 * 0.1 / 4 * 0.1 / 3) ** 0.25)
    with pytest.raises(ValueError):
        S.bleu(h, ["a"], weights=(1.0, 0.5))


def test_self_bleu():
    assert S.self_bleu("a b c", []) == 1.0
    assert S.self_bleu("a b c", ["a b c"]) == 1.0  # the text itself is no peer
    assert S.self_bleu("a b c", ["a b c d"]) == pytest.approx(1 - 0.75)


def test_score_edge_rows(spark):
    rows = [(1, "x y", ["x y", None]), (2, None, ["x"]), (3, "  ", ["x"]), (4, "x", []), (5, "x", None), (6, "long " * 5000, ["long " * 5000])]
    df = spark.createDataFrame(rows, "id int, text string, refs array<string>").withColumn("flagged", F.lit("clash"))
    for name in ("chrf", "rouge_l", "tfidf", "bleu", "meteor", "bm25"):
        got = {r["id"]: (r["score"], r["flagged"]) for r in S.score(df, name).collect()}
        for i in (2, 3, 4, 5):
            assert got[i] == (0.0, True), (name, i)
    batch = {r["id"]: (r["score"], r["flagged"]) for r in S.score(df, "self_bleu").collect()}
    assert batch[4] == batch[5] == (1.0, False) and batch[3] == (0.0, True)
    assert S.score(df.limit(0), "chrf").count() == 0


def test_novelty_and_cosine(spark):
    df = spark.createDataFrame([("dogs cats birds?", "apple banana"), ("what is it", "what is it"), ("", "x"), ("x", None)], "t string, c string")
    got = [r[0] for r in df.select(S.vocabulary_novelty(F.col("t"), F.col("c"))).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in v.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [round(1 / math.sqrt(2), 6), 0.0]


def test_align_edge_rows(spark):
    q = spark.createDataFrame([("c", "q1", "alpha beta"), ("c", "q1", "alpha beta"), ("c", "q2", None), ("d", "q3", "alpha"), (None, "q4", "x")], "course_id string, q_id string, text string")
    c = spark.createDataFrame([("c", "k2", "beta beta gamma"), ("c", "k1", "alpha delta"), ("c", "k3", None), ("e", "k9", "alpha")], "course_id string, chunk_id string, text string")
    got = {r["q_id"]: r for r in align.bm25_align(q, c).collect()}
    assert set(got) == {"q1", "q2"}
    assert got["q2"]["chunk_id"] == "k1" and got["q2"]["bm25_score"] == 0.0 and got["q2"]["low_confidence"]
    assert align.bm25_align(q.limit(0), c).count() == 0 and align.bm25_align(q, c.limit(0)).count() == 0


def test_align_blocks_change_nothing(spark):
    import random

    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 12)))
    q = spark.createDataFrame([("c", f"q{i}", text()) for i in range(40)], "course_id string, q_id string, text string")
    c = spark.createDataFrame([("c", f"k{i:02d}", text()) for i in range(30)], "course_id string, chunk_id string, text string")
    rows = lambda n: sorted(map(tuple, align.bm25_align(q, c, block=n).collect()))
    assert rows(1000) == rows(7)
    w = {r["chunk_id"]: dict(zip(r["terms"], r["weights"])) for r in align.weighted_terms(c).collect()}
    for (_, q_id, chunk, score, _, _), (_, _, t) in zip(rows(1000), sorted(q.collect(), key=lambda r: r["q_id"])):
        every = {k: round(sum(w[k].get(x, 0.0) for x in t.split()), 9) for k in w}
        top = max(every.values())
        assert score == pytest.approx(top, abs=1e-4) and every[chunk] == pytest.approx(top, abs=1e-8)
