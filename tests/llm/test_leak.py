import random

from pyspark.sql import functions as F

from quaestor.llm import leak


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        w = leak.words_of(t)
        have = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for k, q in items:
            v = leak.words_of(q)
            if k is not None and d is not None and any(tuple(v[i : i + run]) in have for i in range(len(v) - run + 1)):
                out.add((d, k))
    return out


def fixture():
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "rate", "of", "a", "gas", "7", "box", "is"])
    items = [(i, " ".join(word() for _ in range(rnd.randint(0, 30)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "one two three four five six seven eight nine ten eleven twelve"), (93, "ONE, two three; four-five six\nseven eight nine ten eleven (twelve)"), (None, "x")]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rnd.randint(0, 60))]
        if d % 3 == 0:
            w = leak.words_of(rnd.choice(items[:25])[1])
            a = rnd.randint(0, max(0, len(w) - 5))
            text[5:5] = w[a : a + rnd.randint(5, 20)]
        docs.append((d, " ".join(text)))
    docs += [(100, "> One two\n> THREE four five, six seven eight nine ten eleven twelve!"), (101, "one two three four five six seven eight nine ten eleven and twelve"), (102, None), (103, ""), (104, docs[0][1]), (None, "y"), (105, "filler words " * 60_000 + " one two three four five six seven eight nine ten eleven twelve")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("question", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, question string").withColumn("text", F.lit("clash"))
    for run in (5, 12):
        want = brute(docs, items, run)
        assert {tuple(r) for r in leak.leaks(d, i, run).collect()} == want
        assert {tuple(r) for r in leak.leaks(d, i, run, block=14).collect()} == want  # items in several blocks
    assert {(100, 92), (100, 93), (105, 92)} <= brute(docs, items, 12)


def test_empty_tables(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, question string")
    assert leak.leaks(d.limit(0), i).count() == 0 and leak.leaks(d, i.limit(0)).count() == 0


def test_shift_table_skips():
    p = tuple("abcdefghijkl")
    e = leak.WuManber({p: {1}})
    assert e.search(list("zzzz") + list(p)) == {1} and e.search(list(p)[:-1]) == set()
    assert e.jump == 11 and e.shift[("k", "l")] == 0 and e.shift[("a", "b")] == 10
