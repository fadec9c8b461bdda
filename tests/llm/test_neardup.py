import random
import re

import pytest
from pyspark.sql import functions as F

from quaestor.llm import neardup


def brute(rows, threshold=0.75):
    sets = [(k, frozenset(re.findall("[a-z0-9]+", t.lower()))) for k, t in {(k, t) for k, t in rows if k is not None and t}]
    sets = [x for x in sets if x[1]]
    return {(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a != b and len(x & y) / len(x | y) >= threshold}


def fixture():
    rnd, rows = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(300)]
    for g in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 70))]
        for v in range(rnd.randint(1, 4)):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 12))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((f"k{g}-{v}", " ".join(words)))
    rows += [(f"copy{i}", "The same question, word for word.") for i in range(40)]
    rows += [("copy0", "The same question, word for word."), ("n", None), ("e", ""), ("b", "  \n"), ("p", "!!!"), (None, "The same question, word for word."), ("long", "very long text " * 30_000)]
    return rows


def test_pairs_match_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "id string, text string").withColumn("words", F.lit("clash")).withColumn("set_id", F.lit("clash"))
    got = {(r["key_a"], r["key_b"]) for r in neardup.duplicate_pairs(df, "id", "text").collect()}
    assert got == brute(rows)


def test_groups_count_links_between_different_texts(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "id string, text string")
    g = {r["key"]: r for r in neardup.duplicate_groups(df, "id", "text").collect()}
    assert g["copy1"]["n_copies"] == 40 and g["copy1"]["n_links"] == 0
    keys = {k for k, t in rows if k is not None and t and re.search("[a-z0-9]", t.lower())}
    assert set(g) == keys
    assert {k for p in brute(rows) for k in p} == {k for k, r in g.items() if r["n_links"] or r["n_copies"] > 1}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert neardup.duplicate_pairs(df, "id", "text").count() == 0 and neardup.duplicate_groups(df, "id", "text").count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_changes_nothing(spark, parts):
    rows = fixture()[:80]
    df = spark.createDataFrame(rows, "id string, text string").repartition(parts)
    assert {(r[0], r[1]) for r in neardup.duplicate_pairs(df, "id", "text").collect()} == brute(rows)


def test_long_lists_are_split_without_a_change(spark):
    rows = fixture()
    sets = neardup.word_sets(spark.createDataFrame(rows, "id string, text string"), "id", "text")
    reps = neardup.classes(sets)
    pairs = lambda n: {(r["id_a"], r["id_b"]) for r in neardup.similar_classes(reps, 0.75, longest=n).collect()}
    assert pairs(2) == pairs(5000) != set()


def test_collisions_are_counted():
    """Against the signature itself: pairs come out that collide often enough, whether in posted or in probed coordinates."""
    import numpy as np
    import pandas as pd

    rnd = random.Random(2)
    base = [rnd.getrandbits(62) for _ in range(60)]
    words = pd.Series([np.array(sorted({x if rnd.random() > 0.08 else rnd.getrandbits(62) for x in base})) for _ in range(40)])
    s = neardup._signature(words)
    assert all(len(p) == neardup.PREFIX for p in s["posts"])
    a, b = s["posts"][0], s["posts"][1]
    n = int((a == b).sum())
    same = (int(s["carried"][0]) ^ int(s["carried"][1])) & neardup._mask(True) == 0
    assert n + same >= neardup.MATCHES
    assert bin((int(s["carried"][0]) ^ int(s["carried"][1])) & neardup._mask(False) & (2**64 - 1)).count("1") <= neardup.BITS - neardup.AGREE


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.8, far from copies."""
    rnd, rows = random.Random(7), []
    for g in range(300):
        words = [f"{g}x{i}" for i in range(56)]
        other = words[:48] + [f"{g}y{i}" for i in range(8)]
        rows += [(f"a{g}", " ".join(words)), (f"b{g}", " ".join(other))]
        rnd.random()
    got = neardup.duplicate_pairs(spark.createDataFrame(rows, "id string, text string"), "id", "text").count()
    assert got >= 297
