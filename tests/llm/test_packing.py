import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaestor.llm import packing


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=80, deadline=None)
def test_balanced_never_overfills(sizes):
    at = packing.balanced(np.array(sizes, dtype=int), 64)
    load = np.bincount(at, weights=sizes) if sizes else np.zeros(0)
    assert len(at) == len(sizes) and (load <= 64).all()
    assert (at == packing.balanced(np.array(sizes, dtype=int), 64)).all()


def test_costs_are_balanced():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 200, 600)
    at = packing.balanced(sizes, 1024)
    load = np.bincount(at, weights=sizes)
    assert load.sum() / (len(load) * 1024) > 0.97 and load.std() < 60


def test_every_token_has_one_place(spark):
    rows = [(i, "word " * (i % 90 + 1)) for i in range(300)] + [(1000, "long text " * 9000), (1001, None), (1002, ""), (None, "x"), (5, "word " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("container", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    out = packing.pack(df, 128, group_items=64).toPandas()
    enc = packing.encoding(packing.TOKENIZER)
    want = sum(len(enc.encode_ordinary(t)) for k, t in rows if k is not None and t)
    assert out.n_tokens.sum() == want and out.groupby("container").n_tokens.sum().max() <= 128
    whole = out.groupby("doc_key").size()
    assert all(whole[i] == (2 if i == 5 else 1) for i in range(300)) and whole[1000] == -(-out[out.doc_key == 1000].n_tokens.sum() // 128)
    big = out[out.doc_key == 1000].sort_values("piece")
    assert (big.start_token.to_numpy() == np.arange(len(big)) * 128).all() and (big.n_tokens[:-1] == 128).all()


def test_empty_table_and_partitioning(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), 128).count() == 0
    df = spark.createDataFrame([(i, "a b c " * (i + 1)) for i in range(40)], "doc_id long, text string")
    key = lambda d: sorted(map(tuple, packing.pack(d, 64).collect()))
    assert key(df) == key(df.repartition(5))
