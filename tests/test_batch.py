import pytest
from pyspark.sql import functions as F

from quaestor.operators import batch
from quaestor.operators import similarity as S

SCHEMA = "course_id string, source_file string, q_id string, text string"
ROWS = [
    ("c", "f", "q2", "name the parts of a cell"), ("c", "f", "q1", "name the parts of a leaf"), ("c", "f", "q1", "name the parts of a leaf"),
    ("c", "f", "q3", " name the parts of a leaf\n"), ("c", "f", "q4", None), ("c", "f", "q5", "  "), (None, "f", "q6", "draw a cell"), (None, "f", "q7", "draw a leaf"),
    ("c", None, "q8", "no batch"), ("c", "g", None, "alone"),
]


def test_rows_hold_the_texts_in_order(spark):
    got = sorted(batch.batch_rows(spark.createDataFrame(ROWS, SCHEMA)).collect(), key=lambda r: (r[0], r[1], r[2]))
    assert [(r["course_id"], r["source_file"], r["position"], r["q_id"], r["copies"]) for r in got] == [
        ("", "f", 1, "q6", 1), ("", "f", 2, "q7", 1), ("c", "f", 1, "q1", 2), ("c", "f", 2, "q2", 1), ("c", "f", 3, "q3", 1), ("c", "f", 4, "q4", 1), ("c", "f", 5, "q5", 1), ("c", "g", 1, None, 1)
    ]
    assert [r["text"] for r in got[2:7]] == ["name the parts of a leaf", "name the parts of a cell", " name the parts of a leaf\n", None, "  "]
    assert batch.batch_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_file_is_ordered_over_its_parts(spark):
    n = 3000
    x = spark.range(n).select(F.lit("c").alias("course_id"), F.lit("f").alias("source_file"), F.format_string("q%05d", "id").alias("q_id"), F.col("id").cast("string").alias("text")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    try:
        got = sorted((r["q_id"], r["position"]) for r in batch.batch_rows(x).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(f"q{i:05d}", i + 1) for i in range(n)]


def test_peers_by_stripped_text_and_null_course(spark):
    got = {r["q_id"]: r["peers"] for r in batch.batch_peers(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {"q1": 1, "q2": 2, "q3": 1, "q4": 0, "q5": 0, "q6": 1, "q7": 1, None: 0}


@pytest.mark.parametrize("block", [64, 1])
def test_self_bleu_equals_the_gathered_batch(spark, block):
    got = {r["q_id"]: (r["score"], r["flagged"]) for r in batch.self_bleu(spark.createDataFrame(ROWS, SCHEMA), block).collect()}
    own = sorted({r for r in ROWS if r[1]}, key=str)
    for c, f, q, t in own:
        if t and t.strip():
            want = S.self_bleu(t, [r[3] for r in own if r[:2] == (c, f) and r[3]])
            assert got[q] == (pytest.approx(want), want < 0.3), q
    assert got["q4"] == got["q5"] == (0.0, True) and got[None] == (1.0, False)
