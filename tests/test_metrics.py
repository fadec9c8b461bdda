import pytest
from pyspark.sql import functions as F

from quaestor.operators import metrics as M

CASES = [
    ("word_count", "photosynthesis", 0.02, None),
    ("word_count", "word " * 60, 1.0, False),
    ("sentence_count", "Describe osmosis. What drives it? Give an example.", 0.6, False),
    ("avg_word_length", "cat", 0.7, False),
    ("long_word_ratio", "what is a cat", 1.0, False),
    ("long_word_ratio", "thermodynamic crystallography equilibrium", 0.0, True),
    ("type_token_ratio", "cat sat on mat", 1.0, False),
    ("type_token_ratio", "cat cat cat cat", 0.25, True),
    ("distinct_2", "cat sat on mat", 1.0, False),
    ("distinct_1", "cat sat on mat", 1.0, False),
    ("distinct_2", "cat", 0.0, True),
    ("wh_word_type", "Who discovered penicillin?", 1.0, False),
    ("wh_word_type", "What is photosynthesis?", 0.7, False),
    ("wh_word_type", "Explain photosynthesis.", 0.2, True),
    ("wh_word_type", "What and why does osmosis occur?", 0.35, False),
    ("question_mark", "What is it?   ", 1.0, False),
    ("question_mark", "Describe photosynthesis.", 0.0, True),
    ("negation_rate", "Which of the following is NOT a mammal?", 0.5, False),
    ("negation_rate", "Why doesn't osmosis stop?", 0.5, False),
    ("bloom_level", "Analyze and design a bridge.", 1.0, False),
    ("bloom_level", "Photosynthesis?", 1 / 6, True),
    ("dok_level", "Explain osmosis.", 0.75, False),
    ("hots_keywords", "Osmosis?", 0.5, False),
    ("openendedness", "Is water wet?", 0.9, False),
    ("openendedness", "Is it clear what happens?", 0.7, False),
    ("openendedness", "Water.", 0.7, False),
    ("k_anonymity_risk", "A plain question about rocks.", 1.0, False),
    ("dp_epsilon_risk", "A 42-year-old woman", 0.6, False),
    ("multipart_question", "(a) foo (b) bar", 1.0, False),
    ("multipart_question", "1. Define x 2. Show y", 1.0, False),
    ("multipart_question", "Part A and Part B", 0.0, True),
    ("multipart_question", "first prove", 0.5, False),
]


def test_exact_values(spark):
    names = sorted({c[0] for c in CASES})
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "id int, text string")
    got = {(r["question_id"], r["metric"]): r for r in M.evaluate(df, "id", names).collect()}
    for i, (name, _, score, flagged) in enumerate(CASES):
        r = got[i, name]
        assert r["score"] == pytest.approx(score, abs=1e-9), (name, CASES[i][1])
        if flagged is not None:
            assert r["flagged"] is flagged, (name, CASES[i][1])


def test_contract_for_every_metric(spark):
    texts = [None, "", "  \t\n", "12345 !!", "word " * 20000, "What is a cat?"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("score", F.lit("clash"))
    rows = M.evaluate(df, "id").collect()
    assert len(rows) == len(texts) * len(M.REGISTRY)
    for r in rows:
        assert 0.0 <= r["score"] <= 1.0
        if r["question_id"] < 3:
            assert r["score"] == 0.0 and r["flagged"] and r["rationale"] == "Question text is empty."
    no_words = {r["metric"]: r["score"] for r in rows if r["question_id"] == 3}
    assert no_words["avg_word_length"] == no_words["long_word_ratio"] == no_words["quantifier_rate"] == 1.0
    assert no_words["word_count"] == no_words["type_token_ratio"] == no_words["distinct_1"] == 0.0


def test_empty_table_and_aspects(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert M.evaluate(df, "id").count() == 0
    one = spark.createDataFrame([(1, "Why?")], "id int, text string")
    assert M.evaluate(one, "id", aspects=[]).count() == len(M.REGISTRY)
    assert {r["aspect"] for r in M.evaluate(one, "id", aspects=["pedagogical"]).collect()} == {"pedagogical"}


def test_lexicon_metrics(spark):
    df = spark.createDataFrame([(1, "The cat runs"), (2, "the of"), (3, ""), (4, None)], "question_id int, text string")
    lex = spark.createDataFrame([("cat", 4.0), ("cat", 3.0), ("runs", 3.0), ("the", 7.0)], "word string, zipf double")
    got = {r[0]: (round(r[1], 6), r[2]) for r in M.zipf_word_frequency(df, lex).collect()}
    assert got == {1: (0.5, False), 2: (0.5, False), 3: (0.0, True), 4: (0.0, True)}
    easy = spark.createDataFrame([("the",), ("cat",)], "word string")
    dale = {r[0]: r[1] for r in M.difficult_word_grade(df, easy, "dale_chall").collect()}
    assert dale[1] == pytest.approx(1 - (0.1579 * 100 / 3 + 0.0496 * 3 + 3.6365) / 10)


def test_easier_text_scores_higher(spark):
    df = spark.createDataFrame([(1, "What is a cat?"), (2, "Notwithstanding thermodynamic considerations, characterise the irreversibility of macroscopic transformations comprehensively.")], "id int, text string")
    got = {(r["question_id"], r["metric"]): r["score"] for r in M.evaluate(df, "id", ["flesch_ease", "flesch_kincaid", "coleman_liau", "avg_syllables"]).collect()}
    for name in ("flesch_ease", "flesch_kincaid", "coleman_liau", "avg_syllables"):
        assert got[1, name] > got[2, name]
