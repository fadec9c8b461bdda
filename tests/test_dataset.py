import pytest
from pyspark.sql import functions as F

from quaestor.operators import annotate as N
from quaestor.operators import dataset as D
from quaestor.operators import pipeline as P
from quaestor.sources import jsonl, report
from quaestor.streaming import evaluate as E


def test_clean_and_sections(spark):
    df = spark.createDataFrame([("a(cid:12)b  c ﬁnd\nHeading One\nbody",), (None,)], "t string")
    r = df.select(D.clean_text(F.col("t")).alias("c"), D.sections(F.col("t")).alias("s")).collect()
    assert r[0]["c"] == "ab c find\nHeading One\nbody" and len(r[0]["s"]) == 2 and r[1]["c"] is None and r[1]["s"] == []


def test_paragraphs_are_packed(spark):
    rows = [("a b c\n\nd e\n\n\n\nf g h i j k",), ("a  b\n\nc",), ("",), (None,), ("a b c d e f g",), ("w x y z u\n\n" * 300,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(D.packed(F.col("t"), 5, 1)).collect()]
    assert got[:5] == [["a b c d e", "e f g h i j k"], ["a  b\n\nc"], [""], None, ["a b c d e f g"]]
    assert len(got[5]) == 300 and got[5][1] == "u w x y z u"
    assert spark.createDataFrame([("a b\n\nc",)], "t string").select(D.packed(F.col("t"), 2, 0)).first()[0] == ["a b", "c"]


def test_ids_are_unique_over_files(spark):
    docs = spark.createDataFrame([("c", f"f{i}", "Problem 1. " + "word " * 20 + "\nProblem 2. short\nProblem 3. " + "text " * 20) for i in range(5)] + [("c", "g", None)], "course_id string, source_file string, text string")
    x = docs.select("course_id", "source_file", F.lit("exam").alias("source_type"), F.posexplode(D.stems(F.col("text"))).alias("pos", "text"))
    ids = sorted(r["q_id"] for r in D.question_ids(x).collect())
    assert ids == [f"c-E{i:04d}" for i in range(1, 11)]


def test_options_and_objectives(spark):
    full = "1. Which is a gas?\nA. iron\nB) neon\nNot an option\nC. zinc"
    df = spark.createDataFrame([(full, "Which is a gas?"), (full, "absent"), (None, "x")], "f string, s string")
    assert [r[0] for r in df.select(D.options_after(F.col("f"), F.col("s"))).collect()] == [["A. iron", "B) neon"], None, None]
    t = spark.createDataFrame([("Intro\nLearning objectives\n- explain the rate law\n* short\n1. derive the second law",)], "t string")
    assert t.select(D.objectives(F.col("t"))).first()[0] == ["explain the rate law", "derive the second law"]


def test_labels(spark):
    df = spark.createDataFrame([("a_b_problem_set-2.pdf",), ("plain.pdf",)], "f string")
    assert [r[0] for r in df.select(D.source_label(F.col("f"))).collect()] == ["B Problem Set 2", "plain"]


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é", 1), (None, 2)], "a string, b int")
    jsonl.write_jsonl(df, str(tmp_path / "x"))
    assert sorted(map(str, jsonl.read_jsonl(spark, str(tmp_path / "x"), df.schema).collect())) == sorted(map(str, df.collect()))
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": "x", "b": 1}\n\n{"a": \n{"_type": "dataset_header"}\n')
    assert jsonl.read_jsonl(spark, str(bad), df.schema).where("a is not null").count() == 1
    with pytest.raises(Exception):
        jsonl.parse(spark.read.text(str(bad)), df.schema, strict=True).collect()
    objects = tmp_path / "o.txt"
    objects.write_text('{"a": "x", "b": 1},\n{"a": "y", "b": 2},\n')
    assert jsonl.read_objects(spark, str(objects), df.schema).count() == 2
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "meta.json").write_text('{\n"a": "x",\n"b": 3}')
    assert jsonl.read_meta(spark, str(tmp_path / "*/meta.json"), df.schema).first()["b"] == 3
    assert [r[0] for r in jsonl.discover(spark, str(tmp_path / "*/meta.json")).collect()] == ["c1"]
    (tmp_path / "goals.txt").write_text(" one \n\n two\n")
    assert [r["line"] for r in jsonl.read_lines(spark, str(tmp_path / "goals.txt")).orderBy("pos").collect()] == ["one", "two"]


def test_old_scores_are_coerced(spark):
    df = spark.createDataFrame([("q", '{"a": {"d": {"m": 0.5, "n": {"score": 0.1, "flagged": true, "rationale": "r"}}}}')], "question_id string, scores string")
    got = {r["metric"]: (r["score"], r["flagged"], r["rationale"]) for r in jsonl.coerce_scores(df).collect()}
    assert got == {"m": (0.5, False, ""), "n": (0.1, True, "r")}


def test_dataset_header_and_report(spark, tmp_path):
    rec = spark.createDataFrame([(("q", ("c", "exam")),)], "question struct<id:string, metadata:struct<course_id:string, source_type:string>>")
    jsonl.write_dataset(rec, str(tmp_path / "d"), "2026-01-01")
    assert '"total_records":1' in spark.read.text(str(tmp_path / "d/header")).first()[0]
    assert jsonl.read_dataset(spark, str(tmp_path / "d/records"), rec.schema, courses=["c"], source_types=["exam"], limit=5).count() == 1
    long = spark.createDataFrame([("q", "a", "some_dim", "m", 0.123456, True, None)], "question_id string, aspect string, dimension string, metric string, score double, flagged boolean, rationale string")
    assert set(report.write(long, str(tmp_path / "r"))) == {"json", "markdown"}
    text = report.markdown_sections(long).first()["value"]
    assert "#### Some Dim ⚠️" in text and "| m | 0.1235 | yes |" in text
    with pytest.raises(ValueError):
        report.write(long, str(tmp_path / "r"), ("html",))


def test_pipeline(spark):
    q = spark.createDataFrame([("a", "Why?"), ("b", None), (None, "x")], "id string, text string")
    long, errors = P.run(q, names=["word_count"])
    assert {r["question_id"] for r in long.collect()} == {"a"} and errors.count() == 2
    r = P.report(q, errors).first()
    assert (r["total"], r["succeeded"], r["failed"]) == (3, 1, 2)
    with pytest.raises(RuntimeError):
        P.failure_guard(P.report(q, errors))
    again, _ = P.run(q, stored=long, names=["word_count"])
    assert again.count() == long.count() == 1  # stored scores come back whole
    assert P.report(q.limit(0), errors.limit(0)).first()["success_rate"] == 0.0


def test_annotated_metrics(spark):
    # "He never runs": runs is the root, He its subject, never its negation
    toks = [("He", "PRON", "PRP", "nsubj", 2, "Sing", ""), ("never", "ADV", "RB", "neg", 2, None, ""), ("runs", "VERB", "VBZ", "ROOT", 2, "Sing", "")]
    df = spark.createDataFrame([(toks,), ([],)], "t array<struct<text:string,pos:string,tag:string,dep:string,head:int,number:string,ent:string>>")
    t = F.col("t")
    cols = [N.parse_tree_depth(N.heads(t)), N.dependency_distance(t), N.passive_voice_rate(t), N.negation_ambiguity(t), N.subject_verb_agreement(t), N.has_verb(t), N.lexical_density(t), N.pronoun_ratio(t)]
    a, b = df.select(*[c.alias(str(i)) for i, c in enumerate(cols)]).collect()
    assert [round(x, 4) for x in a] == [0.9, round(1 - 1.5 / 8, 4), 1.0, round(1 - 0.3 / 1.4, 4), 1.0, 1.0, round(2 / 3, 4), round(2 / 3, 4)]
    assert b["4"] == 0.5 and b["5"] == 0.0


def test_backends(spark):
    with pytest.raises(LookupError):
        N.model_score("bleurt", F.lit("x"), F.array(F.lit("y")))
    with pytest.raises(ValueError):
        N.register(N.Backend("nope", lambda t, r: F.lit(0.0)))
    N.register(N.Backend("bartscore", lambda t, r: F.lit(-2.5)))
    try:
        assert spark.range(1).select(N.model_score("bartscore", F.lit("x"), F.array(F.lit("y")))).first()[0] == 0.5
    finally:
        N.BACKENDS.clear()
    assert round(spark.range(1).select(N.entailment(F.array(F.lit(0.0), F.lit(0.0)))).first()[0], 6) == 0.5


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"q_id": "a", "text": "Why?"}\nbroken\n')
    schema = spark.createDataFrame([], "q_id string, text string").schema
    q = E.evaluate(E.read_items(spark, str(tmp_path / "in"), schema), names=["word_count", "question_mark"]).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["metric"]: r["score"] for r in spark.table("scored").collect()} == {"word_count": 0.02, "question_mark": 1.0}


def test_rules_annotator(spark):
    from quaestor.operators import rules

    df = spark.createDataFrame([("The old dog does not chase cats.",), (None,), (" ",)], "text string")
    r = rules.annotate(df).collect()
    t = r[0]["tokens"]
    assert [x["text"] for x in t] == ["The", "old", "dog", "does", "not", "chase", "cats"] and t[3]["dep"] == "ROOT" and t[2]["dep"] == "nsubj" and t[4]["dep"] == "neg"
    assert r[1]["tokens"] == r[2]["tokens"] == []
