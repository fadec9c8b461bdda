from pyspark.sql import functions as F

from quaestor.operators import annotate as N
from quaestor.operators import evaluation, metrics, runner, wiring
from quaestor.sources import pages, report

ITEM = "question_id string, text string, objectives array<string>, content string, batch array<string>"
ROWS = [("a", "What is the rate of the gas? Explain why.", ["explain the rate of a gas", " "], "The rate of the gas grows.", ["What is heat?", "Name a gas."]), ("b", "", None, None, None), ("c", None, [], "", [])]


def test_what_is_not_to_be_had_is_absent(spark):
    df = spark.createDataFrame(ROWS, ITEM)
    got = {(r["dimension"], r["metric"]) for r in evaluation.evaluate(df).collect()}
    want = {(d, m) for d, ms in wiring.METRICS.items() for m in ms}
    assert want - got == {(d, m) for d, m in want if m in {"bertscore", "bleurt", "bartscore", "comet", "sbert", "nli_entailment", "polysemy_score", "lm_perplexity", "dale_chall", "spache_score", "zipf_word_frequency"}}
    assert not got - want
    N.register(N.Backend("comet", lambda text, refs: F.lit(1.7)))
    try:
        long = evaluation.evaluate(df, spark.createDataFrame([("the",)], "word string"), spark.createDataFrame([("the", 7.0)], "word string, zipf double"))
        rows = long.where("metric = 'comet'").collect()
        assert {(r["question_id"], r["dimension"]): r["score"] for r in rows}[("a", "curriculum_alignment")] == 1.0
        assert all(r["score"] == 0.0 and r["flagged"] for r in rows if r["question_id"] != "a")
        assert long.select("metric").distinct().count() == 52 and long.where("score is null").count() == 0
    finally:
        N.BACKENDS.clear()


def test_wiring_has_the_values_of_the_whole(spark):
    w = wiring.table(spark)
    assert w.count() - w.where("metric is null").count() == 71 and w.select("dimension").distinct().count() == 21


def test_rationale_says_band_and_approximation(spark):
    df = spark.createDataFrame([("a", "What is it? Say why.")], "q string, text string")
    r = {x["metric"]: x["rationale"] for x in metrics.evaluate(df, "q").collect()}
    assert r["word_count"].endswith("(poor)") and r["has_verb"].endswith("[rules]") and "[" not in r["bloom_level"]


def test_stages_and_switches(spark):
    t = lambda *xs: spark.createDataFrame([(x,) for x in xs], "course_id string")
    run = lambda **k: {r["course_id"]: tuple(r)[1:] for r in runner.stages(t("a", "b", None, "a"), t("a"), t("b"), t("a", None), **k).collect()}
    assert run() == {"a": (False, True, True, False), "b": (True, False, True, True)}
    assert run(force_eval=True)["a"][3] and not run(force_eval=True, no_eval=True)["a"][3] and not any(run(dry_run=True)["b"])


def test_second_run_goes_on_where_results_are_missing(spark, tmp_path):
    q = spark.createDataFrame([("a", "1", "What is it?"), ("b", "2", "Say why."), (None, "3", "x"), ("b", "2", "Say why.")], "course_id string, q_id string, text string")
    path = str(tmp_path / "out")
    todo = spark.createDataFrame([("a", True), ("b", False)], "course_id string, evaluate boolean")
    runner.run_evaluate(q, path, todo, ["word_count"])
    runner.run_evaluate(q, path, spark.createDataFrame([("b", True)], "course_id string, evaluate boolean"), ["word_count"])
    assert {(r["course_id"], r["question_id"]) for r in spark.read.parquet(path).collect()} == {("a", "1"), ("b", "2")}


def test_pages(spark, tmp_path):
    html = '<html><head><style>p{}</style></head><body><p>a &amp; b &lt;c&gt;</p><script>x</script><hr class="page"><div>\n d<br/>e</div><!-- f --></body>'
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(pages.html_document(F.col("h"))).collect()
    assert [r[0] for r in got] == ["a & b <c>\n\nd\ne", "", ""]
    for name, data in (("a.bin", b"one|two"), ("b.bin", b"bad")):
        (tmp_path / name).write_bytes(data)

    def backend(data):
        if data == b"bad":
            raise ValueError("no pages")
        return data.decode().split("|")

    rows = {r["path"][-5:]: r for r in pages.read_pages(spark, str(tmp_path), backend).collect()}
    assert rows["a.bin"]["text"] == "one\n\ntwo" and rows["b.bin"]["text"] is None and rows["b.bin"]["error"] == "no pages"


def test_report_has_the_order_of_evaluation(spark):
    rows = [("q", "linguistic_structural", "readability", m, 0.5, False, "r") for m in ("ari", "word_count", "unknown", "sentence_count")]
    long = spark.createDataFrame(rows, "question_id string, aspect string, dimension string, metric string, score double, flagged boolean, rationale string")
    value = report.json_evaluations(long).first()["value"]
    at = [value.index(f'"{m}"') for m in ("word_count", "sentence_count", "ari", "unknown")]
    assert at == sorted(at)
    assert "| Rationale |" in report.markdown_sections(long, True).first()["value"] and '"total_questions":1' in report.json_header(long).first()["value"]
