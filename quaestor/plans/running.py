"""Stages, switches and evaluation by course; the order of metrics; metrics with back ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import az09_words, is_blank, txt
from quaestor.operators import annotate as N
from quaestor.operators import metrics as M
from quaestor.operators import evaluation, pipeline, rules, runner, wiring
from quaestor.operators import similarity as S
from quaestor.plans.annotated import _TOKENS, _in
from quaestor.plans.core import query, r6, s6
from quaestor.plans.similarity import PAIRS, pairs
from quaestor.runtime import cut, scratch, table


def _courses(spark, sf):
    """Courses; those with chunks, with records, with results."""
    t = lambda n, c="course_id": table(spark, sf, n).select(F.col(c).alias("course_id")).where("course_id is not null").distinct()
    return t("course_meta"), t("chunks"), t("records", "question.metadata.course_id"), t("results")


_HAVE = (
    "WITH c AS (SELECT DISTINCT course_id FROM course_meta WHERE course_id IS NOT NULL), s AS (SELECT course_id, "
    "course_id NOT IN (SELECT course_id FROM chunks WHERE course_id IS NOT NULL) AS x, course_id NOT IN (SELECT question.metadata.course_id FROM records WHERE question.metadata.course_id IS NOT NULL) AS a, "
    "course_id NOT IN (SELECT course_id FROM results WHERE course_id IS NOT NULL) AS e FROM c) "
)


@query(_HAVE + 'SELECT course_id, x AS "extract", a AS align, true AS flatten, e AS evaluate FROM s')
def stage_skip(spark, sf):
    return runner.stages(*_courses(spark, sf))


_FLAGS = [(d, n, f) for d in (False, True) for n in (False, True) for f in (False, True)]


@query(
    _HAVE
    + "SELECT course_id, dry_run, no_eval, force_eval, x AND NOT dry_run AS \"extract\", a AND NOT dry_run AS align, NOT dry_run AS flatten, (e OR force_eval) AND NOT dry_run AND NOT no_eval AS evaluate FROM s, (VALUES "
    + ", ".join(f"({d}, {n}, {f})" for d, n, f in _FLAGS)
    + ") AS k(dry_run, no_eval, force_eval)"
)
def cli_switches(spark, sf):
    """The same under every setting of the three switches."""
    sides = _courses(spark, sf)
    one = lambda d, n, f: runner.stages(*sides, d, n, f).withColumns({"dry_run": F.lit(d), "no_eval": F.lit(n), "force_eval": F.lit(f)})
    return reduce(DataFrame.unionByName, [one(*k) for k in _FLAGS])


@query(f"SELECT course_id, count(*) AS questions, count(*) * {len(M.REGISTRY)} AS scores FROM (SELECT DISTINCT course_id, q_id, text FROM questions_raw WHERE course_id IS NOT NULL AND q_id IS NOT NULL) WHERE course_id NOT IN (SELECT course_id FROM results WHERE course_id IS NOT NULL) OR course_id IN (SELECT course_id FROM course_meta) GROUP BY 1")
def run_evaluate(spark, sf):
    """All metrics of the questions of every course, written by course and read back. Courses without metadata are done when
    they have no results; those with metadata are forced."""
    q, path = table(spark, sf, "questions_raw"), scratch(spark, "evaluated")
    meta, _, _, results = _courses(spark, sf)
    everyone = q.select("course_id").where("course_id is not null").distinct()
    forced = everyone.join(meta, "course_id", "left_semi")
    todo = runner.stages(everyone, meta, meta, results).select("course_id", "evaluate").where("evaluate").unionByName(forced.withColumn("evaluate", F.lit(True))).distinct()
    runner.run_evaluate(q, path, todo)
    x = spark.read.parquet(path).groupBy(F.col("course_id").cast("string").alias("course_id")).agg(F.count("score").alias("scores"))
    n = q.select("course_id", "q_id", "text").distinct().where("q_id is not null").groupBy("course_id").agg(F.count("*").alias("questions"))
    return x.join(n, "course_id").select("course_id", "questions", "scores")


@query("SELECT count(*) AS total, count(*) - count(text) AS failed, (count(*) - count(text)) * 1.0 / count(*) > 0.5 AS stopped FROM (SELECT DISTINCT q_id, text FROM questions_raw)")
def circuit_breaker(spark, sf):
    """Whether the share of failed items stops the job; the order in which items fail plays no part."""
    q = table(spark, sf, "questions_raw").select(F.col("q_id").alias("id"), "text").distinct()
    long, errors = pipeline.run(q, names=["word_count"])
    rep = pipeline.report(q, errors, long)
    try:
        pipeline.failure_guard(rep)
        stopped = False
    except RuntimeError:
        stopped = True
    return rep.select("total", "failed", F.lit(stopped).alias("stopped"))


def _sql_wiring() -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'"
    return ", ".join(f"('{a}', '{d}', {i}, {text(m)}, {j}, {text(s)})" for a, d, i, m, j, s in wiring.rows())


@query(f'SELECT * FROM (VALUES {_sql_wiring()}) AS v(aspect, dimension, dimension_no, metric, metric_no, "references")')
def dimension_wiring(spark, sf):
    """Every metric of every dimension in its order, with the source of its references."""
    return wiring.table(spark)


@query("SELECT aspect, count(DISTINCT dimension) AS dimensions, count(metric) AS \"values\" FROM (VALUES " + _sql_wiring() + ") AS v(aspect, dimension, dimension_no, metric, metric_no, r) GROUP BY 1")
def aspect_evaluate(spark, sf):
    """Dimensions and metric values of every aspect."""
    return wiring.table(spark).groupBy("aspect").agg(F.countDistinct("dimension").alias("dimensions"), F.count("metric").alias("values"))


_HAVE_VALUES = [(a, d, i, m, j) for a, d, i, m, j, _ in wiring.rows() if m and m not in {"bertscore", "bleurt", "bartscore", "comet", "sbert", "nli_entailment", "polysemy_score", "lm_perplexity"}]


@query(
    'SELECT v.*, n FROM (VALUES ' + ", ".join(f"('{a}', '{d}', {i}, '{m}', {j})" for a, d, i, m, j in _HAVE_VALUES) + ') AS v(aspect, dimension, dimension_no, metric, metric_no), '
    "(SELECT count(*) AS n FROM (SELECT DISTINCT question.id, question.text, context.learning_objectives, context.course_content, context.metadata.question_batch FROM records))"
)
def evaluate_records(spark, sf):
    """The whole evaluation of every record: which metrics come out, in what order, and for how many records. Metrics without
    a back end are absent."""
    items = pairs(spark, sf).withColumn("question_id", F.struct("question_id", F.xxhash64("text", "objectives", "content", "batch").alias("h")))
    q = table(spark, sf, "questions_raw").select(F.coalesce("text", F.lit("")).alias("text"))
    counts = q.select(F.explode(M.alpha_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    counts = cut(counts.join(F.broadcast(counts.agg(F.sum("c").alias("t"))), F.lit(True)))  # the other side is one row
    easy = counts.where("c * 2000 >= t").select("word")
    zipf = counts.select("word", F.least(F.lit(8.0), F.greatest(F.lit(0.0), F.log10(F.col("c") * 1e9 / F.col("t")))).alias("zipf"))
    n = evaluation.evaluate(items, easy, zipf).groupBy("aspect", "dimension", "metric").agg(F.count("score").alias("n"))
    return n.select("aspect", "dimension", wiring.dimension_place(F.col("dimension")).alias("dimension_no"), "metric", wiring.place(F.col("dimension"), F.col("metric")).alias("metric_no"), "n")


# Metrics whose models are not at hand run here on a back end named `overlap`: a stand-in that is computed from words and is no
# approximation of the model. It exercises normalisation, the maximum over references, flags and absence.
OVERLAP = "overlap"


def _overlap(text, refs):
    """The highest share of different words in common with a reference (Jaccard), null without references."""
    w = F.array_distinct(az09_words(text))
    inter = lambda r: F.size(F.array_intersect(w, F.array_distinct(az09_words(r))))
    one = lambda r: F.when(F.size(F.array_union(w, F.array_distinct(az09_words(r)))) == 0, 0.0).otherwise(inter(r) / F.size(F.array_union(w, F.array_distinct(az09_words(r)))).cast("double"))
    return F.array_max(F.transform(refs, one))


# What each metric's raw value is made of the overlap: values beyond its bounds on purpose, so that clipping is seen.
RAW = {
    "bertscore": (lambda j: j * 1.5, "least(1.0, j * 1.5)", 0.5),
    "bleurt": (lambda j: j * 3 - 0.5, "least(1.0, greatest(0.0, j * 3 - 0.5))", 0.5),
    "bartscore": (lambda j: j * 10 - 6, "least(1.0, greatest(0.0, (j * 10 - 6 + 5.0) / 5.0))", 0.5),
    "comet": (lambda j: j * 2 - 0.1, "least(1.0, greatest(0.0, j * 2 - 0.1))", 0.5),
    "nli_entailment": (lambda j: N.entailment(F.array(1 - j, j * 4, F.lit(0.0)), 1), "exp(j * 4) / (exp(1 - j) + exp(j * 4) + 1)", 0.5),
    "lm_perplexity": (lambda j: 1 + j * 1500, "CASE WHEN 1 + j * 1500 <= 1 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - ln(1 + j * 1500) / ln(1000.0))) END", 0.3),
}
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_J = f"list_max(list_transform(objs, lambda o: CASE WHEN len(list_distinct(list_concat({_WORDS.format('t')}, {_WORDS.format('o')}))) = 0 THEN 0.0 ELSE len(list_intersect({_WORDS.format('t')}, {_WORDS.format('o')})) * 1.0 / len(list_distinct(list_concat({_WORDS.format('t')}, {_WORDS.format('o')}))) END))"


def _backend(name: str):
    make, _, below = RAW[name]

    def f(spark, sf):
        N.register(N.Backend(name, lambda text, refs: make(_overlap(text, refs))))
        x = pairs(spark, sf).withColumn("refs", S.references(F.col("objectives")))
        score = F.when((F.size("refs") == 0) | is_blank(F.col("text")), 0.0).otherwise(N.model_score(name, txt(F.col("text")), F.col("refs")))
        N.BACKENDS.pop(name)  # absent again for every other query
        x = x.select("question_id", score.alias("score"))
        return x.select("question_id", r6("score").alias("score"), (F.col("score") < below).alias("flagged"), F.lit(OVERLAP).alias("backend"))

    f.__doc__ = f"`{name}` of every record against its objectives, on the stand-in back end."
    return f


for _name, (_, _sql, _below) in RAW.items():
    query(
        PAIRS + f", k AS (SELECT question_id, CASE WHEN len(objs) = 0 OR blank THEN 0.0 ELSE (SELECT {_sql} FROM (SELECT {_J} AS j)) END AS score FROM r) SELECT question_id, {s6('score')} AS score, score < {_below} AS flagged, '{OVERLAP}' AS backend FROM k",
        _name,
    )(_backend(_name))


def _senses(spark, sf):
    """A stand-in for a table of senses: in how many courses a word is used, at least one."""
    x = table(spark, sf, "questions_raw").select("course_id", F.explode(M.alpha_words(F.col("text"))).alias("word"))
    return x.groupBy("word").agg(F.greatest(F.lit(1), F.countDistinct("course_id")).cast("int").alias("senses"))


@query(
    _TOKENS.replace("FROM questions_raw), w AS", "FROM (SELECT DISTINCT q_id, text FROM questions_raw)), w AS")
    + "n AS (SELECT word, greatest(1, count(DISTINCT course_id)) AS senses FROM (SELECT course_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM questions_raw) GROUP BY word), "
    + f"s AS (SELECT rid, avg(senses) AS raw FROM tok LEFT JOIN n ON n.word = tok.lw WHERE lw NOT IN {_in(rules.AUX)} AND (verb OR noun OR tag IN ('JJ', 'RB')) GROUP BY rid) "
    + f"SELECT question_id, {s6('greatest(0.0, 1 - least(1.0, coalesce(raw, 0) / 10.0))')} AS score, 'courses' AS backend FROM q LEFT JOIN s USING (rid)"
)
def polysemy_score(spark, sf):
    """Mean number of senses of the open-class words of every question, with the stand-in table `courses`."""
    q = table(spark, sf, "questions_raw").select("q_id", "text").distinct().withColumn("k", F.struct("q_id", F.md5(txt(F.col("text"))).alias("m")))
    t = rules.annotate(q.select("k", "text")).select("k", F.explode_outer(F.filter("tokens", lambda x: x["pos"].isin("NOUN", "VERB", "ADJ", "ADV"))).alias("t"))
    y = t.select("k", F.lower(F.col("t.text")).alias("word")).join(_senses(spark, sf), "word", "left").groupBy("k").agg(F.avg("senses").alias("raw"))
    return y.select(F.col("k.q_id").alias("question_id"), r6(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.coalesce("raw", F.lit(0.0)) / 10.0))).alias("score"), F.lit("courses").alias("backend"))
