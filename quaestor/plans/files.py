"""Sources and sinks over real files in the shared folder: what is written is read back and compared with the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import strip
from quaestor.operators import dataset as D
from quaestor.plans.core import query, r6, s6
from quaestor.plans.dataset import _LIG
from quaestor.plans.rollup import LONG, long
from quaestor.runtime import scratch, table
from quaestor.sources import jsonl, pages, report


def _course_of(path):
    """The course in a path of folders ``course=<id>``."""
    return F.regexp_extract(path, r"course=([^/]+)/", 1)


@query("SELECT q_id, course_id, md5(coalesce(text, '')) AS digest FROM questions_raw")
def scan_jsonl_tolerant(spark, sf):
    """Lines with blank and malformed ones among them, from a file: these are skipped, all others come back."""
    q, path = table(spark, sf, "questions_raw").select("q_id", "course_id", "text"), scratch(spark, "lines")
    bad = spark.createDataFrame([("",), ("   ",), ('{"q_id": "broken',), ("not json",)], "value string")
    q.select(F.to_json(F.struct("*")).alias("value")).unionByName(bad).write.text(path)
    return jsonl.read_jsonl(spark, path, q.schema).select("q_id", "course_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


_COURSES = "SELECT DISTINCT question.metadata.course_id AS c FROM records WHERE question.metadata.course_id IS NOT NULL ORDER BY 1 LIMIT 8"


@query(f"SELECT question.id AS question_id, question.metadata.course_id AS course_id, context.metadata.topic AS topic FROM records WHERE question.metadata.source_type IN ('exam') AND question.metadata.course_id IN ({_COURSES})")
def scan_dataset(spark, sf):
    """The strict reader over records and header written by the flattening sink, filtered by courses and kind."""
    r, path = table(spark, sf, "records"), scratch(spark, "dataset")
    jsonl.write_dataset(r, path, "2026-01-01")
    some = [x[0] for x in r.select(F.col("question.metadata.course_id").alias("c")).where("c is not null").distinct().orderBy("c").limit(8).collect()]
    x = jsonl.read_dataset(spark, f"{path}/*", r.schema, courses=some, source_types=["exam"])
    return x.select(F.col("question.id").alias("question_id"), F.col("question.metadata.course_id").alias("course_id"), F.col("context.metadata.topic").alias("topic"))


def _meta_files(spark, sf) -> tuple[DataFrame, str]:
    """One JSON object per course, in a folder of its own."""
    m, path = table(spark, sf, "course_meta").where("course_id is not null"), scratch(spark, "raw")
    one = m.groupBy("course_id").agg(F.min("title").alias("title"), F.min("level").alias("level"), F.min("subject").alias("subject"))
    one.select(F.col("course_id").alias("course"), F.to_json(F.struct("*")).alias("value")).repartition("course").write.partitionBy("course").text(path)
    return one, path


@query(
    "SELECT c.course_id, m.title, m.level, m.subject FROM (SELECT DISTINCT course_id FROM questions_raw WHERE course_id IS NOT NULL) c "
    "LEFT JOIN (SELECT course_id, min(title) AS title, min(level) AS level, min(subject) AS subject FROM course_meta GROUP BY 1) m USING (course_id)"
)
def scan_json_meta(spark, sf):
    """Metadata of the courses of all questions from their files; a course without a file has nulls."""
    one, path = _meta_files(spark, sf)
    meta = jsonl.read_meta(spark, f"{path}/*/*", one.schema)
    return table(spark, sf, "questions_raw").select("course_id").where("course_id is not null").distinct().join(meta, "course_id", "left")


@query("SELECT DISTINCT course_id AS course FROM course_meta WHERE course_id IS NOT NULL")
def discover_courses(spark, sf):
    _, path = _meta_files(spark, sf)
    return jsonl.discover(spark, f"{path}/*/*").select(F.regexp_replace("course", "^course=", "").alias("course"))


@query(r"SELECT course_id, line, count(*) AS n FROM (SELECT course_id, regexp_replace(unnest(learning_objectives), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line FROM course_meta WHERE course_id IS NOT NULL) WHERE line <> '' GROUP BY ALL")
def scan_text_lines(spark, sf):
    """Objectives from one text file per course, blank lines left out."""
    path = scratch(spark, "objectives")
    x = table(spark, sf, "course_meta").where("course_id is not null").select(F.col("course_id").alias("course"), F.explode("learning_objectives").alias("value"))
    blank = x.select("course").distinct().select("course", F.explode(F.array(F.lit(""), F.lit("  \t"))).alias("value"))
    x.where("value is not null").unionByName(blank).repartition("course").write.partitionBy("course").text(path)
    return jsonl.read_lines(spark, f"{path}/*/*").groupBy(_course_of(F.col("path")).alias("course_id"), "line").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(" + _LIG + r", '[ \t]{2,}', ' ', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> ''")
def scan_pdf(spark, sf):
    """Pages of marked-up documents, from files, back to cleaned text: the analogue of page extraction that runs here. Each
    document comes as two pages, one of them empty, with a script and a comment to be left out."""
    path, x = scratch(spark, "pages"), F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    html = F.concat(F.lit("<html><head><title>t</title></head><body><script>var a = 1 < 2;</script><!-- no -->"), x, F.lit('<hr class="page"/><div> </div></body></html>'))
    table(spark, sf, "documents").where(F.col("text").isNotNull() & (strip(F.col("text")) != "")).select("doc_id", html.alias("html")).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", F.md5(strip(pages.html_document(F.col("html")))).alias("digest"))


_JUDGE = LONG + f"SELECT question_id, dimension, metric, {s6('max(score)')} AS score FROM long WHERE question_id IS NOT NULL GROUP BY ALL"


@query(_JUDGE)
def scan_json_objects(spark, sf):
    """A rater's file of comma-separated objects {question_id, scores: {dimension: {metric: {score}}}}, read back to rows."""
    path = scratch(spark, "judge")
    x = long(spark, sf).where("question_id is not null").groupBy("question_id", "dimension", "metric").agg(F.max("score").alias("score"))
    m = x.groupBy("question_id", "dimension").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("score")))).alias("m"))
    j = m.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "m"))).alias("scores"))
    j.select(F.concat(F.to_json(F.struct("question_id", "scores")), F.lit(",")).alias("value")).write.text(path)
    got = jsonl.read_objects(spark, path, j.schema).select("question_id", F.explode("scores").alias("dimension", "m")).select("question_id", "dimension", F.explode("m").alias("metric", "s"))
    return got.select("question_id", "dimension", "metric", r6("s.score").alias("score"))


@query(
    LONG.replace("coalesce(m.value.flagged, m.value.score < 0.3, false) AS flagged", "m.value.flagged AS flagged")
    + f"SELECT question_id, aspect, dimension, metric, {s6('score')} AS score, CASE WHEN ord(right(question_id, 1)) % 2 = 0 THEN false ELSE flagged END AS flagged FROM long WHERE ord(right(question_id, 1)) % 2 = 1 OR score IS NOT NULL"
)
def scan_results(spark, sf):
    """Saved rows read back from files, half of them in the old form of bare numbers, coerced to the present one."""
    r, path = table(spark, sf, "results"), scratch(spark, "results")
    old = F.ascii(F.expr("right(question_id, 1)")) % 2 == 0
    bare = F.to_json(F.transform_values("scores", lambda a, ds: F.transform_values(ds, lambda d, ms: F.transform_values(ms, lambda m, s: s["score"]))))
    r.select("question_id", F.when(old, bare).otherwise(F.to_json("scores")).alias("scores")).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    x = jsonl.coerce_scores(jsonl.read_jsonl(spark, path, F.broadcast(r.select("question_id", F.lit("").alias("scores"))).schema))
    x = x.where(~(F.ascii(F.expr("right(question_id, 1)")) % 2 == 0) | F.col("score").isNotNull())
    return x.select("question_id", "aspect", "dimension", "metric", r6("score").alias("score"), "flagged")


@query("SELECT q_id, course_id, source_file, md5(coalesce(text, '')) AS digest FROM questions_raw")
def sink_jsonl(spark, sf):
    """Rows to a file of JSON lines and back."""
    q, path = table(spark, sf, "questions_raw"), scratch(spark, "sink")
    jsonl.write_jsonl(q, path)
    return jsonl.parse(spark.read.text(path), q.schema, strict=True).select("q_id", "course_id", "source_file", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT coalesce(question.metadata.course_id, '') AS course_id, count(*) AS records, (SELECT count(*) FROM records) AS total FROM records GROUP BY 1")
def sink_flatten(spark, sf):
    """Records of all courses in one folder with a header; the header's counts, checked against the rows that were written."""
    r, path = table(spark, sf, "records"), scratch(spark, "flat")
    jsonl.write_dataset(r, path, "2026-01-01")
    head = spark.read.schema("_type string, date string, total_records long, courses map<string,long>").json(f"{path}/header").where("_type is not null")
    said = head.select("total_records", F.explode("courses").alias("course_id", "n"))
    there = jsonl.read_dataset(spark, f"{path}/records", r.schema).groupBy(F.coalesce("question.metadata.course_id", F.lit("")).alias("course_id")).agg(F.count("*").alias("records"))
    return there.join(said.where("n > 0"), "course_id").select("course_id", "records", F.col("total_records").alias("total"))


_EVALUATION = "question_id string, aspects array<struct<aspect:string,dimensions:array<struct<dimension:string,metrics:array<struct<metric:string,score:double,flagged:boolean,rationale:string>>>>>>"


def _read_report(spark, path):
    x = spark.read.schema(_EVALUATION).json(path).select("question_id", F.explode("aspects").alias("a"))
    x = x.select("question_id", "a.aspect", F.explode("a.dimensions").alias("d")).select("question_id", "aspect", "d.dimension", F.posexplode("d.metrics").alias("pos", "m"))
    return x.select("question_id", "aspect", "dimension", "m.metric", "m.score", "m.flagged", "pos")


_HALF_EVEN = "CAST(CASE WHEN y - floor(y) = 0.5 AND CAST(floor(y) AS BIGINT) % 2 = 0 THEN floor(y) ELSE floor(y + 0.5) END AS DOUBLE) / 10000"


@query(LONG + f"SELECT question_id, aspect, dimension, metric, {_HALF_EVEN} AS score, flagged FROM (SELECT *, CAST(CAST(score AS VARCHAR) AS DECIMAL(18, 9)) * 10000 AS y FROM long) WHERE question_id IS NOT NULL")
def sink_report_json(spark, sf):
    """The JSON report, written and read back."""
    path = scratch(spark, "report")
    report.write(long(spark, sf), path, ("json",))
    return _read_report(spark, f"{path}/json").where("question_id is not null").drop("pos")


@query(LONG + "SELECT question_id, count(*) AS metrics, count(*) FILTER (WHERE flagged) AS flagged, count(DISTINCT aspect || '/' || dimension) AS dimensions FROM long WHERE question_id IS NOT NULL GROUP BY 1")
def sink_report_md(spark, sf):
    """The Markdown report, written and read back: rows and headings of every question's section."""
    path = scratch(spark, "report")
    report.write(long(spark, sf).where("question_id is not null"), path, ("markdown",))
    lines = spark.read.option("lineSep", "\n\n## ").text(f"{path}/markdown").where("value <> ''").select(F.regexp_replace("value", "^## ", "").alias("v"))
    x = lines.select(F.regexp_extract("v", r"^([^\n]+)", 1).alias("question_id"), F.split("v", "\n").alias("l"))
    row = lambda y: y.rlike(r"^\| .* \| (yes|no) \|$")
    return x.groupBy("question_id").agg(
        F.sum(F.size(F.filter("l", row)).cast("long")).alias("metrics"), F.sum(F.size(F.filter("l", lambda y: row(y) & y.contains("| yes |"))).cast("long")).alias("flagged"), F.sum(F.size(F.filter("l", lambda y: y.startswith("#### "))).cast("long")).alias("dimensions")
    )


@query(LONG + "SELECT 'json' AS format, count(DISTINCT question_id) AS questions FROM long UNION ALL SELECT 'markdown', count(DISTINCT question_id) FROM long UNION ALL SELECT 'header', count(DISTINCT question_id) FROM long")
def reporter(spark, sf):
    """Both formats and the header at once: how many questions each is about."""
    path = scratch(spark, "report")
    x = long(spark, sf).where("question_id is not null")
    out = report.write(x, path)
    n = [report.render(x, f).agg(F.count_distinct("question_id").alias("questions")).select(F.lit(f).alias("format"), "questions") for f in out]
    n.append(spark.read.json(f"{path}/json_header").select(F.lit("header").alias("format"), F.col("total_questions").alias("questions")))
    return reduce(DataFrame.unionByName, n)
