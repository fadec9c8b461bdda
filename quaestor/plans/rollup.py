"""Roll-ups and score analytics over the whole results table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.lexicons import TAXONOMY
from quaestor.operators import analytics as A
from quaestor.operators import rollup as R
from quaestor.plans.core import query, r6, s6
from quaestor.runtime import table

LONG = """
WITH a AS (SELECT question_id, course_id, source_type, unnest(map_entries(scores)) AS e FROM results),
b AS (SELECT question_id, course_id, source_type, e.key AS aspect, unnest(map_entries(e.value)) AS d FROM a),
c AS (SELECT question_id, course_id, source_type, aspect, d.key AS dimension, unnest(map_entries(d.value)) AS m FROM b),
long AS (SELECT question_id, course_id, source_type, aspect, dimension, m.key AS metric, m.value.score AS score,
  coalesce(m.value.flagged, m.value.score < 0.3, false) AS flagged FROM c)
"""
JUDGES = LONG + """, dm AS (SELECT question_id, dimension, avg(score) AS m FROM long WHERE score IS NOT NULL GROUP BY 1, 2),
judges AS (SELECT question_id, dimension, 'a' AS judge, m AS score FROM dm UNION ALL SELECT question_id, dimension, 'b', m * 37 - floor(m * 37) FROM dm
  UNION ALL SELECT question_id, dimension, 'c', CASE WHEN m < 0.9 THEN 1 - m END FROM dm)
"""
TAX = "tax AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{d}')" for a, ds in TAXONOMY.items() for d in ds) + ") AS v(aspect, dimension))"


def long(spark: SparkSession, sf: str) -> DataFrame:
    return R.flatten_scores(table(spark, sf, "results"))


def judges(spark: SparkSession, sf: str) -> DataFrame:
    """Three raters made from the dimension means, one of them with gaps: the real rating files are not at hand."""
    m = long(spark, sf).where("score is not null").groupBy("question_id", "dimension").agg(F.avg("score").alias("m"))
    x = F.col("m")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("judge"), v.alias("score")) for k, v in (("a", x), ("b", x * 37 - F.floor(x * 37)), ("c", F.when(x < 0.9, 1 - x)))]))
    return m.select("question_id", "dimension", each.alias("j")).select("question_id", "dimension", "j.judge", "j.score")


@query(LONG + f"SELECT question_id, aspect, dimension, metric, {s6('score')} AS score, flagged FROM long")
def flatten_scores(spark, sf):
    return long(spark, sf).select("question_id", "aspect", "dimension", "metric", r6("score").alias("score"), "flagged")


@query(LONG + "SELECT count(*) AS n, count(*) FILTER (WHERE flagged) AS flagged FROM long")
def flagged_default(spark, sf):
    return long(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("flagged")).alias("flagged"))


@query(LONG + f"SELECT question_id, aspect, dimension, metric, {s6('max(score)')} AS score FROM long WHERE score IS NOT NULL GROUP BY ALL")
def flat_scores(spark, sf):
    """The nested form {aspect: {dimension: {metric: score}}} of every question, unfolded again for the comparison."""
    x = R.nest_scores(long(spark, sf)).select("question_id", F.explode("scores").alias("aspect", "d")).select("question_id", "aspect", F.explode("d").alias("dimension", "m"))
    return x.select("question_id", "aspect", "dimension", F.explode("m").alias("metric", "score")).withColumn("score", r6("score"))


@query(LONG + "SELECT question_id, aspect, dimension, metric FROM long WHERE flagged")
def flagged_metrics(spark, sf):
    return R.flagged_metrics(long(spark, sf)).select("question_id", "aspect", "dimension", "metric")


@query(LONG + "SELECT question_id, aspect, dimension FROM long GROUP BY ALL HAVING bool_or(flagged)")
def flagged_dimensions(spark, sf):
    return R.flagged_dimensions(long(spark, sf))


_AGG = {"weighted_average": "coalesce(avg(score), 0)", "min_gate": "coalesce(min(score), 0)", "percentile_rank": "coalesce(quantile_cont(score, 0.5), 0)"}
for _by, _expr in _AGG.items():

    @query(LONG + f"SELECT question_id, aspect, dimension, {s6(_expr)} AS score FROM long GROUP BY question_id, aspect, dimension", f"agg_{_by}")
    def _dim(spark, sf, by=_by):
        return R.aggregate_dimension(long(spark, sf), by).withColumn("score", r6("score"))


@query(LONG + f"SELECT question_id, aspect, dimension, {s6("coalesce(sum(w * score) / nullif(sum(CASE WHEN score IS NOT NULL THEN w END), 0), 0)")} AS score FROM (SELECT *, CASE metric WHEN 'word_count' THEN 3.0 WHEN 'chrf' THEN 2.0 ELSE 1.0 END AS w FROM long) GROUP BY question_id, aspect, dimension")
def agg_weighted_by_metric(spark, sf):
    return R.aggregate_dimension(long(spark, sf), "weighted_average", {"word_count": 3.0, "chrf": 2.0}).withColumn("score", r6("score"))


_DIMS = ", dims AS (SELECT question_id, aspect, dimension, coalesce(avg(score), 0) AS score FROM long GROUP BY 1, 2, 3)"
_ZERO = LONG + _DIMS + f", {TAX}, f AS (SELECT q.question_id, tax.aspect, tax.dimension, coalesce(d.score, 0) AS score FROM (SELECT DISTINCT question_id FROM long) q CROSS JOIN tax LEFT JOIN dims d ON d.question_id = q.question_id AND d.aspect = tax.aspect AND d.dimension = tax.dimension)"


@query(_ZERO + f" SELECT question_id, aspect, {s6('avg(score)')} AS score FROM f GROUP BY question_id, aspect")
def aggregate_aspect(spark, sf):
    return R.aggregate_aspect(long(spark, sf)).withColumn("score", r6("score"))


@query(LONG + _DIMS + f" SELECT question_id, aspect, {s6('avg(score)')} AS score FROM dims GROUP BY question_id, aspect")
def aggregate_aspect_skip(spark, sf):
    return R.aggregate_aspect(long(spark, sf), empty_dims="skip").withColumn("score", r6("score"))


_OVER = _ZERO + ", asp AS (SELECT question_id, aspect, avg(score) AS score FROM f GROUP BY 1, 2), o AS (SELECT question_id, avg(score) AS score FROM asp GROUP BY 1)"


@query(_OVER + f" SELECT question_id, {s6('score')} AS score FROM o")
def aggregate_evaluation(spark, sf):
    return R.aggregate_evaluation(long(spark, sf)).withColumn("score", r6("score"))


@query(_OVER + f", cap AS (SELECT DISTINCT question_id, aspect FROM dims WHERE dimension IN ('privacy_risk', 'harmful_content_risk') AND score < 0.2) SELECT asp.question_id, asp.aspect, {s6('CASE WHEN cap.aspect IS NULL THEN score ELSE least(score, 0.2) END')} AS score, cap.aspect IS NOT NULL AS capped FROM asp LEFT JOIN cap ON asp.question_id = cap.question_id AND asp.aspect = cap.aspect")
def critical_cap(spark, sf):
    x = long(spark, sf)
    return R.critical_cap(R.aggregate_dimension(x), R.aggregate_aspect(x)).withColumn("score", r6("score"))


@query(_OVER + f" SELECT question_id, {s6('score')} AS score, score < 0.4 AS review FROM o")
def review_flag(spark, sf):
    return R.review_flag(R.aggregate_evaluation(long(spark, sf))).withColumn("score", r6("score"))


def _summary_sql(keys: str, src: str = "long") -> str:
    return f"SELECT {keys}, {s6('avg(score)')} AS mean, {s6('stddev_samp(score)')} AS std, {s6('min(score)')} AS min, {s6('max(score)')} AS max, count(score) AS count FROM {src} GROUP BY {keys}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


@query(LONG + _summary_sql("aspect, dimension"))
def score_summary(spark, sf):
    return _rounded(A.summary(long(spark, sf), ["aspect", "dimension"]), "mean", "std", "min", "max")


@query(LONG + f"SELECT *, {s6('max - min')} AS range FROM (" + _summary_sql("dimension, metric") + ")")
def metric_stats(spark, sf):
    return _rounded(A.summary(long(spark, sf), ["dimension", "metric"]), "mean", "std", "min", "max").withColumn("range", r6(F.col("max") - F.col("min")))


for _dir, _asc, _k in (("topk", False, 20), ("bottomk", True, 10)):

    @query(LONG + f"SELECT metric, {s6('stddev_samp(score)')} AS std FROM long GROUP BY metric ORDER BY stddev_samp(score) {'ASC' if _asc else 'DESC'} NULLS LAST, metric LIMIT {_k}", _dir)
    def _top(spark, sf, asc=_asc, k=_k):
        return _rounded(A.top(A.summary(long(spark, sf), ["metric"]).select("metric", "std"), "std", k, asc), "std")


@query("SELECT r.course_id, m.field, m.level, r.source_type, count(*) AS n FROM results r LEFT JOIN (SELECT course_id, min(field) AS field, min(level) AS level FROM course_meta GROUP BY 1) m USING (course_id) GROUP BY ALL")
def group_size(spark, sf):
    """All results; courses without metadata have no field and level."""
    meta = table(spark, sf, "course_meta").groupBy("course_id").agg(F.min("field").alias("field"), F.min("level").alias("level"))
    return table(spark, sf, "results").join(meta, "course_id", "left").groupBy("course_id", "field", "level", "source_type").agg(F.count("*").alias("n"))


_PV = LONG + f"SELECT aspect, dimension, {s6("avg(score) FILTER (WHERE source_type = 'assignment')")} AS assignment, {s6("avg(score) FILTER (WHERE source_type = 'exam')")} AS exam FROM long GROUP BY 1, 2"


@query(_PV)
def pivot_mean(spark, sf):
    return _rounded(A.pivot_mean(long(spark, sf), ["aspect", "dimension"], "source_type", ["assignment", "exam"]), "assignment", "exam")


@query(LONG + f"SELECT aspect, dimension, {s6("coalesce(avg(score) FILTER (WHERE source_type = 'exam'), 0) - coalesce(avg(score) FILTER (WHERE source_type = 'assignment'), 0)")} AS diff FROM long GROUP BY 1, 2")
def pivot_diff(spark, sf):
    p = A.pivot_mean(long(spark, sf), ["aspect", "dimension"], "source_type", ["assignment", "exam"])
    return p.select("aspect", "dimension", r6(F.coalesce("exam", F.lit(0.0)) - F.coalesce("assignment", F.lit(0.0))).alias("diff"))


@query("SELECT course_id, count(*) FILTER (WHERE source_type = 'assignment') AS assignment, count(*) FILTER (WHERE source_type = 'exam') AS exam FROM results GROUP BY course_id")
def pivot_count(spark, sf):
    return A.pivot_count(table(spark, sf, "results"), ["course_id"], "source_type", ["assignment", "exam"])


_WIDE = sorted(d for ds in TAXONOMY.values() for d in ds)


@query(
    LONG + "SELECT course_id, " + ", ".join(f"{s6(f"max(m) FILTER (WHERE dimension = '{d}')")} AS {d}" for d in _WIDE) + f", {s6('avg(m)')} AS overall "
    "FROM (SELECT course_id, dimension, avg(score) AS m FROM long GROUP BY 1, 2) GROUP BY 1 ORDER BY overall DESC, course_id"
)
def leaderboard(spark, sf):
    """Means of every dimension by course and the mean over the dimensions there are, best course first."""
    m = long(spark, sf).groupBy("course_id", "dimension").agg(F.avg("score").alias("m"))
    wide = m.groupBy("course_id").agg(*[r6(F.max(F.when(F.col("dimension") == d, F.col("m")))).alias(d) for d in _WIDE], r6(F.avg("m")).alias("overall"))
    return wide.orderBy(F.desc("overall"), "course_id")


@query(LONG + f"SELECT aspect, {s6('avg(m)')} AS mean FROM (SELECT aspect, dimension, avg(score) AS m FROM long GROUP BY 1, 2) GROUP BY 1")
def mean_of_means(spark, sf):
    return _rounded(A.mean_of_means(long(spark, sf), ["aspect", "dimension"], ["aspect"]), "mean")


@query(LONG + "SELECT dimension, min(aspect) AS aspect FROM long GROUP BY 1")
def first_value(spark, sf):
    return long(spark, sf).groupBy("dimension").agg(F.min("aspect").alias("aspect"))


_PAIR = ", x AS (SELECT question_id, dimension, avg(score) AS v FROM long WHERE score IS NOT NULL GROUP BY 1, 2), p AS (SELECT a.question_id, a.dimension AS a, b.dimension AS b, a.v AS x, b.v AS y FROM x a JOIN x b ON a.question_id = b.question_id AND a.dimension < b.dimension)"
_RANKED = _PAIR + ", r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM p)"


@query(LONG + _RANKED + f" SELECT a, b, {s6('corr(rx, ry)')} AS r, count(*) AS n FROM r GROUP BY 1, 2")
def spearman_matrix(spark, sf):
    return _rounded(A.pairwise(long(spark, sf), ["question_id"], "dimension", "score", ranked=True), "r")


@query(LONG + _RANKED + " SELECT a, b FROM r GROUP BY 1, 2 HAVING abs(corr(rx, ry)) > 0.55")
def corr_highlight(spark, sf):
    return A.pairwise(long(spark, sf), ["question_id"], "dimension", "score", ranked=True).where(F.abs("r") > 0.55).select("a", "b")


@query(JUDGES + f", p AS (SELECT a.judge AS a, b.judge AS b, a.score AS x, b.score AS y FROM judges a JOIN judges b ON a.question_id = b.question_id AND a.dimension = b.dimension AND a.judge < b.judge WHERE a.score IS NOT NULL AND b.score IS NOT NULL) SELECT a, b, {s6('corr(x, y)')} AS r, count(*) AS n FROM p GROUP BY 1, 2")
def pearson_matrix(spark, sf):
    return _rounded(A.pairwise(judges(spark, sf), ["question_id", "dimension"], "judge", "score"), "r")


@query(JUDGES + f"SELECT j.judge, j.dimension, {s6('corr(j.score, dm.m)')} AS r FROM judges j JOIN dm USING (question_id, dimension) WHERE j.judge <> 'a' AND j.score IS NOT NULL GROUP BY 1, 2")
def pearson_by_dim(spark, sf):
    j = judges(spark, sf)
    base = j.where("judge = 'a'").select("question_id", "dimension", F.col("score").alias("m"))
    x = j.where("judge <> 'a' and score is not null").join(base, ["question_id", "dimension"])
    return x.groupBy("judge", "dimension").agg(r6(F.corr("score", "m")).alias("r"))


_U = LONG + ", x AS (SELECT dimension, source_type, score FROM long WHERE score IS NOT NULL AND source_type IN ('assignment', 'exam')), r AS (SELECT dimension, source_type, rank() OVER (PARTITION BY dimension ORDER BY score) + (count(*) OVER (PARTITION BY dimension, score) - 1) / 2.0 AS rk FROM x) SELECT dimension, " + s6("sum(rk) FILTER (WHERE source_type = 'exam') - count(*) FILTER (WHERE source_type = 'exam') * (count(*) FILTER (WHERE source_type = 'exam') + 1) / 2.0") + " AS u, count(*) FILTER (WHERE source_type = 'exam') AS n1, count(*) FILTER (WHERE source_type = 'assignment') AS n2 FROM r GROUP BY 1 HAVING n1 > 0 AND n2 > 0"


@query(_U)
def mann_whitney_u(spark, sf):
    return A.mann_whitney(long(spark, sf), ["dimension"], "source_type", "exam", "assignment").select("dimension", r6("u").alias("u"), "n1", "n2")


@query()
def mann_whitney_p(spark, sf):
    return A.mann_whitney(long(spark, sf), ["dimension"], "source_type", "exam", "assignment")


_FR = "SELECT course_id, dimension, avg(CAST(f AS INT)) AS rate, count(*) AS units FROM (SELECT course_id, dimension, question_id, bool_or(flagged) AS f FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2"


@query(LONG + f"SELECT course_id, dimension, {s6('rate')} AS rate, units FROM ({_FR})")
def flag_rate(spark, sf):
    return _rounded(A.flag_rate(long(spark, sf), ["course_id", "dimension"]), "rate")


@query(LONG + f"SELECT dimension, {s6('avg(rate)')} AS rate FROM ({_FR}) GROUP BY 1")
def flag_rate_overall(spark, sf):
    return A.flag_rate(long(spark, sf), ["course_id", "dimension"]).groupBy("dimension").agg(r6(F.avg("rate")).alias("rate"))


@query(LONG + f"SELECT aspect, {s6('avg(rate)')} AS rate FROM (SELECT aspect, metric, avg(CAST(flagged AS INT)) AS rate FROM long GROUP BY 1, 2) GROUP BY 1")
def flag_rate_family(spark, sf):
    return long(spark, sf).groupBy("aspect", "metric").agg(F.avg(F.col("flagged").cast("int")).alias("rate")).groupBy("aspect").agg(r6(F.avg("rate")).alias("rate"))


@query(JUDGES + f"SELECT judge, dimension, {s6('avg(CASE WHEN score < 0.5 THEN 1 ELSE 0 END)')} AS rate FROM judges GROUP BY 1, 2")
def judge_flag_rate(spark, sf):
    return judges(spark, sf).groupBy("judge", "dimension").agg(r6(F.avg(F.when(F.col("score") < 0.5, 1).otherwise(0))).alias("rate"))


@query(JUDGES + f"SELECT question_id, judge, dimension, {s6('score')} AS score FROM judges")
def judge_scores(spark, sf):
    return judges(spark, sf).select("question_id", "judge", "dimension", r6("score").alias("score"))


@query(LONG + f"SELECT question_id, dimension, {s6('avg(score)')} AS mean FROM long GROUP BY 1, 2")
def metric_dim_mean(spark, sf):
    return long(spark, sf).groupBy("question_id", "dimension").agg(r6(F.avg("score")).alias("mean"))


@query(JUDGES + "SELECT dimension FROM judges GROUP BY dimension HAVING count(DISTINCT CASE WHEN score IS NOT NULL THEN judge END) = 3 INTERSECT SELECT dimension FROM long WHERE score IS NOT NULL")
def shared_dims(spark, sf):
    j = judges(spark, sf).where("score is not null").groupBy("dimension").agg(F.count_distinct("judge").alias("k")).where("k = 3").select("dimension")
    return j.intersect(long(spark, sf).where("score is not null").select("dimension"))


@query(JUDGES + f"SELECT dimension, {s6('avg(sd)')} AS disagreement FROM (SELECT question_id, dimension, stddev_pop(score) AS sd FROM judges GROUP BY 1, 2) GROUP BY 1")
def judge_disagreement(spark, sf):
    return A.disagreement(judges(spark, sf), ["question_id", "dimension"]).groupBy("dimension").agg(r6(F.avg("sd")).alias("disagreement"))


@query(JUDGES + f"SELECT question_id, {s6('avg(sd)')} AS disagreement FROM (SELECT question_id, dimension, stddev_pop(score) AS sd FROM judges GROUP BY 1, 2) GROUP BY 1 ORDER BY disagreement DESC, question_id LIMIT 5")
def top_disagreed(spark, sf):
    x = A.disagreement(judges(spark, sf), ["question_id", "dimension"]).groupBy("question_id").agg(r6(F.avg("sd")).alias("disagreement"))
    return A.top(x, "disagreement", 5, tie="question_id")


@query(JUDGES + f"SELECT judge, count(score) AS n, count(DISTINCT CASE WHEN score IS NOT NULL THEN dimension END) AS dims, {s6('avg(score)')} AS mean, {s6('stddev_pop(score)')} AS std, {s6('min(score)')} AS min, {s6('quantile_cont(score, 0.5)')} AS median, {s6('max(score)')} AS max, {s6('avg(CASE WHEN score < 0.5 THEN 1 ELSE 0 END)')} AS flag_rate FROM judges GROUP BY 1")
def source_summary(spark, sf):
    s, j = F.col("score"), judges(spark, sf)
    x = j.groupBy("judge").agg(
        F.count(s).alias("n"), F.count_distinct(F.when(s.isNotNull(), F.col("dimension"))).alias("dims"), r6(F.avg(s)).alias("mean"), r6(F.stddev_pop(s)).alias("std"), r6(F.min(s)).alias("min"),
        r6(F.max(s)).alias("max"), r6(F.avg(F.when(s < 0.5, 1).otherwise(0))).alias("flag_rate"),
    )
    return A.with_percentiles(x, j, ["judge"], "score", {"median": 0.5}).withColumn("median", r6("median"))


@query(LONG + f"SELECT aspect, count(score) AS count, {s6('avg(score)')} AS mean, {s6('stddev_samp(score)')} AS std, {s6('min(score)')} AS min, {s6('quantile_cont(score, 0.25)')} AS p25, {s6('quantile_cont(score, 0.5)')} AS p50, {s6('quantile_cont(score, 0.75)')} AS p75, {s6('max(score)')} AS max FROM long GROUP BY 1")
def describe(spark, sf):
    return _rounded(A.describe(long(spark, sf), ["aspect"], "score"), "mean", "std", "min", "p25", "p50", "p75", "max")


@query(LONG + f"SELECT source_type, dimension, {s6('quantile_cont(score, 0.25)')} AS p25, {s6('quantile_cont(score, 0.5)')} AS p50, {s6('quantile_cont(score, 0.75)')} AS p75 FROM long GROUP BY 1, 2")
def boxplot_stats(spark, sf):
    return _rounded(A.describe(long(spark, sf), ["source_type", "dimension"], "score").select("source_type", "dimension", "p25", "p50", "p75"), "p25", "p50", "p75")


@query(LONG + "SELECT CAST(least(29, floor(score / (1.0 / 30))) AS INT) AS bin, count(*) AS n FROM long WHERE score BETWEEN 0 AND 1 GROUP BY 1")
def histogram(spark, sf):
    return A.histogram(long(spark, sf), "score", 0.0, 1.0, 30)


@query(LONG + "SELECT count(DISTINCT question_id) AS questions, count(DISTINCT metric) AS metrics, count(DISTINCT dimension) AS dimensions, count(DISTINCT course_id) AS courses FROM long")
def nunique(spark, sf):
    return long(spark, sf).agg(*[F.count_distinct(c).alias(n) for c, n in (("question_id", "questions"), ("metric", "metrics"), ("dimension", "dimensions"), ("course_id", "courses"))])


@query(LONG + "SELECT DISTINCT aspect, dimension FROM long")
def drop_duplicates(spark, sf):
    return long(spark, sf).select("aspect", "dimension").dropDuplicates()


@query("SELECT DISTINCT source_type FROM results WHERE source_type IS NOT NULL")
def distinct_values(spark, sf):
    return table(spark, sf, "results").select("source_type").dropna().distinct()


@query(LONG + ", g AS (SELECT question_id, bool_or(flagged) AS f, min(score) AS low FROM long GROUP BY 1) SELECT question_id FROM g WHERE CASE WHEN (SELECT bool_or(f) FROM g) THEN f ELSE low < 0.3 END")
def flagged_questions(spark, sf):
    """Questions with any flag; where nothing at all is flagged, those with a score below 0.30."""
    g = long(spark, sf).groupBy("question_id").agg(F.bool_or("flagged").alias("f"), F.min("score").alias("low"))
    any_flag = g.agg(F.bool_or("f").alias("any"))
    return g.join(F.broadcast(any_flag), F.lit(True)).where(F.when(F.col("any"), F.col("f")).otherwise(F.col("low") < 0.3)).select("question_id")


@query(LONG + "SELECT band, count(*) AS n FROM (SELECT CASE WHEN m >= 0.8 THEN 'Strong' WHEN m >= 0.6 THEN 'Acceptable' WHEN m >= 0.4 THEN 'Borderline' WHEN m IS NOT NULL THEN 'Problematic' END AS band FROM (SELECT question_id, avg(score) AS m FROM long GROUP BY 1)) GROUP BY 1")
def score_band(spark, sf):
    m = long(spark, sf).groupBy("question_id").agg(F.avg("score").alias("m"))
    return m.groupBy(A.score_band(F.col("m")).alias("band")).agg(F.count("*").alias("n"))


@query(LONG + f"SELECT aspect, dimension, field, {s6('avg(score)')} AS mean FROM long LEFT JOIN (SELECT course_id, min(field) AS field FROM course_meta GROUP BY 1) USING (course_id) GROUP BY 1, 2, 3")
def radar_means(spark, sf):
    meta = table(spark, sf, "course_meta").groupBy("course_id").agg(F.min("field").alias("field"))
    return long(spark, sf).join(meta, "course_id", "left").groupBy("aspect", "dimension", "field").agg(r6(F.avg("score")).alias("mean"))


@query(LONG + "SELECT question_id FROM results INTERSECT SELECT question_id FROM long WHERE dimension = 'readability' INTERSECT SELECT question_id FROM long WHERE dimension = 'privacy_risk'")
def join_semi_ids(spark, sf):
    x = long(spark, sf)
    ids = table(spark, sf, "results").select("question_id").distinct()
    for d in ("readability", "privacy_risk"):
        ids = ids.join(x.where(F.col("dimension") == d).select("question_id"), "question_id", "left_semi")
    return ids


@query(LONG + f"SELECT t.dimension, {s6('coalesce(r.rate, 0)')} AS rate FROM (SELECT dimension FROM tax0) t LEFT JOIN (SELECT dimension, avg(CAST(flagged AS INT)) AS rate FROM long GROUP BY 1) r USING (dimension)".replace("(SELECT dimension FROM tax0)", "(SELECT * FROM (VALUES " + ", ".join(f"('{d}')" for ds in TAXONOMY.values() for d in ds) + ") AS v(dimension))"))
def join_reindex(spark, sf):
    rates = long(spark, sf).groupBy("dimension").agg(F.avg(F.col("flagged").cast("int")).alias("rate"))
    known = spark.createDataFrame([(d,) for ds in TAXONOMY.values() for d in ds], "dimension string")
    return known.join(rates, "dimension", "left").select("dimension", r6(F.coalesce("rate", F.lit(0.0))).alias("rate"))


@query("SELECT DISTINCT question.id AS question_id FROM records WHERE question.id IS NOT NULL AND question.id NOT IN (SELECT question_id FROM results WHERE question_id IS NOT NULL)")
def join_anti_cached(spark, sf):
    """Questions still to be evaluated: those without a stored result."""
    todo = table(spark, sf, "records").select(F.col("question.id").alias("question_id")).dropna().distinct()
    return todo.join(table(spark, sf, "results").select("question_id"), "question_id", "left_anti")
