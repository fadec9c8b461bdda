"""The batch runner, stored results, and event windows, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.operators import pipeline
from quaestor.plans.core import query, r6, s6
from quaestor.runtime import table
from quaestor.streaming.evaluate import windowed


def _items(spark, sf):
    return table(spark, sf, "questions_raw").select(F.col("q_id").alias("id"), "text").distinct()


@query("SELECT count(*) AS total, count(text) AS succeeded, count(*) - count(text) AS failed, " + s6("count(text) * 1.0 / count(*)") + " AS success_rate FROM (SELECT DISTINCT q_id, text FROM questions_raw)")
def pipeline_run(spark, sf):
    """All registered metrics over all items; an item has succeeded when every score is there."""
    q = _items(spark, sf)
    long, errors = pipeline.run(q)
    return pipeline.report(q, errors, long).withColumn("success_rate", r6("success_rate"))


@query("SELECT DISTINCT q_id AS question_id, CASE WHEN q_id IS NULL THEN 'missing id' ELSE 'missing text' END AS error FROM questions_raw WHERE q_id IS NULL OR text IS NULL")
def error_capture(spark, sf):
    """Items without id or text, and those that all registered metrics were run on but that lack a score."""
    q = _items(spark, sf)
    long, errors = pipeline.run(q)
    return errors.unionByName(pipeline.unscored(q, long))


@query("SELECT DISTINCT q_id AS id FROM questions_raw WHERE text IS NOT NULL AND (q_id NOT IN (SELECT question_id FROM results WHERE question_id IS NOT NULL))")
def cache_store(spark, sf):
    """Items left to do when those with saved results are stored under their keys."""
    q = _items(spark, sf).where("text is not null and id is not null")
    done = table(spark, sf, "results").select(F.col("question_id").alias("id")).distinct()
    stored = pipeline.todo(q.join(done, "id", "left_semi"), None)
    return pipeline.todo(q, stored).select("id")


@query(f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, {s6('sum(value)')} AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, sf):
    """The windowed aggregate of the streaming module, run over the table at rest."""
    return windowed(table(spark, sf, "events").where("ts is not null")).withColumn("total", r6("total"))


@query("SELECT l_returnflag, l_linestatus, " + ", ".join(f"{s6(f)} AS {n}" for f, n in (("sum(l_quantity)", "sum_qty"), ("avg(l_extendedprice)", "avg_price"), ("quantile_cont(l_discount, 0.5)", "median_disc"))) + ", count(*) AS n FROM lineitem GROUP BY 1, 2")
def table_describe(spark, sf):
    """Grouped description of a plain table."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        r6(F.sum("l_quantity")).alias("sum_qty"), r6(F.avg("l_extendedprice")).alias("avg_price"), r6(F.percentile("l_discount", 0.5)).alias("median_disc"), F.count("*").alias("n")
    )
