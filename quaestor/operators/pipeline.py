"""Batch evaluation as a DataFrame job: skip what is stored, keep errors per row, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import metrics as M
from quaestor.sources.jsonl import cache_key


def todo(questions: DataFrame, stored: DataFrame | None, context: str | None = None) -> DataFrame:
    """Questions (id, text[, context]) whose key is not among ``stored`` (key); adds ``key``."""
    x = questions.withColumn("key", cache_key("id", "text", context))
    return x if stored is None else x.join(stored.select("key").distinct(), "key", "left_anti")


def run(questions: DataFrame, stored: DataFrame | None = None, context: str | None = None, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(long scores with ``key``, errors). An item without id or text is an error row; nothing else can fail, as every
    metric is a total expression. Stored scores come back whole, unlike a cache that keeps only ids."""
    x = todo(questions, None, context)
    ok, bad = x.where(F.col("id").isNotNull() & F.col("text").isNotNull()), x.where(F.col("id").isNull() | F.col("text").isNull())
    errors = bad.select(F.col("id").alias("question_id"), F.when(F.col("id").isNull(), "missing id").otherwise("missing text").alias("error"))
    fresh = ok if stored is None else ok.join(stored.select("key").distinct(), "key", "left_anti")
    long = M.evaluate(fresh, "id", names, "text").join(fresh.select(F.col("id").alias("question_id"), "key").distinct(), "question_id")
    if stored is not None:
        long = long.unionByName(stored.join(ok.select("key").distinct(), "key", "left_semi"), allowMissingColumns=True)
    return long, errors


def scored(long: DataFrame) -> DataFrame:
    """Keys of the items for which every metric gave a score; the scores have to be computed to tell."""
    return long.groupBy("key").agg(F.count("score").alias("given"), F.count("*").alias("metrics")).where("given = metrics").select("key")


def unscored(questions: DataFrame, long: DataFrame, context: str | None = None) -> DataFrame:
    """Error rows (question_id, error) of the items that have id and text but lack a score."""
    x = todo(questions.where("id is not null and text is not null"), scored(long), context)
    return x.select(F.col("id").alias("question_id"), F.lit("not scored").alias("error"))


def report(questions: DataFrame, errors: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """One row: total, succeeded, failed, success_rate (0 for no questions). With ``long`` an item has succeeded once all its
    scores are there; without, once it gave no error."""
    t = questions.agg(F.count("*").alias("total"))
    if long is None:
        done = t.join(F.broadcast(errors.agg(F.count("*").alias("e"))), F.lit(True)).select("total", (F.col("total") - F.col("e")).alias("succeeded"))
    else:
        done = t.join(F.broadcast(scored(long).agg(F.count("*").alias("succeeded"))), F.lit(True))  # one row each
    return done.select("total", "succeeded", (F.col("total") - F.col("succeeded")).alias("failed"), F.when(F.col("total") == 0, 0.0).otherwise(F.col("succeeded") / F.col("total")).alias("success_rate"))


def failure_guard(rep: DataFrame, most: float = 0.5) -> None:
    """Raises when more than this share failed; the order of rows plays no part."""
    r = rep.first()
    if r["total"] and r["failed"] / r["total"] > most:
        raise RuntimeError(f"{r['failed']} of {r['total']} items failed")
