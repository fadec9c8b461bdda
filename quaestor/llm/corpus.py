"""The texts of the project as keys and distinct texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.text import is_blank
from quaestor.runtime import table


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_key, text): questions_raw.text and records.context.course_content."""
    q = table(spark, sf_dir, "questions_raw").select(F.lit("questions_raw").alias("tbl"), F.col("q_id").alias("row_key"), "text")
    r = table(spark, sf_dir, "records").select(F.lit("records").alias("tbl"), F.col("question.id").alias("row_key"), F.col("context.course_content").alias("text"))
    return q.unionByName(r)


def keys_and_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tbl, row_key, text_id), distinct, and (text_id, text), every different text once.

    Rows without key or with a blank text are left out. A text that many rows share is one row of the second table, so
    whatever is costly runs once per text; the partial aggregation drops copies before the shuffle."""
    x = rows.where(F.col("row_key").isNotNull() & ~is_blank(F.col("text"))).withColumn("text_id", F.md5("text"))
    return x.select("tbl", "row_key", "text_id").distinct(), x.select("text_id", "text").distinct()


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(text_id, text): as in ``keys_and_texts``, but also of rows without key."""
    return rows.where(~is_blank(F.col("text"))).select(F.md5("text").alias("text_id"), "text").distinct()


def text_sample(df: DataFrame, text: str, expected: int) -> DataFrame:
    """About ``expected`` rows of ``df`` (never more than twice as many), chosen by the hash of the text alone: the same
    rows at any partitioning. Only for fitting; taken before anything costly is computed."""
    n = df.count()
    h = F.xxhash64(F.col(text))
    some = df if n <= expected else df.where(F.pmod(h, F.lit(1_000_000)) < max(1, round(1e6 * expected / n)))
    return some.withColumn("_h", h).orderBy("_h").limit(2 * expected).drop("_h")
