"""Running the stages of many courses: what is to be done for each, and evaluation written by course.

A stage is decided from what is stored, never from the order of rows: extract where there are no chunks, align where there are
no records, flatten always, evaluate where there are no results or where it is forced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import metrics as M

STAGES = ("extract", "align", "flatten", "evaluate")


def stages(courses: DataFrame, chunks: DataFrame, records: DataFrame, results: DataFrame, dry_run: bool = False, no_eval: bool = False, force_eval: bool = False) -> DataFrame:
    """(course_id, extract, align, flatten, evaluate) for every course. Each side is (course_id); null courses are left out.

    ``dry_run`` runs no stage, ``no_eval`` no evaluation (and wins over ``force_eval``)."""
    have = lambda df, name: df.select("course_id").distinct().withColumn(name, F.lit(True))
    x = courses.where("course_id is not null").select("course_id").distinct()
    for df, name in ((chunks, "c"), (records, "r"), (results, "e")):
        x = x.join(have(df, name), "course_id", "left")
    live = F.lit(not dry_run)
    return x.select(
        "course_id", (F.col("c").isNull() & live).alias("extract"), (F.col("r").isNull() & live).alias("align"), live.alias("flatten"),
        ((F.col("e").isNull() | F.lit(force_eval)) & live & F.lit(not no_eval)).alias("evaluate"),
    )


def run_evaluate(questions: DataFrame, path: str, todo: DataFrame | None = None, names: list[str] | None = None) -> None:
    """Evaluates the questions (course_id, q_id, text) of the courses in ``todo`` and writes long scores partitioned by
    course under ``path``. Only the partitions of these courses are replaced, so a second run, or one after a failure, goes
    on where results are missing. One job for all courses: a large course is many tasks, not one."""
    x = questions.where("course_id is not null and q_id is not null")
    if todo is not None:
        x = x.join(todo.where("evaluate").select("course_id"), "course_id", "left_semi")
    x = x.select("course_id", F.struct("course_id", "q_id", "text").alias("k"), "text").distinct()
    long = M.evaluate(x, "k", names, "text").select(F.col("question_id.course_id").alias("course_id"), F.col("question_id.q_id").alias("question_id"), "aspect", "dimension", "metric", "score", "flagged", "rationale")
    long.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("course_id").parquet(path)
