"""Reports: per question a JSON object and a Markdown section, built in the JVM and written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import wiring

FORMATS = ("json", "markdown")


def _dimensions(long: DataFrame, rationale: bool = True) -> DataFrame:
    """Metrics and dimensions in the order of evaluation; what the wiring does not know comes last, by name."""
    has = lambda c: F.col(c) if c in long.columns else F.lit(None).cast("string")
    m = F.struct(wiring.place(F.col("dimension"), F.col("metric")).alias("n"), "metric", F.bround("score", 4).alias("score"), "flagged", *([has("rationale").alias("rationale")] if rationale else []), has("metadata").alias("metadata"))
    out = long.groupBy("question_id", "aspect", "dimension").agg(F.array_sort(F.collect_list(m)).alias("metrics"), F.bool_or("flagged").alias("any"), F.max(has("notes")).alias("notes"))
    return out.withColumn("metrics", F.transform("metrics", lambda x: x.dropFields("n")))


def json_evaluations(long: DataFrame, rationale: bool = True) -> DataFrame:
    """(question_id, value): {question_id, aspects: [{aspect, dimensions: [{dimension, notes, metrics: [...]}]}]}; a question's
    metrics are few, so the lists are bounded by the number of metrics. Null fields are left out."""
    d = _dimensions(long, rationale)
    dim = F.struct(wiring.dimension_place(F.col("dimension")).alias("n"), "dimension", "notes", "metrics")
    d = d.groupBy("question_id", "aspect").agg(F.array_sort(F.collect_list(dim)).alias("dimensions")).withColumn("dimensions", F.transform("dimensions", lambda x: x.dropFields("n")))
    aspect = F.struct(wiring.aspect_place(F.col("aspect")).alias("n"), "aspect", "dimensions")
    a = d.groupBy("question_id").agg(F.array_sort(F.collect_list(aspect)).alias("aspects")).withColumn("aspects", F.transform("aspects", lambda x: x.dropFields("n")))
    return a.select("question_id", F.to_json(F.struct("question_id", "aspects")).alias("value"))


def json_header(long: DataFrame) -> DataFrame:
    """(value): the one object beside the evaluations: when it was made and how many questions it is about."""
    n = long.agg(F.count_distinct("question_id").alias("total_questions"))
    return n.select(F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), "total_questions")).alias("value"))


def title(c):
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def markdown_sections(long: DataFrame, rationale: bool = False) -> DataFrame:
    """(question_id, value): a section per question, a table per dimension, a warning sign where a metric is flagged; with
    ``rationale`` a column for it."""
    d = _dimensions(long)
    more = lambda m: F.concat(F.lit(" "), F.coalesce(m["rationale"], F.lit("")), F.lit(" |")) if rationale else F.lit("")
    row = lambda m: F.concat(F.lit("| "), m["metric"], F.lit(" | "), F.coalesce(F.format_number(m["score"], 4), F.lit("-")), F.lit(" | "), F.when(m["flagged"], "yes").otherwise("no"), F.lit(" |"), more(m))
    head = F.concat(F.lit("#### "), title(F.col("dimension")), F.when(F.col("any"), " ⚠️").otherwise(""), F.lit("\n\n| Metric | Score | Flagged |" + (" Rationale |" if rationale else "") + "\n|---|---|---|" + ("---|" if rationale else "") + "\n"))
    d = d.select("question_id", "aspect", "dimension", F.concat(head, F.array_join(F.transform("metrics", row), "\n")).alias("block"))
    a = d.groupBy("question_id", "aspect").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(wiring.dimension_place(F.col("dimension")).alias("n"), "dimension", "block"))), lambda x: x["block"]), "\n\n").alias("blocks"))
    q = a.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(wiring.aspect_place(F.col("aspect")).alias("n"), "aspect", "blocks"))).alias("x"))
    return q.select("question_id", F.concat(F.lit("## "), "question_id", F.lit("\n\n"), F.array_join(F.transform("x", lambda y: F.concat(F.lit("### "), title(y["aspect"]), F.lit("\n\n"), y["blocks"])), "\n\n")).alias("value"))


def _checked(formats: tuple[str, ...]) -> None:
    unknown = [f for f in formats if f not in FORMATS]
    if unknown:
        raise ValueError(f"unknown formats {unknown}; one of {FORMATS}")


def render(long: DataFrame, form: str) -> DataFrame:
    """(question_id, value) in one format, without writing; an unknown one raises."""
    _checked((form,))
    return json_evaluations(long) if form == "json" else markdown_sections(long)


def write(long: DataFrame, path: str, formats: tuple[str, ...] = FORMATS) -> dict[str, str]:
    """Writes the formats asked for and says where; an unknown one raises. JSON has its header beside it."""
    _checked(formats)
    out = {}
    for f in formats:
        render(long, f).select("value").write.mode("overwrite").option("lineSep", "\n" if f == "json" else "\n\n").text(f"{path}/{f}")
        if f == "json":
            json_header(long).coalesce(1).write.mode("overwrite").text(f"{path}/json_header")
        out[f] = f"{path}/{f}"
    return out
