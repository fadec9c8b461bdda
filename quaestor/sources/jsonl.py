"""JSON-lines sources and sinks. Parsing works on a column of lines, so files and tables share it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions.text import strip


def parse(lines: DataFrame, schema: T.StructType, strict: bool = False, header_column: str | None = None) -> DataFrame:
    """Rows of ``schema`` from a ``value`` column. Blank lines are skipped; malformed ones are skipped too, or raise when
    ``strict``. Lines with a non-null ``header_column`` are headers and dropped."""
    x = lines.where(strip(F.col("value")) != "")
    if header_column:
        x = x.where(F.get_json_object("value", f"$.{header_column}").isNull())
    fields = T.StructType([*schema.fields, *([] if strict else [T.StructField("_bad", T.StringType())])])
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = x.select(F.from_json("value", fields, options).alias("r")).select("r.*")
    return rows if strict else rows.where("_bad is null").drop("_bad")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerant reader of a file or folder."""
    return parse(spark.read.text(path), schema)


def dataset(rows: DataFrame, courses: list[str] | None = None, source_types: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Filters of the dataset reader; ``limit`` 0 means all."""
    if courses:
        rows = rows.where(F.col("question.metadata.course_id").isin(*courses))
    if source_types:
        rows = rows.where(F.col("question.metadata.source_type").isin(*source_types))
    return rows.limit(limit) if limit else rows


def read_dataset(spark: SparkSession, path: str, schema: T.StructType, courses: list[str] | None = None, source_types: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Strict reader: a malformed line raises, the header line is dropped."""
    return dataset(parse(spark.read.text(path), schema, strict=True, header_column="_type"), courses, source_types, limit)


def read_meta(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Course files, one JSON object each over any number of lines."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern)


def read_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, pos, line): trimmed non-blank lines of text files, in order."""
    x = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return x.withColumn("line", strip(F.col("line"))).where("line <> ''")


def read_objects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files of comma-separated JSON objects without brackets."""
    x = spark.read.text(path, wholetext=True)
    body = F.concat(F.lit("["), F.regexp_replace("value", r",\s*$", ""), F.lit("]"))
    return x.select(F.explode(F.from_json(body, T.ArrayType(schema), {"mode": "FAILFAST"})).alias("r")).select("r.*")


def discover(spark: SparkSession, pattern: str) -> DataFrame:
    """(course): sorted names of the folders that hold a file of this pattern, e.g. ``raw/*/course_meta.json``."""
    x = spark.read.format("binaryFile").load(pattern).select(F.element_at(F.split("path", "/"), -2).alias("course"))
    return x.distinct().orderBy("course")


def coerce_scores(lines: DataFrame, keep: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Long rows from a JSON ``scores`` column whose leaves are structs or, in the old form, bare numbers."""
    leaf = F.from_json("scores", "map<string,map<string,map<string,string>>>")
    a = lines.select(*keep, F.explode(leaf).alias("aspect", "d"))
    b = a.select(*keep, "aspect", F.explode("d").alias("dimension", "m"))
    c = b.select(*keep, "aspect", "dimension", F.explode("m").alias("metric", "v"))
    new = F.from_json("v", "score double, flagged boolean, rationale string")
    bare = F.expr("try_cast(v as double)")
    score = F.when(bare.isNotNull(), bare).otherwise(new["score"])
    flag = F.when(bare.isNotNull(), F.lit(False)).otherwise(new["flagged"])
    why = F.when(bare.isNotNull(), F.lit("")).otherwise(new["rationale"])
    return c.select(*keep, "aspect", "dimension", "metric", score.alias("score"), flag.alias("flagged"), why.alias("rationale"))


def lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, not ASCII-escaped."""
    lines(df).write.mode(mode).text(path)


def write_dataset(records: DataFrame, path: str, date: str) -> None:
    """Records as JSON lines ordered by course, and a one-line header beside them: date, total, counts by course."""
    course = F.col("question.metadata.course_id")
    records.repartitionByRange(course, F.col("question.id")).sortWithinPartitions(course, F.col("question.id")).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/records")
    by = records.groupBy(F.coalesce(course, F.lit("")).alias("c")).agg(F.count("*").alias("n"))
    head = by.agg(F.sum("n").alias("total_records"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "n")))).alias("courses"))
    head.select(F.to_json(F.struct(F.lit("dataset_header").alias("_type"), F.lit(date).alias("date"), "total_records", "courses")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/header")


def cache_key(text_id: str = "id", text: str = "text", context: str | None = None):
    """Key of a stored result: the item and, unlike a key of the item alone, the context it was judged in."""
    parts = [F.col(text_id).alias("id"), F.col(text).alias("text"), F.lit("2").alias("v")]
    if context:
        parts.append(F.xxhash64(context).alias("context"))
    return F.sha2(F.to_json(F.struct(*parts)), 256)
