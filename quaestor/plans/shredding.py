"""Problem 4: the nested records as flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.text import is_blank
from quaestor.operators import shred
from quaestor.plans.core import query
from quaestor.runtime import cut, table

_FOUND = r"""
WITH r AS (SELECT DISTINCT question, context FROM records), o AS (
  SELECT question, context, unnest(range(1, len(context.learning_objectives) + 1)) AS i FROM r
), k AS (
  SELECT question, context, i FROM o
  WHERE trim(regexp_replace(coalesce(context.learning_objectives[i], ''), '[\s\p{Z}]+', ' ', 'g')) <> ''
)
SELECT question.id AS question_id, coalesce(question.metadata.course_id, '') AS course_id,
  coalesce(context.metadata.chunk_id, '') AS chunk_id, CAST(i AS INTEGER) AS objective_no FROM k
UNION ALL
SELECT question.id, coalesce(question.metadata.course_id, ''), coalesce(context.metadata.chunk_id, ''), 0 FROM r
WHERE coalesce(len(list_filter(context.learning_objectives, lambda x: trim(regexp_replace(coalesce(x, ''), '[\s\p{Z}]+', ' ', 'g')) <> '')), 0) = 0
"""


@query(_FOUND)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """From the flat tables alone: record -> question -> metadata, record -> context -> metadata, context -> objectives.

    The table is read and hashed once; the flat tables are taken from what that leaves, without the texts."""
    df = table(spark, sf, "records")
    part = lambda *path: reduce(lambda c, i: c.getField("v").getField(f"f{i}"), _places(df.schema, path), F.col("node"))
    ids = {"record": (), "question": ("question",), "question_meta": ("question", "metadata"), "context": ("context",), "context_meta": ("context", "metadata")}
    kept = [part(*p).getField("id").alias(n) for n, p in ids.items()]
    scalars = {"question_id": ("question", "id"), "course_id": ("question", "metadata", "course_id"), "chunk_id": ("context", "metadata", "chunk_id")}
    kept += [part(*p).getField("v").alias(n) for n, p in scalars.items()]
    goals = F.transform(part("context", "learning_objectives").getField("v"), lambda x, i: F.when(~is_blank(x.getField("v")), i + 1))
    one = cut(shred.records(df).select(*kept, F.array_compact(goals).alias("ordinals")))
    rec = one.select(*ids).distinct()
    obj = lambda key, name: one.where(F.col(key).isNotNull()).groupBy(key).agg(F.first(name).alias(name))
    said = one.select("context", F.explode("ordinals").alias("ordinal")).distinct()
    x = rec.join(obj("question", "question_id"), "question", "left").join(obj("question_meta", "course_id"), "question_meta", "left")
    x = x.join(obj("context_meta", "chunk_id"), "context_meta", "left").join(said, "context", "left")
    return x.select("question_id", F.coalesce("course_id", F.lit("")).alias("course_id"), F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.coalesce("ordinal", F.lit(0)).cast("int").alias("objective_no"))


def _places(kind, path):
    """The positions of the fields along a path of structs."""
    out = []
    for name in path:
        out.append(kind.fieldNames().index(name))
        kind = kind[name].dataType
    return out


@query("SELECT count(DISTINCT struct_pack(q := question, c := context)) AS records, count(*) AS occurrences FROM records")
def p4_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct records stored once, and their occurrences kept."""
    return shred.spine(table(spark, sf, "records"), "record").agg(F.count("*").alias("records"), F.sum("copies").alias("occurrences"))


_LINKS = """
WITH r AS (SELECT DISTINCT question, context FROM records), q AS (SELECT DISTINCT question AS o FROM r WHERE question IS NOT NULL), c AS (SELECT DISTINCT context AS o FROM r WHERE context IS NOT NULL)
, m AS (SELECT DISTINCT o.metadata AS o FROM c WHERE o.metadata IS NOT NULL)
, l AS (
  SELECT 'record' AS parent, 'question' AS field, 1 AS ordinal, CAST(question AS VARCHAR) AS child FROM r WHERE question IS NOT NULL
  UNION ALL SELECT 'record', 'context', 1, CAST(context AS VARCHAR) FROM r WHERE context IS NOT NULL
  UNION ALL SELECT 'record__question', 'metadata', 1, CAST(o.metadata AS VARCHAR) FROM q WHERE o.metadata IS NOT NULL
  UNION ALL SELECT 'record__context', 'metadata', 1, CAST(o.metadata AS VARCHAR) FROM c WHERE o.metadata IS NOT NULL
  UNION ALL SELECT 'record__question', 'options', i, o.options[i] FROM q, unnest(range(1, len(o.options) + 1)) AS t(i)
  UNION ALL SELECT 'record__context', 'learning_objectives', i, o.learning_objectives[i] FROM c, unnest(range(1, len(o.learning_objectives) + 1)) AS t(i)
  UNION ALL SELECT 'record__context__metadata', 'question_batch', i, o.question_batch[i] FROM m, unnest(range(1, len(o.question_batch) + 1)) AS t(i)
)
SELECT parent, field, count(*) AS links, count(DISTINCT child) AS children, CAST(max(ordinal) AS INTEGER) AS longest FROM l GROUP BY parent, field
"""


@query(_LINKS)
def p4_links(spark: SparkSession, sf: str) -> DataFrame:
    """The bridge rows of the records by parent and field: links, different children, longest array."""
    b = shred.bridge(table(spark, sf, "records"), "record")
    return b.groupBy("parent", "field").agg(F.count("*").alias("links"), F.countDistinct("child_id").alias("children"), F.max("ordinal").alias("longest"))


@query()
def p4_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """All parent-child links of the records: structs, array entries with their ordinals, map values."""
    return shred.bridge(table(spark, sf, "records"), "record")
