"""Queries of the problems tagged llm, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.text import is_blank
from quaestor.llm import leak, neardup, packing, quality, reading, residue, scan_repair
from quaestor.llm.corpus import distinct_texts, item_rows, keys_and_texts
from quaestor.runtime import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    keys, texts = keys_and_texts(item_rows(spark, sf))
    return keys.join(quality.structural(texts).select("text_id"), "text_id").select("tbl", "row_key").distinct()


def p1_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics alone, by table, over the text of every key."""
    keys, texts = keys_and_texts(item_rows(spark, sf))
    x = keys.join(quality.with_stats(texts).select("text_id", "n_words", "end_punct_share", "symbol_ratio"), "text_id")
    return x.groupBy("tbl").agg(
        F.count("*").alias("texts"), F.sum(F.col("n_words").cast("long")).alias("words"), F.round(F.avg("end_punct_share"), 6).alias("end_punct_share"), F.round(F.avg("symbol_ratio"), 6).alias("symbol_ratio")
    )


def p1_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of every text, blank ones left out."""
    keys, texts = keys_and_texts(item_rows(spark, sf))
    stats = quality.with_stats(texts).select("text_id", *[F.round(c, 6).alias(c) for c in quality.FEATURES])
    return keys.join(stats, "text_id").drop("text_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neardup.duplicate_pairs(table(spark, sf, "questions_raw").select("q_id", "text"), "q_id", "text", threshold=0.75)
    return pairs.select(F.col("key_a").alias("q_id_a"), F.col("key_b").alias("q_id_b"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per question with the class of its exact word set, the copies in it and its links to other classes."""
    g = neardup.duplicate_groups(table(spark, sf, "questions_raw").select("q_id", "text"), "q_id", "text", threshold=0.75)
    return g.select(F.col("key").alias("q_id"), "class_id", "n_copies", "n_links")


def _prose(texts: DataFrame) -> DataFrame:
    """Those of ``texts`` (text_id, text) that are neither list, table nor junk. All are scored; the rest, as p1_found lists
    it, has no case by the definition of problem 3."""
    return cut(quality.score(texts).where(F.col("p_structural") < 0.5).select("text_id", "text"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    keys, texts = keys_and_texts(item_rows(spark, sf))
    prose = _prose(texts)
    word = F.transform("words", lambda w: F.struct(F.lit("word").alias("kind"), w.alias("fixed")))
    line = F.transform("lines", lambda x: F.struct(F.lit("line").alias("kind"), x.alias("fixed")))
    each = scan_repair.repair(prose, rebuild=False, titles=table(spark, sf, "course_meta").select("title"), unique=True).select("text_id", F.explode(F.concat(word, line)).alias("f"))
    return keys.join(each, "text_id").select("tbl", "row_key", "f.kind", "f.fixed").distinct()


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every row, with a key or without, continuous and without page lines. Lists, tables and junk have no running
    text to repair and come as they stand; blank and null texts come empty."""
    rows = item_rows(spark, sf)
    prose = _prose(distinct_texts(rows))
    done = scan_repair.repair(prose, titles=table(spark, sf, "course_meta").select("title"), unique=True).select("text_id", "repaired")
    each = rows.select("tbl", "row_key", F.when(is_blank(F.col("text")), "").otherwise(F.col("text")).alias("text")).distinct().withColumn("text_id", F.md5("text"))
    return each.join(done, "text_id", "left").select("tbl", "row_key", F.coalesce("repaired", "text").alias("repaired"))


def _fields(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pair = F.explode(
        F.array(
            F.struct(F.lit("question").alias("tbl"), F.col("question.text").alias("text")),
            F.struct(F.lit("content").alias("tbl"), F.col("context.course_content").alias("text")),
        )
    )
    return keys_and_texts(table(spark, sf, "records").select(F.col("question.id").alias("row_key"), pair.alias("x")).select("row_key", "x.tbl", "x.text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    keys, texts = _fields(spark, sf)
    prose = cut(quality.score(texts).where(F.col("p_structural") < 0.5).select("text_id", "text"))
    return keys.join(reading.bands(prose).select("text_id", "band"), "text_id").select(F.col("row_key").alias("question_id"), F.col("tbl").alias("field"), "band").distinct()


def p5_profile(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts of each field have each level; lists, tables and junk have none (null), as in p5_found."""
    keys, texts = _fields(spark, sf)
    prose = cut(quality.score(texts).where(F.col("p_structural") < 0.5).select("text_id", "text"))
    levels = keys.join(reading.score(prose).select("text_id", "level"), "text_id", "left")
    return levels.groupBy(F.col("tbl").alias("field"), "level").agg(F.count("*").alias("texts"))


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    """A place for every document in containers of the largest capacity of table containers."""
    kind = table(spark, sf, "containers").orderBy(F.desc("capacity_tokens"), "container_kind").first()
    out = packing.pack(table(spark, sf, "documents"), kind["capacity_tokens"])
    return out.select(F.lit(kind["container_kind"]).alias("container_kind"), "container", F.col("doc_key").alias("doc_id"), "piece", "start_token", "n_tokens")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used and the share of them filled, for every capacity of table containers."""
    out, sizes = None, packing.sizes_of(table(spark, sf, "documents"))
    for k in table(spark, sf, "containers").select("container_kind", "capacity_tokens").distinct().collect():
        x = packing.place(sizes, k["capacity_tokens"])
        each = x.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
        each = each.select(F.lit(k["container_kind"]).alias("container_kind"), "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * k["capacity_tokens"]), 4).alias("fill"))
        out = each if out is None else out.unionByName(each)
    return out


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), run=12)


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """By test item the number of documents that give it away."""
    return p7_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents")).select(F.col("doc_key").alias("doc_id"))


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by source, with those left out as residue."""
    docs = table(spark, sf, "documents").where(~is_blank(F.col("text"))).select("doc_id", "source")
    bad = residue.residue(table(spark, sf, "documents")).select(F.col("doc_key").alias("doc_id"), "reason")
    return docs.join(bad, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("reason").alias("residue"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = [p1_found, p1_statistics, p1_documents, p2_found, p2_classes, p3_found, p3_repaired, p5_found, p5_profile, p6_pack, p6_fill, p7_found, p7_report, p8_found, p8_kept]
    return {f.__name__: f for f in fns}


_P7 = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM eval_items
), item_runs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS r FROM item_words, unnest(range(1, len(w) - 10)) AS t(i)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL
), doc_runs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS r FROM doc_words, unnest(range(1, len(w) - 10)) AS t(i)
), hits AS (SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (r))
"""


_P2 = r"""
WITH s AS (
  SELECT DISTINCT q_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM questions_raw WHERE text IS NOT NULL AND q_id IS NOT NULL
), e AS (SELECT q_id, len(w) AS n, unnest(w) AS x FROM s WHERE len(w) > 0)
, d AS (SELECT x, count(*) AS df FROM e GROUP BY x)
, p AS (SELECT q_id, n, x, row_number() OVER (PARTITION BY q_id ORDER BY df, x) AS r FROM e JOIN d USING (x))
, c AS (
  SELECT DISTINCT a.q_id AS q_id_a, b.q_id AS q_id_b FROM p a JOIN p b ON a.x = b.x AND a.q_id < b.q_id
  WHERE a.r <= a.n - ceil(0.75 * a.n) + 1 AND b.r <= b.n - ceil(0.75 * b.n) + 1 AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n)
)"""


def oracle_sql() -> dict[str, str]:
    texts = r"""
WITH t AS (
  SELECT 'questions_raw' AS tbl, q_id AS row_key, text FROM questions_raw
  UNION SELECT 'records', question.id, context.course_content FROM records
), u AS (SELECT DISTINCT tbl, row_key, text FROM t WHERE row_key IS NOT NULL AND trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) <> '')
"""
    return {
        "p7_found": _P7 + "SELECT doc_id, item_id FROM hits",
        "p7_report": _P7 + "SELECT item_id, count(*) AS documents FROM hits GROUP BY item_id",
        "p2_found": _P2
        + r"""
SELECT q_id_a, q_id_b FROM c JOIN s a ON a.q_id = q_id_a JOIN s b ON b.q_id = q_id_b
WHERE len(list_intersect(a.w, b.w)) >= 0.75 * len(list_distinct(list_concat(a.w, b.w)))""",
        "p2_classes": _P2
        + r""", l AS (
  SELECT a.w AS wa, b.w AS wb FROM c JOIN s a ON a.q_id = q_id_a JOIN s b ON b.q_id = q_id_b
  WHERE a.w <> b.w AND len(list_intersect(a.w, b.w)) >= 0.75 * len(list_distinct(list_concat(a.w, b.w)))
), k AS (SELECT w, count(DISTINCT o) AS n FROM (SELECT wa AS w, wb AS o FROM l UNION ALL SELECT wb, wa FROM l) GROUP BY w)
SELECT q_id, min(q_id) OVER (PARTITION BY w) AS class_id, count(*) OVER (PARTITION BY w) AS n_copies, coalesce(k.n, 0) AS n_links FROM s LEFT JOIN k USING (w) WHERE len(s.w) > 0""",
        "p1_statistics": texts
        + r""", b AS (
  SELECT tbl, regexp_replace(text, '(\p{L})(?:-|­)\r?\n(\p{Ll})', '\1\2', 'g') AS t FROM u
), f AS (
  SELECT tbl, len(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS n_words,
    list_filter(regexp_split_to_array(t, '\r?\n'), lambda x: trim(x) <> '') AS lines,
    length(regexp_replace(t, '[ \n\t\r]+', '', 'g')) AS solid,
    length(regexp_replace(t, '[ \n\t\r]+', '', 'g')) - length(array_to_string(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), '')) AS symbols FROM b
)
SELECT tbl, count(*) AS texts, CAST(sum(n_words) AS BIGINT) AS words,
  round(avg(CASE WHEN len(lines) = 0 THEN 0 ELSE len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;,]["'')]?\s*$'))) * 1.0 / len(lines) END), 6) AS end_punct_share,
  round(avg(CASE WHEN solid = 0 THEN 0 ELSE symbols * 1.0 / solid END), 6) AS symbol_ratio
FROM f GROUP BY tbl""",
    }
