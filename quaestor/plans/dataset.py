"""Dataset construction over documents, questions and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.operators import dataset as D
from quaestor.plans.core import query
from quaestor.runtime import table

_LIG = "replace(replace(replace(replace(replace(regexp_replace(text, '\\(cid:\\d+\\)', '', 'g'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl')"


@query(f"SELECT q_id, md5(regexp_replace({_LIG}, '[ \\t]{{2,}}', ' ', 'g')) AS digest FROM questions_raw")
def clean_text(spark, sf):
    return table(spark, sf, "questions_raw").select("q_id", F.md5(D.clean_text(F.col("text"))).alias("digest"))


@query(r"SELECT chunk_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{Z}]+'), lambda x: x <> '')) AS tokens FROM chunks")
def approx_tokens(spark, sf):
    return table(spark, sf, "chunks").select("chunk_id", D.approx_tokens(F.col("text")).cast("long").alias("tokens"))


@query(r"SELECT chunk_id FROM chunks WHERE len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{Z}]+'), lambda x: x <> '')) >= 20")
def min_chunk_filter(spark, sf):
    return table(spark, sf, "chunks").where(D.approx_tokens(F.col("text")) >= D.MIN_TOKENS).select("chunk_id")


_WORDS = r"list_filter(regexp_split_to_array({}, '[\s\p{{Z}}]+'), lambda x: x <> '')"
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _packed(source: str, most: int, overlap: int) -> str:
    """CTEs from ``source`` (id, section) to ``chunks`` (id, part, chunk): paragraphs gathered one after another."""
    full = f"len(words) > 0 AND len(words) + len(ps[i]) > {most}"
    return (
        f"sized AS (SELECT id, section, {_WORDS.format('section')} AS tok FROM {source}), "
        f"paras AS (SELECT id, list_filter(list_transform(string_split(section, chr(10) || chr(10)), lambda p: {_WORDS.format('p')}), lambda w: len(w) > 0) AS ps FROM sized WHERE len(tok) > {most}), "
        "st AS (SELECT id, ps, 1::BIGINT AS i, []::VARCHAR[] AS words, []::VARCHAR[] AS done FROM paras UNION ALL "
        f"SELECT id, ps, i + 1, CASE WHEN {full} THEN list_concat(words[-{overlap}:], ps[i]) ELSE list_concat(words, ps[i]) END, CASE WHEN {full} THEN list_append(done, array_to_string(words, ' ')) ELSE done END FROM st WHERE i <= len(ps)), "
        "lists AS (SELECT id, CASE WHEN len(words) > 0 THEN list_append(done, array_to_string(words, ' ')) ELSE done END AS cs FROM st WHERE i = len(ps) + 1 "
        f"UNION ALL SELECT id, [section] FROM sized WHERE len(tok) <= {most}), "
        "chunks AS (SELECT id, k - 1 AS part, cs[k] AS chunk FROM lists, unnest(range(1, len(cs) + 1)) AS u(k)) "
    )


_CHUNKS = (
    "WITH RECURSIVE d AS (SELECT doc_id, course_id, string_split(regexp_replace(" + _LIG + r", '[ \t]{2,}', ' ', 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL), "
    r"l AS (SELECT doc_id, course_id, i, ls[i] AS line, i > 1 AND i < len(ls) AND regexp_full_match(ls[i], '[A-Z][A-Za-z0-9 \-:]{3,60}') AS head FROM d, unnest(range(1, len(ls) + 1)) AS u(i)), "
    "g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l), "
    f"s AS (SELECT doc_id, course_id, g, {_STRIP.format("string_agg(line, chr(10) ORDER BY i)")} AS section FROM g GROUP BY 1, 2, 3), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS sec FROM s WHERE section <> ''), "
    "src AS (SELECT struct_pack(doc := doc_id, course := course_id, sec := sec) AS id, section FROM n), " + _packed("src", 500, 50) + ", "
    "c AS (SELECT id.course AS course_id, 'doc_' || lpad(CAST(id.doc AS VARCHAR), 8, '0') AS source_file, id.sec * 100000 + part AS pos, substr(string_split(chunk, chr(10))[1], 1, 80) AS topic, chunk AS text, "
    f"len({_WORDS.format('chunk')}) AS token_count FROM chunks) "
)


@query(_CHUNKS + "SELECT course_id, source_file, pos, topic, md5(text) AS digest, token_count FROM c WHERE token_count >= 20")
def chunk_by_heading(spark, sf):
    """Documents cut into sections and chunks."""
    return _chunks(spark, sf).withColumn("digest", F.md5("text")).drop("text").withColumns({"pos": F.col("pos").cast("long"), "token_count": F.col("token_count").cast("long")})


def _chunks(spark, sf):
    docs = table(spark, sf, "documents").select("course_id", F.format_string("doc_%08d", "doc_id").alias("file"), "text")
    return D.chunk(docs, "file", "course_id", "text")


@query(
    _CHUNKS + ", k AS (SELECT * FROM c WHERE token_count >= 20 AND course_id IS NOT NULL) "
    "SELECT course_id || '-content-' || lpad(CAST(row_number() OVER (PARTITION BY course_id ORDER BY source_file, pos) - 1 AS VARCHAR), 4, '0') AS chunk_id, course_id, source_file, topic, token_count FROM k"
)
def chunk_id(spark, sf):
    """The same with running ids per course; documents of no course have none."""
    return D.chunk_ids(_chunks(spark, sf)).select("chunk_id", "course_id", "source_file", "topic", F.col("token_count").cast("long").alias("token_count"))


@query("WITH RECURSIVE src AS (SELECT doc_id AS id, text AS section FROM documents WHERE text IS NOT NULL), " + _packed("src", 500, 50) + f"SELECT id AS doc_id, part, len({_WORDS.format('chunk')}) AS tokens, md5(chunk) AS digest FROM chunks")
def split_long_section(spark, sf):
    """Documents of more than 500 words packed by paragraphs with an overlap of 50; others as they are."""
    docs = table(spark, sf, "documents").where("text is not null")
    x = docs.select("doc_id", F.posexplode(D.packed(F.col("text"))).alias("part", "chunk"))
    return x.select("doc_id", F.col("part").cast("long").alias("part"), D.approx_tokens(F.col("chunk")).cast("long").alias("tokens"), F.md5("chunk").alias("digest"))


_LABEL = r"(?:problem|exercise|question|part)\s+\d"
_TASKS = "explain|describe|prove|show|find|calculate|derive|state|define|give|list|compare|discuss|evaluate"
_STEMS = (
    "WITH d AS (SELECT doc_id, course_id, doc_kind, coalesce(text, '') AS t FROM documents), "
    rf"m AS (SELECT *, regexp_matches(t, '(?i)(?:^|\n){_LABEL}') AS labelled, string_split(regexp_replace(t, '(?i)(^|\n)({_LABEL})', '\1' || chr(1) || '\2', 'g'), chr(1))[2:] AS pieces, "
    rf"regexp_extract_all(t, '(?is)(?:^|\n)\s*(\d+[.\)]\s{{1,3}}(?:[A-Z].{{15,}}?)(?:\?|(?:{_TASKS})[^.\n]*\.))', 1) AS numbered FROM d), "
    f"p AS (SELECT *, list_filter(list_transform(CASE WHEN labelled THEN pieces ELSE numbered END, lambda x: regexp_replace({_STRIP.format('x')}, '\\s{{2,}}', ' ', 'g')), lambda x: length(x) >= 30) AS stems FROM m), "
    "s AS (SELECT doc_id, course_id, doc_kind, t, k - 1 AS pos, stems[k] AS stem FROM p, unnest(range(1, len(stems) + 1)) AS u(k)) "
)


@query(_STEMS + "SELECT doc_id, pos, stem FROM s")
def extract_stems(spark, sf):
    """Item stems found in all documents."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(D.stems(F.col("text"))).alias("pos", "stem")).withColumn("pos", F.col("pos").cast("long"))


@query(
    _STEMS + "SELECT coalesce(course_id, '') || '-' || CASE WHEN doc_kind = 'exam' THEN 'E' ELSE 'A' END || lpad(CAST(row_number() OVER (PARTITION BY coalesce(course_id, ''), doc_kind = 'exam' ORDER BY doc_id, pos) AS VARCHAR), 4, '0') AS q_id, "
    "coalesce(course_id, '') AS course_id, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS source_file, md5(stem) AS digest FROM (SELECT * REPLACE (coalesce(doc_kind, '') AS doc_kind) FROM s)"
)
def question_id(spark, sf):
    """Stems of all documents with collision-free ids by course and kind; no course counts as one of its own."""
    kind = F.when(F.col("doc_kind") == "exam", "exam").otherwise("assignment")
    x = table(spark, sf, "documents").select(F.coalesce("course_id", F.lit("")).alias("course_id"), F.format_string("doc_%08d", "doc_id").alias("source_file"), kind.alias("source_type"), F.posexplode(D.stems(F.col("text"))).alias("pos", "text"))
    return D.question_ids(x).select("q_id", "course_id", "source_file", F.md5("text").alias("digest"))


@query(
    _STEMS + r", o AS (SELECT doc_id, stem, CASE WHEN strpos(t, stem) > 0 THEN list_filter(string_split(substr(t, strpos(t, stem) + length(stem), 800), chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}]+', '', 'g') <> '') END AS ls FROM s), "
    r"f AS (SELECT *, list_transform(ls, lambda x: regexp_matches(x, '^\s*[A-E][.\)]\s')) AS is_option FROM o), "
    "b AS (SELECT *, list_position(is_option, true) AS a FROM f), e AS (SELECT *, list_position(is_option[a:], false) AS z FROM b) "
    f"SELECT doc_id, stem, array_to_string(CASE WHEN a > 0 THEN list_transform(CASE WHEN z > 0 THEN ls[a:a + z - 2] ELSE ls[a:] END, lambda x: {_STRIP.format('x')}) END, '|') AS options FROM e"
)
def extract_options(spark, sf):
    """Options after every stem, joined by a bar; null where there are none."""
    x = table(spark, sf, "documents").select("doc_id", "text", F.explode(D.stems(F.col("text"))).alias("stem"))
    got = D.options_after(F.col("text"), F.col("stem"))
    return x.select("doc_id", "stem", F.when(got.isNotNull(), F.array_join(got, "|")).alias("options"))


_HEAD = r"learning\s+objectives?|course\s+objectives?|learning\s+outcomes?|goals?"


@query(
    "WITH m AS (SELECT course_id, list_filter(min(learning_objectives), lambda x: coalesce(x, '') <> '') AS own FROM course_meta WHERE course_id IS NOT NULL GROUP BY 1), "
    rf"d AS (SELECT doc_id, course_id, coalesce(text, '') AS t, length(regexp_extract(coalesce(text, ''), '(?is)^(.*?)(?:{_HEAD})', 1)) AS before, regexp_matches(coalesce(text, ''), '(?i)(?:{_HEAD})') AS headed FROM documents WHERE doc_kind = 'syllabus'), "
    "p AS (SELECT doc_id, course_id, CASE WHEN headed THEN substr(t, before + 1, 2000) ELSE t END AS part FROM d), "
    r"f AS (SELECT doc_id, course_id, list_concat(regexp_extract_all(part, '(?m)^\s*[-•*]\s+(.+)', 1), regexp_extract_all(part, '(?m)^\s*\d+[.)]\s+(.+)', 1)) AS found FROM p), "
    f"o AS (SELECT doc_id, CASE WHEN len(own) > 0 THEN own ELSE list_filter(list_transform(found, lambda x: {_STRIP.format('x')}), lambda x: length(x) > 10) END AS os FROM f LEFT JOIN m USING (course_id)) "
    "SELECT doc_id, k - 1 AS pos, os[k] AS objective FROM o, unnest(range(1, len(os) + 1)) AS u(k)"
)
def extract_objectives(spark, sf):
    """Objectives of every syllabus: those in the metadata of its course where there are any, else those in its text."""
    docs = table(spark, sf, "documents").where(F.col("doc_kind") == "syllabus")
    meta = table(spark, sf, "course_meta").where("course_id is not null").groupBy("course_id").agg(F.min("learning_objectives").alias("m"))
    own = F.filter("m", lambda x: F.coalesce(x, F.lit("")) != "")
    x = docs.join(meta, "course_id", "left").select("doc_id", F.when(F.size(own) > 0, own).otherwise(D.objectives(F.col("text"))).alias("o"))
    return x.select("doc_id", F.posexplode("o").alias("pos", "objective")).withColumn("pos", F.col("pos").cast("long"))


@query(
    r"""SELECT DISTINCT source_file, CASE WHEN len(p) > 1 THEN array_to_string(list_transform(regexp_split_to_array(lower(replace(array_to_string(p[greatest(1, len(p) - 2):len(p)], ' '), '-', ' ')), ' '),
  lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') ELSE s END AS label
FROM (SELECT source_file, regexp_replace(source_file, '\.[^./]+$', '') AS s, string_split(regexp_replace(source_file, '\.[^./]+$', ''), '_') AS p FROM questions_raw WHERE source_file IS NOT NULL)"""
)
def source_label(spark, sf):
    f = table(spark, sf, "questions_raw").select("source_file").where("source_file is not null").distinct()
    return f.select("source_file", D.source_label(F.col("source_file")).alias("label"))


@query("SELECT q_id, m.subject, m.level, m.field FROM questions_raw q LEFT JOIN (SELECT course_id, min(subject) AS subject, min(level) AS level, min(field) AS field FROM course_meta WHERE course_id IS NOT NULL GROUP BY 1) m USING (course_id)")
def enrich_course(spark, sf):
    return D.enrich_course(table(spark, sf, "questions_raw"), table(spark, sf, "course_meta")).select("q_id", "subject", "level", "field")


@query("SELECT q_id, m.title FROM questions_raw q LEFT JOIN (SELECT course_id, min(title) AS title FROM course_meta GROUP BY 1) m USING (course_id)")
def join_meta(spark, sf):
    meta = table(spark, sf, "course_meta").groupBy("course_id").agg(F.min("title").alias("title"))
    return table(spark, sf, "questions_raw").join(meta, "course_id", "left").select("q_id", "title")
