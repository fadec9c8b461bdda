"""Similarity of records to their references, alignment, diversity and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import align, batch
from quaestor.operators import similarity as S
from quaestor.operators.annotate import NORMALISE
from quaestor.plans.core import query, r6, s6
from quaestor.runtime import table


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (question_id, text, objectives, content, batch) of the records."""
    r = table(spark, sf, "records")
    return r.select(F.col("question.id").alias("question_id"), F.col("question.text").alias("text"), F.col("context.learning_objectives").alias("objectives"), F.col("context.course_content").alias("content"), F.col("context.metadata.question_batch").alias("batch")).distinct()


PAIRS = r"""
WITH r0 AS (SELECT DISTINCT question.id AS question_id, question.text AS text, context.learning_objectives AS objectives, context.course_content AS content,
  context.metadata.question_batch AS batch FROM records),
r AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t,
  regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') = '' AS blank,
  list_filter(coalesce(objectives, []), lambda x: regexp_replace(coalesce(x, ''), '[\s\p{Z}]+', '', 'g') <> '') AS objs FROM r0)
"""


def _final(value: str, empty: str) -> str:
    s = s6(f"CASE WHEN blank OR {empty} THEN 0.0 ELSE coalesce(v, 0) END")
    return f" SELECT question_id, {s} AS score, (blank OR {empty} OR coalesce(v, 0) < 0.3) AS flagged FROM r LEFT JOIN ({value}) vv USING (rid)"


_NOREF = "len(objs) = 0"
_BM25 = (
    PAIRS
    + r""", d AS (SELECT rid, i AS ref, list_filter(regexp_split_to_array(lower(objs[i]), '\s+'), lambda x: x <> '') AS tok FROM r, unnest(range(1, len(objs) + 1)) AS u(i)),
z AS (SELECT rid, count(*) AS n, avg(len(tok)) AS avgdl FROM d GROUP BY rid),
tf AS (SELECT rid, ref, dl, term, count(*) AS tf FROM (SELECT rid, ref, len(tok) AS dl, unnest(tok) AS term FROM d) GROUP BY ALL),
df AS (SELECT rid, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN z USING (rid) GROUP BY rid, term, n),
fl AS (SELECT rid, 0.25 * avg(idf) AS fl FROM df GROUP BY rid),
w AS (SELECT tf.rid, ref, tf.term, (CASE WHEN idf < 0 THEN fl ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df ON tf.rid = df.rid AND tf.term = df.term JOIN fl ON fl.rid = tf.rid JOIN z ON z.rid = tf.rid),
qt AS (SELECT rid, unnest(list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '')) AS term FROM r),
s AS (SELECT w.rid, ref, sum(w) AS s FROM qt JOIN w ON qt.rid = w.rid AND qt.term = w.term GROUP BY 1, 2),
alls AS (SELECT d.rid, d.ref, coalesce(s.s, 0) AS s FROM d LEFT JOIN s ON d.rid = s.rid AND d.ref = s.ref),
v AS (SELECT rid, least(1.0, greatest(0.0, max(s) / 10.0)) AS v FROM alls GROUP BY rid)"""
    + _final("SELECT * FROM v", _NOREF)
)
_TFIDF = (
    PAIRS
    + r""", dd AS (SELECT rid, 0 AS ref, t AS x FROM r UNION ALL SELECT rid, i, objs[i] FROM r, unnest(range(1, len(objs) + 1)) AS u(i)),
tk AS (SELECT rid, ref, list_filter(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+'), lambda y: length(y) > 1) AS w FROM dd),
g AS (SELECT rid, ref, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tk),
tf AS (SELECT rid, ref, g, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT rid, count(*) AS n FROM dd GROUP BY rid),
df AS (SELECT rid, g, ln((1.0 + n) / (1 + count(*))) + 1 AS idf FROM tf JOIN n USING (rid) GROUP BY rid, g, n),
w AS (SELECT tf.rid, ref, tf.g, tf * idf AS w FROM tf JOIN df ON tf.rid = df.rid AND tf.g = df.g), nm AS (SELECT rid, ref, sqrt(sum(w * w)) AS nm FROM w GROUP BY 1, 2),
dot AS (SELECT a.rid, b.ref, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.rid = b.rid AND a.g = b.g AND a.ref = 0 AND b.ref > 0 GROUP BY 1, 2),
v AS (SELECT dot.rid, max(dot / (x.nm * y.nm)) AS v FROM dot JOIN nm x ON x.rid = dot.rid AND x.ref = 0 JOIN nm y ON y.rid = dot.rid AND y.ref = dot.ref GROUP BY 1)"""
    + _final("SELECT * FROM v", _NOREF)
)
_CHRF = (
    PAIRS
    + r""", dd AS (SELECT rid, 0 AS ref, regexp_replace(t, '\s+', '', 'g') AS x FROM r UNION ALL SELECT rid, i, regexp_replace(objs[i], '\s+', '', 'g') FROM r, unnest(range(1, len(objs) + 1)) AS u(i)),
g AS (SELECT rid, ref, k, substr(x, i, k) AS g, count(*) AS c FROM dd, unnest(range(1, 7)) AS o(k), unnest(range(1, length(x) - k + 2)) AS u(i) GROUP BY ALL),
tot AS (SELECT rid, ref, k, greatest(0, length(x) - k + 1) AS n FROM dd, unnest(range(1, 7)) AS o(k)),
m AS (SELECT a.rid, b.ref, a.k, sum(least(a.c, b.c)) AS m FROM g a JOIN g b ON a.rid = b.rid AND a.k = b.k AND a.g = b.g AND a.ref = 0 AND b.ref > 0 GROUP BY 1, 2, 3),
pq AS (SELECT h.rid, y.ref, avg(coalesce(m.m, 0) * 1.0 / h.n) AS p, avg(coalesce(m.m, 0) * 1.0 / y.n) AS q FROM tot h JOIN tot y ON h.rid = y.rid AND h.k = y.k AND h.ref = 0 AND y.ref > 0
  LEFT JOIN m ON m.rid = h.rid AND m.ref = y.ref AND m.k = h.k WHERE h.n > 0 AND y.n > 0 GROUP BY 1, 2),
v AS (SELECT rid, max(CASE WHEN p + q > 0 THEN 5 * p * q / (4 * p + q) ELSE 0 END) AS v FROM pq GROUP BY rid)"""
    + _final("SELECT * FROM v", _NOREF)
)
_BLEU2 = (
    PAIRS
    + r""", p0 AS (SELECT rid, i AS peer, batch[i] AS x FROM r, unnest(range(1, coalesce(len(batch), 0) + 1)) AS u(i)
  WHERE NOT blank AND trim(regexp_replace(coalesce(batch[i], ''), '[\s\p{Z}]+', ' ', 'g')) <> '' AND regexp_replace(batch[i], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> regexp_replace(t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')),
dd AS (SELECT rid, 0 AS peer, regexp_extract_all(lower(t), '[a-z]+') AS w FROM r WHERE NOT blank UNION ALL SELECT rid, peer, regexp_extract_all(lower(x), '[a-z]+') FROM p0),
g AS (SELECT rid, peer, k, g, count(*) AS c FROM (SELECT rid, peer, 1 AS k, unnest(w) AS g FROM dd UNION ALL SELECT rid, peer, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM dd) GROUP BY ALL),
m AS (SELECT b.rid, b.peer, sum(least(a.c, b.c)) FILTER (WHERE a.k = 1) AS m1, sum(least(a.c, b.c)) FILTER (WHERE a.k = 2) AS m2 FROM g a JOIN g b ON a.rid = b.rid AND a.k = b.k AND a.g = b.g AND a.peer = 0 AND b.peer > 0 GROUP BY 1, 2),
e AS (SELECT d.rid, CASE WHEN len(d.w) = 0 OR len(h.w) = 0 THEN 0.0 ELSE least(1.0, len(h.w) * 1.0 / len(d.w)) * sqrt(coalesce(m1, 0) * 1.0 / len(h.w) * coalesce(m2, 0) / greatest(1, len(h.w) - 1)) END AS b
  FROM dd d JOIN dd h ON h.rid = d.rid AND h.peer = 0 AND d.peer > 0 LEFT JOIN m ON m.rid = d.rid AND m.peer = d.peer),
v AS (SELECT rid, greatest(0.0, 1 - avg(b)) AS v FROM e GROUP BY rid)
SELECT question_id, """
    + s6("CASE WHEN blank THEN 0.0 ELSE coalesce(v, 1.0) END")
    + " AS score, (blank OR coalesce(v, 1.0) < 0.3) AS flagged FROM r LEFT JOIN v USING (rid)"
)


def _metric(name: str, refs: str):
    def f(spark: SparkSession, sf: str) -> DataFrame:
        x = pairs(spark, sf)
        arr = {"objectives": S.references(F.col("objectives")), "content": S.content_reference(F.col("content")), "batch": F.col("batch")}[refs]
        return S.score(x.select("question_id", "text", arr.alias("refs")), name).select("question_id", r6("score").alias("score"), "flagged")

    f.__doc__ = f"`{name}` of every distinct record against its {refs}."
    return f


_OBJS = r"list_filter(coalesce(objectives, []), lambda x: regexp_replace(coalesce(x, ''), '[\s\p{Z}]+', '', 'g') <> '') AS objs"
_CONTENT = "CASE WHEN length(coalesce(content, '')) > 0 THEN [content] ELSE [] END AS objs"
_BLEU = (
    PAIRS
    + r""", dd AS (SELECT rid, 0 AS ref, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+(?:[-''’.][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]') AS w FROM r
  UNION ALL SELECT rid, i, regexp_extract_all(lower(objs[i]), '[\p{L}\p{N}_]+(?:[-''’.][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]') FROM r, unnest(range(1, len(objs) + 1)) AS u(i)),
g AS (SELECT rid, ref, k, array_to_string(w[i:i + k - 1], chr(1)) AS g, count(*) AS c FROM dd, unnest(range(1, 5)) AS o(k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL),
b AS (SELECT rid, k, g, max(c) AS c FROM g WHERE ref > 0 GROUP BY ALL),
m AS (SELECT g.rid, g.k, sum(least(g.c, b.c)) AS m FROM g JOIN b ON g.rid = b.rid AND g.k = b.k AND g.g = b.g WHERE g.ref = 0 GROUP BY 1, 2),
h AS (SELECT rid, len(w) AS n FROM dd WHERE ref = 0), near AS (SELECT dd.rid, arg_min(len(w), abs(len(w) - n) * 1000000 + len(w)) AS near FROM dd JOIN h ON h.rid = dd.rid WHERE ref > 0 GROUP BY 1),
lg AS (SELECT h.rid, h.n, sum(0.25 * ln(coalesce(nullif(m.m, 0), 0.1) / greatest(1, h.n - k + 1))) AS lg, max(CASE WHEN k = 1 THEN coalesce(m.m, 0) END) AS one FROM h CROSS JOIN unnest(range(1, 5)) AS o(k) LEFT JOIN m USING (rid, k) GROUP BY 1, 2),
v AS (SELECT rid, CASE WHEN n = 0 OR one = 0 THEN 0.0 ELSE (CASE WHEN n > near THEN 1.0 ELSE exp(1 - near * 1.0 / n) END) * exp(lg) END AS v FROM lg JOIN near USING (rid))"""
    + _final("SELECT * FROM v", _NOREF)
)
_SQL = {("bleu", "objectives"): _BLEU, ("bm25", "objectives"): _BM25, ("tfidf", "objectives"): _TFIDF, ("chrf", "objectives"): _CHRF}
_SQL |= {(n, "content"): sql.replace(_OBJS, _CONTENT) for (n, _), sql in list(_SQL.items())}
for _n in ("bleu", "rouge_l", "meteor", "chrf", "tfidf", "bm25"):
    for _r in ("objectives", "content"):
        query(_SQL.get((_n, _r)), f"{_n}_{_r}" if _r == "content" else _n)(_metric(_n, _r))
query(_BLEU2, "self_bleu")(_metric("self_bleu", "batch"))


@query(PAIRS + ", w AS (SELECT question_id, coalesce(content, '') AS c, list_distinct(regexp_extract_all(lower(t), '[a-z]+')) AS q, regexp_extract_all(lower(coalesce(content, '')), '[a-z]+') AS k FROM r) SELECT question_id, " + s6("CASE WHEN len(q) = 0 OR length(c) = 0 THEN 0.0 ELSE len(list_filter(q, lambda x: NOT list_contains(k, x))) * 1.0 / len(q) END") + " AS score FROM w")
def vocabulary_novelty(spark, sf):
    return pairs(spark, sf).select("question_id", r6(S.vocabulary_novelty(F.col("text"), F.col("content"))).alias("score"))


@query(PAIRS + r"SELECT question_id, 'learning_objectives' AS source, i::INT AS position, objs[i] AS reference FROM r, unnest(range(1, len(objs) + 1)) AS u(i) UNION ALL SELECT question_id, 'course_content', 1, content FROM r WHERE length(coalesce(content, '')) > 0")
def reference_collect(spark, sf):
    """The reference texts of every record from either source, in their order."""
    x = pairs(spark, sf)
    one = lambda name, refs: x.select("question_id", F.lit(name).alias("source"), F.posexplode(refs).alias("position", "reference"))
    both = one("learning_objectives", S.references(F.col("objectives"))).unionByName(one("course_content", S.content_reference(F.col("content"))))
    return both.withColumn("position", (F.col("position") + 1).cast("int"))


_ALIGN = r"""
WITH q AS (SELECT DISTINCT course_id, q_id, text FROM questions_raw WHERE course_id IS NOT NULL AND q_id IS NOT NULL),
c AS (SELECT course_id, chunk_id, list_filter(regexp_split_to_array(lower(coalesce(max(text), '')), '[\s\p{Z}]+'), lambda x: x <> '') AS tok FROM chunks WHERE course_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
z AS (SELECT course_id, count(*) AS n, avg(len(tok)) AS avgdl FROM c GROUP BY 1),
tf AS (SELECT course_id, chunk_id, dl, term, count(*) AS tf FROM (SELECT course_id, chunk_id, len(tok) AS dl, unnest(tok) AS term FROM c) GROUP BY ALL),
df AS (SELECT course_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN z USING (course_id) GROUP BY course_id, term, n),
fl AS (SELECT course_id, 0.25 * avg(idf) AS fl FROM df GROUP BY 1),
w AS (SELECT tf.course_id, tf.term, chunk_id, (CASE WHEN idf < 0 THEN fl ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w
  FROM tf JOIN df ON tf.course_id = df.course_id AND tf.term = df.term JOIN fl ON fl.course_id = tf.course_id JOIN z ON z.course_id = tf.course_id),
qt AS (SELECT course_id, q_id, term, count(*) AS k FROM (SELECT course_id, q_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\p{Z}]+'), lambda x: x <> '')) AS term FROM q) GROUP BY ALL),
s AS (SELECT qt.course_id, q_id, chunk_id, sum(k * w) AS s FROM qt JOIN w ON qt.course_id = w.course_id AND qt.term = w.term GROUP BY 1, 2, 3),
a AS (SELECT q.course_id, q.q_id, c.chunk_id, coalesce(s.s, 0) AS s FROM q JOIN c USING (course_id) LEFT JOIN s ON s.course_id = q.course_id AND s.q_id = q.q_id AND s.chunk_id = c.chunk_id),
b AS (SELECT *, row_number() OVER (PARTITION BY course_id, q_id ORDER BY round(s, 9) DESC, chunk_id) AS rn FROM a)
SELECT course_id, q_id, chunk_id, round(s, 4) AS bm25_score, rn::INT AS retrieval_rank, s < 5 AS low_confidence FROM b WHERE rn = 1
"""


@query(_ALIGN)
def bm25_align(spark, sf):
    return align.bm25_align(table(spark, sf, "questions_raw"), table(spark, sf, "chunks"))


@query(
    "WITH x AS (SELECT vec_id, label, embedding FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(embedding[i]) AS m FROM x, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY 1, 2) GROUP BY 1) "
    f"SELECT vec_id, {s6('greatest(0.0, least(1.0, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre))))')} AS score, greatest(0.0, least(1.0, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre)))) < 0.5 AS flagged FROM x, c GROUP BY vec_id"
)
def sbert(spark, sf):
    """The highest cosine of every vector with its references, within 0 and 1: here the centres of all labels, a fixed few."""
    x = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    mean = x.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    refs = centre.agg(F.collect_list("centre").alias("refs"))  # one row
    best = x.crossJoin(F.broadcast(refs)).select("vec_id", F.array_max(F.transform("refs", lambda r: S.cosine(F.col("embedding"), r))).alias("s"))
    score = NORMALISE["sbert"](F.col("s"))
    return best.select("vec_id", r6(score).alias("score"), (score < 0.5).alias("flagged"))


@query(r"""SELECT q_id, source_file, count(*) OVER (PARTITION BY course_id, source_file) AS batch FROM (SELECT DISTINCT coalesce(course_id, '') AS course_id, source_file, q_id, text FROM questions_raw) WHERE source_file IS NOT NULL""")
def question_batch(spark, sf):
    """Size of the batch (course and source file) of every question; `question_batch_rows` has its texts."""
    x = table(spark, sf, "questions_raw").select(F.coalesce("course_id", F.lit("")).alias("course_id"), "source_file", "q_id", "text").distinct().where("source_file is not null")
    n = x.groupBy("course_id", "source_file").agg(F.count("*").alias("batch"))
    return x.join(n, ["course_id", "source_file"]).select("q_id", "source_file", "batch")


@query("SELECT a.q_id, count(*) AS peers FROM (SELECT DISTINCT course_id, source_file, q_id, text FROM questions_raw WHERE text IS NOT NULL) a JOIN (SELECT course_id, source_file, text, count(*) AS k FROM (SELECT DISTINCT course_id, source_file, q_id, text FROM questions_raw WHERE text IS NOT NULL) GROUP BY ALL) b ON a.course_id = b.course_id AND a.source_file = b.source_file AND a.text <> b.text, unnest(range(b.k)) AS u(i) GROUP BY a.q_id, a.text, a.course_id, a.source_file")
def join_pairs(spark, sf):
    """Batch peers with another text, per question: counted from group sizes, so no pair is ever built."""
    x = table(spark, sf, "questions_raw").select("course_id", "source_file", "q_id", "text").distinct().where("text is not null and course_id is not null and source_file is not null")
    same = x.groupBy("course_id", "source_file", "text").agg(F.count("*").alias("same"))
    whole = same.groupBy("course_id", "source_file").agg(F.sum("same").alias("whole"))
    y = x.join(same, ["course_id", "source_file", "text"]).join(whole, ["course_id", "source_file"])
    return y.where("whole > same").select("q_id", (F.col("whole") - F.col("same")).alias("peers"))


@query("SELECT coalesce(course_id, '') AS course_id, source_file, row_number() OVER (PARTITION BY coalesce(course_id, ''), source_file ORDER BY q_id NULLS FIRST, coalesce(md5(text), '')) AS position, q_id, text, copies FROM (SELECT course_id, source_file, q_id, text, count(*) AS copies FROM (SELECT coalesce(course_id, '') AS course_id, source_file, q_id, text FROM questions_raw WHERE source_file IS NOT NULL) GROUP BY ALL)")
def question_batch_rows(spark, sf):
    """The batches themselves, a row for each member; `question_batch` has their sizes."""
    return batch.batch_rows(table(spark, sf, "questions_raw"))


_MEMBERS = r"WITH m AS (SELECT DISTINCT coalesce(course_id, '') AS c, source_file AS f, q_id, text, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s FROM questions_raw WHERE source_file IS NOT NULL)"


@query(_MEMBERS + " SELECT a.q_id, count(b.c) AS peers FROM m a LEFT JOIN m b ON a.c = b.c AND a.f = b.f AND a.s <> b.s AND a.s <> '' AND b.s <> '' GROUP BY a.c, a.f, a.q_id, a.text")
def question_batch_peers(spark, sf):
    """Peers by the stripped text, blank ones left out and null courses kept, as self_bleu counts them."""
    return batch.batch_peers(table(spark, sf, "questions_raw")).select("q_id", "peers")


@query(
    _MEMBERS
    + r""", d AS (SELECT row_number() OVER () AS rid, *, regexp_extract_all(lower(s), '[a-z]+') AS w FROM m),
g AS (SELECT rid, c, f, k, g, count(*) AS n FROM (SELECT rid, c, f, 1 AS k, unnest(w) AS g FROM d WHERE s <> '' UNION ALL SELECT rid, c, f, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d WHERE s <> '') GROUP BY ALL),
o AS (SELECT a.rid, b.rid AS peer, sum(least(a.n, b.n)) FILTER (WHERE a.k = 1) AS m1, sum(least(a.n, b.n)) FILTER (WHERE a.k = 2) AS m2 FROM g a JOIN g b ON a.c = b.c AND a.f = b.f AND a.k = b.k AND a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT a.rid, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE least(1.0, len(a.w) * 1.0 / len(b.w)) * sqrt(coalesce(m1, 0) * 1.0 / len(a.w) * coalesce(m2, 0) / greatest(1, len(a.w) - 1)) END AS b
  FROM d a JOIN d b ON a.c = b.c AND a.f = b.f AND a.s <> b.s AND a.s <> '' AND b.s <> '' LEFT JOIN o ON o.rid = a.rid AND o.peer = b.rid),
v AS (SELECT rid, greatest(0.0, 1 - avg(b)) AS v FROM e GROUP BY rid)
SELECT q_id, """
    + s6("CASE WHEN s = '' THEN 0.0 ELSE coalesce(v, 1.0) END")
    + " AS score, (s = '' OR coalesce(v, 1.0) < 0.3) AS flagged FROM d LEFT JOIN v USING (rid)"
)
def self_bleu_raw(spark, sf):
    """self_bleu of the raw questions against the batches built from them."""
    return batch.self_bleu(table(spark, sf, "questions_raw")).select("q_id", r6("score").alias("score"), "flagged")
