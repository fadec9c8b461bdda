"""Alignment of every question with its best course passage by BM25.

Statistics (document frequencies, idf, weights) are joins and aggregations over an inverted index. Scoring meets blocks of
questions with blocks of passages of the same course: a task holds one block of either, whatever the size of a course.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import ws_tokens


def weighted_terms(chunks: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(course_id, chunk_id, terms, weights): per passage its distinct terms with their BM25 weights; both lists are empty for
    an empty passage. Negative idf becomes ``epsilon`` times the mean idf of the course's vocabulary."""
    c = chunks.where(F.col("course_id").isNotNull() & F.col("chunk_id").isNotNull()).groupBy("course_id", "chunk_id").agg(F.max("text").alias("text"))
    c = c.select("course_id", "chunk_id", ws_tokens(F.lower("text")).alias("tok")).withColumn("dl", F.size("tok"))
    course = c.groupBy("course_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = c.select("course_id", "chunk_id", "dl", F.explode("tok").alias("term")).groupBy("course_id", "chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("course_id", "term").agg(F.count("*").alias("df")).join(course, "course_id")
    df = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = df.groupBy("course_id").agg((F.avg("idf") * epsilon).alias("floor"))
    idf = df.join(floor, "course_id").select("course_id", "term", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"), "avgdl")
    w = tf.join(idf, ["course_id", "term"]).withColumn("w", F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    # as many entries as the passage has terms
    lists = w.groupBy("course_id", "chunk_id").agg(F.collect_list(F.struct("term", "w")).alias("x"))
    out = c.select("course_id", "chunk_id").join(lists, ["course_id", "chunk_id"], "left")
    none = F.array().cast("array<struct<term:string,w:double>>")
    x = F.coalesce("x", none)
    return out.select("course_id", "chunk_id", F.transform(x, lambda e: e["term"]).alias("terms"), F.transform(x, lambda e: e["w"]).alias("weights"))


def _best(key, questions: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
    """The best passage of one block for every question of one block: postings are added up per question."""
    chunks = chunks.sort_values("chunk_id", kind="stable").reset_index(drop=True)
    if not len(chunks) or not len(questions):
        return pd.DataFrame({"course_id": [], "q_id": [], "t_id": [], "chunk_id": [], "s": []})
    at: dict[str, tuple[list, list]] = {}
    for i, (terms, weights) in enumerate(zip(chunks["terms"], chunks["weights"])):
        for t, w in zip(terms, weights):
            rows, ws = at.setdefault(t, ([], []))
            rows.append(i)
            ws.append(w)
    posts = {t: (np.array(rows), np.array(ws)) for t, (rows, ws) in at.items()}
    won, top = [], []
    for terms, times in zip(questions["terms"], questions["times"]):
        score = np.zeros(len(chunks))
        for t, k in zip(terms, times):
            p = posts.get(t)
            if p is not None:
                score[p[0]] += k * p[1]
        score = np.round(score, 9)
        j = int(score.argmax())
        won.append(chunks["chunk_id"].iat[j])
        top.append(float(score[j]))
    return pd.DataFrame({"course_id": questions["course_id"], "q_id": questions["q_id"], "t_id": questions["t_id"], "chunk_id": won, "s": top})


def bm25_align(questions: DataFrame, chunks: DataFrame, low: float = 5.0, block: int = 1000) -> DataFrame:
    """(course_id, q_id, chunk_id, bm25_score, retrieval_rank, low_confidence): the top passage of the question's course.

    ``questions`` (course_id, q_id, text) and ``chunks`` (course_id, chunk_id, text); ties go to the lower chunk_id, a
    passage without common terms scores 0 (and wins over negative scores). Null courses and ids, and courses without
    chunks, give no row; a question with several texts gives one for each. Questions and passages are hashed into blocks
    of about ``block``, so the memory of a task does not depend on the size of a course.
    """
    q = questions.where(F.col("course_id").isNotNull() & F.col("q_id").isNotNull())
    q = q.select("course_id", "q_id", F.md5(F.coalesce("text", F.lit("\x00"))).alias("t_id"), "text").dropDuplicates(["course_id", "q_id", "t_id"])
    tok = ws_tokens(F.lower("text"))
    q = q.select("course_id", "q_id", "t_id", F.array_distinct(tok).alias("terms"), tok.alias("tok"))
    q = q.withColumn("times", F.transform("terms", lambda t: F.size(F.filter("tok", lambda x: x == t)))).drop("tok")
    c = weighted_terms(chunks)
    size = q.groupBy("course_id").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks"))
    size = size.join(c.groupBy("course_id").agg(F.ceil(F.count("*") / block).cast("int").alias("c_blocks")), "course_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ql = q.join(size, "course_id").select("course_id", "q_id", "t_id", "terms", "times", F.pmod(F.xxhash64("q_id", "t_id"), F.col("q_blocks")).cast("int").alias("qb"), every("c_blocks").alias("cb"))
    cl = c.join(size, "course_id").select("course_id", "chunk_id", "terms", "weights", F.pmod(F.xxhash64("chunk_id"), F.col("c_blocks")).cast("int").alias("cb"), every("q_blocks").alias("qb"))
    keys = ["course_id", "qb", "cb"]
    best = ql.groupBy(*keys).cogroup(cl.groupBy(*keys)).applyInPandas(_best, "course_id string, q_id string, t_id string, chunk_id string, s double")
    one = best.groupBy("course_id", "q_id", "t_id").agg(F.min_by(F.struct("chunk_id", "s"), F.struct(-F.col("s"), F.col("chunk_id"))).alias("m"))
    s = F.col("m.s")
    return one.select("course_id", "q_id", F.col("m.chunk_id").alias("chunk_id"), F.round(s, 4).alias("bm25_score"), F.lit(1).alias("retrieval_rank"), (s < low).alias("low_confidence"))
