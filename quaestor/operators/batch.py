"""Question batches as rows: all questions of one course and source file, in the order of their ids.

A batch is never gathered into one row or task. Positions come from a range-ordered pass over ids and text hashes alone,
so a hot file is spread over as many tasks as its size asks for; comparisons meet block by block.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.text import strip
from quaestor.operators.similarity import grams
from quaestor.runtime import cut

BATCH = ["course_id", "source_file"]
_ID = [*BATCH, "q_key", "text_key"]


def batch_rows(questions: DataFrame) -> DataFrame:
    """(course_id, source_file, position, q_id, text, copies): the members of every batch, exact copies once with their number.

    ``position`` counts from 1 by q_id, then by the hash of the text. A null course is the course ''; rows without a
    source file belong to no batch; null and blank texts keep their place. A text is known by its MD5 hash."""
    x = questions.where("source_file is not null").select(
        F.coalesce("course_id", F.lit("")).alias("course_id"),
        "source_file",
        F.when(F.col("q_id").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("q_id"))).alias("q_key"),  # null comes first and joins
        F.coalesce(F.md5("text"), F.lit("")).alias("text_key"),
        "text",
    )
    light = x.groupBy(*_ID).agg(F.count("*").alias("copies"))
    # the bounds of the ranges are sampled, so the parts are fixed before they are counted
    parts = cut(light.repartitionByRange(*_ID).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy(*BATCH, "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy(*BATCH).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*BATCH, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy(*BATCH, "part").orderBy("q_key", "text_key"))
    placed = parts.withColumn("own", own).join(offsets, [*BATCH, "part"]).select(*_ID, (F.col("offset") + F.col("own")).alias("position"), "copies")
    texts = x.groupBy(*_ID).agg(F.first("text").alias("text"))
    q_id = F.when(F.col("q_key") != "0", F.expr("substring(q_key, 2)"))
    return texts.join(placed, _ID).select(*BATCH, "position", q_id.alias("q_id"), "text", "copies")


def _members(questions: DataFrame) -> DataFrame:
    """Distinct (course_id, source_file, q_id, text) of the batches, with the stripped text ``s``."""
    x = questions.where("source_file is not null").select(F.coalesce("course_id", F.lit("")).alias("course_id"), "source_file", "q_id", "text").distinct()
    return x.withColumn("s", strip(F.col("text")))


def batch_peers(questions: DataFrame) -> DataFrame:
    """(course_id, source_file, q_id, text, peers): how many members of the batch are peers of each question: those that
    are not blank and whose stripped text is another. Counted from group sizes; a blank question has no peers."""
    x = _members(questions)
    same = x.where("s <> ''").groupBy(*BATCH, "s").agg(F.count("*").alias("same"))
    whole = same.groupBy(*BATCH).agg(F.sum("same").alias("whole"))
    y = x.join(same, [*BATCH, "s"], "left").join(whole, BATCH, "left")
    return y.select(*BATCH, "q_id", "text", F.coalesce(F.col("whole") - F.col("same"), F.lit(0)).alias("peers"))


def _bleu_sums(left: list[str], right: list[str], copies: list[int]) -> list[float]:
    """For each left text the sum of BLEU-2 (linear brevity) over the copies of the other right texts."""
    prepared: dict[str, tuple[int, Counter, Counter]] = {}
    for t in {*left, *right}:
        w = re.findall("[a-z]+", t.lower())
        prepared[t] = len(w), grams(w, 1), grams(w, 2)
    # postings of the right side: only texts that share a gram are ever compared
    posts: tuple[dict, dict] = ({}, {})
    for j, t in enumerate(right):
        for k in (0, 1):
            for g, c in prepared[t][k + 1].items():
                posts[k].setdefault(g, []).append((j, c))
    out = []
    for t in left:
        n, *mine = prepared[t]
        hits = ({}, {})
        for k in (0, 1):
            at = hits[k]
            for g, c in mine[k].items():
                for j, d in posts[k].get(g, ()):
                    at[j] = at.get(j, 0) + (c if c < d else d)
        total = 0.0
        for j, m2 in hits[1].items():
            if right[j] != t:
                total += copies[j] * min(1.0, n / prepared[right[j]][0]) * math.sqrt(hits[0][j] / n * m2 / max(1, n - 1))
        out.append(total)
    return out


def _sums(left: pd.Series, right: pd.Series, copies: pd.Series) -> pd.Series:
    return pd.Series([_bleu_sums(list(a), list(b), list(k)) for a, b, k in zip(left, right, copies)], dtype=object)


def self_bleu(questions: DataFrame, block: int = 64) -> DataFrame:
    """(course_id, source_file, q_id, text_key, score, flagged): self_bleu of every question against its batch.

    Equal stripped texts of a batch are one text with a count, known by its MD5 hash. A batch of more than ``block`` texts
    is dealt into blocks, which meet pair by pair in different tasks. A blank question scores 0, flagged; one without
    peers 1, not flagged."""
    raw = questions.where("source_file is not null").select(F.coalesce("course_id", F.lit("")).alias("course_id"), "source_file", "q_id", "text", strip(F.col("text")).alias("s"))
    raw = raw.select(*BATCH, "q_id", F.coalesce(F.md5("text"), F.lit("")).alias("text_key"), F.when(F.col("s") != "", F.md5("s")).alias("s_key"), "s")
    members = cut(raw.select(*BATCH, "q_id", "text_key", "s_key").distinct())
    same = members.where("s_key is not null").groupBy(*BATCH, "s_key").agg(F.count("*").alias("same"))
    whole = same.groupBy(*BATCH).agg(F.sum("same").alias("whole"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = cut(same.join(whole, BATCH).withColumn("b", F.pmod(F.xxhash64("s_key"), F.col("blocks")).cast("int")))
    texts = raw.where("s_key is not null").groupBy(*BATCH, "s_key").agg(F.first("s").alias("s"))
    entries = texts.join(dealt, [*BATCH, "s_key"]).groupBy(*BATCH, "blocks", "b").agg(F.sort_array(F.collect_list(F.struct("s_key", "s", "same"))).alias("e"))
    bleu = F.pandas_udf(_sums, "array<double>")
    alone = entries.where("blocks = 1").select(*BATCH, F.col("e.s_key").alias("k"), bleu("e.s", "e.s", "e.same").alias("v"))
    several = entries.where("blocks > 1")
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = several.select(*BATCH, spread.alias("other"), F.col("e").alias("l"))
    right = several.select(*BATCH, F.col("b").alias("other"), F.col("e").alias("r"))
    met = left.join(right, [*BATCH, "other"]).select(*BATCH, F.col("l.s_key").alias("k"), bleu("l.s", "r.s", "r.same").alias("v"))
    sums = alone.unionByName(met).select(*BATCH, F.explode(F.arrays_zip("k", "v")).alias("z"))
    per = sums.groupBy(*BATCH, F.col("z.k").alias("s_key")).agg(F.sum("z.v").alias("bleu"))
    peers = F.col("whole") - F.col("same")
    known = dealt.join(per, [*BATCH, "s_key"]).select(*BATCH, "s_key", F.when(peers == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("bleu") / peers)).alias("score"))
    y = members.join(known, [*BATCH, "s_key"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return y.select(*BATCH, "q_id", "text_key", "score", (F.col("score") < 0.3).alias("flagged"))
