"""The whole evaluation of items with their context: every metric that can be had, in the order of the wiring.

Metrics come from column expressions, from the references of the item, from annotated tokens, from lexicon tables and from
registered back ends. What is not to be had (no back end, no lexicon) is absent from the result, never null or zero.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import is_blank, txt, word_runs
from quaestor.operators import annotate as N
from quaestor.operators import metrics as M
from quaestor.operators import rules, wiring
from quaestor.operators import similarity as S

TOKEN_METRICS = ("bleu", "rouge_l", "meteor", "chrf", "tfidf", "bm25")
# Metrics over annotated tokens (columns tokens, heads and text) with the score below which they are flagged.
ANNOTATED: dict[str, tuple[Callable[[], Column], float]] = {
    "lexical_density": (lambda: N.lexical_density(F.col("tokens")), 0.3),
    "parse_tree_depth": (lambda: N.parse_tree_depth(F.col("heads")), 0.3),
    "dependency_distance": (lambda: N.dependency_distance(F.col("tokens")), 0.3),
    "constituent_count": (lambda: N.constituent_count(F.col("tokens"), rules.noun_chunks(F.col("tokens"))), 0.3),
    "passive_voice_rate": (lambda: N.passive_voice_rate(F.col("tokens")), 0.5),
    "negation_ambiguity": (lambda: N.negation_ambiguity(F.col("tokens")), 0.5),
    "subject_verb_agreement": (lambda: N.subject_verb_agreement(F.col("tokens")), 0.7),
    "question_type_consistency": (lambda: N.question_type_consistency(F.col("tokens"), word_runs(F.col("text"))), 0.6),
}


def _rows(scored: DataFrame, dimension: str, metric: str) -> DataFrame:
    return scored.select("question_id", F.lit(dimension).alias("dimension"), F.lit(metric).alias("metric"), "score", "flagged")


def from_references(items: DataFrame) -> list[DataFrame]:
    """Every reference metric against objectives and against content, novelty and self_bleu; back ends where registered."""
    out = []
    sides = {"curriculum_alignment": S.references(F.col("objectives")), "concept_coverage": S.content_reference(F.col("content"))}
    for dimension, refs in sides.items():
        x = items.select("question_id", "text", refs.alias("refs"))
        out += [_rows(S.score(x, name), dimension, name) for name in TOKEN_METRICS]
        for name in [n for n in N.available() if n in wiring.REFERENCE]:
            void = (F.size("refs") == 0) | is_blank(F.col("text"))
            y = x.withColumn("score", F.when(void, 0.0).otherwise(N.model_score(name, txt(F.col("text")), F.col("refs"))))
            out.append(_rows(y.withColumn("flagged", void | (F.col("score") < N.FLAG_BELOW[name])), dimension, name))
    novelty = items.withColumn("score", S.vocabulary_novelty(F.col("text"), F.col("content"))).withColumn("flagged", F.col("score") < 0.3)
    out.append(_rows(novelty, "diversity", "vocabulary_novelty"))
    out.append(_rows(S.score(items.select("question_id", "text", F.col("batch").alias("refs")), "self_bleu"), "diversity", "self_bleu"))
    return out


def from_tokens(items: DataFrame) -> DataFrame:
    """All annotated metrics in one pass over the tokens of the `rules` annotator."""
    dimension = {m: d for d, ms in wiring.METRICS.items() for m in ms}
    x = rules.annotate(items.select("question_id", "text")).withColumn("heads", N.heads(F.col("tokens")))
    blank = is_blank(F.col("text"))
    each = [F.struct(F.lit(dimension[n]).alias("dimension"), F.lit(n).alias("metric"), F.when(blank, 0.0).otherwise(build()).cast("double").alias("score"), F.lit(below).alias("below")) for n, (build, below) in ANNOTATED.items()]
    x = x.select("question_id", blank.alias("blank"), F.explode(F.array(*each)).alias("m"))
    return x.select("question_id", "m.dimension", "m.metric", "m.score", (F.col("blank") | (F.col("m.score") < F.col("m.below"))).alias("flagged"))


def evaluate(items: DataFrame, easy: DataFrame | None = None, zipf: DataFrame | None = None) -> DataFrame:
    """Long rows (question_id, aspect, dimension, metric, score, flagged) of ``items`` (question_id, text, objectives, content,
    batch; ids differ). ``easy`` (word) brings dale_chall and spache_score, ``zipf`` (word, zipf) zipf_word_frequency."""
    plain = M.evaluate(items, "question_id").select("question_id", "dimension", "metric", "score", "flagged")
    parts = [plain, *from_references(items), from_tokens(items)]
    q = items.select("question_id", "text")
    if easy is not None:
        for kind, name in (("dale_chall", "dale_chall"), ("spache", "spache_score")):
            parts.append(_rows(M.difficult_word_grade(q, easy, kind).withColumn("flagged", F.col("score") < 0.3), "readability", name))
    if zipf is not None:
        parts.append(_rows(M.zipf_word_frequency(q, zipf).withColumn("flagged", F.col("score") < 0.3), "linguistic_complexity", "zipf_word_frequency"))
    aspect = F.create_map(*[F.lit(x) for a, ds in wiring.TAXONOMY.items() for d in ds for x in (d, a)])
    return reduce(DataFrame.unionByName, parts).select("question_id", aspect[F.col("dimension")].alias("aspect"), "dimension", "metric", "score", "flagged")
