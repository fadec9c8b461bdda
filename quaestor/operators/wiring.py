"""Which metrics make up which dimension, in the order in which they are evaluated and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.lexicons import TAXONOMY

# The metrics of every dimension that has any, in order, and the source of their references.
REFERENCE = "bleu rouge_l meteor chrf tfidf bm25 bertscore bleurt bartscore comet sbert nli_entailment".split()
METRICS = {
    "curriculum_alignment": REFERENCE,
    "cognitive_demand": "bloom_level dok_level hots_keywords".split(),
    "concept_coverage": REFERENCE,
    "response_burden": "openendedness sqp_score multipart_question stem_complexity".split(),
    "readability": (
        "word_count sentence_count avg_word_length avg_syllables long_word_ratio type_token_ratio lexical_density "
        "flesch_ease flesch_kincaid dale_chall gunning_fog coleman_liau ari smog linsear_write spache_score"
    ).split(),
    "linguistic_complexity": "conjunction_rate zipf_word_frequency parse_tree_depth dependency_distance constituent_count passive_voice_rate".split(),
    "ambiguity": "wh_word_type pronoun_ratio quantifier_rate polysemy_score negation_ambiguity".split(),
    "well_formedness": "question_mark negation_rate has_verb subject_verb_agreement question_type_consistency lm_perplexity".split(),
    "diversity": "distinct_1 distinct_2 vocabulary_novelty self_bleu".split(),
    "privacy_risk": "pii_risk k_anonymity_risk dp_epsilon_risk".split(),
}
SOURCES = {"curriculum_alignment": "learning_objectives", "concept_coverage": "course_content"}


def rows() -> list[tuple[str, str, int, str | None, int, str | None]]:
    """(aspect, dimension, dimension's place, metric, metric's place, reference source); dimensions without metrics too."""
    out = []
    for aspect, dims in TAXONOMY.items():
        for i, d in enumerate(dims, 1):
            for j, m in enumerate(METRICS.get(d, [None]), 1):
                out.append((aspect, d, i, m, j, SOURCES.get(d)))
    return out


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "aspect string, dimension string, dimension_no int, metric string, metric_no int, references string")


def place(dimension: Column, metric: Column) -> Column:
    """The metric's place in its dimension; unknown ones come last."""
    known = F.create_map(*[F.lit(x) for d, ms in METRICS.items() for j, m in enumerate(ms, 1) for x in (f"{d}/{m}", j)])
    return F.coalesce(F.try_element_at(known, F.concat(dimension, F.lit("/"), metric)), F.lit(999))


def dimension_place(dimension: Column) -> Column:
    known = F.create_map(*[F.lit(x) for ds in TAXONOMY.values() for i, d in enumerate(ds, 1) for x in (d, i)])
    return F.coalesce(F.try_element_at(known, dimension), F.lit(999))


def aspect_place(aspect: Column) -> Column:
    known = F.create_map(*[F.lit(x) for i, a in enumerate(TAXONOMY, 1) for x in (a, i)])
    return F.coalesce(F.try_element_at(known, aspect), F.lit(999))
