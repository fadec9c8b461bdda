"""Metrics over annotated tokens, and the interface for model back ends.

Annotation is a column ``tokens ARRAY<STRUCT<text, pos, tag, dep, head INT, number, ent>>`` (``head`` is the index of the
head token, its own index at the root) that a caller's parser provides. Without one these metrics are absent, not null.
A model back end provides a raw value per row; what turns it into a score is here. None ships with this package.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaestor import lexicons as L
from quaestor.functions.text import ratio

# Dependency labels that open a clause.
CLAUSE_ROOTS = ["ROOT", "ccomp", "xcomp", "advcl", "relcl", "acl", "csubj", "conj"]
CLAUSAL = ["ccomp", "xcomp", "advcl", "relcl", "acl", "csubj"]


def _down(x: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - x)


def _alpha(t: Column) -> Column:
    return F.filter(t, lambda x: x["text"].rlike(r"^\p{L}+$"))


def _tagged(t: Column, prefixes: list[str]) -> Column:
    return F.filter(t, lambda x: x["tag"].rlike("^(" + "|".join(prefixes) + ")"))


def lexical_density(t: Column) -> Column:
    return ratio(F.size(_tagged(_alpha(t), ["NN", "VB", "JJ", "RB"])), F.size(_alpha(t)))


def pronoun_ratio(t: Column) -> Column:
    return 1 - ratio(F.size(F.filter(t, lambda x: x["tag"].isin("PRP", "PRP$"))), F.size(_alpha(t)))


def has_verb(t: Column) -> Column:
    return F.when(F.size(_tagged(t, ["VB", "MD"])) > 0, 1.0).otherwise(0.0)


def conjunction_rate(t: Column, subordinators: list[str], max_rate: float = 0.3) -> Column:
    hits = F.filter(_alpha(t), lambda x: (x["tag"] == "CC") | ((x["tag"] == "IN") & F.lower(x["text"]).isin(*subordinators)))
    return _down(ratio(F.size(hits), F.size(_alpha(t))) / max_rate)


def parts_by_conjunction(t: Column) -> Column:
    """1 + the coordinating conjunctions that follow a verb (VB, VBP, VBZ), each verb used once."""

    def step(s: Column, x: Column) -> Column:
        verb, hit = x["tag"].isin("VB", "VBP", "VBZ"), (x["tag"] == "CC") & s["seen"]
        return F.struct((verb | (s["seen"] & ~hit)).alias("seen"), (s["n"] + F.when(hit, 1).otherwise(0)).alias("n"))

    return F.aggregate(t, F.struct(F.lit(False).alias("seen"), F.lit(1).alias("n")), step)["n"]


def multipart_question(t: Column, text: Column, max_extra: float = 2.0) -> Column:
    """All three heuristics: question marks, part markers, conjunctions after a verb."""
    marks = F.regexp_count(text, F.lit(r"\?"))
    parts = F.greatest(F.lit(1), marks, F.regexp_count(F.lower(text), F.lit(L.PART_MARKER)) + 1, parts_by_conjunction(t))
    return _down((parts - 1) / max_extra)


def heads(t: Column) -> Column:
    """Index of each token's head. Make it a column of its own before ``parse_tree_depth``, which looks into it often."""
    return F.transform(t, lambda x: x["head"])


def _doublings(t: Column) -> Column:
    """As many steps as reach every ancestor when each step looks twice as far: the logarithm of the number of tokens."""
    return F.sequence(F.lit(1), F.ceil(F.log2(F.size(t) + 2.0)).cast("int"))


def depths(head: Column) -> Column:
    """Edges to the root per token. All tokens look up at once, each step twice as far as the one before."""
    start = F.struct(head.alias("at"), F.transform(head, lambda h, i: F.when(h == i, 0).otherwise(1)).alias("d"))

    def step(s: Column, _: Column) -> Column:
        d = F.zip_with(s["d"], s["at"], lambda x, a: x + F.get(s["d"], a))
        return F.struct(F.transform(s["at"], lambda a: F.get(s["at"], a)).alias("at"), d.alias("d"))

    return F.aggregate(_doublings(head), start, step)["d"]


def parse_tree_depth(head: Column, max_depth: float = 10.0) -> Column:
    return _down(F.coalesce(F.array_max(depths(head)), F.lit(0)) / max_depth)


def dependency_distance(t: Column, max_dist: float = 8.0) -> Column:
    far = F.filter(F.transform(t, lambda x, i: F.abs(x["head"] - i)), lambda d: d > 0)
    return _down(ratio(F.aggregate(far, F.lit(0), lambda a, b: a + b), F.size(far)) / max_dist)


def constituent_count(t: Column, noun_chunks: Column, most: float = 6.0) -> Column:
    clauses = F.filter(t, lambda x: x["dep"].isin(*CLAUSE_ROOTS) & x["pos"].isin("VERB", "AUX"))
    return _down((noun_chunks + F.size(clauses)) / most)


def passive_voice_rate(t: Column, most: float = 1.0) -> Column:
    return _down(F.size(F.filter(t, lambda x: x["dep"].isin("nsubjpass", "auxpass"))) / most)


def negation_ambiguity(t: Column, most: float = 1.4) -> Column:
    """0.3 per negation, 0.7 where something above the negated token's head is clausal; the head itself is not tested."""
    head = F.transform(t, lambda x: x["head"])
    above = F.transform(t, lambda x, i: (x["head"] != i) & F.get(t, x["head"])["dep"].isin(*CLAUSAL))

    def step(s: Column, _: Column) -> Column:
        hit = F.zip_with(s["hit"], s["at"], lambda h, a: h | F.get(s["hit"], a))
        return F.struct(F.transform(s["at"], lambda a: F.get(s["at"], a)).alias("at"), hit.alias("hit"))

    hit = F.aggregate(_doublings(t), F.struct(head.alias("at"), above.alias("hit")), step)["hit"]
    any_neg = F.exists(t, lambda x: x["dep"] == "neg")
    found = F.transform(F.array(F.when(any_neg, hit)), lambda h: F.aggregate(F.transform(t, lambda x: F.when(x["dep"] == "neg", F.when(F.get(h, x["head"]), 0.7).otherwise(0.3)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)).getItem(0)
    return _down(F.when(any_neg, found).otherwise(0.0) / most)



def subject_verb_agreement(t: Column) -> Column:
    """Share of subject-verb pairs that agree in number where both have one; 0.5 without such pairs."""
    pairs = F.filter(t, lambda x: x["dep"].isin("nsubj", "nsubjpass") & x["number"].isNotNull() & F.get(t, x["head"])["pos"].isin("VERB", "AUX") & F.get(t, x["head"])["number"].isNotNull())
    good = F.filter(pairs, lambda x: x["number"] == F.get(t, x["head"])["number"])
    return F.when(F.size(pairs) == 0, 0.5).otherwise(ratio(F.size(good), F.size(pairs)))


def question_type_consistency(t: Column, text_words: Column) -> Column:
    """who, where and when want a matching entity in the text; anything else is consistent."""
    wh = F.get(F.filter(text_words, lambda w: w.isin("who", "what", "where", "when", "which", "why", "how")), F.lit(0))
    has = lambda labels: F.exists(t, lambda x: x["ent"].isin(*labels))
    fit = F.when(wh == "who", has(["PERSON"])).when(wh == "where", has(["GPE", "LOC", "FAC"])).when(wh == "when", has(["DATE", "TIME"])).otherwise(True)
    return F.when(fit, 1.0).otherwise(0.5)


def polysemy_score(synsets: Column, most: float = 10.0) -> Column:
    """From the synset counts of the open-class tokens that have any."""
    known = F.filter(synsets, lambda n: n > 0)
    return _down(ratio(F.aggregate(known, F.lit(0), lambda a, b: a + b), F.size(known)) / most)


def _clip(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


# What a back end's raw value becomes; the highest over the references is taken before.
NORMALISE: dict[str, Callable[[Column], Column]] = {
    "bertscore": lambda raw: F.least(F.lit(1.0), raw),
    "bleurt": _clip,
    "bartscore": lambda raw: _clip((raw + 5.0) / 5.0),
    "comet": _clip,
    "sbert": _clip,
    "nli_entailment": _clip,
    "lm_perplexity": lambda raw: F.when(raw <= 1, 1.0).otherwise(_clip(1 - F.log(raw) / F.log(F.lit(1000.0)))),
}
FLAG_BELOW = {"bertscore": 0.5, "bleurt": 0.5, "bartscore": 0.5, "comet": 0.5, "sbert": 0.5, "nli_entailment": 0.5, "lm_perplexity": 0.3}


@dataclass(frozen=True)
class Backend:
    """``raw`` maps (text, references) columns to the raw value; usually an iterator UDF that loads its model once."""

    metric: str
    raw: Callable[[Column, Column], Column]


BACKENDS: dict[str, Backend] = {}


def register(b: Backend) -> None:
    if b.metric not in NORMALISE:
        raise ValueError(f"unknown model metric {b.metric!r}; one of {sorted(NORMALISE)}")
    BACKENDS[b.metric] = b


def available() -> list[str]:
    return sorted(BACKENDS)


def model_score(name: str, text: Column, refs: Column) -> Column:
    """The score of a registered back end; a metric without one raises here and is absent from evaluations."""
    if name not in BACKENDS:
        raise LookupError(f"no back end for {name!r} is registered")
    return NORMALISE[name](BACKENDS[name].raw(text, refs))


def entailment(logits: Column, index: int = 1) -> Column:
    """Softmax probability of one class from an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.element_at(e, index + 1) / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
