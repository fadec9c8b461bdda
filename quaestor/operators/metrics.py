"""Text metrics as columns: a registry of specs, evaluated in one projection and turned to long rows.

Every metric follows one contract: blank text scores 0 and is flagged; otherwise ``flagged`` is score < ``flag_below``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor import lexicons as L
from quaestor.functions.text import alpha_words, count_in, ngrams, ratio, sentence_parts, strip, txt, word_runs, ws_tokens

def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the shared token views once; every metric reads these."""
    t = F.col(text)
    x = df.withColumns({"_t": txt(t), "_strip": strip(t), "_w": alpha_words(t), "_wr": word_runs(t), "_tok": ws_tokens(t), "_parts": sentence_parts(t)})
    long_parts = F.filter("_parts", lambda p: F.size(F.regexp_extract_all(p, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) > 2)
    x = x.withColumns(
        {
            "_syl": F.transform("_w", lambda w: F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(w, "e+$", ""), F.lit("[aeiou]+")))),
            "_low": F.lower("_t"),
            "_n": F.size("_w"),
            "_words": F.size(F.filter("_tok", lambda x: x.rlike(r"[\p{L}\p{N}]"))),
            "_sents": F.greatest(F.lit(1), F.size(long_parts)),
        }
    )
    return x.withColumns({"_nsyl": F.aggregate("_syl", F.lit(0), lambda p, q: p + q), "_poly": F.size(F.filter("_syl", lambda y: y >= 3))})


@dataclass(frozen=True)
class MetricSpec:
    """``score`` builds the score column from the token views; ``never_flag`` marks rows that stay unflagged."""

    name: str
    aspect: str
    dimension: str
    flag_below: float
    score: Callable[[], Column]
    never_flag: Callable[[], Column] | None = None
    needs: tuple[str, ...] = ()


REGISTRY: dict[str, MetricSpec] = {}
# Metrics that stand on word lists and patterns in place of a tagger; their rationale says so.
BY_RULES = ("conjunction_rate", "pronoun_ratio", "has_verb", "multipart_question", "pii_risk", "k_anonymity_risk", "dp_epsilon_risk")


def metric(name: str, dimension: str, flag_below: float, never_flag=None, needs: tuple[str, ...] = ()):
    aspect = next(a for a, ds in L.TAXONOMY.items() if dimension in ds)

    def deco(f: Callable[[], Column]):
        REGISTRY[name] = MetricSpec(name, aspect, dimension, flag_below, f, never_flag, needs)
        return f

    return deco


def _c(name: str) -> Column:
    return F.col(name)


def _n() -> Column:
    return F.col("_n")


def down(x: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - x)


def capped(x: Column, top: float) -> Column:
    return F.least(F.lit(1.0), x / top)


# readability: counts -------------------------------------------------------------------------------------------------
@metric("word_count", "readability", 0.1)
def word_count(max_words: float = 50.0):
    return capped(_n(), max_words)


@metric("sentence_count", "readability", 0.0)
def sentence_count(max_sentences: float = 5.0):
    return capped(F.greatest(F.lit(1), F.size("_parts")), max_sentences)


@metric("avg_word_length", "readability", 0.3)
def avg_word_length(max_avg_chars: float = 10.0):
    return down(ratio(F.length(F.array_join("_w", "")), _n()) / max_avg_chars)


@metric("avg_syllables", "readability", 0.3)
def avg_syllables(max_avg_syllables: float = 4.0):
    return down(ratio(_c("_nsyl"), _n()) / max_avg_syllables)


@metric("long_word_ratio", "readability", 0.5)
def long_word_ratio(long_threshold: int = 6):
    return 1 - ratio(F.size(F.filter("_w", lambda w: F.length(w) > long_threshold)), _n())


@metric("type_token_ratio", "readability", 0.4)
def type_token_ratio():
    return ratio(F.size(F.array_distinct("_w")), _n())


# readability: grade formulas -----------------------------------------------------------------------------------------
def _words() -> Column:
    return F.col("_words")


def _sentences() -> Column:
    """Parts of more than two words, at least one."""
    return F.col("_sents")


def _poly() -> Column:
    return F.col("_poly")


def _grade(raw: Column, top: float) -> Column:
    return down(F.greatest(F.lit(0.0), raw) / top)


@metric("flesch_ease", "readability", 0.3)
def flesch_ease():
    raw = 206.835 - 1.015 * ratio(_words(), _sentences()) - 84.6 * ratio(_c("_nsyl"), _words())
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw / 100.0))


@metric("flesch_kincaid", "readability", 0.2)
def flesch_kincaid(max_grade: float = 18.0):
    return _grade(0.39 * ratio(_words(), _sentences()) + 11.8 * ratio(_c("_nsyl"), _words()) - 15.59, max_grade)


@metric("gunning_fog", "readability", 0.2)
def gunning_fog(max_grade: float = 20.0):
    return _grade(0.4 * (ratio(_words(), _sentences()) + 100.0 * ratio(_poly(), _words())), max_grade)


@metric("coleman_liau", "readability", 0.2)
def coleman_liau(max_grade: float = 18.0):
    letters = F.length(F.regexp_replace("_t", r"[^\p{L}\p{N}]+", ""))
    return _grade(0.058 * (100.0 * ratio(letters, _words())) - 0.296 * (100.0 * ratio(_sentences(), _words())) - 15.8, max_grade)


@metric("ari", "readability", 0.2)
def ari(max_grade: float = 18.0):
    chars = F.length(F.regexp_replace("_t", r"[\s\p{Z}]+", ""))
    return _grade(4.71 * ratio(chars, F.size("_tok")) + 0.5 * ratio(_words(), _sentences()) - 21.43, max_grade)


@metric("smog", "readability", 0.2)
def smog(max_grade: float = 18.0):
    raw = F.when(_sentences() < 3, 0.0).otherwise(1.043 * F.sqrt(30.0 * ratio(_poly(), _sentences())) + 3.1291)
    return _grade(raw, max_grade)


@metric("linsear_write", "readability", 0.2)
def linsear_write(max_grade: float = 18.0):
    head = F.slice("_syl", 1, 100)
    r = ratio(F.size(F.filter(head, lambda y: y < 3)) + 3 * F.size(F.filter(head, lambda y: y >= 3)), _sentences())
    return _grade(F.when(r > 20, r / 2).otherwise((r - 2) / 2), max_grade)


# linguistic complexity, ambiguity, form ------------------------------------------------------------------------------
@metric("conjunction_rate", "linguistic_complexity", 0.3)
def conjunction_rate(max_rate: float = 0.3):
    """By lexicon (`rules` annotator): coordinators and subordinators; an approximation of the tagged count."""
    return down(ratio(count_in(_c("_w"), sorted({*L.CONJUNCTION_SUBORDINATORS, *L.COORDINATORS})), _n()) / max_rate)


@metric("wh_word_type", "ambiguity", 0.3)
def wh_word_type():
    found = F.array_distinct(F.filter("_wr", lambda w: w.isin(*L.WH_SCORES)))
    worth = F.transform(found, lambda w: F.when(w.isin("who", "where", "when", "which"), 1.0).when(w == "what", 0.7).otherwise(0.4))
    return F.when(F.size(found) == 0, 0.2).otherwise(F.array_max(worth) / F.when(F.size(found) > 1, 2.0).otherwise(1.0))


@metric("pronoun_ratio", "ambiguity", 0.5)
def pronoun_ratio():
    """By lexicon (`rules` annotator): personal and possessive pronouns."""
    return 1 - ratio(count_in(_c("_w"), L.PRONOUNS), _n())


@metric("quantifier_rate", "ambiguity", 0.5)
def quantifier_rate(max_rate: float = 0.3):
    return down(ratio(count_in(_c("_w"), L.QUANTIFIERS), _n()) / max_rate)


@metric("question_mark", "well_formedness", 0.5)
def question_mark():
    return F.when(F.endswith(_c("_strip"), F.lit("?")), 1.0).otherwise(0.0)


@metric("negation_rate", "well_formedness", 0.5)
def negation_rate(max_count: float = 2.0):
    return down((F.regexp_count(F.col("_low"), F.lit(r"n't\b")) + count_in(_c("_w"), L.NEGATIONS)) / max_count)


@metric("has_verb", "well_formedness", 0.5)
def has_verb():
    """By lexicon and ending (`rules` annotator): auxiliaries, modals, demand verbs, and -ed, -ing, -ise forms."""
    verbs = sorted({*L.OPEN_AUX, *L.levels(L.BLOOM), "be", "been", "am", "may", "might", "must", "shall", "find", "prove", "take"})
    return F.when(F.exists("_w", lambda w: w.isin(*verbs) | w.rlike("^[a-z]{3,}(ed|ing|ise|ize|ifies|izes)$")), 1.0).otherwise(0.0)


# diversity -----------------------------------------------------------------------------------------------------------
def distinct_n(n: int) -> Column:
    g = ngrams(_c("_w"), n)
    return ratio(F.size(F.array_distinct(g)), F.size(g))


@metric("distinct_1", "diversity", 0.5)
def distinct_1():
    return distinct_n(1)


@metric("distinct_2", "diversity", 0.5)
def distinct_2():
    return distinct_n(2)


# cognitive demand ----------------------------------------------------------------------------------------------------
def best_level(words: Column, groups: dict[int, str]) -> Column:
    """The highest level of any word, 0 for none."""
    by: dict[int, list[str]] = {}
    for w, k in L.levels(groups).items():
        by.setdefault(k, []).append(w)
    def among(names: list[str]) -> Column:
        return F.exists(words, lambda w: w.isin(*sorted(names)))

    out = F.lit(0)
    for k in sorted(by):
        out = F.when(among(by[k]), F.lit(k)).otherwise(out)
    return out


@metric("bloom_level", "cognitive_demand", 0.4)
def bloom_level():
    return F.greatest(F.lit(1), best_level(_c("_w"), L.BLOOM)) / 6.0


@metric("dok_level", "cognitive_demand", 0.35)
def dok_level():
    return F.greatest(F.lit(1), best_level(_c("_w"), L.DOK)) / 4.0


def _no_signal() -> Column:
    return count_in(_c("_w"), [*L.HOTS, *L.LOTS]) == 0


@metric("hots_keywords", "cognitive_demand", 0.3, never_flag=_no_signal)
def hots_keywords():
    h, low = count_in(_c("_w"), L.HOTS), count_in(_c("_w"), L.LOTS)
    return F.when(h + low == 0, 0.5).otherwise(ratio(h, h + low))


# response burden -----------------------------------------------------------------------------------------------------
@metric("openendedness", "response_burden", 0.3)
def openendedness():
    has = lambda words: F.exists("_wr", lambda w: w.isin(*words))
    aux = F.lower("_strip").rlike(rf"^({'|'.join(L.OPEN_AUX)})([^\p{{L}}\p{{N}}_]|$)")
    return F.when(has(L.OPEN_CREATE), 0.05).when(has(L.OPEN_ANALYSE), 0.2).when(has(L.OPEN_EXPLAIN), 0.4).when(has(L.OPEN_WH), 0.7).when(aux, 0.9).otherwise(0.7)


@metric("sqp_score", "response_burden", 0.5)
def sqp_score():
    parts = F.filter(F.split(F.col("_low"), r"\b(?:and|or)\b"), lambda p: F.size(F.regexp_extract_all(p, F.lit("[a-z]+"), F.lit(0))) >= 4)
    has = lambda words: F.exists("_w", lambda w: w.isin(*words))
    cost = lambda cond, k: F.when(cond, F.lit(L.SQP_WEIGHTS[k])).otherwise(0.0)
    penalty = cost(F.size(parts) >= 3, "double_barrel") + cost(F.col("_low").rlike("|".join(L.LEADING)), "leading") + cost(has(L.LOADED), "loaded") + cost(has(L.VAGUE), "vague")
    return down(penalty)


@metric("multipart_question", "response_burden", 0.5)
def multipart_question(max_extra: float = 2.0):
    """Question marks and part markers; the third heuristic of the definition needs a tagger and is left out."""
    marks = F.length("_t") - F.length(F.replace("_t", F.lit("?"), F.lit("")))
    parts = F.greatest(F.lit(1), marks, F.regexp_count(F.col("_low"), F.lit(L.PART_MARKER)) + 1)
    return down((parts - 1) / max_extra)


@metric("stem_complexity", "response_burden", 0.3)
def stem_complexity(max_words: float = 40.0, max_preamble: float = 20.0, max_clauses: float = 4.0):
    before = F.get(F.split(F.col("_low"), L.WH_AUX, 2), F.lit(0))
    preamble = F.size(F.regexp_extract_all(before, F.lit("[a-z]+"), F.lit(0)))
    commas = F.length("_t") - F.length(F.replace("_t", F.lit(","), F.lit("")))
    clauses = count_in(_c("_wr"), L.SUBORDINATORS) + F.greatest(F.lit(0), commas - 1)
    return down(0.4 * capped(_n(), max_words) + 0.35 * capped(preamble, max_preamble) + 0.25 * capped(clauses, max_clauses))


# privacy -------------------------------------------------------------------------------------------------------------
@metric("pii_risk", "privacy_risk", 0.7)
def pii_risk(max_density: float = 0.3):
    """The pattern layer; names and organisations need an entity annotator and count 0 without one."""
    low = F.col("_low")
    hits = F.regexp_count("_t", F.lit(L.EMAIL)) + F.regexp_count("_t", F.lit(L.PHONE)) + F.regexp_count("_t", F.lit(L.SSN)) + F.regexp_count(low, F.lit(L.IDENT))
    return down(hits / F.greatest(F.lit(1), _n()) / max_density)


def _any_word(words: list[str]) -> Column:
    return F.exists("_w", lambda w: w.isin(*words))


@metric("k_anonymity_risk", "privacy_risk", 0.5)
def k_anonymity_risk(k: float = 5.0, population: float = 10000.0):
    one = lambda c: F.when(c, 1).otherwise(0)
    attributes = one(F.col("_low").rlike(L.AGE)) + one(_any_word(L.GENDER_K)) + one(_any_word(L.MEDICAL_K))
    return F.least(F.lit(1.0), F.greatest(F.lit(1.0), population / F.pow(F.lit(2.0), attributes)) / k)


@metric("dp_epsilon_risk", "privacy_risk", 0.5)
def dp_epsilon_risk(max_epsilon: float = 20.0):
    bits = lambda c, k: F.when(c, L.DP_BITS[k]).otherwise(0.0)
    eps = bits(F.col("_low").rlike(L.AGE), "age_specific") + bits(_any_word(L.GENDER_DP), "gender") + bits(_any_word(L.MEDICAL_DP), "medical_condition")
    return down(eps / max_epsilon)


# metrics that a caller's lexicon enables -----------------------------------------------------------------------------
def zipf_word_frequency(df: DataFrame, lexicon: DataFrame, key: str = "question_id", text: str = "text", max_zipf: float = 7.0) -> DataFrame:
    """(key, score, flagged): mean Zipf value of the content words (all words where there are none), unknown words 0.

    ``lexicon`` is (word, zipf); Spark broadcasts it only when it is small."""
    x = df.select(F.col(key), alpha_words(F.col(text)).alias("w"), (strip(F.col(text)) == "").alias("blank"))
    content = F.filter("w", lambda w: ~w.isin(*L.ZIPF_STOP))
    words = x.select(key, F.explode_outer(F.when(F.size(content) > 0, content).otherwise(F.col("w"))).alias("word"), "blank")
    lex = lexicon.groupBy("word").agg(F.max("zipf").alias("zipf"))
    mean = words.join(lex, "word", "left").groupBy(key, "blank").agg(F.avg(F.when(F.col("word").isNotNull(), F.coalesce("zipf", F.lit(0.0)))).alias("raw"))
    score = F.when(F.col("blank"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("raw", F.lit(0.0)) / max_zipf)))
    return mean.select(key, score.alias("score"), (score < 0.4).alias("flagged"))


def difficult_word_grade(df: DataFrame, easy: DataFrame, kind: str, key: str = "question_id", text: str = "text") -> DataFrame:
    """(key, score): ``dale_chall`` or ``spache`` with a caller's easy-word table (word); absent without one."""
    x = with_tokens(df.select(key, text), text).select(key, _words().alias("words"), _sentences().alias("sentences"), F.explode_outer("_w").alias("word"))
    known = easy.select("word").distinct().withColumn("easy", F.lit(1))
    g = x.join(known, "word", "left").groupBy(key, "words", "sentences").agg(F.count(F.when(F.col("word").isNotNull() & F.col("easy").isNull(), 1)).alias("hard"))
    pct, per = 100.0 * ratio(F.col("hard"), F.col("words")), ratio(F.col("words"), F.col("sentences"))
    if kind == "dale_chall":
        raw = 0.1579 * pct + 0.0496 * per + F.when(pct > 5, 3.6365).otherwise(0.0)
        return g.select(key, down(F.greatest(F.lit(0.0), raw) / 10.0).alias("score"))
    return g.select(key, F.greatest(F.lit(0.0), 1 - (0.141 * per + 0.086 * pct + 0.839) / 6.0).alias("score"))


# evaluation ----------------------------------------------------------------------------------------------------------
def score_columns(spec: MetricSpec) -> Column:
    """struct(score, flagged) of one metric under the shared contract."""
    s = F.when(F.col("_strip") == "", F.lit(0.0)).otherwise(spec.score())
    return s


def evaluate_wide(df: DataFrame, names: list[str] | None = None, text: str = "text") -> DataFrame:
    """``df`` with one score column per metric; ``names`` None or empty means all."""
    specs = [REGISTRY[n] for n in (names or list(REGISTRY))]
    keep = list(df.columns)
    x = with_tokens(df, text)
    extra = [f.never_flag().alias(f"_nf_{f.name}") for f in specs if f.never_flag]
    return x.select(*[F.col(f"`{c}`") for c in keep], F.col("_strip"), *[score_columns(s).alias(s.name) for s in specs], *extra)


def evaluate(df: DataFrame, key: str, names: list[str] | None = None, text: str = "text", aspects: list[str] | None = None) -> DataFrame:
    """Long rows (question_id, aspect, dimension, metric, score, flagged, rationale). ``aspects`` None or empty means all."""
    specs = [REGISTRY[n] for n in (names or list(REGISTRY)) if not aspects or REGISTRY[n].aspect in aspects]
    wide = evaluate_wide(df.select(F.col(key).alias("question_id"), F.col(text).alias("text")), [s.name for s in specs], "text")
    rows = []
    for s in specs:
        flag = (F.col("_strip") == "") | (F.col(s.name) < s.flag_below)
        if s.never_flag:
            flag = (F.col("_strip") == "") | ((F.col(s.name) < s.flag_below) & ~F.col(f"_nf_{s.name}"))
        rows.append(F.struct(F.lit(s.aspect).alias("aspect"), F.lit(s.dimension).alias("dimension"), F.lit(s.name).alias("metric"), F.col(s.name).alias("score"), flag.alias("flagged")))
    long = wide.select("question_id", "_strip", F.explode(F.array(*rows)).alias("m")).select("question_id", "_strip", "m.*")
    said = F.format_string("%s score=%.4f", "metric", "score")
    band = F.when(F.col("score") >= 0.6, "good").when(F.col("score") >= 0.3, "moderate").otherwise("poor")
    said = F.when(F.col("dimension") == "readability", F.concat(said, F.lit(" ("), band, F.lit(")"))).when(F.col("metric").isin(*BY_RULES), F.concat(said, F.lit(" [rules]"))).otherwise(said)
    why = F.when(F.col("_strip") == "", "Question text is empty.").otherwise(said)
    return long.withColumn("rationale", why).drop("_strip")
