"""One query per text metric over all of questions_raw, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor import lexicons as L
from quaestor.operators import metrics as M
from quaestor.plans.core import query, r6, s6
from quaestor.runtime import table

TOKENS = r"""
WITH t0 AS (
  SELECT q_id AS question_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s FROM questions_raw
), t1 AS (
  SELECT *, lower(t) AS low, regexp_extract_all(lower(t), '[a-z]+') AS w, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS wr,
    list_filter(regexp_split_to_array(t, '[\s\p{Z}]+'), lambda x: x <> '') AS tok,
    list_filter(regexp_split_to_array(trim(t), '[.!?]+'), lambda x: trim(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g')) <> '') AS parts FROM t0
), t2 AS (
  SELECT *, len(w) AS n, list_transform(w, lambda x: greatest(1, len(regexp_extract_all(regexp_replace(x, 'e+$', ''), '[aeiou]+')))) AS syl,
    len(list_filter(tok, lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) AS words,
    greatest(1, len(list_filter(parts, lambda p: len(regexp_extract_all(p, '[\p{L}\p{N}]+')) > 2))) AS sents FROM t1
), q AS (
  SELECT *, coalesce(list_sum(syl), 0) AS nsyl, len(list_filter(syl, lambda y: y >= 3)) AS poly FROM t2
)"""


def _in(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def _count(words, arr: str = "w") -> str:
    return f"len(list_filter({arr}, lambda x: x IN {_in(words)}))"


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def _down(x: str) -> str:
    return f"greatest(0.0, 1 - ({x}))"


def _grade(raw: str, top: float) -> str:
    return _down(f"greatest(0.0, {raw}) / {top}")


def _level(groups: dict[int, str]) -> str:
    by: dict[int, list[str]] = {}
    for w, k in L.levels(groups).items():
        by.setdefault(k, []).append(w)
    return "CASE " + " ".join(f"WHEN {_count(by[k])} > 0 THEN {k}" for k in sorted(by, reverse=True)) + " ELSE 1 END"


def _rx(p: str) -> str:
    return p.replace("'", "''")


_hots, _lots = _count(L.HOTS), _count(L.LOTS)
_verbs = sorted({*L.OPEN_AUX, *L.levels(L.BLOOM), "be", "been", "am", "may", "might", "must", "shall", "find", "prove", "take"})
_w = lambda k: str(L.SQP_WEIGHTS[k])
_pos = f"len(regexp_extract_all(split_part(regexp_replace(low, '{L.WH_AUX}', chr(1)), chr(1), 1), '[a-z]+'))"
_commas = "(length(t) - length(replace(t, ',', '')))"

SCORES = {
    "word_count": "least(1.0, n / 50.0)",
    "sentence_count": "least(1.0, greatest(1, len(parts)) / 5.0)",
    "avg_word_length": _down(_div("length(array_to_string(w, ''))", "n") + " / 10.0"),
    "avg_syllables": _down(_div("nsyl", "n") + " / 4.0"),
    "long_word_ratio": "1 - " + _div("len(list_filter(w, lambda x: length(x) > 6))", "n"),
    "type_token_ratio": _div("len(list_distinct(w))", "n"),
    "flesch_ease": f"least(1.0, greatest(0.0, (206.835 - 1.015 * {_div('words', 'sents')} - 84.6 * {_div('nsyl', 'words')}) / 100.0))",
    "flesch_kincaid": _grade(f"0.39 * {_div('words', 'sents')} + 11.8 * {_div('nsyl', 'words')} - 15.59", 18.0),
    "gunning_fog": _grade(f"0.4 * ({_div('words', 'sents')} + 100.0 * {_div('poly', 'words')})", 20.0),
    "coleman_liau": _grade(r"0.058 * (100.0 * " + _div(r"length(regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g'))", "words") + f") - 0.296 * (100.0 * {_div('sents', 'words')}) - 15.8", 18.0),
    "ari": _grade(r"4.71 * " + _div(r"length(regexp_replace(t, '[\s\p{Z}]+', '', 'g'))", "len(tok)") + f" + 0.5 * {_div('words', 'sents')} - 21.43", 18.0),
    "smog": _grade(f"CASE WHEN sents < 3 THEN 0.0 ELSE 1.043 * sqrt(30.0 * {_div('poly', 'sents')}) + 3.1291 END", 18.0),
    "linsear_write": "(SELECT " + _grade("CASE WHEN r > 20 THEN r / 2 ELSE (r - 2) / 2 END", 18.0) + " FROM (SELECT " + _div("len(list_filter(syl[1:100], lambda y: y < 3)) + 3 * len(list_filter(syl[1:100], lambda y: y >= 3))", "sents") + " AS r))",
    "conjunction_rate": _down(_div(_count(sorted({*L.CONJUNCTION_SUBORDINATORS, *L.COORDINATORS})), "n") + " / 0.3"),
    "wh_word_type": "CASE WHEN {f} = 0 THEN 0.2 ELSE (CASE WHEN {a} > 0 THEN 1.0 WHEN {b} > 0 THEN 0.7 ELSE 0.4 END) / (CASE WHEN {f} > 1 THEN 2.0 ELSE 1.0 END) END".format(
        f=f"len(list_distinct(list_filter(wr, lambda x: x IN {_in(L.WH_SCORES)})))", a=_count(["who", "where", "when", "which"], "wr"), b=_count(["what"], "wr")
    ),
    "pronoun_ratio": "1 - " + _div(_count(L.PRONOUNS), "n"),
    "quantifier_rate": _down(_div(_count(L.QUANTIFIERS), "n") + " / 0.3"),
    "question_mark": "CASE WHEN suffix(s, '?') THEN 1.0 ELSE 0.0 END",
    "negation_rate": _down(f"(len(regexp_extract_all(low, 'n''t\\b')) + {_count(L.NEGATIONS)}) / 2.0"),
    "has_verb": f"CASE WHEN len(list_filter(w, lambda x: x IN {_in(_verbs)} OR regexp_matches(x, '^[a-z]{{3,}}(ed|ing|ise|ize|ifies|izes)$'))) > 0 THEN 1.0 ELSE 0.0 END",
    "distinct_1": _div("len(list_distinct(w))", "n"),
    "distinct_2": _div("len(list_distinct(list_transform(range(1, n), lambda i: w[i] || ' ' || w[i + 1])))", "greatest(0, n - 1)"),
    "bloom_level": f"({_level(L.BLOOM)}) / 6.0",
    "dok_level": f"({_level(L.DOK)}) / 4.0",
    "hots_keywords": f"CASE WHEN {_hots} + {_lots} = 0 THEN 0.5 ELSE {_div(_hots, f'{_hots} + {_lots}')} END",
    "openendedness": f"CASE WHEN {_count(L.OPEN_CREATE, 'wr')} > 0 THEN 0.05 WHEN {_count(L.OPEN_ANALYSE, 'wr')} > 0 THEN 0.2 WHEN {_count(L.OPEN_EXPLAIN, 'wr')} > 0 THEN 0.4 "
    f"WHEN {_count(L.OPEN_WH, 'wr')} > 0 THEN 0.7 WHEN regexp_matches(lower(s), '^({'|'.join(L.OPEN_AUX)})([^\\p{{L}}\\p{{N}}_]|$)') THEN 0.9 ELSE 0.7 END",
    "sqp_score": _down(
        f"(CASE WHEN len(list_filter(regexp_split_to_array(low, '\\b(?:and|or)\\b'), lambda p: len(regexp_extract_all(p, '[a-z]+')) >= 4)) >= 3 THEN {_w('double_barrel')} ELSE 0.0 END"
        f" + CASE WHEN regexp_matches(low, '{_rx('|'.join(L.LEADING))}') THEN {_w('leading')} ELSE 0.0 END"
        f" + CASE WHEN {_count(L.LOADED)} > 0 THEN {_w('loaded')} ELSE 0.0 END + CASE WHEN {_count(L.VAGUE)} > 0 THEN {_w('vague')} ELSE 0.0 END)"
    ),
    "multipart_question": _down(f"(greatest(1, length(t) - length(replace(t, '?', '')), len(regexp_extract_all(low, '{L.PART_MARKER}')) + 1) - 1) / 2.0"),
    "stem_complexity": _down(f"0.4 * least(1.0, n / 40.0) + 0.35 * least(1.0, {_pos} / 20.0) + 0.25 * least(1.0, ({_count(L.SUBORDINATORS, 'wr')} + greatest(0, {_commas} - 1)) / 4.0)"),
    "pii_risk": _down(f"(len(regexp_extract_all(t, '{L.EMAIL}')) + len(regexp_extract_all(t, '{L.PHONE}')) + len(regexp_extract_all(t, '{L.SSN}')) + len(regexp_extract_all(low, '{L.IDENT}'))) / CAST(greatest(1, n) AS DOUBLE) / 0.3"),
    "k_anonymity_risk": f"least(1.0, greatest(1.0, 10000.0 / pow(2.0, CAST(regexp_matches(low, '{L.AGE}') AS INT) + CAST({_count(L.GENDER_K)} > 0 AS INT) + CAST({_count(L.MEDICAL_K)} > 0 AS INT))) / 5.0)",
    "dp_epsilon_risk": _down(f"(7.0 * CAST(regexp_matches(low, '{L.AGE}') AS INT) + 1.0 * CAST({_count(L.GENDER_DP)} > 0 AS INT) + 7.0 * CAST({_count(L.MEDICAL_DP)} > 0 AS INT)) / 20.0"),
}


def _sql(name: str) -> str:
    spec, score = M.REGISTRY[name], SCORES[name]
    never = f"({_hots} + {_lots} = 0)" if spec.never_flag else "false"
    return f"""{TOKENS}
SELECT question_id, {s6("score")} AS score, blank OR (score < {spec.flag_below} AND NOT never) AS flagged
FROM (SELECT question_id, s = '' AS blank, CASE WHEN s = '' THEN 0.0 ELSE CAST({score} AS DOUBLE) END AS score, {never} AS never FROM q)"""


def _run(name: str):
    def f(spark: SparkSession, sf: str) -> DataFrame:
        out = M.evaluate(table(spark, sf, "questions_raw").select("q_id", "text"), "q_id", [name])
        return out.select("question_id", r6("score").alias("score"), "flagged")

    f.__doc__ = f"The metric `{name}` for every row of questions_raw."
    return f


for _name in SCORES:
    query(_sql(_name), _name)(_run(_name))


@query(
    TOKENS
    + ", m AS ("
    + " UNION ALL ".join(f"SELECT question_id, '{M.REGISTRY[k].dimension}' AS dimension, CASE WHEN s = '' THEN 0.0 ELSE CAST({SCORES[k]} AS DOUBLE) END AS score FROM q" for k in ("word_count", "sentence_count", "avg_word_length", "long_word_ratio", "type_token_ratio", "distinct_2"))
    + f") SELECT question_id, dimension, {s6('avg(score)')} AS score FROM m GROUP BY question_id, dimension"
)
def aggregate_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: six metrics per question, long rows, mean per dimension (rows with one id count together)."""
    names = ["word_count", "sentence_count", "avg_word_length", "long_word_ratio", "type_token_ratio", "distinct_2"]
    long = M.evaluate(table(spark, sf, "questions_raw").select("q_id", "text"), "q_id", names)
    return long.groupBy("question_id", "dimension").agg(r6(F.avg("score")).alias("score"))


@query(
    " UNION ALL ".join(f"SELECT question_id, '{M.REGISTRY[k].aspect}' AS aspect, '{M.REGISTRY[k].dimension}' AS dimension, '{k}' AS metric, score, flagged FROM ({_sql(k)})" for k in M.REGISTRY if k in SCORES)
    if set(M.REGISTRY) <= set(SCORES)
    else None
)
def evaluate_all(spark: SparkSession, sf: str) -> DataFrame:
    """All registered metrics of every question in one projection, as long rows with flags."""
    return M.evaluate(table(spark, sf, "questions_raw").select("q_id", "text"), "q_id").select("question_id", "aspect", "dimension", "metric", r6("score").alias("score"), "flagged")


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{d}', {str(d in L.CRITICAL).lower()})" for a, ds in L.TAXONOMY.items() for d in ds)
    + ") AS v(aspect, dimension, critical)"
)
def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed table of aspects and dimensions."""
    return spark.createDataFrame([(a, d, d in L.CRITICAL) for a, ds in L.TAXONOMY.items() for d in ds], "aspect string, dimension string, critical boolean")


@query(
    TOKENS
    + ", z AS (SELECT term, least(8.0, greatest(0.0, log10(c * 1e9 / sum(c) OVER ()))) AS zipf FROM (SELECT term, count(*) AS c FROM (SELECT unnest(w) AS term FROM q) GROUP BY term)), "
    + f"k AS (SELECT row_number() OVER () AS rid, question_id, s, CASE WHEN len(list_filter(w, lambda x: x NOT IN {_in(L.ZIPF_STOP)})) > 0 THEN list_filter(w, lambda x: x NOT IN {_in(L.ZIPF_STOP)}) ELSE w END AS c FROM (SELECT DISTINCT question_id, s, w FROM q)), "
    + "e AS (SELECT rid, avg(coalesce(zipf, 0)) AS raw FROM (SELECT rid, unnest(c) AS term FROM k) LEFT JOIN z USING (term) GROUP BY rid) "
    + f"SELECT question_id, {s6("CASE WHEN s = '' THEN 0.0 ELSE least(1.0, greatest(0.0, coalesce(raw, 0) / 7.0)) END")} AS score FROM k LEFT JOIN e USING (rid)"
)
def zipf_word_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Mean Zipf value per question; the lexicon is counted from all questions, as no published list is at hand."""
    q = table(spark, sf, "questions_raw").select("q_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = q.select(F.explode(M.alpha_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    lex = counts.join(F.broadcast(counts.agg(F.sum("c").alias("total"))), F.lit(True))  # the other side is one row
    lex = lex.select("word", F.least(F.lit(8.0), F.greatest(F.lit(0.0), F.log10(F.col("c") * 1e9 / F.col("total")))).alias("zipf"))
    keyed = q.distinct().withColumn("key", F.struct("q_id", F.xxhash64("text")))
    return M.zipf_word_frequency(keyed, lex, "key", "text").select(F.col("key.q_id").alias("question_id"), r6("score").alias("score"))
