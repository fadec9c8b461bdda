"""Annotated metrics over all questions with the `rules` annotator, and grade formulas with a lexicon from the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor import lexicons as L
from quaestor.functions.text import alpha_words, is_blank, txt
from quaestor.operators import annotate as N
from quaestor.operators import metrics as M
from quaestor.operators import rules
from quaestor.operators.evaluation import ANNOTATED
from quaestor.plans.core import query, r6, s6
from quaestor.plans.metrics import TOKENS
from quaestor.runtime import table



SPECS = {**ANNOTATED, "multipart_question_annotated": (lambda: N.multipart_question(F.col("tokens"), txt(F.col("text"))), 0.5)}


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "questions_raw").select(F.col("q_id").alias("question_id"), "text")
    return rules.annotate(q).withColumn("heads", N.heads(F.col("tokens")))


def _run(name: str):
    build, below = SPECS[name]

    def f(spark: SparkSession, sf: str) -> DataFrame:
        blank = is_blank(F.col("text"))
        score = F.when(blank, 0.0).otherwise(build())
        x = annotated(spark, sf).select("question_id", blank.alias("b"), score.alias("score"))
        return x.select("question_id", r6("score").alias("score"), (F.col("b") | (F.col("score") < below)).alias("flagged"), F.lit(rules.NAME).alias("annotator"))

    f.__doc__ = f"The metric `{name}` of every question with the rules annotator (an approximation)."
    return f


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_MD = "('can', 'could', 'will', 'would', 'should', 'may', 'might', 'must', 'shall')"
_TAG = (
    f"CASE WHEN lw IN {_in(rules.DETERMINERS)} THEN 'DT' WHEN lw IN {_in(L.PRONOUNS)} THEN 'PRP' WHEN lw IN {_in(L.COORDINATORS)} THEN 'CC' WHEN lw IN {_in([*rules.PREPOSITIONS, *L.CONJUNCTION_SUBORDINATORS])} THEN 'IN' "
    f"WHEN lw IN {_in(L.WH_SCORES)} THEN 'WP' WHEN lw IN {_MD} THEN 'MD' WHEN lw IN {_in(rules.AUX)} THEN 'VBZ' WHEN lw IN {_in(rules.VERBS)} THEN 'VB' WHEN lw IN {_in(rules.ADVERBS)} OR lw ~ '[a-z]{{2,}}ly' THEN 'RB' "
    "WHEN lw ~ '[a-z]{3,}ed' THEN 'VBD' WHEN lw ~ '[a-z]{3,}ing' THEN 'VBG' WHEN lw ~ '[a-z]{2,}(ous|ful|ive|al|ic|able|ible|less|ary)' THEN 'JJ' WHEN lw ~ '[a-z]{2,}[^s]s' THEN 'NNS' ELSE 'NN' END"
).replace("lw ~ '", "regexp_full_match(lw, '").replace("' THEN 'RB'", "') THEN 'RB'").replace("' THEN 'VBD'", "') THEN 'VBD'").replace("' THEN 'VBG'", "') THEN 'VBG'").replace("' THEN 'JJ'", "') THEN 'JJ'").replace("' THEN 'NNS'", "') THEN 'NNS'")
_TOKENS = (
    r"WITH q AS (SELECT row_number() OVER () AS rid, q_id AS question_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', '', 'g') = '' AS b FROM questions_raw), "
    "w AS (SELECT rid, i - 1 AS i, lower(ws[i]) AS lw, len(ws) AS n FROM (SELECT rid, regexp_extract_all(t, '[A-Za-z]+') AS ws FROM q), unnest(range(1, len(ws) + 1)) AS u(i)), "
    f"g AS (SELECT *, {_TAG} AS tag FROM w), y AS (SELECT *, tag LIKE 'VB%' OR tag = 'MD' AS verb, tag LIKE 'NN%' OR tag LIKE 'PRP%' AS noun FROM g), "
    "r AS (SELECT rid, coalesce(min(i) FILTER (WHERE verb), 0) AS root FROM y GROUP BY rid), "
    "k AS (SELECT y.*, root, lead(tag) OVER p AS nt, lag(tag) OVER p AS pt, lag(lw) OVER p AS pw FROM y JOIN r USING (rid) WINDOW p AS (PARTITION BY rid ORDER BY i)), "
    f"tok AS (SELECT *, CASE WHEN i = root THEN 'ROOT' WHEN lw IN ('not', 'never', 'no') THEN 'neg' WHEN noun AND i < root AND (i + 1 = root OR nt LIKE 'RB%' OR nt = 'MD' OR nt LIKE 'VB%') THEN 'nsubj' WHEN lw IN {_in(rules.BE)} AND nt = 'VBD' THEN 'auxpass' "
    f"WHEN verb AND pw IN {_in(rules.BE)} THEN 'conj' WHEN verb AND pt = 'IN' THEN 'advcl' WHEN verb THEN 'conj' WHEN tag = 'DT' THEN 'det' WHEN tag = 'JJ' THEN 'amod' ELSE 'dep' END AS dep, "
    "CASE WHEN i = root THEN i WHEN tag IN ('DT', 'JJ', 'PRP$') AND i + 1 < n THEN i + 1 ELSE root END AS head, "
    "CASE WHEN tag = 'NNS' THEN 'P' WHEN tag = 'NN' THEN 'S' WHEN lw IN ('are', 'were', 'have', 'do') THEN 'P' WHEN lw IN ('is', 'was', 'has', 'does') THEN 'S' END AS num, "
    f"CASE WHEN lw IN {_in(rules.AUX)} THEN 'AUX' WHEN verb THEN 'VERB' END AS pos FROM k), "
)
# From the tokens of every question (v, one row a question that has any) to its score; e is the score without tokens.
_VALUES = {
    "lexical_density": ("SELECT rid, avg(CASE WHEN tag LIKE 'NN%' OR tag LIKE 'VB%' OR tag LIKE 'JJ%' OR tag LIKE 'RB%' THEN 1.0 ELSE 0.0 END) AS v FROM tok GROUP BY rid", "0.0"),
    "parse_tree_depth": (
        "SELECT rid, greatest(0.0, 1 - max(stop - i + CASE WHEN stop = root THEN 0 ELSE 1 END) / 10.0) AS v FROM "
        "(SELECT rid, i, root, min(CASE WHEN i = root OR head <> i + 1 THEN i END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM tok) GROUP BY rid",
        "1.0",
    ),
    "dependency_distance": ("SELECT rid, greatest(0.0, 1 - coalesce(avg(abs(head - i)) FILTER (WHERE head <> i), 0) / 8.0) AS v FROM tok GROUP BY rid", "1.0"),
    "constituent_count": (
        "SELECT rid, greatest(0.0, 1 - (count(*) FILTER (WHERE tag LIKE 'NN%' AND coalesce(pt NOT LIKE 'NN%', true)) + count(*) FILTER (WHERE dep IN ('ROOT', 'advcl', 'conj') AND pos IN ('VERB', 'AUX'))) / 6.0) AS v FROM tok GROUP BY rid",
        "1.0",
    ),
    "passive_voice_rate": ("SELECT rid, greatest(0.0, 1.0 - count(*) FILTER (WHERE dep = 'auxpass')) AS v FROM tok GROUP BY rid", "1.0"),
    # in these trees nothing clausal stands above a head, so every negation costs the same
    "negation_ambiguity": ("SELECT rid, greatest(0.0, 1 - count(*) FILTER (WHERE dep = 'neg') * 0.3 / 1.4) AS v FROM tok GROUP BY rid", "1.0"),
    "subject_verb_agreement": (
        "SELECT a.rid, coalesce(avg(CASE WHEN a.num = h.num THEN 1.0 ELSE 0.0 END) FILTER (WHERE a.dep = 'nsubj' AND a.num IS NOT NULL AND h.pos IN ('VERB', 'AUX') AND h.num IS NOT NULL), 0.5) AS v FROM tok a JOIN tok h ON h.rid = a.rid AND h.i = a.head GROUP BY a.rid",
        "0.5",
    ),
    # no entities are known, so a question that wants one is not consistent
    "question_type_consistency": (
        r"SELECT rid, CASE WHEN list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+'), lambda x: x IN ('who', 'what', 'where', 'when', 'which', 'why', 'how'))[1] IN ('who', 'where', 'when') THEN 0.5 ELSE 1.0 END AS v FROM q",
        "1.0",
    ),
    "multipart_question_annotated": (
        "SELECT q.rid, greatest(0.0, 1 - (greatest(1, length(t) - length(replace(t, '?', '')), len(regexp_extract_all(lower(t), '" + L.PART_MARKER.replace("'", "''") + "')) + 1, coalesce(hits, 0) + 1) - 1) / 2.0) AS v FROM q LEFT JOIN "
        "(SELECT rid, count(*) FILTER (WHERE tag = 'CC' AND verbs > coalesce(before, 0)) AS hits FROM (SELECT rid, tag, verbs, lag(verbs) OVER (PARTITION BY rid ORDER BY i) AS before FROM "
        "(SELECT rid, i, tag, count(*) FILTER (WHERE tag IN ('VB', 'VBP', 'VBZ')) OVER (PARTITION BY rid ORDER BY i) AS verbs FROM tok) WHERE tag = 'CC') GROUP BY rid) USING (rid)",
        "1.0",
    ),
}


def _sql(name: str) -> str:
    value, empty = _VALUES[name]
    score = f"CASE WHEN b THEN 0.0 ELSE coalesce(v, {empty}) END"
    return _TOKENS + f"s AS ({value}) SELECT question_id, {s6(score)} AS score, b OR {score} < {SPECS[name][1]} AS flagged, '{rules.NAME}' AS annotator FROM q LEFT JOIN s USING (rid)"


for _name in SPECS:
    query(_sql(_name), _name)(_run(_name))


def _easy(spark: SparkSession, sf: str) -> DataFrame:
    """Words that make up at least 1 in 2,000 of all words: a stand-in for the published easy lists."""
    c = table(spark, sf, "questions_raw").select(F.explode(alpha_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    return c.join(F.broadcast(c.agg(F.sum("c").alias("t"))), F.col("c") * 2000 >= F.col("t")).select("word")


_G = TOKENS + (
    ", c AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM q) GROUP BY 1), easy AS (SELECT word FROM c WHERE c * 2000 >= (SELECT sum(c) FROM c)), "
    "d AS (SELECT DISTINCT question_id, t, words, sents, w FROM q), k AS (SELECT row_number() OVER () AS rid, * FROM d), "
    "h AS (SELECT rid, count(*) AS hard FROM (SELECT rid, unnest(w) AS word FROM k) WHERE word NOT IN (SELECT word FROM easy) GROUP BY 1), "
    "g AS (SELECT question_id, CASE WHEN words = 0 THEN 0.0 ELSE 100.0 * coalesce(hard, 0) / words END AS pct, words * 1.0 / sents AS per FROM k LEFT JOIN h USING (rid)) "
)


def _grade(kind: str):
    def f(spark: SparkSession, sf: str) -> DataFrame:
        q = table(spark, sf, "questions_raw").select("q_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
        x = M.difficult_word_grade(q.select(F.struct("q_id", F.md5("text").alias("m")).alias("k"), "text"), _easy(spark, sf), kind, "k", "text")
        return x.select(F.col("k.q_id").alias("question_id"), r6("score").alias("score"))

    f.__doc__ = f"`{kind}` of every question with easy words counted from the corpus."
    return f


query(_G + f"SELECT question_id, {s6('greatest(0.0, 1 - greatest(0.0, 0.1579 * pct + 0.0496 * per + CASE WHEN pct > 5 THEN 3.6365 ELSE 0.0 END) / 10.0)')} AS score FROM g", "dale_chall")(_grade("dale_chall"))
query(_G + f"SELECT question_id, {s6('greatest(0.0, 1 - (0.141 * per + 0.086 * pct + 0.839) / 6.0)')} AS score FROM g", "spache_score")(_grade("spache"))
