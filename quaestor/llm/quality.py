"""Problem 1: per-document text statistics, and the telling of prose from lists, tables and junk.

Gradient-boosted trees over document statistics, trained on weak labels (labelling rules that may abstain) and
calibrated on hand-checked texts that training does not see. All statistics are built-in column expressions; only they reach Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.text import count_in, is_blank, ratio, txt
from quaestor.llm import gbt
from quaestor.llm.corpus import text_sample
from quaestor.llm.holdout import PROSE_OR_NOT

# The commonest English function words.
COMMON = (
    "a an and are as at be been but by can could did do does each for from had has have he her his how i if in into is it its "
    "may more most no not of on one only or our she should so some such than that the their them then there these they this "
    "to under up was we were what when where whether which while who why will with would you your"
).split()

FEATURES = [
    "n_words", "n_lines", "mean_word_len", "symbol_ratio", "digit_ratio", "end_punct_share", "common_share", "words_per_line",
    "short_line_share", "odd_word_share", "sentence_word_share", "marker_share", "number_share", "distinct_share",
]


def _share(a: Column, pred) -> Column:
    return ratio(F.size(F.filter(a, pred)), F.size(a))


def _unbroken(c: Column) -> Column:
    """The text with words that are broken over two lines put together."""
    given = txt(c)
    broken = given.contains("-\n") | given.contains("\u00ad\n") | given.contains("-\r\n") | given.contains("\u00ad\r\n")
    return F.when(broken, F.regexp_replace(given, r"(\p{L})(?:-|\u00ad)\r?\n(?=\p{Ll})", "$1")).otherwise(given)


def without_introduction(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the text, less its first line where that is an introduction: a sentence (or a lead-in that ends with a
    colon) above three lines or more that are no running sentences, as hardly any sentence ends in them."""
    x = df.withColumn("_raw", _unbroken(F.col(text))).withColumn("_rest", F.regexp_replace("_raw", r"^\s*[^\n]+\n", ""))
    first = F.regexp_extract("_raw", r"^\s*([^\n]+)\n", 1)
    entries = F.size(F.filter(F.split("_rest", "\n"), lambda y: F.trim(y) != "")) >= 3
    ends = F.regexp_count("_rest", F.lit(r"\p{L}{2}[)\]\"']?[.!?][\"')]?(?:\s|$)"))
    leads = first.rlike(r"\S\s+\S+\s.*[.:?!][\"')]?\s*$")
    is_introduction = leads & entries & (ends * 40 < F.size(F.split("_rest", r"\s+")))
    return x.withColumn(out, F.when(is_introduction, F.col("_rest")).otherwise(F.col("_raw"))).drop("_raw", "_rest")


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the statistics in ``FEATURES`` (doubles) for the whole text in column ``text``.

    Null and blank texts get 0 in every statistic. Existing columns of the same names are replaced; other columns
    are kept. Copies and extra columns (also ones named like a statistic, which are replaced) change nothing. Word arrays live only inside one projection, never in a shuffle.
    """
    staged = df.withColumn("_body", _unbroken(F.col(text)))
    t = F.col("_body")
    whole = F.replace(F.replace(F.replace(t, F.lit("\n\n"), F.lit("\x02")), F.lit("\n"), F.lit(" ")), F.lit("\x02"), F.lit("\n"))
    staged = staged.withColumns(
        {
            "_lines": F.filter(F.split(t, "\r?\n"), lambda x: F.trim(x) != ""),
            "_words": F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)),
            # lines of one paragraph belong together; blank lines and ends of sentences part
            "_parts": F.split(F.regexp_replace(whole, r"([.!?][\"')]?)\s+", "$1\n"), "\n+"),
        }
    )
    words, lines = F.col("_words"), F.col("_lines")
    n = F.size(words)
    tight = t
    for blank in " \n\t\r":  # far cheaper than one translation of them all
        tight = F.replace(tight, F.lit(blank), F.lit(""))

    def inside(part: Column) -> Column:
        """The words of a part that is a running sentence: it ends like one and has enough common words."""
        words_in = F.transform(F.array(F.split(F.lower(part), r"\s+")), lambda ws: F.when((F.size(ws) >= 5) & (count_in(ws, COMMON) * 20 >= F.size(ws)), F.size(ws)).otherwise(0)).getItem(0)
        return F.when(part.rlike(r"[\p{L}\p{N})\]\"'][.!?][\"')]?\s*$"), words_in).otherwise(0)

    # what several statistics share is a column of its own, else each use would compute it again
    odd = r"[bcdfghjklmnpqrstvwxz]{5}|\b[bcdfghjklmnpqrstvwxz]{3,}\b|[a-z][0-9]+[a-z]"
    staged = staged.withColumns(
        {
            "_n": n, "_k": F.size(lines), "_solid": F.length(tight), "_signs": F.length(F.array_join(words, "")), "_short": F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"\S+")) <= 6)),
            "_sentence": F.aggregate(F.transform(F.col("_parts"), inside), F.lit(0), lambda a, b: a + b), "_odd": F.regexp_count(F.lower(t), F.lit(odd)), "_digits": F.regexp_count(t, F.lit("[0-9]")),
            "_numbers": F.regexp_count(t, F.lit(r"\b[0-9]+\b")), "_common": count_in(words, COMMON),
        }
    )
    n, k, solid, signs = F.col("_n"), F.col("_k"), F.col("_solid"), F.col("_signs")
    feats = {
        "n_words": n.cast("double"),
        "n_lines": k.cast("double"),
        "mean_word_len": ratio(signs, n),
        "symbol_ratio": F.greatest(F.lit(0.0), ratio(solid - signs, solid)),
        "digit_ratio": ratio(F.col("_digits"), solid),
        "end_punct_share": _share(lines, lambda x: x.rlike(r"[.!?:;,][\"')]?\s*$")),
        "common_share": ratio(F.col("_common"), n),
        "words_per_line": ratio(n, k),
        "short_line_share": ratio(F.col("_short"), k),
        "odd_word_share": F.least(F.lit(1.0), ratio(F.col("_odd"), n)),
        "sentence_word_share": F.least(F.lit(1.0), ratio(F.col("_sentence"), n)),
        "marker_share": _share(lines, lambda x: x.rlike(r"^\s*([-*•◦·‣–]|\(?[0-9a-z]{1,3}[.)]|[#|+])\s*")),
        "number_share": F.least(F.lit(1.0), ratio(F.col("_numbers"), n)),
        "distinct_share": ratio(F.size(F.array_distinct(words)), n),
    }
    return staged.withColumns(feats).drop("_lines", "_words", "_parts", "_body", "_n", "_k", "_solid", "_signs", "_short", "_sentence", "_odd", "_digits", "_numbers", "_common")


def weak_label() -> Column:
    """1 not prose, 0 prose, null where the rules abstain."""
    c = F.col
    prose = (c("sentence_word_share") >= 0.6) & (c("common_share") >= 0.03) & (c("odd_word_share") < 0.1) & (c("number_share") < 0.3)
    junk = (c("sentence_word_share") <= 0.15) & ((c("short_line_share") >= 0.7) | ((c("common_share") <= 0.05) & (c("mean_word_len") < 8)) | (c("odd_word_share") >= 0.25) | (c("number_share") >= 0.5))
    return F.when(prose, 0).when(junk & (c("n_words") >= 5), 1)


def _judged(df: DataFrame, text: str) -> DataFrame:
    """The statistics that the classifier sees: of the text without its introduction, which changes nothing in the verdict."""
    return with_stats(without_introduction(df, text, "_judged"), "_judged").drop("_judged")


def _checked(spark: SparkSession, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of one third of the hand-checked texts: 0 for training, 1 for calibration, 2 for the test."""
    seen = {0: 0, 1: 0}
    rows = []
    for t, y in PROSE_OR_NOT:
        if seen[y] % 3 == part:
            rows.append((t, y))
        seen[y] += 1
    p = _judged(spark.createDataFrame(rows, "text string, label int"), "text").select(*FEATURES, "label").toPandas()
    return p[FEATURES].to_numpy(float), p["label"].to_numpy(float)


def fit(df: DataFrame, text: str = "text", sample: int = 8000) -> gbt.Boosted:
    """Trees fitted on about ``sample`` rows (at most twice as many), those of them that get a weak label, and on a third of
    the hand-checked texts; calibrated on another third. The last third is only for ``holdout``."""
    spark = df.sparkSession
    some = _judged(text_sample(df.where(F.length(text) > 0).select(text), text, sample), text)
    rows = some.select(*FEATURES, weak_label().alias("label")).toPandas().dropna()
    own, label = _checked(spark, 0)
    x = np.vstack([rows[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), own])
    y = np.concatenate([rows["label"].to_numpy(float), label])
    return gbt.fit(x, y, FEATURES).calibrate(*_checked(spark, 1))


def holdout(model: gbt.Boosted, spark: SparkSession) -> dict[str, float]:
    """Accuracy, Brier score and calibration error (mean chance against share) on texts the model has never seen."""
    x, y = _checked(spark, 2)
    p = model.probability(x)
    return {"texts": len(y), "accuracy": float(((p >= 0.5) == y).mean()), "brier": float(((p - y) ** 2).mean()), "calibration_error": float(abs(p.mean() - y.mean()))}


def score(df: DataFrame, text: str = "text", sample: int = 8000) -> DataFrame:
    """``df`` with ``p_structural``, the calibrated chance that the text is list, table or junk, and the statistics it rests
    on (of the text without its introduction; ``with_stats`` gives those of the whole text).

    Blank texts get null; texts of symbols alone get 1."""
    model = fit(df, text, sample)
    p = _judged(df, text).withColumn("p_structural", model.column())
    return p.withColumn("p_structural", F.when(F.col("n_words") > 0, F.col("p_structural")).otherwise(F.when(~is_blank(F.col(text)), F.lit(1.0))))


def structural(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text as a whole is a list, table or junk."""
    return score(df, text).where(F.col("p_structural") >= threshold)
