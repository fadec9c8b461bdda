"""Problem 5: the reading level of a text by regularised ordinal regression.

Features (lexical diversity, word rarity, connectives, a clause-depth proxy, lengths) are column expressions; the
proportional-odds model is fitted on a bounded sample whose grades come from published readability formulas that
agree, and calibrated to graded passages. The formulas rest on syllables, long words and words per sentence; none of these is a
feature, so that the regression has to find the level by other signs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.text import count_in, ratio, txt
from quaestor.llm.corpus import text_sample
from quaestor.llm.holdout import GRADED
from quaestor.runtime import cut

# Connectives and words that open a subordinate clause.
CONNECTIVES = (
    "although because before after since unless until whereas while whenever wherever whether though thus hence therefore moreover however nevertheless "
    "furthermore consequently notwithstanding insofar provided irrespective thereby otherwise if when that which who whose whom as than where why how"
).split()
FEATURES = ["word_len", "root_ttr", "rare_share", "connective_share", "clauses", "longest"]
MEASURES = [*FEATURES, "sentence_len", "syllables", "long_share"]  # the last three serve the formulas only
LEVELS = [3.5, 8.5, 12.5, 16.5]  # upper ends of the grade bands; the first is `easy`, what lies above the last is `hard`
RARE_BELOW = 5e-4  # a word is common when it makes up this share of all words: at most 1 / RARE_BELOW words can be


def common_words(df: DataFrame, text: str = "text") -> list[str]:
    """The words that make up at least ``RARE_BELOW`` of all words of all texts. By counting, there are at most 2,000."""
    words = F.explode(F.regexp_extract_all(F.lower(txt(F.col(text))), F.lit("[a-z]+"), F.lit(0)))
    counts = cut(df.select(words.alias("w")).groupBy("w").agg(F.count("*").alias("c")))
    total = counts.agg(F.sum("c")).first()[0] or 0
    return [r[0] for r in counts.where(F.col("c") >= total * RARE_BELOW).select("w").orderBy("w").collect()]


def with_features(df: DataFrame, common: list[str], text: str = "text") -> DataFrame:
    """Adds ``MEASURES`` and ``n_words``. Null and blank texts get zeros. Columns of these names are replaced."""
    t = F.regexp_replace(txt(F.col(text)), r"(\p{L})(?:-|­)\s+(?=\p{Ll})", "$1")
    t = F.regexp_replace(t, r"(?<=\d)[.,](?=\d)", "")
    sentence = F.split("_t", r"(?<=\p{L}{2}[.!?][\"')]?|\d[.!?])\s+|\n\s*\n|\n(?=\s*(?:\([a-z0-9]\)|[-*•]))|\n(?=\p{Lu}\p{L}* \p{Ll})")  # a title has no full stop, but a sentence begins below it
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    x = df.withColumn("_t", t).withColumns({"_w": words(F.col("_t")), "_s": F.filter(F.transform(sentence, lambda s: F.size(words(s))), lambda n: n >= 2)})
    w, s = F.col("_w"), F.col("_s")
    x = x.withColumn("_y", F.transform(w, lambda a: F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(a, "e+$", ""), F.lit("[aeiouy]+")))))
    n, k, y = F.size(w), F.size(s), F.col("_y")
    total = lambda a: F.aggregate(a, F.lit(0), lambda p, q: p + q)
    feats = {
        "n_words": n,
        "word_len": ratio(F.length(F.array_join(w, "")), n),
        "sentence_len": F.log1p(ratio(n, F.greatest(k, F.lit(1)))),
        "syllables": ratio(total(y), n),
        "long_share": ratio(F.size(F.filter(y, lambda a: a >= 3)), n),
        "root_ttr": F.when(n == 0, 0.0).otherwise(F.size(F.array_distinct(w)) / F.sqrt(2.0 * F.greatest(n, F.lit(1)))),
        "rare_share": ratio(n - count_in(w, common or [""]), n),
        "connective_share": ratio(count_in(w, CONNECTIVES), n),
        "clauses": ratio(F.regexp_count("_t", F.lit("[,;:]")) + count_in(w, CONNECTIVES), F.greatest(k, F.lit(1))),
        "longest": F.log1p(F.coalesce(F.array_max(s), F.lit(0)).cast("double")),
    }
    return x.withColumns(feats).drop("_t", "_w", "_s", "_y")


def formula_grade() -> Column:
    """The weak grade: the mean of two grade formulas (by syllables and by long words), null where they differ by more
    than five years, or above 16 and below 4 both."""
    per = F.exp("sentence_len") - 1
    fk = 0.39 * per + 11.8 * F.col("syllables") - 15.59
    fog = 0.4 * (per + 100 * F.col("long_share"))
    both = ((fk > 16.5) & (fog > 16.5)) | ((fk < 3.5) & (fog < 4.5))
    return F.when((F.col("n_words") >= 8) & (both | (F.abs(fk - fog) <= 5)), F.when((fk < 3.5) & (fog < 4.5), F.lit(2.0)).otherwise((fk + fog) / 2))


@dataclass
class Ordinal:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def column(self) -> Column:
        """The latent score, by Arrow batches of features; nondeterministic so that no filter on it is pushed below them."""
        model = self

        @F.pandas_udf("double")
        def latent(x: pd.Series) -> pd.Series:
            return pd.Series(model.latent(np.vstack(x.to_numpy()).astype(float)) if len(x) else [], dtype=float)

        return latent.asNondeterministic()(F.array(*[F.col(f).cast("double") for f in FEATURES]))


def fit_ordinal(x: np.ndarray, level: np.ndarray, weight: np.ndarray, l2: float = 0.02, steps: int = 1500, rate: float = 0.05) -> Ordinal:
    """Proportional odds by Adam on the penalised likelihood; cut points stay ordered through their log gaps."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z, k = (x - mean) / scale, len(LEVELS)
    p = np.concatenate([np.zeros(x.shape[1]), [-1.5], np.full(k - 1, 0.0)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = weight / weight.sum()
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    d = x.shape[1]
    for i in range(1, steps + 1):
        w, gaps = p[:d], np.exp(np.clip(p[d + 1 :], -6, 6))
        cuts = p[d] + np.concatenate([[0], np.cumsum(gaps)])
        f = z @ w
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = sig(edges[level + 1] - f), sig(edges[level] - f)
        pr = np.maximum(hi - lo, 1e-9)
        dh, dl = hi * (1 - hi) / pr * weight, lo * (1 - lo) / pr * weight
        gf = dh - dl  # of the negative log likelihood by f
        gc = np.zeros(k)
        np.add.at(gc, level[level < k], -dh[level < k])
        np.add.at(gc, level[level > 0] - 1, dl[level > 0])
        g = np.concatenate([z.T @ gf + l2 * w, [gc.sum()], [gc[j + 1 :].sum() * gaps[j] for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    gaps = np.exp(np.clip(p[d + 1 :], -6, 6))
    return Ordinal(mean, scale, p[:d], p[d] + np.concatenate([[0], np.cumsum(gaps)]))


def _graded(spark: SparkSession, part: int, common: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and grades of one third of the graded passages: 0 for the fit, 1 for the cut points, 2 for the test."""
    rows = [(float(g), t) for i, (g, t) in enumerate(GRADED) if i % 3 == part]
    p = with_features(spark.createDataFrame(rows, "grade double, text string"), common).select(*FEATURES, "grade").toPandas()
    return p[FEATURES].to_numpy(float), p["grade"].to_numpy(float)


def fit(df: DataFrame, common: list[str], text: str = "text", sample: int = 8000) -> Ordinal:
    """Fits on about ``sample`` rows (at most twice as many), those of them that get a weak grade, each band weighing the
    same, and on a third of the graded passages, which together weigh a third; the outer cut points are then moved between
    the passages of another third on either side where these can be told apart. The last third is only for ``holdout``."""
    spark = df.sparkSession
    level = F.lit(0)
    for c in LEVELS:
        level = level + F.when(F.col("grade") > c, 1).otherwise(0)
    feats = with_features(text_sample(df.where(F.length(text) > 0).select(text), text, sample), common, text)
    rows = feats.withColumn("grade", formula_grade()).where("grade is not null").select(*FEATURES, level.alias("level")).toPandas()
    own, grade = _graded(spark, 0, common)
    x = np.vstack([rows[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), own])
    y = np.concatenate([rows["level"].to_numpy(int), np.searchsorted(LEVELS, grade, side="left")])
    counts = rows["level"].value_counts()
    w = np.concatenate([[1 / counts[k] for k in rows["level"]], np.full(len(own), max(1, len(counts)) / 2 / len(own))])
    model = fit_ordinal(x, y, w)
    other, g = _graded(spark, 1, common)
    f = model.latent(other)
    for at in (0, len(LEVELS) - 1):
        low, high = f[g <= LEVELS[at]].max(), f[g > LEVELS[at]].min()
        if low < high:
            model.cuts[at] = min(max(model.cuts[at], low), high)
    return model


def holdout(model: Ordinal, common: list[str], spark: SparkSession) -> dict[str, float]:
    """On passages that the fit has not seen: rank agreement with their grades, and how many of the bands are right."""
    x, g = _graded(spark, 2, common)
    f = model.latent(x)
    rank = lambda v: pd.Series(v).rank().to_numpy()
    band = lambda level: np.where(level == 0, -1, np.where(level == len(LEVELS), 1, 0))
    right = band(np.searchsorted(model.cuts, f)) == band(np.searchsorted(LEVELS, g))
    return {"texts": len(g), "rank_agreement": float(np.corrcoef(rank(f), rank(g))[0, 1]), "bands_right": float(right.mean())}


def score(df: DataFrame, text: str = "text", sample: int = 8000) -> DataFrame:
    """``df`` with features, ``level`` (0 easiest to 4 hardest), ``p_easy`` and ``p_hard``; null for blank texts."""
    common = common_words(df, text)
    feats = with_features(df, common, text)
    model = fit(df, common, text, sample)
    f = model.column()
    cuts = [float(c) for c in model.cuts]
    level = F.lit(0)
    for c in cuts:
        level = level + F.when(F.col("latent") > c, 1).otherwise(0)
    has = F.col("n_words") > 0
    out = feats.withColumn("latent", f).withColumn("latent", F.when(has, F.col("latent")))
    return (
        out.withColumn("level", F.when(has, level)).withColumn("p_easy", 1 / (1 + F.exp(F.col("latent") - cuts[0]))).withColumn("p_hard", 1 / (1 + F.exp(cuts[-1] - F.col("latent"))))
    )


def bands(df: DataFrame, text: str = "text", sample: int = 8000) -> DataFrame:
    """The rows that lie clearly at one end, with ``band`` `easy` or `hard`. Texts of fewer than five words have none."""
    x = score(df, text, sample).where(F.col("n_words") >= 5)
    return x.withColumn("band", F.when(F.col("level") == 0, "easy").when(F.col("level") == len(LEVELS), "hard")).where("band is not null")
