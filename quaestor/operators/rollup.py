"""From nested scores to long rows, and up again: metric -> dimension -> aspect -> overall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.lexicons import CRITICAL, TAXONOMY


def flatten_scores(results: DataFrame, keep: tuple[str, ...] = ("question_id", "course_id", "source_type"), skip_dimensions: tuple[str, ...] = (), flag_below: float = 0.3) -> DataFrame:
    """Long rows of scores MAP<aspect, MAP<dimension, MAP<metric, STRUCT<score, flagged, rationale>>>>.

    Empty aspects and dimensions give no rows; a missing flag is score < ``flag_below``; a null score keeps its row."""
    a = results.select(*keep, F.explode("scores").alias("aspect", "_d"))
    b = a.select(*keep, "aspect", F.explode("_d").alias("dimension", "_m"))
    c = b.select(*keep, "aspect", "dimension", F.explode("_m").alias("metric", "_s"))
    long = c.select(*keep, "aspect", "dimension", "metric", F.col("_s.score").alias("score"), F.coalesce("_s.flagged", F.col("_s.score") < flag_below, F.lit(False)).alias("flagged"), F.col("_s.rationale").alias("rationale"))
    return long.where(~F.col("dimension").isin(*skip_dimensions)) if skip_dimensions else long


def nest_scores(long: DataFrame, key: str = "question_id") -> DataFrame:
    """The inverse: (key, scores) with {aspect: {dimension: {metric: score}}}. A repeated metric keeps its highest score."""
    one = long.where(F.col("score").isNotNull()).groupBy(key, "aspect", "dimension", "metric").agg(F.max("score").alias("score"))
    m = one.groupBy(key, "aspect", "dimension").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "score")))).alias("m"))
    d = m.groupBy(key, "aspect").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "m"))).alias("d"))
    return d.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("aspect", "d"))).alias("scores"))


def weighted_average(x: Column, w: Column | None = None) -> Column:
    """Sum of w*x over sum of w; 0 without rows or weight. Null scores are left out together with their weight."""
    w = F.lit(1.0) if w is None else w
    return F.coalesce(F.sum(w * x) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0)), F.lit(0.0))


def min_gate(x: Column, w: Column | None = None) -> Column:
    return F.coalesce(F.min(x), F.lit(0.0))


def percentile_rank(p: float = 50.0) -> Callable[..., Column]:
    if not 0 <= p <= 100:
        raise ValueError("percentile must lie between 0 and 100")
    return lambda x, w=None: F.coalesce(F.percentile(x, p / 100.0), F.lit(0.0))


STRATEGIES: dict[str, Callable[..., Column]] = {"weighted_average": weighted_average, "min_gate": min_gate, "percentile_rank": percentile_rank(50.0)}


def available_strategies() -> list[str]:
    return sorted(STRATEGIES)


def strategy(name: str | Callable[..., Column]) -> Callable[..., Column]:
    if callable(name):
        return name
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; one of {available_strategies()}")
    return STRATEGIES[name]


def _weight(column: str, weights: dict[str, float] | None) -> Column | None:
    if not weights:
        return None
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, F.lit(float(v))).otherwise(out)
    return out


def aggregate_dimension(long: DataFrame, by: str = "weighted_average", weights: dict[str, float] | None = None, key: str = "question_id") -> DataFrame:
    return long.groupBy(key, "aspect", "dimension").agg(strategy(by)(F.col("score"), _weight("metric", weights)).alias("score"))


def aggregate_aspect(long: DataFrame, by: str = "weighted_average", dimension_by: str = "weighted_average", weights: dict[str, float] | None = None, empty_dims: str = "zero", key: str = "question_id") -> DataFrame:
    """Dimensions collapsed without metric weights, then aspects. ``empty_dims``: `zero` lets dimensions of the taxonomy
    that have no metric count 0, `skip` leaves them out."""
    dims = aggregate_dimension(long, dimension_by, None, key)
    if empty_dims == "zero":
        spark = long.sparkSession
        known = spark.createDataFrame([(a, d) for a, ds in TAXONOMY.items() for d in ds], "aspect string, dimension string")
        every = long.select(key).distinct().join(F.broadcast(known), F.lit(True))  # 21 fixed rows
        dims = every.join(dims, [key, "aspect", "dimension"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    elif empty_dims != "skip":
        raise ValueError("empty_dims must be zero or skip")
    return dims.groupBy(key, "aspect").agg(strategy(by)(F.col("score"), _weight("dimension", weights)).alias("score"))


def aggregate_evaluation(long: DataFrame, by: str = "weighted_average", dimension_by: str = "weighted_average", weights: dict[str, float] | None = None, empty_dims: str = "zero", key: str = "question_id") -> DataFrame:
    aspects = aggregate_aspect(long, by, dimension_by, None, empty_dims, key)
    return aspects.groupBy(key).agg(strategy(by)(F.col("score"), _weight("aspect", weights)).alias("score"))


def critical_cap(dims: DataFrame, aspects: DataFrame, threshold: float = 0.2, key: str = "question_id") -> DataFrame:
    """Extension: an aspect that holds a critical dimension below ``threshold`` scores ``threshold`` at most."""
    low = dims.where(F.col("dimension").isin(*CRITICAL) & (F.col("score") < threshold)).select(key, "aspect").distinct().withColumn("capped", F.lit(True))
    hit = F.coalesce("capped", F.lit(False))
    return aspects.join(low, [key, "aspect"], "left").select(key, "aspect", F.when(hit, F.least("score", F.lit(threshold))).otherwise(F.col("score")).alias("score"), hit.alias("capped"))


def review_flag(overall: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Extension: marks overall scores below ``threshold`` for review."""
    return overall.withColumn("review", F.col("score") < threshold)


def flagged_metrics(long: DataFrame) -> DataFrame:
    return long.where("flagged")


def flagged_dimensions(long: DataFrame, key: str = "question_id") -> DataFrame:
    return long.groupBy(key, "aspect", "dimension").agg(F.bool_or("flagged").alias("any")).where("any").drop("any")
