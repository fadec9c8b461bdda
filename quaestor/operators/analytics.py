"""Grouped analysis of long score rows. Everything is declarative; nothing is collected."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.runtime import cut


def summary(df: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """mean, std (ddof 1), min, max, count of non-null values by ``keys``."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))


def ordered(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, _k, _b, _n): every different value of a group with its count, how many rows of the group lie below it,
    and how many the group has; null values take no part.

    Equal values are counted first. The values are then range-partitioned over all tasks, so that not even a group that holds
    most rows is sorted in one; each partition counts within itself and gets the rows of the partitions before it added."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_k"))
    # written, as the number of a partition must not change
    placed = cut(counts.repartitionByRange(*group, value).withColumn("_p", F.spark_partition_id()))
    parts = placed.groupBy(*group, "_p").agg(F.sum("_k").alias("_t"))
    over = Window.partitionBy(*group)
    parts = parts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_p").alias("_q"),
        F.coalesce(F.sum("_t").over(over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_t").over(over).alias("_n"),
    )
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_p") == F.col("_q")])
    inside = F.sum("_k").over(Window.partitionBy(*group, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(parts, same).select(*group, value, "_k", (F.col("_o") + F.coalesce(inside, F.lit(0))).alias("_b"), "_n")


def percentiles(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(group, one column per entry of ``at``): exact percentiles with linear interpolation; groups without values have no row."""
    x = ordered(df, group, value)
    picks = []
    for name, p in at.items():
        pos = (F.col("_n") - 1) * p
        covers = lambda i: (F.col("_b") <= i) & (i < F.col("_b") + F.col("_k"))
        low, high = F.max(F.when(covers(F.floor(pos)), F.col(value))), F.max(F.when(covers(F.ceil(pos)), F.col(value)))
        picks.append((low + (F.max(pos) - F.floor(F.max(pos))) * (high - low)).alias(name))
    return x.groupBy(*group).agg(*picks)


def with_percentiles(base: DataFrame, df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``base``, one row per group, with the percentiles of ``df`` beside it."""
    q = percentiles(df, group, value, at).select(*[F.col(g).alias(f"_j{i}") for i, g in enumerate(group)], *at)
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_j{i}")) for i, g in enumerate(group)])
    return base.join(q, same, "left").drop(*[f"_j{i}" for i in range(len(group))])


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles, max."""
    v = F.col(value)
    x = df.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return with_percentiles(x, df, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def pivot_mean(df: DataFrame, keys: list[str], column: str, values: list[str], value: str = "score") -> DataFrame:
    """Means side by side; the values are named, so no extra pass finds them."""
    return df.groupBy(*keys).pivot(column, values).agg(F.avg(value))


def pivot_count(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(column, values).count().na.fill(0, values)


def mean_of_means(df: DataFrame, inner: list[str], outer: list[str], value: str = "score") -> DataFrame:
    return df.groupBy(*inner).agg(F.avg(value).alias("m")).groupBy(*outer).agg(F.avg("m").alias("mean"))


def flag_rate(long: DataFrame, keys: list[str], unit: str = "question_id") -> DataFrame:
    """Share of units with any flag, by ``keys``."""
    each = long.groupBy(*keys, unit).agg(F.bool_or("flagged").alias("f"))
    return each.groupBy(*keys).agg(F.avg(F.col("f").cast("int")).alias("rate"), F.count("*").alias("units"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal-width bins, the last one closed; values outside and nulls are left out; empty bins have no row."""
    x = df.where((F.col(value) >= low) & (F.col(value) <= high))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int"))
    return x.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def average_ranks(df: DataFrame, group: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks within ``group``, ties sharing their mean rank (see ``ordered``); null values and groups have none."""
    ranked = ordered(df, group, value).select(*group, value, (F.col("_b") + (F.col("_k") + 1) / 2.0).alias(out))
    return df.join(ranked, [*group, value], "left")


def pairwise(df: DataFrame, unit: list[str], name: str, value: str, ranked: bool = False) -> DataFrame:
    """(a, b, r, n): correlation of every pair of series over the units both have; ``ranked`` gives Spearman's.

    Series are few (dimensions, judges), units many: the join key is the unit, and each unit has one row per series."""
    x = df.where(F.col(value).isNotNull()).groupBy(*unit, name).agg(F.avg(value).alias("v"))
    a = x.select(*unit, F.col(name).alias("a"), F.col("v").alias("x"))
    b = x.select(*unit, F.col(name).alias("b"), F.col("v").alias("y"))
    both = a.join(b, unit).where(F.col("a") < F.col("b"))
    if ranked:
        both = average_ranks(average_ranks(both, ["a", "b"], "x", "rx"), ["a", "b"], "y", "ry")
        return both.groupBy("a", "b").agg(F.corr("rx", "ry").alias("r"), F.count("*").alias("n"))
    return both.groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def mann_whitney(df: DataFrame, keys: list[str], group: str, first: str, second: str, value: str = "score") -> DataFrame:
    """(keys, u, n1, n2, p): U of the first group and the two-sided p by normal approximation with tie and continuity
    correction; null values take no part, a key without both groups gives no row."""
    x = df.where(F.col(value).isNotNull() & F.col(group).isin(first, second))
    r = average_ranks(x, keys, value)
    ties = x.groupBy(*keys, value).agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("tie"))
    one = F.col(group) == first
    s = r.groupBy(*keys).agg(F.sum(F.when(one, F.col("rank"))).alias("r1"), F.count(F.when(one, 1)).alias("n1"), F.count(F.when(~one, 1)).alias("n2")).where("n1 > 0 and n2 > 0")
    s = s.join(ties, keys)
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    mu = F.col("n1") * F.col("n2") / 2.0
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("tie") / F.greatest(F.lit(1.0), (n * (n - 1)).cast("double"))))
    s = s.withColumns({"u": u, "z": F.when(sd == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (F.abs(u - mu) - 0.5)) / F.nullif(sd, F.lit(0.0)))})

    @F.pandas_udf("double")  # one value a key: the error function has no built-in form
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(v / math.sqrt(2.0)))

    return s.select(*keys, "u", "n1", "n2", two_sided("z").alias("p"))


def disagreement(df: DataFrame, unit: list[str], value: str = "score") -> DataFrame:
    """Population deviation across raters per unit."""
    return df.groupBy(*unit).agg(F.stddev_pop(value).alias("sd"))


def score_band(c):
    return F.when(c >= 0.8, "Strong").when(c >= 0.6, "Acceptable").when(c >= 0.4, "Borderline").when(c.isNotNull(), "Problematic")


def top(df: DataFrame, by: str, n: int, ascending: bool = False, tie: str = "metric") -> DataFrame:
    """The first ``n`` rows by a column, ties by name: a top-k, so the limit is the feature."""
    return df.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), tie).limit(n)
