"""Feature ranking: Fisher scores, thresholds, masks, correlations."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hingeworks.operators import gram

#: Stands for the variance of a class of one row.
LEAST_VARIANCE = 1e-10
#: Columns up to which scores are one expression a column and correlations one a pair; beyond, they come from sums of vectors and blocks.
PAIRWISE = 40


def fisher_expr(x: Column, y: Column, guards: bool = True) -> Column:
    """Aggregate: squared distances of the class means from the mean over the summed sample variances.

    With guards, a class of one row (or none) has variance 1e-10, and a zero or undefined quotient is 0.
    """
    of = lambda cls: F.when(y == cls, x)
    mean, up, down = F.avg(x), F.avg(of(1)), F.avg(of(-1))
    var = lambda cls: F.coalesce(F.var_samp(of(cls)), F.lit(LEAST_VARIANCE)) if guards else F.var_samp(of(cls))
    score = F.try_divide((up - mean) * (up - mean) + (down - mean) * (down - mean), var(1) + var(-1))
    return F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)) if guards else score


def _fisher_of(mean: np.ndarray, sums: np.ndarray, guards: bool) -> np.ndarray:
    """The same scores from counts, sums and sums of squares by label, around any centre; NaN where undefined."""
    with np.errstate(divide="ignore", invalid="ignore"):
        count, total, square = sums.transpose(1, 0, 2)
        whole = total.sum(axis=0) / count.sum(axis=0)
        var = (square - total * total / count) / (count - 1)
        var = np.where(var < 1e-12 * square / np.maximum(count, 1), 0.0, var)
        if guards:
            var = np.where(count < 2, LEAST_VARIANCE, var)
        far, below = ((total / count - whole) ** 2).sum(axis=0), var.sum(axis=0)
        score = np.where(below == 0, np.nan, far / below)
    return np.nan_to_num(score, nan=0.0, posinf=0.0, neginf=0.0) if guards else score


def fisher_scores(df: DataFrame, columns: list[str], label: str = "label", guards: bool = True) -> DataFrame:
    """(j, feature, score), j from 1: one aggregation for all features, beyond PAIRWISE columns of vectors."""
    if len(columns) > PAIRWISE:
        data = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("features"), F.col(label).cast("int").alias("label"))
        scores = _fisher_of(*gram.by_label(data, len(columns)), guards)
        rows = [(j, c, None if np.isnan(x) else float(x)) for j, (c, x) in enumerate(zip(columns, scores), 1)]  # a row a feature
        return df.sparkSession.createDataFrame(rows, "j int, feature string, score double")
    one = df.agg(*[fisher_expr(F.col(c), F.col(label), guards).alias(f"s{j}") for j, c in enumerate(columns, 1)])
    rows = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(c).alias("feature"), F.col(f"s{j}").alias("score")) for j, c in enumerate(columns, 1)])
    return one.select(F.inline(rows))


def ranks(scores: DataFrame) -> DataFrame:
    """Adds rank: highest score first, ties to the larger position."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("j"))))  # a row a feature


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return ranks(scores).where(F.col("rank") <= k)


def top_share(scores: DataFrame, share: float = 0.1) -> DataFrame:
    """At least one feature, else the floor of the share."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return ranks(scores.withColumn("n", n)).where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))).drop("n")


def thresholds(scores: DataFrame, at: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """Percentiles of the scores with linear interpolation: one row a threshold."""
    p = scores.agg(F.percentile("score", F.array(*[F.lit(a) for a in at])).alias("t"))
    return p.select(F.posexplode("t").alias("i", "threshold")).select(F.element_at(F.array(*[F.lit(a) for a in at]), F.col("i") + 1).alias("percentile"), "threshold")


def masks(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """(percentile, j, feature, selected): score at or above each threshold."""
    return scores.join(F.broadcast(limits)).select("percentile", "j", "feature", (F.col("score") >= F.col("threshold")).alias("selected"))


def percentile_masks(scores: DataFrame, at: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """The masks of the scores' own percentiles, both from one evaluation: sums of another order could put a score below itself."""
    share = F.array(*[F.lit(a) for a in at])
    one = scores.agg(F.collect_list(F.struct("j", "feature", "score")).alias("s"), F.percentile("score", share).alias("t"))  # a row a feature
    each = one.select("s", F.inline(F.arrays_zip(share.alias("percentile"), F.col("t").alias("threshold")))).select("percentile", "threshold", F.inline("s"))
    return each.select("percentile", "j", "feature", (F.col("score") >= F.col("threshold")).alias("selected"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson matrix in long form (feature_i, feature_j, corr), both halves; a pair's rows are those where neither is null."""
    if len(columns) > PAIRWISE:
        names = F.array(*[F.lit(c) for c in columns])
        found = gram.correlations(df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("features")), len(columns))
        return found.select(F.get(names, F.col("a")).alias("feature_i"), F.get(names, F.col("b")).alias("feature_j"), "corr")
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(x).alias("feature_i"), F.lit(y).alias("feature_j"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs) for x, y in ({(a, b), (b, a)})]
    return one.select(F.inline(F.array(*rows)))


def target_ranking(df: DataFrame, columns: list[str], target: str, first: int = 1, last: int = 10) -> DataFrame:
    """Features by absolute correlation with the target, places first to last."""
    one = df.agg(*[F.corr(c, target).alias(f"c{j}") for j, c in enumerate(columns)])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.col(f"c{j}")).alias("abs_corr")) for j, c in enumerate(columns)])))
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("abs_corr"), "feature")))
    return placed.where(F.col("place").between(first, last))
