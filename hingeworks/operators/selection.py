"""Selected feature sets: frequency over folds and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency(sets: DataFrame, k: int, by: list[str] | None = None, selected: str = "selected") -> DataFrame:
    """(feature, freq): folds that select a feature over k, the number of folds planned."""
    each = sets.select(*(by or []), F.explode(selected).alias("feature"))
    return each.groupBy(*(by or []), "feature").agg((F.count(F.lit(1)) / F.lit(k)).alias("freq"))


def frequent(freq: DataFrame, above: float = 0.5) -> DataFrame:
    return freq.where(F.col("freq") > above)


def stability(sets: DataFrame, by: list[str], fold: str = "fold", selected: str = "selected") -> DataFrame:
    """(by, stability): mean Jaccard likeness of the selected sets of two folds, pairs with an empty union left aside.

    One set has stability 1; without a pair of non-empty union it is 0. Folds of a group are few, pairs stay in it.
    """
    a = sets.select(*by, F.col(fold).alias("fa"), F.col(selected).alias("sa"))
    b = sets.select(*by, F.col(fold).alias("fb"), F.col(selected).alias("sb"))
    union = F.size(F.array_union("sa", "sb"))
    likeness = F.when(union > 0, F.size(F.array_intersect("sa", "sb")) / union)
    pairs = a.join(b, by).where("fa < fb").groupBy(*by).agg(F.avg(likeness).alias("mean"))
    counts = sets.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(pairs, by, "left").select(*by, F.when(F.col("n") == 1, 1.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("stability"))
