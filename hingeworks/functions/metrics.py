"""Classification metrics as aggregates over label and prediction columns in {-1, 0, 1}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(y: Column, p: Column) -> dict[str, Column]:
    """tn, fp, fn, tp; a prediction of 0 is in none of them."""
    count = lambda c: F.count_if(c).cast("long")
    return {"tn": count((y == -1) & (p == -1)), "fp": count((y == -1) & (p == 1)), "fn": count((y == 1) & (p == -1)), "tp": count((y == 1) & (p == 1))}


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metric_columns(y: Column, p: Column) -> dict[str, Column]:
    """accuracy, sensitivity, specificity, auc (from labels), f1_score, g_mean of a group.

    A 0 prediction is wrong; it counts as half a hit in the rank-based auc. A group of one class has auc 0 and g_mean 0.
    """
    n = confusion(y, p)
    pos, neg = F.count_if(y == 1), F.count_if(y == -1)
    sens, spec = _ratio(n["tp"], pos), _ratio(n["tn"], neg)
    both = (pos > 0) & (neg > 0)
    half = lambda c: _ratio(F.count_if(c & (p == 0)), F.count_if(c)) / 2
    auc = F.when(both, (sens + half(y == 1) + spec + half(y == -1)) / 2 + _tie_gap(y, p, pos, neg)).otherwise(0.0)
    three = F.count_if(p == 0) > 0
    return {
        "accuracy": F.avg((y == p).cast("double")),
        "sensitivity": sens,
        "specificity": spec,
        "balanced_accuracy": (sens + spec) / 2,
        "auc": auc,
        "f1_score": _ratio(2 * n["tp"], 2 * n["tp"] + n["fp"] + F.count_if((y == 1) & (p != 1))),
        "g_mean": F.when(both & ~three, F.sqrt(sens * spec)).otherwise(0.0),
    }


def _tie_gap(y: Column, p: Column, pos: Column, neg: Column) -> Column:
    """What three-valued predictions add to (TPR + TNR) / 2 with half hits: P(+,0)P(-,0) counted once, not in halves of each."""
    share = lambda cls, v, n: _ratio(F.count_if((y == cls) & (p == v)), n)
    a, z, b = share(1, 1, pos), share(1, 0, pos), share(1, -1, pos)
    a_, z_, b_ = share(-1, 1, neg), share(-1, 0, neg), share(-1, -1, neg)
    rank = a * (b_ + z_) + a * a_ / 2 + z * b_ + z * z_ / 2 + b * b_ / 2
    return rank - (a + z / 2 + b_ + z_ / 2) / 2


def auc_rank(df: DataFrame, y: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Area under the curve by average ranks, ties at half; 0 for a group of one class.

    Scores are first counted per distinct value, so ties and groups of any size meet as sums; the ranks run over the
    distinct values of a group. With a weight a row counts as often.
    """
    count = lambda c: F.count_if(c) if weight is None else F.sum(F.when(c, F.col(weight)).otherwise(0))
    n = df.groupBy(*by, score).agg(count(F.col(y) == 1).alias("__up"), count(F.col(y) == -1).alias("__down"))
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    up, down = F.col("__up"), F.col("__down")
    won = up * (F.coalesce(F.sum(down).over(before), F.lit(0)) + down / 2)
    wins = n.withColumn("__won", won).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("__won", "__up", "__down")])
    return wins.select(*by, F.when((up > 0) & (down > 0), F.col("__won") / (up * down)).otherwise(0.0).alias("auc"))


def evaluate(df: DataFrame, y: str, p: str, by: list[str], zero_pred: str = "count_as_wrong") -> DataFrame:
    """Metrics per group; zero_pred="drop_fold" leaves out groups with a prediction of 0.

    "outside" takes rates from the four cells of the confusion table only, which a prediction of 0 is in none of; such a
    row is still wrong for the accuracy, and a rate without rows is null.
    """
    if zero_pred == "outside":
        n = {k: c.cast("double") for k, c in confusion(F.col(y), F.col(p)).items()}
        sens, spec = F.try_divide(n["tp"], n["tp"] + n["fn"]), F.try_divide(n["tn"], n["tn"] + n["fp"])
        rates = {"accuracy": F.avg((F.col(y) == F.col(p)).cast("double")), "sensitivity": sens, "specificity": spec, "balanced_accuracy": (sens + spec) / 2, "auc": (sens + spec) / 2}
        rates |= {"f1_score": F.try_divide(2 * n["tp"], 2 * n["tp"] + n["fp"] + n["fn"]), "g_mean": F.sqrt(F.try_divide(sens * n["tn"], n["tn"] + n["fp"]))}
        return df.groupBy(*by).agg(*[c.alias(k) for k, c in rates.items()])
    found = df.groupBy(*by).agg(*[c.alias(k) for k, c in metric_columns(F.col(y), F.col(p)).items()], F.count_if(F.col(p) == 0).alias("zeros"))
    if zero_pred == "drop_fold":
        found = found.where("zeros = 0")
    return found.drop("zeros")
