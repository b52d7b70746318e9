"""Z-scores with population deviations; a constant feature is centred and left unscaled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(columns: list[str]) -> list:
    """Aggregates mean_<c> and sd_<c> for each column: one pass for all."""
    out = []
    for c in columns:
        sd = F.stddev_pop(c)
        out += [F.avg(c).alias(f"mean_{c}"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"sd_{c}")]
    return out


def stats(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*moments(columns))


def fold_stats(df: DataFrame, columns: list[str], k: int, fold: str = "fold") -> DataFrame:
    """Statistics of each fold's training rows, (fold, n, mean_*, sd_*), in one pass over the data.

    Each row belongs to k - 1 training sides. Count, mean and squared deviations of each fold are taken once; those of
    the other folds are then merged, around their joint mean, so that nothing cancels.
    """
    n = F.count(F.lit(1)).alias("n")
    per = df.groupBy(fold).agg(n, *[a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    other = per.select(*[F.col(c).alias(f"{c}_") for c in per.columns])
    pairs = per.select(F.col(fold)).join(F.broadcast(other), F.col(fold) != F.col(f"{fold}_"))  # k rows a side
    rows = pairs.groupBy(fold).agg(F.sum("n_").alias("n"), F.collect_list(F.struct(*other.columns)).alias("others"))
    out = [F.col(fold), F.col("n")]
    for c in columns:
        mean, square, flat = _merged("others", F.col("n"), c)
        rows = rows.withColumn(f"mean_{c}", mean).withColumn(f"q_{c}", square(F.col(f"mean_{c}")))
        out += [F.col(f"mean_{c}"), F.when(flat | (F.col(f"q_{c}") == 0), F.lit(1.0)).otherwise(F.sqrt(f"q_{c}")).alias(f"sd_{c}")]
    return rows.select(*out)


def _merged(parts: str, n: Column, c: str):
    """Mean of a column over parts (n_, m_<c>_, v_<c>_, lo_<c>_, hi_<c>_), its variance given the mean, and whether it is constant."""
    m, v, lo, hi = (f"{k}_{c}_" for k in ("m", "v", "lo", "hi"))
    mean = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["n_"] * x[m]) / n
    square = lambda at: F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["n_"] * (x[v] + (x[m] - at) * (x[m] - at))) / n
    flat = F.array_min(F.transform(parts, lambda x: x[lo])) == F.array_max(F.transform(parts, lambda x: x[hi]))
    return mean, square, flat


def apply(df: DataFrame, statistics: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Columns z_<c>; statistics has a row a group (few), so it is broadcast."""
    joined = df.join(F.broadcast(statistics), by) if by else df.join(F.broadcast(statistics))
    z = {f"z_{c}": (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in columns}
    return joined.withColumns(z).drop(*[f"{s}_{c}" for c in columns for s in ("mean", "sd")])
