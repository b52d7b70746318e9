"""Fold assignment: exact (a seeded permutation), by hash, or modular."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exact_folds(m: int, k: int = 10, seed: int = 42) -> np.ndarray:
    """Fold of each row 0..m-1: a permutation cut into k chunks, the first m mod k one longer."""
    order = np.arange(m)
    np.random.RandomState(seed).shuffle(order)
    fold = np.empty(m, dtype=np.int64)
    for i, chunk in enumerate(np.array_split(order, k)):
        fold[chunk] = i
    return fold


def exact_table(spark: SparkSession, m: int, k: int = 10, seed: int = 42) -> DataFrame:
    """(row_id, fold) of the exact permutation, of a table that the driver can hold; `permuted` is for any."""
    return spark.createDataFrame([(i, int(f)) for i, f in enumerate(exact_folds(m, k, seed))], "row_id long, fold long")


def permuted(keys: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """(row_id, fold) for one column of distinct keys of any number: folds of sizes that differ by at most 1, the first m mod k one larger.

    Keys are ordered by a seeded digest, the same in any engine. Ranges of that order are dealt to tasks, each counts its
    rows, and a row's place is its place in its range behind the ranges before, so nothing but a count a range is gathered.
    """
    name = keys.columns[0]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")))
    width = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.select(F.col(name).alias("row_id"), digest.alias("digest")).repartitionByRange(width, "digest", "row_id").withColumn("part", F.spark_partition_id()).persist()
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("m"))
    placed = dealt.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("digest", "row_id")) - 1)
    small, larger = F.floor(F.col("m") / k), F.col("m") % k
    edge = larger * (small + 1)
    fold = F.when(F.col("at") < edge, F.floor(F.col("at") / (small + 1))).otherwise(larger + F.floor((F.col("at") - edge) / F.greatest(small, F.lit(1))))
    return placed.select("row_id", fold.cast("long").alias("fold"))


def hash_fold(key: Column, k: int = 10, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k))


def modular_fold(key: Column, line: Column, k: int = 10) -> Column:
    """Integer arithmetic only, the same in any engine."""
    return F.pmod(key * 7 + line, F.lit(k))


def held_out(key: Column, test_share: float = 0.2, seed: int = 42) -> Column:
    """Whether a row is of the test side: a seeded digest of its key, the same in any engine and however rows are dealt."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    # nine digits, so that a share of 1 has its number, too; digits of one width sort as numbers
    return F.concat(F.lit("0"), F.substring(digest, 1, 8)) < F.lit(f"{int(test_share * (1 << 32)):09x}")


def hold_out(df: DataFrame, key: Column, test_share: float = 0.2, repeats: int = 5, seed: int = 42) -> list[tuple[DataFrame, DataFrame]]:
    """Seeded random hold-outs (train, test)."""
    sides = [held_out(key, test_share, seed + i) for i in range(repeats)]
    return [(df.where(~side), df.where(side)) for side in sides]


def joined(data: DataFrame, folds: DataFrame | str) -> DataFrame:
    """data with a column fold, from a table (row_id, fold) or a column of its own by name, which needs no join."""
    return data.withColumn("fold", F.col(folds)) if isinstance(folds, str) else data.join(folds, "row_id")


def train_of(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) != k)


def test_of(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) == k)
