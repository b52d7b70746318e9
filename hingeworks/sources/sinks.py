"""Results as tables keyed by (model, dataset, variant, combo_id, fold), with CSV exports and plot-ready frames."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: below spark.checkpoint.dir, or the checkpoint folder set in code.

    With neither, a local session gets a temporary folder; a cluster session is refused. The folder is removed at the
    end of the driver's process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hingeworks-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append((path, spark._jvm, spark._jsc.hadoopConfiguration()))
    return path


_scratch: list[tuple] = []


@atexit.register
def _drop_scratch() -> None:
    """Scratch folders go with the driver's process."""
    for path, jvm, conf in _scratch:
        with contextlib.suppress(Exception):  # the JVM may be gone
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """One partitioned table for all per-fold metrics."""
    metrics.write.mode(mode).partitionBy("model", "dataset", "variant").parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A CSV with one header; arrays become text such as `2, 6`."""
    flat = [F.concat_ws(", ", F.col(c).cast("array<string>")).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).coalesce(1).write.mode(mode).option("header", True).csv(path)


def append_results(df: DataFrame, path: str, tau: bool) -> None:
    """Rows added to a folder of result CSVs: Model, Type of model, Accuracy, AUC, Time, Features selected, Number of features, C and, for pinball models, tau."""
    names = ["Model", "Type of model", "Accuracy", "AUC", "Time", "Features selected", "Number of features", "C", *(["tau"] if tau else [])]
    export_csv(df.select(*names), path, mode="append")


def detail_name(model: str, dataset: str, variant: str, params: dict, stamp: str) -> str:
    """File name of one grid point's fold metrics."""
    return f"{model}_{dataset}_{variant}_{'_'.join(f'{k}{v}' for k, v in params.items())}_{stamp}.csv"


def sweep_name(dataset: str, variant_name: str) -> str:
    """File name of a sweep over C."""
    return f"{dataset}_c_auc_log_{variant_name.lower().replace(' + ', '_')}.csv"


def union_results(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in first-seen order, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def line_plot(curve: DataFrame, x: str, mean: str, std: str) -> DataFrame:
    """Plot-ready curve: x, mean, lo, hi, is_best (the first best), log_x (whether the range of x is over tenfold)."""
    whole = curve.agg(F.max(mean).alias("top"), F.min_by(F.col(x), F.struct(-F.col(mean), F.col(x))).alias("best"), (F.max(x) > 10 * F.min(x)).alias("log_x"))
    joined = curve.join(F.broadcast(whole))  # a one-row frame
    return joined.select(F.col(x).alias("x"), F.col(mean).alias("mean"), (F.col(mean) - F.col(std)).alias("lo"), (F.col(mean) + F.col(std)).alias("hi"), (F.col(x) == F.col("best")).alias("is_best"), "log_x")


def axis_bounds(value: Column, below: float = 0.05, above: float = 0.3) -> tuple[Column, Column]:
    """Aggregates: the y-range of a curve, within [0.5, 1]."""
    return F.greatest(F.lit(0.5), F.min(value) - below), F.least(F.lit(1.0), F.max(value) + above)


def heat_map(points: DataFrame, rows: str = "C", columns: str = "tau", value: str = "auc_mean") -> DataFrame:
    """One row per C, one column per tau, mean value."""
    return points.groupBy(rows).pivot(columns).avg(value).orderBy(rows)
