"""Whole experiments: model x data set x variant grids, resumable or not, one- and two-parameter sweeps, chained tuning."""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hingeworks.operators.folds import joined
from hingeworks.operators.selection import frequency
from hingeworks.plans import search, shared
from hingeworks.sources.datasets import display_name

#: Grids of the one-parameter tunings.
TUNE_C = (0.01, 0.1, 1.0, 10.0, 100.0)
TUNE_TAU = (0.1, 0.3, 0.5, 0.7, 1.0)
#: Grid points of a model that are fitted between two writes to a store.
AT_A_TIME = 100
STORE_KEYS = ["dataset", "variant", "model", "point", "fold"]


def held(rows: DataFrame) -> DataFrame:
    """A small table (a row a fit) as rows of its own, so that nothing behind it runs twice or stays cached."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


@contextlib.contextmanager
def stopped_at(spark: SparkSession, deadline: float | None) -> Iterator[None]:
    """Jobs that this thread starts inside are cancelled at the deadline (seconds since the epoch), running tasks too."""
    if deadline is None:
        yield
        return
    sc, group = spark.sparkContext, f"until-{uuid.uuid4().hex}"
    names = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = [sc.getLocalProperty(n) for n in names]
    sc.setJobGroup(group, "a grid with a deadline", interruptOnCancel=True)
    timer = threading.Timer(max(0.0, deadline - time.time()), sc.cancelJobGroup, (group,))
    timer.daemon = True
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        for n, v in zip(names, before):
            sc.setLocalProperty(n, v)


def point_key(point: dict) -> str:
    """A grid point as text that doesn't depend on the grid it is in."""
    return json.dumps(point, sort_keys=True)


def finished(spark: SparkSession, store: str) -> DataFrame | None:
    """The fold metrics in a store, or None if nothing has been stored."""
    try:
        return spark.read.parquet(store)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def resumed(data: DataFrame, folds: DataFrame | str, grids: dict[str, list[dict]], store: str, domain: str = "nonneg", deadline: float | None = None, method: str | None = None, tolerance: float = shared.TOLERANCE) -> DataFrame:
    """Fold metrics of a grid, from a store that keeps what is finished.

    The store is a Parquet folder that grows by appends, each of AT_A_TIME points of a model; what it already has (by
    data set, variant, model, parameters and fold) isn't fitted again, so a run that was killed goes on where it stopped.
    At the deadline running jobs are cancelled; fits that are missing then are rows with status skipped, and not stored.
    """
    spark = data.sparkSession
    sides = joined(data, folds).select("dataset", "variant", F.col("fold").cast("long").alias("fold")).where("fold IS NOT NULL").distinct()
    sides = held(sides)  # a row a fold
    planned = [(m, i, point_key(p), json.dumps(p)) for m, points in grids.items() for i, p in enumerate(points)]
    plan = spark.createDataFrame(planned, "model string, combo_id long, point string, params string")
    wanted = sides.crossJoin(F.broadcast(plan))  # folds by points: a row a fit

    def missing() -> DataFrame:
        done = finished(spark, store)
        return wanted if done is None else wanted.join(done.select(*STORE_KEYS).distinct(), STORE_KEYS, "left_anti")

    open_ = {(r.model, r.combo_id) for r in missing().select("model", "combo_id").distinct().collect()}  # a row a point
    try:
        for model, points in grids.items():
            left = [i for i in range(len(points)) if (model, i) in open_]
            for at in range(0, len(left), AT_A_TIME):
                if deadline is not None and time.time() > deadline:
                    break
                part = [points[i] for i in left[at : at + AT_A_TIME]]
                keys = spark.createDataFrame([(j, point_key(p)) for j, p in enumerate(part)], "combo_id long, point string")
                with stopped_at(spark, deadline):
                    rows = held(search.cross_validate(data, folds, {model: part}, domain=domain, deadline=deadline, method=method, tolerance=tolerance))
                rows = rows.where("status <> 'skipped'").join(F.broadcast(keys), "combo_id").drop("combo_id", "params")
                done = finished(spark, store)
                if done is not None:
                    rows = rows.join(done.select(*STORE_KEYS), STORE_KEYS, "left_anti")
                rows.coalesce(1).write.mode("append").parquet(store)  # a row a fit
    except Exception:
        if deadline is None or time.time() <= deadline:
            raise  # not the deadline's doing
    done = finished(spark, store)
    if done is None:
        done = spark.createDataFrame([], ", ".join(x for x in search.METRICS.split(", ") if x.split()[0] not in ("combo_id", "params")) + ", point string")
    rows = wanted.join(done, STORE_KEYS, "left").withColumn("status", F.coalesce("status", F.lit("skipped")))
    return rows.select(*search.METRIC_NAMES)


def run(data: DataFrame, folds: DataFrame | str, grids: dict[str, list[dict]], criterion: str = "auc", minutes: float | None = None, domain: str = "nonneg", store: str | None = None, method: str | None = None, tolerance: float = shared.TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(fold metrics, best rows) of a grid over every data set and variant of data.

    A best row has the display name, parameters, means, the last fold's weights and the features of most folds (all
    non-zero beyond 1e-6 of those weights, or without weights the features of over half of the folds). With a store the
    grid is resumable (see `resumed`).
    """
    deadline = time.time() + 60 * minutes if minutes else None
    if store is not None:
        metrics = held(resumed(data, folds, grids, store, domain, deadline, method, tolerance))
    else:
        metrics = held(search.cross_validate(data, folds, grids, domain=domain, deadline=deadline, method=method, tolerance=tolerance))
    winners = search.best(search.summary(metrics), criterion)
    weights = search.winner_weights(metrics, winners)
    k = (data if isinstance(folds, str) else folds).agg(F.countDistinct(folds if isinstance(folds, str) else "fold")).first()[0]
    chosen = metrics.join(winners.select(*search.KEYS, "combo_id"), [*search.KEYS, "combo_id"])
    often = frequency(chosen, k, search.KEYS).where("freq > 0.5").groupBy(*search.KEYS).agg(F.sort_array(F.collect_list("feature")).alias("often"))
    nonzero = F.filter(F.transform("w", lambda x, i: F.when(F.abs(x) > 1e-6, i + 1)), lambda i: i.isNotNull())
    out = winners.join(weights, [*search.KEYS, "combo_id"], "left").join(often, search.KEYS, "left")
    out = out.withColumn("features_selected", F.coalesce(nonzero, F.col("often"))).withColumn("type", display_name(F.col("variant")))
    return metrics, out.drop("often")


def tune(data: DataFrame, folds: DataFrame | str, model: str, values: dict[str, tuple], fixed: dict | None = None, criterion: str = "auc", auc_from: str = "label", domain: str = "nonneg", method: str | None = None) -> tuple[DataFrame, dict]:
    """(curve of means and deviations per point, first best point)."""
    points = search.grid(values, fixed)
    metrics = held(search.cross_validate(data, folds, {model: points}, domain=domain, auc_from=auc_from, method=method))
    curve = search.summary(metrics)
    top = search.best(curve, criterion).select("combo_id").first()
    names = F.from_json("params", ", ".join(f"{k} double" for k in values)).alias("p")
    return curve.select("*", names).select("*", "p.*").drop("p"), points[top.combo_id] if top else {}


def chained(data: DataFrame, folds: DataFrame | str, budget: int = 5, domain: str = "nonneg", method: str | None = None) -> dict:
    """Tune C, then tau at the best C, then both together, for the budgeted pinball model."""
    step = lambda values, fixed: tune(data, folds, "PinFSSVM", values, {"B": budget} | fixed, domain=domain, method=method)[1]
    first = step({"C": TUNE_C}, {"tau": 0.5})
    second = step({"tau": TUNE_TAU}, {"C": first.get("C", 1.0)})
    return {"C": first, "tau": second, "both": step({"C": TUNE_C, "tau": TUNE_TAU}, {})}


def sweep(data: DataFrame, folds: DataFrame | str, name: str, values: tuple, fixed: dict, model: str = "PinFSSVM", domain: str = "nonneg", method: str | None = None) -> DataFrame:
    """AUC against one parameter, the others fixed, per variant: (variant, value, auc_mean, auc_std)."""
    metrics = search.cross_validate(data, folds, {model: search.grid({name: values}, fixed)}, domain=domain, method=method)
    value = F.from_json("params", f"{name} double")[name].alias("value")
    return search.summary(metrics).select("variant", value, "auc_mean", "auc_std")
