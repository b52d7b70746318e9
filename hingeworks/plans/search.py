"""Parameter grids and cross-validation as Spark tasks.

A task is one (model, fold, path): a path is a run of grid points that share all parameters but the feature budget, so
that each fit starts from the one before. A fold is scaled once per task. Data of fits that one task can hold is
broadcast after a check of its size; larger tables are fitted by passes that all fits share (`plans.shared`).
"""

from __future__ import annotations

import itertools
import json
import pickle
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hingeworks.operators.folds import exact_folds, joined, permuted
from hingeworks.operators.models import MODELS, RFESVM, Fitted, L1SVM, LinearModel, fisher_score
from hingeworks.operators.solvers.bnb import GAP, ROUNDED, Search
from hingeworks.plans import shared as by_passes
from hingeworks.plans.shared import METRIC_NAMES, METRICS  # noqa: F401

#: Numbers (rows times features) of a data set that tasks may hold, about 160 MB; and where one task does many fits one
#: after the other (eliminations and searches), which copies it some ten times for each and takes as long as all of them.
MOST_NUMBERS, MOST_HELD = 20_000_000, 2_000_000
#: Nodes that a task of a budgeted search takes on in the first round, and at most in a later one.
FIRST_STEPS, MOST_STEPS = 16, 128
#: Powers of two from 1/8 to 32.
C_GRID = tuple(2.0**k for k in range(-3, 6))
TAU_GRID = (0.1, 0.5, 1.0)


def budgets(n: int, most: int = 30) -> tuple[int, ...]:
    return tuple(range(1, min(n, most) + 1))


def default_grids(n: int) -> dict[str, dict[str, tuple]]:
    """Grid of each model for n features."""
    return {
        "L1SVM": {"C": C_GRID},
        "L2SVM": {"C": C_GRID},
        "MILP1": {"C": C_GRID, "B": budgets(n)},
        "PinballSVM": {"C": C_GRID, "tau": TAU_GRID},
        "PinFSSVM": {"C": C_GRID, "tau": TAU_GRID, "B": budgets(n), "time_limit": (60,)},
        "FisherSVM": {"C": C_GRID, "n_features": budgets(n)},
        "RFESVM": {"C": C_GRID, "n_features": budgets(n)},
    }


def grid(values: dict[str, tuple], fixed: dict | None = None) -> list[dict]:
    """Cartesian product in key order, last key fastest; fixed parameters override."""
    return [dict(zip(values, point)) | (fixed or {}) for point in itertools.product(*values.values())]


def grid_table(spark: SparkSession, values: dict[str, tuple]) -> DataFrame:
    """The same product as a table with combo_id."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(itertools.product(*values.values()))], ["combo_id", *values])


def auc_of(y: np.ndarray, s: np.ndarray) -> float:
    """Area under the curve by average ranks; 0 with one class."""
    up, down = np.sort(s[y == 1]), np.sort(s[y != 1])
    if not len(up) or not len(down):
        return 0.0
    below = np.searchsorted(down, up, "left") + np.searchsorted(down, up, "right")
    return float(below.sum() / 2 / (len(up) * len(down)))


def fold_metrics(y: np.ndarray, p: np.ndarray, score: np.ndarray | None = None) -> dict[str, float]:
    """accuracy, auc (from labels, or from scores), f1_score, g_mean."""
    tp, fn, fp = ((y == 1) & (p == 1)).sum(), ((y == 1) & (p != 1)).sum(), ((y == -1) & (p == 1)).sum()
    tn = ((y == -1) & (p == -1)).sum()
    pos, neg = (y == 1).sum(), (y == -1).sum()
    two = pos and neg and not (p == 0).any()
    return {
        "accuracy": float((y == p).mean()) if len(y) else 0.0,
        "auc": auc_of(y, p if score is None else score),
        "f1_score": float(2 * tp / (2 * tp + fp + fn)) if tp + fp + fn else 0.0,
        "g_mean": float(np.sqrt(tp / pos * (tn / neg))) if two else 0.0,
    }


def scaled(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, sd = train.mean(axis=0), train.std(axis=0)
    sd[(sd == 0) | (train.max(axis=0) == train.min(axis=0))] = 1.0
    return (train - mean) / sd, (test - mean) / sd


def _paths(model: str, points: list[dict]) -> list[list[int]]:
    """Points that differ in B only, B ascending."""
    groups: dict[str, list[int]] = {}
    for i, p in enumerate(points):
        groups.setdefault(json.dumps({k: v for k, v in p.items() if k != "B"}, sort_keys=True), []).append(i)
    return [sorted(g, key=lambda i: (points[i].get("B") is None, points[i].get("B") or 0)) for g in groups.values()]


def _fits(model: str, points: list[dict], domain: str, x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, path: list[int], auc_from: str, zero_pred: str, deadline: float | None):
    """Result rows of a path on one fold; failures are rows."""
    last = None
    for i in path:
        row = {"combo_id": i, "status": "skipped", "error": None}
        if deadline is not None and time.time() > deadline:
            yield row
            continue
        try:
            m = MODELS[model](**points[i], **({"domain": domain} if "domain" not in points[i] else {}))
            if last is not None and hasattr(m, "start"):
                m.start = last
            if deadline is not None:
                m.time_limit = min(getattr(m, "time_limit", None) or np.inf, max(deadline - time.time(), 1e-3))
            m.fit(x, y)
            f = m.fitted
            if hasattr(m, "start") and f.w is not None:
                last = (f.w, f.b)
            score = m.decision_function(tx)
            p = np.sign(score).astype(int)
            row |= {"status": f.status, "w": f.w.tolist(), "b": f.b, "selected": f.selected, "num_features": int((f.w != 0).sum()), "objective": f.objective, "train_time": f.train_time, "gap": f.gap}
            if zero_pred == "drop_fold" and (p == 0).any():
                row |= {"status": "failed", "error": "a prediction is 0"}
            else:
                row |= fold_metrics(ty, p, score if auc_from == "score" else None)
        except Exception as e:  # a failed fold is data, not the end of the grid
            row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:300]}
        yield row


def cross_validate(data: DataFrame, folds: DataFrame | str, models: dict[str, list[dict]], domain: str = "nonneg", auc_from: str = "label", zero_pred: str = "count_as_wrong", deadline: float | None = None, method: str | None = None, tolerance: float = by_passes.TOLERANCE) -> DataFrame:
    """Fold metrics of every (dataset, variant, model, point, fold).

    data has (row_id, dataset, variant, features, label), folds (row_id, fold), or it names a column of data. Points that differ only in parameters a
    model ignores are fitted once and reported each. A deadline (seconds since the epoch) skips what is left. method:
    "tasks", a task a fold and path, which hold the data; "passes" over the table, shared by all fits; by default passes
    beyond MOST_NUMBERS. Either gives the same fits, within the relative gap that passes prove (tolerance).
    """
    spark = data.sparkSession
    n_numbers = data.agg(F.coalesce(F.sum(F.size("features")), F.lit(0))).first()[0]
    if method == "passes" or (method is None and n_numbers > MOST_NUMBERS):
        return by_passes.cross_validate(data, folds, models, domain, auc_from, zero_pred, deadline, tolerance)
    rows = joined(data, folds).orderBy("dataset", "variant", "row_id").toArrow()
    sets: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    keys = list(zip(rows["dataset"].to_pylist(), rows["variant"].to_pylist()))
    for key in sorted(set(keys)):
        part = rows.filter(pa.array([k == key for k in keys]))
        sets[key] = (np.array(part["features"].to_pylist(), dtype=float), part["label"].to_numpy().astype(float), part["fold"].to_numpy())
    shared = spark.sparkContext.broadcast(sets)
    tasks, twins = [], {}
    for name, points in models.items():
        first: dict[str, int] = {}
        for i, p in enumerate(points):
            same = json.dumps({k: v for k, v in p.items() if k not in getattr(MODELS[name], "ignored", ())}, sort_keys=True)
            twins.setdefault((name, first.setdefault(same, i)), []).append(i)
        kept = sorted(first.values())
        for path in _paths(name, [points[i] for i in kept]):
            for (dataset, variant), (_, _, fold) in sets.items():
                for k in sorted(set(fold.tolist())):
                    tasks.append((dataset, variant, name, k, [kept[i] for i in path]))
    if not tasks:
        return spark.createDataFrame([], METRICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict = {}
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                x, y, fold = shared.value[(t["dataset"], t["variant"])]
                key = (t["dataset"], t["variant"], t["fold"])
                if key not in ready:
                    ready.clear()
                    ready[key] = scaled(x[fold != t["fold"]], x[fold == t["fold"]])
                train, test = ready[key]
                points = models[t["model"]]
                for row in _fits(t["model"], points, domain, train, y[fold != t["fold"]], test, y[fold == t["fold"]], t["path"], auc_from, zero_pred, deadline):
                    for i in twins[(t["model"], row["combo_id"])]:
                        out.append({"model": t["model"], "dataset": t["dataset"], "variant": t["variant"], "fold": t["fold"]} | row | {"combo_id": i, "params": json.dumps(points[i])})
            yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in schema.names} for r in out], schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(a, kinds[b]) for a, b in (x.split() for x in METRICS.split(", "))])
    width = min(len(tasks), 4 * spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame([(i % width, *t) for i, t in enumerate(tasks)], "slot int, dataset string, variant string, model string, fold long, path array<int>")
    return table.repartitionById(width, F.col("slot")).mapInArrow(run, METRICS)


KEYS = ["model", "dataset", "variant"]


def summary(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation over successful folds per grid point."""
    names = ("accuracy", "auc", "f1_score", "g_mean")
    good = metrics.where(F.col("accuracy").isNotNull()).groupBy(*KEYS, "combo_id", "params")
    agg = [F.sort_array(F.collect_list(F.struct("fold", *names))).alias("by_fold"), *[F.stddev_pop(c).alias(f"{c}_std") for c in names]]
    agg += [F.avg("train_time").alias("train_time_mean"), F.avg("num_features").alias("num_features_mean"), F.count(F.lit(1)).alias("folds")]
    mean = lambda c: (F.aggregate("by_fold", F.lit(0.0), lambda s, x: s + x[c]) / F.col("folds")).alias(f"{c}_mean")
    rows = good.agg(*agg)  # a list of a point's folds; summed in their order, however rows are dealt
    return rows.select(*KEYS, "combo_id", "params", *[mean(c) for c in names], *[f"{c}_std" for c in names], "train_time_mean", "num_features_mean", "folds")


def best(points: DataFrame, criterion: str = "auc") -> DataFrame:
    """The first grid point with the highest positive mean of the criterion; none if no point is above 0. Means that agree to 12 digits are equal."""
    c = F.round(F.col(f"{criterion}_mean"), 12)
    rest = [x for x in points.columns if x not in KEYS]
    top = points.where(c > 0).groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct(c, -F.col("combo_id"))).alias("top"))
    return top.select(*KEYS, "top.*")  # no join, for which all fits would be done a second time


def winner_weights(metrics: DataFrame, winners: DataFrame) -> DataFrame:
    """w and b of the winner's last fold; null if that fold failed."""
    own = metrics.join(winners.select(*KEYS, "combo_id"), [*KEYS, "combo_id"])
    return own.groupBy(*KEYS, "combo_id").agg(F.max_by(F.struct("w", "b"), "fold").alias("m")).select(*KEYS, "combo_id", "m.w", "m.b")


def sweep_best(points: DataFrame, by: str, value: str = "auc_mean") -> DataFrame:
    """Best value of each setting of one parameter over the others."""
    return points.groupBy(by).agg(F.max(value).alias("best"))


def spread(spark: SparkSession, items: list, work) -> list:
    """work(item) of each item in a Spark task of its own, in order; items and results are small."""
    if not items:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("i").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pickle.dumps(work(items[i]))], pa.binary())], ["i", "result"])

    table = spark.range(len(items)).select(F.col("id").alias("i")).repartitionById(len(items), F.col("i").cast("int"))
    found = table.mapInArrow(run, "i long, result binary").collect()  # a row an item
    return [pickle.loads(r.result) for r in sorted(found, key=lambda r: r.i)]


def budgeted(spark: SparkSession, x: np.ndarray, y: np.ndarray, model: LinearModel, want: int = 48) -> Fitted:
    """A budgeted model's fit, proven optimal, searched in rounds of Spark tasks.

    The first round's task solves the root and finds a first fit by rounding and swaps. In each further round tasks take
    the open nodes, dealt by turns, search each of theirs for a bounded number of nodes, and return what is left and the
    best fit; the next round's tasks all know the best of all, and the nodes are dealt anew.
    """
    began = time.monotonic()
    shared = spark.sparkContext.broadcast((x, y, model.spec, model.budget, model.costs, model.start))

    def search(mine: list | None, best: tuple | None, limit: int) -> tuple:
        xs, ys, spec, budget, costs, start = shared.value
        part = Search(xs, ys, spec, budget, costs)
        part.best = best
        if mine is None:
            mine = part.begin(start)
        else:
            part.rounds = ROUNDED  # later nodes need no rounding of their own
        return part.best, part.some(mine, limit), part.explored

    ((best, nodes, explored),) = spread(spark, [None], lambda _: search(None, None, FIRST_STEPS))
    steps = FIRST_STEPS
    while nodes:
        tasks = [nodes[i::want] for i in range(min(want, len(nodes)))]
        nodes = []
        for found, left, count in spread(spark, tasks, lambda mine, best=best, limit=steps: search(mine, best, limit)):
            explored += count
            nodes += left
            if found[2] < best[2] - 1e-12:
                best = found
        steps = min(2 * steps, MOST_STEPS)
    shared.unpersist()
    w, b, value = best
    gap = GAP * max(1.0, abs(value))
    return Fitted(w, b, (w != 0).astype(int), [int(j) + 1 for j in np.flatnonzero(w)], value, "optimal", time.monotonic() - began, gap, explored)


def fit_any(data: DataFrame, model: LinearModel, method: str | None = None, tolerance: float = by_passes.TOLERANCE) -> Fitted:
    """A model fitted to the scaled rows of data (row_id, features, label), by passes over the table (`plans.shared`).

    method "tasks" instead lets tasks hold the rows: a budgeted model's subtrees are searched in many, an elimination in
    one. That is the default for those two up to MOST_NUMBERS and MOST_HELD numbers, where a pass for each of their many
    fits takes longer.
    """
    many = getattr(model, "budget", None) is not None or isinstance(model, RFESVM)
    if method is None:
        numbers = data.agg(F.coalesce(F.sum(F.size("features")), F.lit(0))).first()[0] if many else 0
        method = "tasks" if many and numbers <= (MOST_HELD if isinstance(model, RFESVM) else MOST_NUMBERS) else "passes"
    if method == "passes":
        return by_passes.fit_table(data, model, tolerance)
    x, y = _small(data, "tasks")
    if getattr(model, "budget", None) is not None:
        return budgeted(data.sparkSession, x, y, model)
    shared = data.sparkSession.sparkContext.broadcast((x, y))
    (got,) = spread(data.sparkSession, [model], lambda m: m.fit(*shared.value).fitted)
    return got


def _first_best(found: list[dict | None]) -> dict:
    best: dict = {"auc": 0.0}
    for f in found:
        if f is not None and f["auc"] > best["auc"] + 1e-12:
            best = f
    return best


def fisher_in_tasks(train: tuple[np.ndarray, np.ndarray], c_grid=C_GRID, percentiles=(25, 50, 75), repeats: int = 5, seed: int = 42, folds: int = 10, domain: str = "nonneg", deadline: float | None = None, spark: SparkSession | None = None) -> dict:
    """For each C the threshold of least mean hold-out error among score percentiles, then cross-validation on its mask.

    An empty mask falls back to the top tenth. Returns the best point by mean AUC with its own threshold and mask. With
    a session each C is a Spark task.
    """
    x, y = train
    scores = fisher_score(x, y)
    limits = np.percentile(scores, percentiles)
    rng = np.random.default_rng(seed)
    splits = [rng.permutation(len(y)) for _ in range(repeats)]
    fold, part = exact_folds(len(y), folds, seed), max(1, len(y) // 5)

    def mask(limit: float) -> np.ndarray:
        use = scores >= limit
        if not use.any():
            use[np.argsort(scores)[-max(1, int(0.1 * len(scores))) :]] = True
        return use

    def point(c: float, data) -> dict | None:
        if deadline is not None and time.time() > deadline:
            return None
        x, y = data
        right = lambda use, a, b: fold_metrics(y[b], L1SVM(C=c, domain=domain).fit(*_side(x[:, use], y, a, b)[0]).predict(_side(x[:, use], y, a, b)[1]))
        errors = [np.mean([1 - right(mask(t), order[part:], order[:part])["accuracy"] for order in splits]) for t in limits]
        limit = limits[int(np.argmin(errors))]
        use = mask(limit)
        got = [right(use, np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in range(folds)]
        return {"C": c, "threshold": float(limit), "auc": float(np.mean([g["auc"] for g in got])), "accuracy": float(np.mean([g["accuracy"] for g in got])), "selected": [int(j) + 1 for j in np.flatnonzero(use)]}

    return _first_best(_over_grid(spark, list(c_grid), point, (x, y)))


def rfe_in_tasks(train: tuple[np.ndarray, np.ndarray], c_grid=C_GRID, seed: int = 42, folds: int = 10, domain: str = "nonneg", spark: SparkSession | None = None) -> dict:
    """For each C, cross-validate at each size while halving the features by the last fold's weights; best mean AUC.

    With a session each C is a Spark task.
    """
    fold = exact_folds(len(train[1]), folds, seed)

    def point(c: float, data) -> dict:
        x, y = data
        at, best = np.arange(x.shape[1]), {"auc": 0.0}
        while len(at) > 1:
            got = []
            for k in range(folds):
                (a, b), test = _side(x[:, at], y, np.flatnonzero(fold != k), np.flatnonzero(fold == k))
                last = L1SVM(C=c, domain=domain).fit(a, b)
                got.append(fold_metrics(y[fold == k], last.predict(test)))
            auc = float(np.mean([g["auc"] for g in got]))
            if auc > best["auc"]:
                best = {"C": c, "auc": auc, "accuracy": float(np.mean([g["accuracy"] for g in got])), "selected": [int(j) + 1 for j in at]}
            at = np.delete(at, np.argsort(last.fitted.w**2, kind="stable")[: len(at) // 2])
        return best

    return _first_best(_over_grid(spark, list(c_grid), point, train))


def _side(x: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray):
    """((training rows, labels), test rows), scaled by the training rows."""
    a, b = scaled(x[train], x[test])
    return (a, y[train]), b


def _over_grid(spark: SparkSession | None, values: list[float], point, data) -> list:
    if spark is None:
        return [point(c, data) for c in values]
    shared = spark.sparkContext.broadcast(data)
    return spread(spark, values, lambda c: point(c, shared.value))


def _small(data: DataFrame, method: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Scaled rows and labels for tasks that hold them, after a check of their size; None: by passes."""
    if method is None:
        method = "passes" if data.agg(F.coalesce(F.sum(F.size("features")), F.lit(0))).first()[0] > MOST_HELD else "tasks"
    if method == "passes":
        return None
    rows = data.select("row_id", "features", "label").toArrow().sort_by("row_id")
    x = np.array(rows["features"].to_pylist(), dtype=float)
    return scaled(x, x)[0], rows["label"].to_numpy().astype(float)


def fisher_search(data: DataFrame, folds: DataFrame | str | None = None, c_grid: tuple = C_GRID, method: str | None = None, **options) -> dict:
    """The best C and Fisher threshold of a table of any size: in tasks up to MOST_HELD (folds are then the exact permutation), else by shared passes."""
    train = _small(data, method)
    if train is not None:
        return fisher_in_tasks(train, c_grid, spark=data.sparkSession, **options)
    return by_passes.fisher_search(data, permuted(data.select("row_id")) if folds is None else folds, c_grid, **options)


def rfe_search(data: DataFrame, folds: DataFrame | str | None = None, c_grid: tuple = C_GRID, method: str | None = None, **options) -> dict:
    """The best C and feature set on the halving path, as `fisher_search`."""
    train = _small(data, method)
    if train is not None:
        return rfe_in_tasks(train, c_grid, spark=data.sparkSession, **options)
    return by_passes.rfe_search(data, permuted(data.select("row_id")) if folds is None else folds, c_grid, **options)
