"""Fits, cross-validation and feature searches of tables of any size: all fits of a call share their passes over the table."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hingeworks.functions import metrics
from hingeworks.operators import folds as splits
from hingeworks.operators.models import MODELS, RFESVM, FisherSVM, Fitted, LinearModel
from hingeworks.operators.solvers.ipm import Spec
from hingeworks.operators.solvers.passes import NO_FOLD, RAW, Count, Fit, Passes, Work, budget_search, condensed, cost_path, elimination, newton, together

#: Relative gap that fits are proven to; wider ones can leave a feature with a weight that an optimum doesn't have.
TOLERANCE = 1e-6
METRICS = "model string, dataset string, variant string, combo_id long, params string, fold long, status string, error string, accuracy double, auc double, f1_score double, g_mean double, train_time double, num_features int, selected array<int>, w array<double>, b double, objective double, gap double"
METRIC_NAMES = [x.split()[0] for x in METRICS.split(", ")]


def fit_work(passes: Passes, model: LinearModel, side: int | None = None, tolerance: float = TOLERANCE) -> Work:
    """A model's fit on the scaled training rows of a side, as a work that returns Fitted."""
    began, own, n = time.monotonic(), passes.side(side), passes.n
    spec = getattr(model, "spec", None)
    if spec is None:
        raise ValueError(f"{type(model).__name__} is no fit of the family that passes can do")
    listed, every = None, np.arange(n)
    if isinstance(model, FisherSVM):
        scores = own.fisher()
        listed = sorted(range(n), key=lambda j: (-scores[j], -j))[: min(model.n_features, n)]
        fit = yield from newton(own, side, np.array(sorted(listed)), spec, tolerance)
    elif isinstance(model, RFESVM):
        fit, steps = yield from elimination(own, side, n, spec, model.n_features, model.drop, tolerance)
        listed = steps[-1] if steps else every.tolist()
    elif getattr(model, "budget", None) is not None:
        (fit,) = yield from budget_search(own, side, n, spec, [model.budget], model.costs, tolerance)
    else:
        fit = yield from newton(own, side, every, spec, tolerance)
    return fitted(fit, n, listed, tolerance, time.monotonic() - began)


def fitted(fit: Fit, n: int, listed: list[int] | None, tolerance: float, took: float) -> Fitted:
    w = fit.full(n)
    chosen = np.flatnonzero(w).tolist() if listed is None else listed
    v = np.zeros(n, dtype=int)
    v[chosen] = 1
    proven = fit.gap <= tolerance * (1 + abs(fit.value)) * (1 + 1e-9)
    return Fitted(w, fit.b, v, [int(j) + 1 for j in chosen], fit.value, "optimal" if proven else "gap_open", took, fit.gap, fit.passes)


def fit_table(data: DataFrame, model: LinearModel, tolerance: float = TOLERANCE) -> Fitted:
    """A model fitted to all rows of data (features, label), scaled, by passes: no row leaves its task."""
    rows = condensed(data.select("features", "label", F.lit(0).alias("fold")))
    try:
        passes = Passes(rows)
        (got,) = passes.run([fit_work(passes, model, None, tolerance)])
    finally:
        rows.unpersist()
    if isinstance(got, Exception):
        raise got
    return got


def fit_grid(data: DataFrame, models: dict[str, list[dict]], domain: str = "nonneg", tolerance: float = TOLERANCE) -> dict[str, list[Fitted]]:
    """The fits of all points of each model's grid on all rows, scaled; they share their passes, and points that differ in the budget a search."""
    rows = condensed(data.select("features", "label", F.lit(0).alias("fold")))
    out: dict[str, list] = {m: [None] * len(points) for m, points in models.items()}
    try:
        passes = Passes(rows)
        trees = [(m, tree) for m, points in models.items() for tree in _trees(points, list(range(len(points))))]
        works = [_points(passes, m, [models[m][i] for i in tree], domain, None, tolerance) for m, tree in trees]
        for (m, tree), got in zip(trees, passes.run(works)):
            if isinstance(got, Exception):
                raise got
            for i, (f, _) in zip(tree, got):
                out[m][i] = f
    finally:
        rows.unpersist()
    return out


def path(data: DataFrame, spec: Spec, low: float, high: float, tolerance: float = 1e-7) -> DataFrame:
    """(c_from, c_to, w, b, gap): the fits of all C from low to high, by the intervals on which one fit is the optimum."""
    rows = condensed(data.select("features", "label", F.lit(0).alias("fold")))
    try:
        passes = Passes(rows)
        (got,) = passes.run([cost_path(passes.side(None), None, np.arange(passes.n), spec, low, high, tolerance)])
    finally:
        rows.unpersist()
    if isinstance(got, Exception):
        raise got
    out = [(float(a), float(b), f.full(passes.n).tolist(), f.b, f.gap) for a, b, f in got]  # a row an interval
    return data.sparkSession.createDataFrame(out, "c_from double, c_to double, w array<double>, b double, gap double")


def table_metrics(t: np.ndarray, zero_pred: str = "count_as_wrong") -> dict[str, float] | None:
    """accuracy, auc (from labels), f1_score and g_mean of counts of labels 1, -1 by predictions 1, 0, -1; None for a dropped fold."""
    (tp, _, fn), (fp, _, tn) = t
    zeros, pos, neg = t[:, 1].sum(), t[0].sum(), t[1].sum()
    if zeros and zero_pred == "drop_fold":
        return None
    up, down = t[0] / max(pos, 1), t[1] / max(neg, 1)
    wins = up[0] * (down[1] + down[2]) + up[1] * down[2] + (up * down).sum() / 2
    wrong = pos - tp
    return {
        "accuracy": float((tp + tn) / (pos + neg)) if pos + neg else 0.0,
        "auc": float(wins) if pos and neg else 0.0,
        "f1_score": float(2 * tp / (2 * tp + fp + wrong)) if tp + fp + wrong else 0.0,
        "g_mean": float(np.sqrt(tp / pos * (tn / neg))) if pos and neg and not zeros else 0.0,
    }


def fit_and_count(passes: Passes, model: LinearModel, side: int | None, tolerance: float = TOLERANCE) -> Work:
    """(Fitted, the table of its predictions on the side's test rows)."""
    got = yield from fit_work(passes, model, side, tolerance)
    (table,) = yield [Count(side, np.arange(passes.n), np.r_[got.w, got.b])]
    return got, table


def cross_validate(data: DataFrame, folds: DataFrame | str, models: dict[str, list[dict]], domain: str = "nonneg", auc_from: str = "label", zero_pred: str = "count_as_wrong", deadline: float | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Fold metrics of every (dataset, variant, model, point, fold), as search.METRICS.

    All fits of a data set move on together, so the number of passes doesn't grow with points or folds. Points that
    differ in ignored parameters are fitted once. Failures and fits beyond the deadline are rows.
    """
    spark = data.sparkSession
    whole = splits.joined(data, folds)
    out: list[dict] = []
    sets = [tuple(r) for r in whole.select("dataset", "variant").distinct().collect()]  # a row a data set
    for dataset, variant in sorted(sets):
        own = condensed(whole.where((F.col("dataset") == dataset) & (F.col("variant") == variant)))
        try:
            out += [{"dataset": dataset, "variant": variant} | r for r in _one_set(own, models, domain, auc_from, zero_pred, deadline, tolerance)]
        finally:
            own.unpersist()
    return spark.createDataFrame([tuple(r.get(c) for c in METRIC_NAMES) for r in out], METRICS)  # a row a fit


def _one_set(rows: DataFrame, models: dict[str, list[dict]], domain: str, auc_from: str, zero_pred: str, deadline: float | None, tolerance: float) -> list[dict]:
    passes = Passes(rows)
    jobs, works, sizes, twins = [], [], [], {}
    for name, points in models.items():
        first: dict[str, int] = {}
        for i, point in enumerate(points):
            same = json.dumps({k: v for k, v in point.items() if k not in getattr(MODELS[name], "ignored", ())}, sort_keys=True)
            twins.setdefault((name, first.setdefault(same, i)), []).append(i)
        for tree in _trees(points, sorted(first.values())):
            for k in passes.folds:
                jobs += [(name, i, k) for i in tree]
                works.append(_points(passes, name, [points[i] for i in tree], domain, k, tolerance))
                sizes.append(len(tree))
    results = [r for got, n in zip(passes.run(works, deadline), sizes) for r in (got if isinstance(got, list) else [got] * n)]
    ranked = _rank_auc(passes, [(k, r[0]) if isinstance(r, tuple) else None for (_, _, k), r in zip(jobs, results)]) if auc_from == "score" else {}
    out = []
    for number, ((name, i, k), result) in enumerate(zip(jobs, results)):
        row = {"model": name, "fold": k, "status": "skipped"}
        if isinstance(result, Exception):
            row |= {"status": "failed", "error": f"{type(result).__name__}: {result}"[:300]}
        elif result is not None:
            f, table = result
            row |= {"status": f.status, "w": f.w.tolist(), "b": f.b, "selected": f.selected, "num_features": int((f.w != 0).sum()), "objective": f.objective, "train_time": f.train_time, "gap": f.gap}
            found = table_metrics(table, zero_pred)
            row |= {"status": "failed", "error": "a prediction is 0"} if found is None else found
            if found is not None and number in ranked:
                row["auc"] = ranked[number]
        out += [row | {"combo_id": t, "params": json.dumps(models[name][t])} for t in twins[(name, i)]]
    return out


def _trees(points: list[dict], at: list[int]) -> list[list[int]]:
    """Points (by number) that differ in the budget only, together: one search finds them all."""
    groups: dict[str, list[int]] = {}
    for i in at:
        same = {k: v for k, v in points[i].items() if k != "B"} | ({} if points[i].get("B") is not None else {"number": i})
        groups.setdefault(json.dumps(same, sort_keys=True), []).append(i)
    return list(groups.values())


def _points(passes: Passes, name: str, points: list[dict], domain: str, side: int | None, tolerance: float) -> Work:
    """(Fitted, table) of each point; models are constructed when it is run, so that wrong parameters are a failed fit."""
    models = [MODELS[name](**({"domain": domain} | p)) for p in points]
    first, began, n = models[0], time.monotonic(), passes.n
    if getattr(first, "budget", None) is None:
        return (yield from together([fit_and_count(passes, m, side, tolerance) for m in models]))
    found = yield from budget_search(passes.side(side), side, n, first.spec, [m.budget for m in models], first.costs, tolerance)
    fits = [fitted(f, n, None, tolerance, time.monotonic() - began) for f in found]
    tables = yield [Count(side, np.arange(n), np.r_[f.w, f.b]) for f in fits]
    return list(zip(fits, tables))


def _rank_auc(passes: Passes, fits: list[tuple[int, Fitted] | None]) -> dict[int, float]:
    """The area under the curve by scores, by the number of the fit: test rows are scored by all fits in one pass, then ranked by fit."""
    sent = [(i, passes.tested(f[0]), *passes.raw(f[0], np.arange(passes.n), np.r_[f[1].w, f[1].b])) for i, f in enumerate(fits) if f is not None]
    n, centre, unit = passes.n, passes.centre, passes.unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n) - centre) / unit
            y, fold = batch.column("label").cast(pa.int32()), batch.column("fold").to_numpy()
            weight = batch.column("weight").to_numpy() if "weight" in batch.schema.names else np.ones(len(fold), np.int64)
            for i, out, w, b in sent:
                at = np.flatnonzero(np.isin(fold, out))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), y.take(pa.array(at)), pa.array(x[at] @ w + b), pa.array(weight[at])], ["fit", "label", "score", "weight"])

    scored = passes.rows.mapInArrow(run, "fit int, label int, score double, weight long")
    return {r.fit: r.auc for r in metrics.auc_rank(scored, "label", "score", ["fit"], "weight").collect()}  # a row a fit


def _mean(tables: list[np.ndarray], name: str) -> float:
    return float(np.mean([table_metrics(t)[name] for t in tables]))


def _best(found: list[dict | Exception | None]) -> dict:
    """The first with the highest positive AUC."""
    best: dict = {"auc": 0.0}
    for f in found:
        if isinstance(f, Exception):
            raise f
        if f is not None and f["auc"] > best["auc"] + 1e-12:
            best = f
    return best


def rfe_search(data: DataFrame, folds: DataFrame | str, c_grid: tuple[float, ...], domain: str = "nonneg", deadline: float | None = None, rank: str = "last_fold", tolerance: float = TOLERANCE) -> dict:
    """For each C, cross-validate at each size while halving the features by the last fold's weights; best mean AUC.

    A size of 1 is not scored. rank="unscaled" ranks by the weights of a fit on all rows, unscaled, instead. All C and all
    folds share their passes; rows (row_id, features, label) and folds (row_id, fold).
    """
    rows = condensed(splits.joined(data, folds))

    def point(passes: Passes, c: float) -> Work:
        spec, at, best = Spec("hinge", "l1", c, domain=domain), np.arange(passes.n), {"auc": 0.0}
        while len(at) > 1:
            sides = [*passes.folds, *([RAW] if rank == "unscaled" else [])]
            fits = yield from together([newton(passes.side(k), k, at, spec, tolerance) for k in sides])
            tables = yield [Count(k, at, np.r_[f.full(passes.n)[at], f.b]) for k, f in zip(passes.folds, fits)]
            auc = _mean(tables, "auc")
            if auc > best["auc"]:
                best = {"C": c, "auc": auc, "accuracy": _mean(tables, "accuracy"), "selected": [int(j) + 1 for j in at]}
            w = fits[-1].full(passes.n)[at]
            at = np.delete(at, np.argsort(w**2, kind="stable")[: len(at) // 2])
        return best

    try:
        passes = Passes(rows)
        return _best(passes.run([point(passes, c) for c in c_grid], deadline))
    finally:
        rows.unpersist()


def fisher_search(data: DataFrame, folds: DataFrame | str, c_grid: tuple[float, ...], percentiles: tuple = (25, 50, 75), repeats: int = 5, share: float = 0.2, seed: int = 42, domain: str = "nonneg", deadline: float | None = None, tolerance: float = TOLERANCE) -> dict:
    """For each C the threshold of least mean hold-out error among score percentiles, then cross-validation on its mask.

    Scores are those of all rows; an empty mask falls back to the top tenth. Hold-outs are seeded digests of row_id, the
    folds are given. Returns the best point by mean AUC with its own threshold and mask. All fits share their passes.
    """
    key = F.col("row_id")
    bits = sum((splits.held_out(key, share, seed + i).cast("long") * (1 << i) for i in range(repeats)), F.lit(0).cast("long"))
    rows = condensed(splits.joined(data, folds).select("features", "label", (F.coalesce("fold", F.lit(NO_FOLD >> repeats)) * (1 << repeats) + bits).alias("fold")))

    def use_of(scores: np.ndarray, limit: float) -> np.ndarray:
        use = scores >= limit
        if not use.any():
            use[np.argsort(scores)[-max(1, int(0.1 * len(scores))) :]] = True
        return np.flatnonzero(use)

    def right(passes: Passes, c: float, at: np.ndarray, sides: list[int]) -> Work:
        fits = yield from together([newton(passes.side(s), s, at, Spec("hinge", "l1", c, domain=domain), tolerance) for s in sides])
        return (yield [Count(s, at, np.r_[f.full(passes.n)[at], f.b]) for s, f in zip(sides, fits)])

    def point(passes: Passes, c: float, kfold: list[int], held: list[int]) -> Work:
        scores = passes.side(None).fisher()
        limits = np.percentile(scores, percentiles)
        tried = yield from together([right(passes, c, use_of(scores, t), held) for t in limits])
        limit = limits[int(np.argmin([round(1 - _mean(tables, "accuracy"), 12) for tables in tried]))]
        at = use_of(scores, limit)
        tables = yield from right(passes, c, at, kfold)
        return {"C": c, "threshold": float(limit), "auc": _mean(tables, "auc"), "accuracy": _mean(tables, "accuracy"), "selected": [int(j) + 1 for j in at]}

    try:
        passes = Passes(rows)
        cells = passes.folds
        passes.tests = {-1 - i: {f for f in cells if f >> i & 1} for i in range(repeats)} | {-100 - k: {f for f in cells if f >> repeats == k} for k in {f >> repeats for f in cells} - {NO_FOLD >> repeats}}
        kfold, held = sorted((s for s in passes.tests if s <= -100), reverse=True), [-1 - i for i in range(repeats)]
        return _best(passes.run([point(passes, c, kfold, held) for c in c_grid], deadline))
    finally:
        rows.unpersist()
