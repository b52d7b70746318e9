"""Linear scores, losses and objectives as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decision(features: list[Column], w: list[float], b: float) -> Column:
    """w.x + b over scalar columns."""
    return sum((F.lit(float(k)) * x for k, x in zip(w, features)), F.lit(float(b)))


def decision_array(features: Column, w: Column, b: Column) -> Column:
    """w.x + b over array columns."""
    return F.aggregate(F.zip_with(features, w, lambda a, k: a * k), F.lit(0.0), lambda s, x: s + x) + b


def predict(score: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum(score).cast("int")


def margin(label: Column, score: Column) -> Column:
    return label * score


def hinge(m: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - m)


def pinball(m: Column, tau: float) -> Column:
    return F.greatest(1 - m, F.lit(float(tau)) * (m - 1))


def l1_norm(w: list[float]) -> float:
    return float(sum(abs(x) for x in w))


def l2_norm2(w: list[float]) -> float:
    return float(sum(x * x for x in w))


def objective(m: Column, w: list[float], loss: str = "hinge", reg: str = "none", c: float = 1.0, tau: float = 0.5) -> Column:
    """Aggregate: regulariser plus c times the summed loss of margins."""
    fixed = {"none": 0.0, "l1": l1_norm(w), "l2": 0.5 * l2_norm2(w)}[reg]
    return F.lit(fixed) + F.lit(float(c)) * F.sum(hinge(m) if loss == "hinge" else pinball(m, tau))


def nonzero(w: Column, eps: float = 0.0) -> Column:
    """1-based positions of weights beyond eps in absolute value."""
    at = F.transform(w, lambda x, i: F.when(F.abs(x) > eps, i + 1))
    return F.filter(at, lambda i: i.isNotNull())


def scatter(selected: Column, w: Column, n: int) -> Column:
    """Weights of a feature subset back in place among n, zero elsewhere."""
    found = F.map_from_arrays(selected, w)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.coalesce(F.try_element_at(found, j), F.lit(0.0)))


def gather(features: Column, selected: Column) -> Column:
    """Features at 1-based positions, in the order of the list."""
    return F.transform(selected, lambda j: F.element_at(features, j))
