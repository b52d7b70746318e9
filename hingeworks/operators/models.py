"""The seven classifiers over one family of linear fits, with the accessors of a fitted model."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np

from hingeworks.operators.ranking import LEAST_VARIANCE
from hingeworks.operators.solvers.bnb import fit_budget
from hingeworks.operators.solvers.ipm import Spec, fit, objective


@dataclass
class Fitted:
    """status is optimal, gap_open (the proven gap is wider than asked for), feasible_timeout or failed; selected is 1-based.

    gap: what another fit may be better by at most, where it was proven; passes: over the table, where it was fitted by such.
    """

    w: np.ndarray | None = None
    b: float = 0.0
    v: np.ndarray | None = None
    selected: list[int] = field(default_factory=list)
    objective: float = float("nan")
    status: str = "failed"
    train_time: float = 0.0
    gap: float | None = None
    passes: int | None = None


class LinearModel:
    """fit(x, y), predict(x), decision_function(x), get_selected_features(), get_num_selected_features()."""

    #: Parameters that don't change the fit: points that differ in these only are fitted once.
    ignored: tuple[str, ...] = ()

    def __init__(self, domain: str = "nonneg", time_limit: float | None = None):
        self.domain, self.time_limit, self.fitted = domain, time_limit, Fitted()

    def _fit(self, x: np.ndarray, y: np.ndarray, deadline: float | None) -> Fitted:
        raise NotImplementedError

    def fit(self, x: np.ndarray, y: np.ndarray) -> LinearModel:
        began = time.monotonic()
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        self.fitted = self._fit(x, y, began + self.time_limit if self.time_limit else None)
        self.fitted.train_time = time.monotonic() - began
        return self

    def _ready(self) -> Fitted:
        if self.fitted.w is None:
            raise ValueError("the model is not fitted")
        return self.fitted

    def decision_function(self, x: np.ndarray) -> np.ndarray:
        f = self._ready()
        return np.asarray(x, dtype=float) @ f.w + f.b

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.sign(self.decision_function(x)).astype(int)

    def get_selected_features(self) -> list[int]:
        return list(self._ready().selected)

    def get_num_selected_features(self) -> int:
        return len(self.get_selected_features())


def _plain(x: np.ndarray, y: np.ndarray, spec: Spec) -> Fitted:
    w, b, got = fit(x, y, spec)
    return Fitted(w, b, (w != 0).astype(int), [int(j) + 1 for j in np.flatnonzero(w)], objective(x, y, w, b, spec), "optimal" if got.ok or got.gap < 1e-5 * (1 + abs(got.objective)) else "failed")


class L1SVM(LinearModel):
    def __init__(self, C: float = 1.0, time_limit: float | None = None, domain: str = "nonneg"):  # noqa: N803
        super().__init__(domain, time_limit)
        self.spec = Spec("hinge", "l1", C, domain=domain)

    def _fit(self, x, y, deadline):
        return _plain(x, y, self.spec)


class L2SVM(LinearModel):
    """Features count as selected beyond 1e-6; a failed fit has zero weights."""

    def __init__(self, C: float = 1.0, time_limit: float | None = None, domain: str = "nonneg"):  # noqa: N803
        super().__init__(domain, time_limit)
        self.spec = Spec("hinge", "l2", C, domain=domain)

    def _fit(self, x, y, deadline):
        got = _plain(x, y, self.spec)
        if got.status == "failed":
            n = x.shape[1]
            return Fitted(np.zeros(n), 0.0, np.zeros(n, int), [], objective(x, y, np.zeros(n), 0.0, self.spec), "failed")
        return got


class PinballSVM(LinearModel):
    def __init__(self, C: float = 1.0, tau: float = 0.5, time_limit: float | None = None, domain: str = "nonneg"):  # noqa: N803
        super().__init__(domain, time_limit)
        self.spec = Spec("pinball", "l2", C, tau, domain)

    def _fit(self, x, y, deadline):
        return _plain(x, y, self.spec)


class _Budgeted(LinearModel):
    def __init__(self, spec: Spec, budget: float | None, costs, time_limit, domain):
        super().__init__(domain, time_limit)
        self.spec, self.budget, self.costs = spec, budget, costs
        self.start: tuple[np.ndarray, float] | None = None

    def _fit(self, x, y, deadline):
        w, b, value, status = fit_budget(x, y, self.spec, self.budget, self.costs, deadline, self.start)
        return Fitted(w, b, (w != 0).astype(int), [int(j) + 1 for j in np.flatnonzero(w)], value, status)


class MILP1(_Budgeted):
    """Hinge loss without regulariser; C is accepted and has no effect."""

    ignored = ("C",)

    def __init__(self, B: float | None = None, C: float = 1.0, l_bound: float = -2.0, u_bound: float = 2.0, time_limit: float | None = None, costs=None, domain: str = "nonneg"):  # noqa: N803
        super().__init__(Spec("hinge", "none", 1.0, domain=domain, box=(l_bound, u_bound)), B, costs, time_limit, domain)
        self.C = C


class PinFSSVM(_Budgeted):
    """Pinball loss, L1 regulariser, at most B features."""

    def __init__(self, B: float | None = None, C: float = 1.0, tau: float = 0.5, l_bound: float = -2.0, u_bound: float = 2.0, time_limit: float | None = None, costs=None, domain: str = "nonneg"):  # noqa: N803
        super().__init__(Spec("pinball", "l1", C, tau, domain, (l_bound, u_bound)), B, costs, time_limit, domain)


def fisher_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of all features, with the guards of the table operator."""
    up, down = x[y == 1], x[y == -1]
    var = lambda p: p.var(axis=0, ddof=1) if len(p) > 1 else np.full(x.shape[1], LEAST_VARIANCE)
    mean = x.mean(axis=0)
    far = sum((p.mean(axis=0) - mean) ** 2 if len(p) else np.full(x.shape[1], np.nan) for p in (up, down))
    below = var(up) + var(down)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.where(below == 0, 0.0, far / below), nan=0.0, posinf=0.0, neginf=0.0)


class FisherSVM(LinearModel):
    """L1SVM on the n_features of highest Fisher score (ties to the larger position), selected in score order."""

    def __init__(self, n_features: int = 1, C: float = 1.0, kernel: str = "linear", time_limit: float | None = None, domain: str = "nonneg"):  # noqa: N803
        super().__init__(domain, time_limit)
        self.n_features, self.spec = n_features, Spec("hinge", "l1", C, domain=domain)

    def _fit(self, x, y, deadline):
        n = x.shape[1]
        order = sorted(range(n), key=lambda j, s=fisher_score(x, y): (-s[j], -j))[: min(self.n_features, n)]
        return _scattered(x, y, self.spec, order)


def _scattered(x: np.ndarray, y: np.ndarray, spec: Spec, at: list[int]) -> Fitted:
    got, w = _plain(x[:, at], y, spec), np.zeros(x.shape[1])
    if got.status == "failed":
        return Fitted(w, 0.0, np.zeros(len(w), int), [j + 1 for j in at], objective(x, y, w, 0.0, spec), "failed")
    w[at] = got.w
    v = np.zeros(len(w), dtype=int)
    v[at] = 1
    return Fitted(w, got.b, v, [j + 1 for j in at], got.objective, got.status)


class RFESVM(LinearModel):
    """Drop the feature of least squared weight (first on ties), or half of them, until n_features remain; refit."""

    def __init__(self, n_features: int, C: float = 1.0, kernel: str = "linear", time_limit: float | None = None, domain: str = "nonneg", drop: str = "one"):  # noqa: N803
        super().__init__(domain, time_limit)
        if n_features is None or n_features < 1:
            raise ValueError("n_features must be at least 1")
        self.n_features, self.drop, self.spec = n_features, drop, Spec("hinge", "l1", C, domain=domain)

    def path(self, x: np.ndarray, y: np.ndarray) -> list[list[int]]:
        """Remaining features (0-based) after each elimination."""
        at, out = list(range(x.shape[1])), []
        while len(at) > self.n_features:
            got = _plain(x[:, at], y, self.spec)
            if got.status == "failed":
                break
            gone = 1 if self.drop == "one" else min(len(at) // 2, len(at) - self.n_features)
            worst = set(sorted(range(len(at)), key=lambda i, w=got.w: (w[i] ** 2, i))[:gone])
            at = [j for i, j in enumerate(at) if i not in worst]
            out.append(at)
        return out

    def _fit(self, x, y, deadline):
        steps = self.path(x, y)
        return _scattered(x, y, self.spec, steps[-1] if steps else list(range(x.shape[1])))


MODELS: dict[str, type[LinearModel]] = {m.__name__: m for m in (L1SVM, L2SVM, MILP1, PinballSVM, PinFSSVM, FisherSVM, RFESVM)}


def register(name: str, model: type) -> None:
    """Add a class with fit, predict and fitted of its own."""
    MODELS[name] = model
