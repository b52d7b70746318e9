"""Certificates, brute force and metamorphic properties of the fits."""

import itertools
import time

import numpy as np
import pytest

from hingeworks.operators import models
from hingeworks.operators.models import L1SVM, L2SVM, MILP1, FisherSVM, PinballSVM, PinFSSVM, RFESVM, fisher_score
from hingeworks.operators.solvers.bnb import _on, fit_budget
from hingeworks.operators.solvers import bnb, passes
from hingeworks.operators.solvers.ipm import Spec, fit, loss_pieces, objective


def problem(seed, m=40, n=6):
    r = np.random.default_rng(seed)
    x = r.normal(size=(m, n))
    return x, np.where(x @ r.normal(size=n) + r.normal(size=m) > 0, 1.0, -1.0)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("domain", ["nonneg", "free"])
@pytest.mark.parametrize("loss,reg", [("hinge", "l1"), ("hinge", "l2"), ("pinball", "l2"), ("pinball", "l1")])
def test_solution_is_feasible_and_optimal(seed, domain, loss, reg):
    x, y = problem(seed)
    spec = Spec(loss, reg, 0.7, 0.3, domain)
    w, b, got = fit(x, y, spec)
    assert got.infeasibility <= 1e-6 and got.gap <= 1e-6 * (1 + abs(got.objective))
    if domain == "nonneg":
        assert (w >= 0).all() and b >= 0
    value = objective(x, y, w, b, spec)
    rng = np.random.default_rng(seed)
    for scale in (1e-3, 1e-2, 0.3):
        for _ in range(60):
            w2, b2 = w + scale * rng.normal(size=len(w)), b + scale * rng.normal()
            if domain == "nonneg":
                w2, b2 = np.maximum(w2, 0), max(b2, 0)
            assert objective(x, y, w2, b2, spec) >= value - 1e-5 * (1 + value)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("domain", ["nonneg", "free"])
@pytest.mark.parametrize("loss,reg,budget", [("pinball", "l1", 2), ("hinge", "none", 3)])
def test_budget_matches_all_supports(seed, domain, loss, reg, budget):
    x, y = problem(seed)
    spec = Spec(loss, reg, 1.0, 0.5, domain, (-2.0, 2.0))
    best = min(_on(x, y, spec, np.isin(np.arange(6), c))[2] for c in itertools.combinations(range(6), budget))
    w, _, value, status = fit_budget(x, y, spec, budget)
    assert status == "optimal" and (w != 0).sum() <= budget
    assert abs(best - value) <= 1e-5 * (1 + abs(best))


def test_budget_is_monotone_and_reaches_the_plateau():
    x, y = problem(3, 60)
    values = [PinFSSVM(B=b, C=1.0, tau=0.5, domain="free").fit(x, y).fitted.objective for b in range(1, 7)]
    assert all(a >= b - 1e-6 for a, b in zip(values, values[1:]))
    assert abs(values[-1] - PinFSSVM(B=None, C=1.0, tau=0.5, domain="free").fit(x, y).fitted.objective) < 1e-6


def test_costs_bound_the_sum():
    x, y = problem(4)
    f = MILP1(B=3.0, costs=[1, 2, 1, 2, 1, 2], domain="free").fit(x, y).fitted
    assert sum(c for c, v in zip([1, 2, 1, 2, 1, 2], f.w) if v) <= 3


def test_milp_ignores_c_and_free_is_no_worse():
    x, y = problem(5)
    a, b = MILP1(B=2, C=0.1).fit(x, y), MILP1(B=2, C=30.0).fit(x, y)
    assert a.fitted.objective == b.fitted.objective
    for model in (L1SVM, L2SVM, PinballSVM):
        assert model(domain="free").fit(x, y).fitted.objective <= model().fit(x, y).fitted.objective + 1e-6


def test_doubled_rows_at_half_weight_are_the_same_problem():
    x, y = problem(6)
    a = L2SVM(C=1.0, domain="free").fit(x, y).fitted
    b = L2SVM(C=0.5, domain="free").fit(np.vstack([x, x]), np.r_[y, y]).fitted
    assert np.allclose(a.w, b.w, atol=1e-4)


def test_pinball_tends_to_hinge():
    x, y = problem(7)
    a = fit(x, y, Spec("pinball", "l2", 1.0, 1e-7, "free"))[2].objective
    b = fit(x, y, Spec("hinge", "l2", 1.0, domain="free"))[2].objective
    assert abs(a - b) < 1e-3


def test_timeout_returns_the_incumbent():
    x, y = problem(8, 200, 20)
    f = fit_budget(x, y, Spec("hinge", "none", 1.0, domain="free", box=(-2.0, 2.0)), 5, deadline=time.monotonic() - 1)
    assert f[3] == "feasible_timeout" and (f[0] != 0).sum() <= 5


def test_fisher_and_rfe_keep_their_lists():
    x, y = problem(9)
    f = FisherSVM(n_features=3).fit(x, y)
    order = sorted(range(6), key=lambda j, s=fisher_score(x, y): (-s[j], -j))[:3]
    assert f.get_selected_features() == [j + 1 for j in order] and f.get_num_selected_features() == 3
    r = RFESVM(n_features=2).fit(x, y)
    assert len(r.get_selected_features()) == 2
    with pytest.raises(ValueError):
        RFESVM(n_features=0)
    ties = np.hstack([x[:, :1], x[:, :1]])
    assert RFESVM(n_features=1).fit(ties, y).fitted.w.shape == (2,)


def test_unfitted_and_constant_column():
    with pytest.raises(ValueError):
        L1SVM().predict(np.zeros((1, 2)))
    x, y = problem(10)
    x[:, 1] = 0
    assert fisher_score(x, y)[1] == 0
    assert L1SVM().fit(x, y).fitted.w[1] == 0


def test_any_class_can_join():
    class Always(models.LinearModel):
        def _fit(self, x, y, deadline):
            return models.Fitted(np.zeros(x.shape[1]), 1.0, status="optimal")

    models.register("Always", Always)
    try:
        assert (models.MODELS["Always"]().fit(np.zeros((3, 2)), np.ones(3)).predict(np.zeros((3, 2))) == 1).all()
    finally:
        del models.MODELS["Always"]


def _answered(work, x, y):
    """A work's result from sums over rows at hand, and the number of its questions."""
    asked, got = 0, next(work)
    while True:
        sums = []
        for a in got:
            k, v = len(a.at) + 1, np.zeros(a.numbers)
            passes._add(v, x[:, a.at], y, y * (x[:, a.at] @ a.u[:-1] + a.u[-1]), np.ones(len(y)), a.width, loss_pieces(a.spec.loss, a.spec.tau))
            sums.append(passes.Sums(float(v[0]), float(v[1]), v[2 : 2 + k], v[2 + k : 2 + 2 * k], v[2 + 2 * k : 2 + 3 * k], v[2 + 3 * k : 2 + 4 * k], v[2 + 4 * k :].reshape(k, k)))
        asked += len(got)
        try:
            got = work.send(sums)
        except StopIteration as e:
            return e.value, asked


@pytest.mark.parametrize("spec,most", [(Spec("pinball", "l1", 1.0, 0.5, box=(-2.0, 2.0)), 300), (Spec("hinge", "none", 1.0, box=(-2.0, 2.0)), 700)])
def test_a_budget_search_asks_little(spec, most):
    """Relaxations are not solved again for what they keep, and roundings end once they can't win."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(400, 16)), np.where(rng.random(400) < 0.5, 1.0, -1.0)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    of = lambda s: passes.Moments(passes.Moments.of(x[s], np.ones(s.sum())), 16)
    side = passes.Side(of(y != 0), {1: of(y > 0), -1: of(y < 0)})
    (fit,), asked = _answered(passes.budget_search(side, None, 16, spec, [4], None, 1e-6), x, y)
    value = fit_budget(x, y, spec, 4)[2]
    assert abs(fit.value - value) <= 2e-6 * (1 + value) and fit.gap <= 1e-6 * (1 + fit.value)
    assert asked <= most


@pytest.mark.parametrize("spec", [Spec("pinball", "l1", 1.0, 0.5, box=(-2.0, 2.0)), Spec("hinge", "none", 1.0, domain="free", box=(-2.0, 2.0))])
def test_a_budget_search_solves_few_nodes_over_all_rows(spec, monkeypatch):
    """Nodes are bounded by the rows near the bend; the interior point is for what is offered."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(300, 14)), np.where(rng.random(300) < 0.5, 1.0, -1.0)
    best = min(_on(x, y, spec, np.isin(np.arange(14), c))[2] for c in itertools.combinations(range(14), 3))
    calls, solve = [], bnb._on
    monkeypatch.setattr(bnb, "_on", lambda *a: calls.append(1) or solve(*a))
    w, _, value, status = fit_budget(x, y, spec, 3)
    assert status == "optimal" and (w != 0).sum() <= 3 and abs(value - best) <= 2e-6 * (1 + best)
    assert len(calls) <= 40
