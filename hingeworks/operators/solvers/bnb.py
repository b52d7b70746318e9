"""Branch and bound for fits with a limit on the features used."""

from __future__ import annotations

import time
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np

from hingeworks.operators.solvers.ipm import Spec, fit, loss_pieces, objective
from hingeworks.operators.solvers.passes import Ask, Fit, Sums, _add, newton

#: Relative distance to the bound at which a fit counts as optimal.
GAP = 1e-6


#: Nodes from the root on at which the relaxation is rounded; features that a swap tries for each it takes out.
ROUNDED, SWAPS = 40, 6
#: Margin from which on a row's loss is summed as it is when a node is bounded (at 1 it bends; below, it is a line); the
#: width that such fits begin with; the share of the most that a row must bend by for their curvature; rows summed at once;
#: the share of what a last feature must save that a group of them may, by their slopes and curvature.
BENT, WIDTH, FLAT, BLOCK, SAVED = 0.3, 0.05, 1e-3, 8192, 0.6
#: The relative gap of fits that others only start from.
CENTRED = 1e-4

#: Features kept in and left out, weights and intercept to start from, and whether the relaxation is known to be open.
Node = tuple[np.ndarray, np.ndarray, np.ndarray, bool]
Best = tuple[np.ndarray, float, float]


@dataclass
class Part:
    """Rows whose margin may reach the bend, and the sums of the features and 1 over the others, by label.

    The others count with the first piece of their loss, which is never above it: a bound for the part is one for all rows.
    """

    x: np.ndarray
    y: np.ndarray
    up: np.ndarray
    down: np.ndarray

    def of(self, at: np.ndarray) -> Part:
        ends = np.r_[at, -1]
        return Part(self.x[:, at], self.y, self.up[ends], self.down[ends])

    def sums(self, u: np.ndarray, width: float, pieces: tuple[float, float, float, float]) -> Sums:
        k, (a1, d1, _, _) = len(u), pieces
        v = np.zeros(2 + 4 * k + k * k)
        for i in range(0, len(self.y), BLOCK):
            x, y = self.x[i : i + BLOCK], self.y[i : i + BLOCK]
            _add(v, x, y, y * (x @ u[:-1] + u[-1]), np.ones(len(y)), width, pieces, FLAT)
        line = a1 * (self.up[-1] + self.down[-1]) - d1 * float((self.up - self.down) @ u)
        parts = v[2 : 2 + 4 * k].reshape(4, k)
        return Sums(float(v[0] + line), float(v[1] + line), parts[0] - d1 * (self.up - self.down), parts[1] - d1 * self.up, parts[2], parts[3], v[2 + 4 * k :].reshape(k, k))


def _on(x: np.ndarray, y: np.ndarray, spec: Spec, use: np.ndarray, row=None, above=None) -> tuple[np.ndarray, float, float]:
    """Fit on the features of a mask: full weights, intercept, objective (infinite once it is known to reach `above`)."""
    n = x.shape[1]
    at = np.flatnonzero(use)
    w, b, got = fit(x[:, at], y, spec, None if row is None else (row[0][at], row[1]), above)
    full = np.zeros(n)
    full[at] = w
    return full, b, np.inf if got.beaten else objective(x, y, full, b, spec)


class Search:
    """Branch and bound for one problem: the sum of costs of non-zero weights is at most budget.

    A node fixes some features in and some out; the rest are relaxed to |w_j| / box, whose summed cost the budget
    bounds. Nodes branch on the largest relaxed weight.

    A node is first bounded by Newton steps on the smoothed loss of the rows near its bend (`passes.newton`), from the
    weights of the node before, and without the budget's limit: they end as soon as the bound reaches the incumbent, or a
    weight vector is better, so that the node is open. Where only one more feature has room, each is tried at once, from one
    fit of those kept. What is offered as a fit, and nodes of whose relaxation the budget may be the limit, are solved by the
    interior point over all rows; such a fit, too, ends as soon as its bound reaches the incumbent.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, spec: Spec, budget: float, costs: np.ndarray | None = None):
        self.x, self.y, self.spec, self.budget = x, y, spec, budget
        self.n = x.shape[1]
        self.costs = np.ones(self.n) if costs is None else np.asarray(costs, dtype=float)
        self.top = max(abs(v) for v in spec.box) if spec.box else None
        # with weights in the box an optimal intercept is 0 or meets a row's margin
        cheap = np.cumsum(np.sort(self.costs))
        many = int((cheap <= budget + 1e-9).sum())
        self.most = 1.0 + (self.top or 0.0) * float(np.sort(np.abs(x), axis=1)[:, self.n - many :].sum(axis=1).max(initial=0.0)) if many else 1.0
        self.best: Best | None = None
        self.rounds = self.explored = 0
        low, high = spec.box if spec.box else (0.0, 0.0)
        self.quick = high > 0 and spec.reg != "l2" and (spec.domain == "nonneg" or low < 0)
        self.side = SimpleNamespace(reach=float(np.abs(x).max(initial=0.0)))
        self.total = [np.r_[x[y == s].sum(axis=0), (y == s).sum()] for s in (1, -1)]

    def affordable(self, w: np.ndarray) -> bool:
        return self.costs[w != 0].sum() <= self.budget + 1e-9

    def offer(self, w: np.ndarray, b: float) -> bool:
        if not self.affordable(w):
            return False
        value = objective(self.x, self.y, w, b, self.spec)
        if self.best is None or value < self.best[2] - 1e-12:
            self.best = (w, b, value)
            return True
        return False

    def rounded(self, w: np.ndarray, keep: np.ndarray, out: np.ndarray, b: float | None = None) -> None:
        order = sorted(range(self.n), key=lambda j: (not keep[j], -abs(w[j]), j))
        use, left = np.zeros(self.n, dtype=bool), self.budget
        for j in order:
            if not out[j] and self.costs[j] <= left + 1e-9 and (keep[j] or w[j] != 0):
                use[j], left = True, left - self.costs[j]
        if use.any():
            self.tried(use, None if b is None else np.r_[np.where(use, w, 0.0), b])

    def swapped(self) -> None:
        """Take one feature out of the incumbent and one in, as long as that helps; those that would lower the loss most are tried."""
        better = True
        while better:
            better = False
            w, b, _ = self.best
            for i in np.flatnonzero(w):
                use = w != 0
                use[i] = False
                rest = _on(self.x, self.y, self.spec, use)
                margin = self.y * (self.x @ rest[0] + rest[1])
                pull = np.where(margin < 1, 1.0, -self.spec.tau if self.spec.loss == "pinball" else 0.0) * self.y @ self.x
                pull = pull if self.spec.domain == "nonneg" else np.abs(pull)
                pull[use] = -np.inf
                for j in np.argsort(-pull, kind="stable")[:SWAPS]:
                    if j != i and pull[j] > 0:
                        more = use.copy()
                        more[j] = True
                        better |= self.tried(more, np.r_[rest[0], rest[1]])
                if better:
                    break

    def goal(self) -> float:
        """What a node's bound must reach for it to hold no better fit."""
        return np.inf if self.best is None else self.best[2] - GAP * max(1.0, abs(self.best[2]))

    def part(self, u: np.ndarray) -> Part:
        near = self.y * (self.x @ u[:-1] + u[-1]) > BENT
        x, y = self.x[near], self.y[near]
        return Part(x, y, *[t - np.r_[x[y == s].sum(axis=0), (y == s).sum()] for t, s in zip(self.total, (1, -1))])

    def bounded(self, part: Part, at: np.ndarray, start: np.ndarray, goal: float, first: Sums | None = None) -> tuple[Fit, np.ndarray]:
        """A fit of features on a part (which has just these), until its bound reaches the goal or it is better itself, and
        where it came to at the first width, of all features: a like fit takes fewer steps from there than from the best
        weights. first: the sums at the start."""
        pieces, ends = loss_pieces(self.spec.loss, self.spec.tau), np.isfinite(goal)
        work = newton(self.side, None, at, self.spec, GAP / 2 if ends else CENTRED, start, WIDTH, goal=lambda: goal, coarse=np.inf if ends else None, least=self.best[2])
        (ask,) = next(work)
        centre = np.zeros(self.n + 1)
        while True:
            if ask.width == WIDTH:
                centre[np.r_[at, self.n]] = ask.u
            try:
                (ask,) = work.send([part.sums(ask.u, ask.width, pieces) if first is None else first])
            except StopIteration as e:
                return e.value, centre
            first = None

    def probed(self, at: np.ndarray, start: np.ndarray, goal: float) -> tuple[Fit, np.ndarray]:
        """The same on the rows near the bend at the start, and again on those at its end if it looks open there only."""
        got, centre = self.bounded(self.part(start).of(at), at, np.r_[start[at], start[-1]], goal)
        if not got.beaten and objective(self.x, self.y, got.full(self.n), got.b, self.spec) >= goal:
            got, centre = self.bounded(self.part(np.r_[got.full(self.n), got.b]).of(at), at, np.r_[centre[at], centre[-1]], goal)
        return got, centre

    def tried(self, use: np.ndarray, start: np.ndarray | None = None) -> bool:
        """Offer the fit of some features, unless it is found to be no better."""
        at = np.flatnonzero(use)
        if self.quick and self.best is not None and start is not None and len(at) and self.probed(at, start, self.goal())[0].beaten:
            return False
        return self.offer(*_on(self.x, self.y, self.spec, use)[:2])

    def last(self, keep: np.ndarray, loose: np.ndarray, start: np.ndarray) -> None:
        """Try each of the loose features together with those kept: first in groups, whose joint fit is a bound for each of theirs."""
        own, more = np.flatnonzero(keep), np.flatnonzero(loose)
        if not len(own):
            size = np.linalg.norm(start[:-1])  # as far as all of them go together
            for j in more:
                self.explored += 1
                self.tried(np.arange(self.n) == j, np.r_[np.where(np.arange(self.n) == j, -size if start[j] < 0 else size, 0.0), start[-1]])
            return
        u = np.where(np.r_[keep, True], start, 0.0)
        for _ in range(2):  # the second time on the rows near the bend of the first fit
            fit, u = self.bounded(self.part(u).of(own), own, np.r_[u[own], u[-1]], np.inf)
        at, part = np.r_[own, more], self.part(u)
        part = part.of(at)
        sums = part.sums(np.r_[u[at], u[-1]], WIDTH, loss_pieces(self.spec.loss, self.spec.tau))
        pull = -self.spec.c * sums.grad[len(own) : -1]
        pull = np.maximum((pull if self.spec.domain == "nonneg" else np.abs(pull)) - (self.spec.reg == "l1"), 0.0)
        gain = pull**2 / (2 * self.spec.c * np.maximum(np.diag(sums.curve)[len(own) : -1], 1e-12))  # about what each would save
        room, order = SAVED * (fit.value - self.goal()), np.argsort(gain, kind="stable")
        group = np.floor(np.cumsum(gain[order]) / room) if room > 0 else np.arange(len(order))
        stack = [order[group == k] for k in np.unique(group)]
        while stack:
            now = stack.pop()
            mine = np.r_[np.arange(len(own)), len(own) + now]
            ends = np.r_[mine, -1]
            first = Sums(sums.loss, sums.exact, sums.grad[ends], sums.up[ends], sums.drift[ends], sums.lift[ends], sums.curve[np.ix_(ends, ends)])
            self.explored += 1
            got, centre = self.bounded(part.of(mine), at[mine], np.r_[u[at[mine]], u[-1]], self.goal(), first)
            if got.beaten:
                continue
            if len(now) > 1:  # together they leave it open
                stack += [now[: (len(now) + 1) // 2], now[(len(now) + 1) // 2 :]]
            else:
                self.tried(np.isin(np.arange(self.n), at[mine]), centre)

    def begin(self, start: tuple[np.ndarray, float] | None = None) -> list[Node]:
        """Incumbents, and the root if it is open."""
        w, b, value = _on(self.x, self.y, self.spec, np.ones(self.n, dtype=bool))
        if self.affordable(w):
            self.best = (w, b, value)
            return []
        none = np.zeros(self.n, dtype=bool)
        self.offer(np.zeros(self.n), _on(self.x, self.y, self.spec, none)[1])
        if start is not None:
            self.offer(*start)
        self.rounded(w, none, none)
        self.swapped()
        u = np.r_[w, b]
        return [(none, none, self.bounded(self.part(u), np.arange(self.n), u, np.inf)[1] if self.quick else u, True)]

    def step(self, node: Node) -> list[Node]:
        """The open children of a node, the one to go first last."""
        self.explored += 1
        keep, out, start, known = node
        left = self.budget - self.costs[keep].sum()
        if left < -1e-9:
            return []
        out = out | (~keep & (self.costs > left + 1e-9))
        loose = ~keep & ~out
        w, b = np.where(out, 0.0, start[:-1]), start[-1]
        final = self.costs[loose].sum() <= left + 1e-9
        if self.quick and self.best is not None and not final:
            if np.sort(self.costs[loose])[:2].sum() > left + 1e-9:
                self.last(keep, loose, np.r_[w, b])
                return []
            if not known or (w != start[:-1]).any():
                got, u = self.probed(np.flatnonzero(~out), np.r_[w, b], self.goal())
                if got.beaten:
                    return []
                w, b = u[:-1], u[-1]
        if final and self.quick:
            self.tried(~out, np.r_[w, b])
            return []
        spent = np.where(keep, 0.0, self.costs) @ np.abs(w)
        if not self.quick or self.best is None or spent > left * self.top or self.costs[keep | (w != 0)].sum() <= self.budget + 1e-9:
            row = (np.where(keep, 0.0, self.costs / self.top), max(left, 0.0)) if self.top else None
            goal = self.goal()
            w, b, bound = _on(self.x, self.y, self.spec, ~out, row, (goal, self.most) if np.isfinite(goal) and self.top else None)
            if bound >= goal:
                return []
            if self.costs[keep | (w != 0)].sum() <= self.budget + 1e-9:
                self.offer(w, b)
                return []
        if self.rounds < ROUNDED and not known:
            self.rounds += 1
            self.rounded(w, keep, out, b)
        at = np.flatnonzero(loose & (w != 0))
        j = at[np.argmax(np.abs(w[at]))]
        without, within, u = out.copy(), keep.copy(), np.r_[w, b]
        without[j] = within[j] = True
        return [(keep, without, np.where(np.arange(self.n + 1) == j, 0.0, u), False), (within, out, u, True)]

    def some(self, nodes: list[Node], limit: int) -> list[Node]:
        """Depth first for about `limit` nodes: those that are open then, the shallowest first."""
        stack, end = list(reversed(nodes)), self.explored + limit
        while stack and self.explored < end:
            stack += self.step(stack.pop())
        return stack

    def run(self, nodes: list[Node], deadline: float | None = None) -> str:
        """Depth first to the end: optimal, or feasible_timeout beyond a deadline."""
        stack = list(nodes)
        while stack:
            if deadline is not None and time.monotonic() > deadline:
                return "feasible_timeout"
            stack += self.step(stack.pop())
        return "optimal"


def fit_budget(x: np.ndarray, y: np.ndarray, spec: Spec, budget: float | None, costs: np.ndarray | None = None, deadline: float | None = None, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float, float, str]:
    """(w, b, objective, status): the sum of costs of non-zero weights is at most budget; None is no limit.

    `start` is a feasible (w, b), such as the fit for a smaller budget. Status is optimal or feasible_timeout.
    """
    if budget is None:
        return (*_on(x, y, spec, np.ones(x.shape[1], dtype=bool)), "optimal")
    search = Search(x, y, spec, budget, costs)
    status = search.run(search.begin(start), deadline)
    return (*search.best, status)
