"""Primal-dual interior point for linear classifiers: two-piece losses, L1 / L2 / no regulariser, box and budget rows.

minimise   sum_j (q_j u_j^2 / 2 + c_j u_j) + C sum_i xi_i
subject to xi_i >= a_k - d_k g_i.u  (k = 1, 2),   lower <= u <= upper,   A u <= f

with g_i = y_i (x_i, 1). Slack variables are eliminated by hand, so a step factors one matrix of the size of u.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Weights this small are residue of the interior path and count as zero.
RESIDUE = 1e-6


@dataclass
class Solution:
    u: np.ndarray
    objective: float
    gap: float
    infeasibility: float
    iterations: int
    ok: bool
    beaten: bool = False


def loss_pieces(loss: str, tau: float) -> tuple[float, float, float, float]:
    """(a1, d1, a2, d2) of max(a1 - d1 m, a2 - d2 m)."""
    return (1.0, 1.0, 0.0, 0.0) if loss == "hinge" else (1.0, 1.0, -tau, -tau)


def lagrangian(g: np.ndarray, c: np.ndarray, weight: float, pieces: tuple[float, float, float, float], lower: np.ndarray, upper: np.ndarray, rows: np.ndarray, limits: np.ndarray, lam: list[np.ndarray]) -> float:
    """A bound from below on the objective without quadratic part, from any positive multipliers of the two pieces.

    Given the multipliers, scaled to sum to the weight, the rest is linear over the box and one budget row: variables
    in the row are taken in the order of what they gain a unit of budget. -inf if an unbounded variable gains.
    """
    a1, d1, a2, d2 = pieces
    share = weight * lam[0] / (lam[0] + lam[1])
    left = c - g.T @ (d1 * share + d2 * (weight - share))
    value = float(a1 * share.sum() + a2 * (weight - share).sum())
    with np.errstate(invalid="ignore"):
        best = np.minimum(np.where(left == 0, 0.0, left * lower), np.where(left == 0, 0.0, left * upper))
    if not len(rows):
        return value + float(best.sum())
    r, room = rows[0], float(limits[0])
    free = r <= 0
    value += float(best[free].sum())
    gain, need = -np.minimum(best[~free], 0.0), (r * upper)[~free]
    order = np.argsort(-gain / need, kind="stable")
    before = np.cumsum(need[order]) - need[order]
    return value - float((gain[order] * np.clip((room - before) / need[order], 0.0, 1.0)).sum())


def solve(g: np.ndarray, c: np.ndarray, q: np.ndarray, weight: float, pieces: tuple[float, float, float, float], lower: np.ndarray, upper: np.ndarray, rows: np.ndarray | None = None, limits: np.ndarray | None = None, tolerance: float = 1e-9, most: int = 80, above: tuple[float, np.ndarray, np.ndarray] | None = None) -> Solution:
    """above: (value, lower, upper): stop as soon as a bound from below, over these bounds on u, reaches the value (`beaten`)."""
    m, d = g.shape
    a1, d1, a2, d2 = pieces
    rows = np.zeros((0, d)) if rows is None else rows
    limits = np.zeros(0) if limits is None else limits
    has_l, has_u = np.isfinite(lower), np.isfinite(upper)
    u = np.zeros(d)
    u[has_l] = lower[has_l] + 1.0
    u[has_u] = upper[has_u] - 1.0
    u[has_l & has_u] = (lower[has_l & has_u] + upper[has_l & has_u]) / 2
    score = g @ u
    xi = np.maximum(a1 - d1 * score, a2 - d2 * score) + 1.0
    s = [xi - a1 + d1 * score, xi - a2 + d2 * score]
    lam = [np.full(m, weight / 2), np.full(m, weight / 2)]
    sl, su = (u - lower)[has_l], (upper - u)[has_u]
    ml, mu_ = np.ones(has_l.sum()), np.ones(has_u.sum())
    sa = np.maximum(limits - rows @ u, 1.0)
    nu = np.ones(len(limits))
    count = 2 * m + len(sl) + len(su) + len(sa)
    scale = 1.0 + abs(weight) * m
    best = None
    for it in range(1, most + 1):
        score = g @ u
        rp = [s[0] - (xi - a1 + d1 * score), s[1] - (xi - a2 + d2 * score)]
        ra = sa - (limits - rows @ u)
        r_xi = weight - lam[0] - lam[1]
        r_u = q * u + c - g.T @ (d1 * lam[0] + d2 * lam[1]) + rows.T @ nu
        r_u[has_l] -= ml
        r_u[has_u] += mu_
        total = lam[0] @ s[0] + lam[1] @ s[1] + ml @ sl + mu_ @ su + nu @ sa
        value = float(0.5 * (q * u) @ u + c @ u + weight * np.maximum(a1 - d1 * score, a2 - d2 * score).sum())
        bad = max(np.abs(rp[0]).max(initial=0), np.abs(rp[1]).max(initial=0), np.abs(ra).max(initial=0), np.abs(r_u).max(initial=0) / scale, np.abs(r_xi).max(initial=0))
        best = Solution(u.copy(), value, float(total), float(bad), it, False)
        if total <= tolerance * (1 + abs(value)) and bad <= 1e-7:
            best.ok = True
            break
        if above is not None and it > 4 and lagrangian(g, c, weight, pieces, above[1], above[2], rows, limits, lam) >= above[0]:
            best.beaten = True
            break
        mu = total / count
        dk = [lam[0] / s[0], lam[1] / s[1]]
        both, mixed = dk[0] + dk[1], d1 * dk[0] + d2 * dk[1]
        k = dk[0] * dk[1] * (d1 - d2) ** 2 / both
        dl, du_, da = ml / sl, mu_ / su, nu / sa
        h = (g.T * k) @ g + (rows.T * da) @ rows
        diag = q.copy()
        diag[has_l] += dl
        diag[has_u] += du_
        h[np.diag_indices(d)] += diag + 1e-12 * (1 + np.trace(h) / d)
        try:
            factor = np.linalg.cholesky(h)
        except np.linalg.LinAlgError:
            h[np.diag_indices(d)] += 1e-8 * (1 + np.abs(h).max())
            try:
                factor = np.linalg.cholesky(h)
            except np.linalg.LinAlgError:
                break

        def step(comp):
            e = [comp[0] / s[0] + dk[0] * rp[0], comp[1] / s[1] + dk[1] * rp[1]]
            el, eu, ea = comp[2] / sl, comp[3] / su, comp[4] / sa + da * ra
            rhs = -r_u + g.T @ (d1 * e[0] + d2 * e[1] - mixed * (e[0] + e[1] - r_xi) / both) - rows.T @ ea
            rhs[has_l] += el
            rhs[has_u] -= eu
            x = np.linalg.solve(factor.T, np.linalg.solve(factor, rhs))
            dg = g @ x
            dxi = (e[0] + e[1] - r_xi - mixed * dg) / both
            dlam = [e[0] - dk[0] * (dxi + d1 * dg), e[1] - dk[1] * (dxi + d2 * dg)]
            ds = [dxi + d1 * dg - rp[0], dxi + d2 * dg - rp[1]]
            ax = rows @ x
            return x, dxi, dlam, ds, el - dl * x[has_l], eu + du_ * x[has_u], ea + da * ax, x[has_l], -x[has_u], -ax - ra

        def longest(move):
            _, _, dlam, ds, dml, dmu, dnu, dsl, dsu, dsa = move
            reach = 1.0
            for v, dv in ((s[0], ds[0]), (s[1], ds[1]), (lam[0], dlam[0]), (lam[1], dlam[1]), (sl, dsl), (su, dsu), (ml, dml), (mu_, dmu), (sa, dsa), (nu, dnu)):
                low = dv < 0
                if low.any():
                    reach = min(reach, float((-v[low] / dv[low]).min()))
            return reach

        plain = [-lam[0] * s[0], -lam[1] * s[1], -ml * sl, -mu_ * su, -nu * sa]
        aff = step(plain)
        reach = longest(aff)
        _, _, dlam, ds, dml, dmu, dnu, dsl, dsu, dsa = aff
        after = sum(float((v + reach * dv) @ (w + reach * dw)) for v, dv, w, dw in ((lam[0], dlam[0], s[0], ds[0]), (lam[1], dlam[1], s[1], ds[1]), (ml, dml, sl, dsl), (mu_, dmu, su, dsu), (nu, dnu, sa, dsa)))
        sigma = (max(after, 0.0) / total) ** 3
        fix = sigma * mu
        comp = [plain[0] + fix - dlam[0] * ds[0], plain[1] + fix - dlam[1] * ds[1], plain[2] + fix - dml * dsl, plain[3] + fix - dmu * dsu, plain[4] + fix - dnu * dsa]
        move = step(comp)
        t = min(1.0, 0.995 * longest(move))
        x, dxi, dlam, ds, dml, dmu, dnu, dsl, dsu, dsa = move
        u, xi = u + t * x, xi + t * dxi
        s = [s[0] + t * ds[0], s[1] + t * ds[1]]
        lam = [lam[0] + t * dlam[0], lam[1] + t * dlam[1]]
        sl, su, sa = sl + t * dsl, su + t * dsu, sa + t * dsa
        ml, mu_, nu = ml + t * dml, mu_ + t * dmu, nu + t * dnu
    return best


@dataclass(frozen=True)
class Spec:
    """loss hinge or pinball, reg none, l1 or l2; domain nonneg bounds w and b below by 0, free does not; box bounds |w| parts."""

    loss: str = "hinge"
    reg: str = "l1"
    c: float = 1.0
    tau: float = 0.5
    domain: str = "nonneg"
    box: tuple[float, float] | None = None


def objective(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, spec: Spec) -> float:
    a1, d1, a2, d2 = loss_pieces(spec.loss, spec.tau)
    m = y * (x @ w + b)
    reg = {"none": 0.0, "l1": float(np.abs(w).sum()), "l2": 0.5 * float(w @ w)}[spec.reg]
    return reg + spec.c * float(np.maximum(a1 - d1 * m, a2 - d2 * m).sum())


def fit(x: np.ndarray, y: np.ndarray, spec: Spec, limit_row: tuple[np.ndarray, float] | None = None, above: tuple[float, float] | None = None) -> tuple[np.ndarray, float, Solution]:
    """(w, b, solution). limit_row (r, f) adds sum_j r_j |w_j| <= f. above (value, most) stops early once no fit with |b| <= most is better than value."""
    m, n = x.shape
    free = spec.domain == "free"
    low, high = spec.box if spec.box else (-np.inf, np.inf)
    parts = [x, -x] if free else [x]  # free weights are a difference of two non-negative parts
    g = y[:, None] * np.hstack([*parts, np.ones((m, 1))])
    d = g.shape[1]
    lower = np.zeros(d)
    lower[-1] = -np.inf if free else 0.0
    upper = np.full(d, np.inf)
    upper[:n] = max(high, 0.0)
    if free:
        upper[n : 2 * n] = max(-low, 0.0)
    c, q = np.zeros(d), np.zeros(d)
    if spec.reg == "l1":
        c[:-1] = 1.0
    elif spec.reg == "l2":
        q[:-1] = 1.0
    if free and spec.reg != "l1":
        c[:-1] += 1e-9  # keeps the two parts from growing together
    rows = limits = None
    if limit_row is not None:
        r, f = limit_row
        rows, limits = np.concatenate([*([r] * len(parts)), [0.0]])[None, :], np.array([f])
    if above is not None and not q.any():
        value, most = above
        above = (value, np.r_[lower[:-1], max(lower[-1], -most)], np.r_[upper[:-1], most])
    else:
        above = None
    got = solve(g, c, q, spec.c, loss_pieces(spec.loss, spec.tau), lower, upper, rows, limits, above=above)
    w = got.u[:n] - got.u[n : 2 * n] if free else got.u[:n].copy()
    w[np.abs(w) < RESIDUE] = 0.0
    b = float(got.u[-1])
    if not free and b < RESIDUE:
        b = 0.0
    return w, b, got
