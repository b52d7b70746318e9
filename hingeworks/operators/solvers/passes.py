"""Fits of tables of any size, by passes over the table that all fits share.

A fit is a generator that asks for sums at a point and gets them from the next pass, so any number of fits (folds, grid
points, nodes of a search for the best few features) moves on together, and the number of passes is that of the slowest.
A pass sums, for each question, the loss smoothed over a width, its gradient and its curvature: (k + 1)^2 numbers for k
features, whatever the number of rows. A fit takes Newton steps on the smoothed loss while the width shrinks; the slopes
of the smoothed loss are multipliers that prove a bound below every fit, so each ends with a gap that is proven. Rows that
are equal may be one row with a weight (`condensed`), so passes over a table of few distinct rows don't grow with it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hingeworks.operators.ranking import LEAST_VARIANCE
from hingeworks.operators.solvers.ipm import RESIDUE, Spec, loss_pieces

#: Numbers that a pass sums in a task at most, and that may come to the driver without a merge of their own; partitions whose sums may.
MOST_SUMS, MOST_SENT, MOST_PARTS = 2_000_000, 1_000_000, 64
#: Nodes of a search that a pass works on; the relative gap at which a node's relaxation is branched; roundings for all open budgets.
MOST_OPEN, LOOSE, ROUNDINGS = 64, 1e-2, 60
#: What the width shrinks by, as soon as a step promises less than this share of what the smoothing leaves open; steps at
#: a width that needn't shrink; its least value, and passes of a fit at most.
SHRINK, SETTLED, CENTRED, LEAST_WIDTH, MOST_PASSES = 0.3, 0.01, 6, 1e-9, 150
#: Rows for each distinct one from which on equal rows become one; distinct rows of a partition then.
REPEATS, DISTINCT_ROWS = 4, 50_000
#: The fold of rows without one: they are in every training side.
NO_FOLD = -(1 << 24)


@dataclass
class Ask:
    """Sums over rows outside `fold` (None: all rows) at weights and intercept u of the features `at`, in that side's scaled coordinates."""

    fold: int | None
    at: np.ndarray
    u: np.ndarray
    width: float
    spec: Spec

    @property
    def numbers(self) -> int:
        k = len(self.at) + 1
        return 2 + 4 * k + k * k


@dataclass
class Count:
    """The rows of `fold` (None: all rows) as a 2 x 3 table: labels 1, -1 by predictions 1, 0, -1 of u."""

    fold: int | None
    at: np.ndarray
    u: np.ndarray
    numbers: int = 6


@dataclass
class Sums:
    """loss: smoothed; exact: as it is; grad and curve: of the smoothed loss; up: the gradient's part of label 1; drift: the gradient's change with the width; lift: the curvature's last column, of label 1."""

    loss: float
    exact: float
    grad: np.ndarray
    up: np.ndarray
    drift: np.ndarray
    lift: np.ndarray
    curve: np.ndarray


@dataclass
class Fit:
    """Weights of the features at, intercept, objective, a bound below all fits, and passes taken.

    beaten: the bound reached the goal; bounds: below all fits within each of the rooms that were asked about.
    """

    at: np.ndarray
    w: np.ndarray
    b: float
    value: float
    bound: float
    passes: int
    beaten: bool = False
    bounds: np.ndarray | None = None

    @property
    def gap(self) -> float:
        return float(max(self.value - self.bound, 0.0))

    def full(self, n: int) -> np.ndarray:
        out = np.zeros(n)
        out[self.at] = np.where(np.abs(self.w) < RESIDUE, 0.0, self.w)
        return out


#: The side of all rows, unscaled.
RAW = -(1 << 40)

#: A generator that yields lists of questions, receives the answers in the same order, and returns its result.
Work = Generator[list[Ask | Count], list, object]


def reduced(parts: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], partitions: int, numbers: int) -> dict[int, np.ndarray]:
    """Vectors (id int, v array<double>) of all tasks merged by id: on the driver if they are few, before that in tasks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("v")
            for i, key in enumerate(batch.column("id").to_pylist()):
                v = vectors[i].values.to_numpy()
                held[key] = v if key not in held else merge(held[key], v)
        for key, v in held.items():
            yield _row(key, v)

    if partitions > MOST_PARTS:
        width = int(partitions**0.5)
        parts, partitions = parts.repartition(width).mapInArrow(run, "id int, v array<double>"), width
    if partitions * numbers > MOST_SENT:
        parts = parts.repartition(max(1, min(partitions, numbers // 100_000)), "id").mapInArrow(run, "id int, v array<double>")
    out: dict[int, np.ndarray] = {}
    table = parts.toArrow()
    for chunk in table.to_batches():
        for i, key in enumerate(chunk.column("id").to_pylist()):
            v = chunk.column("v")[i].values.to_numpy()
            out[key] = v if key not in out else merge(out[key], v)
    return out


def _row(key: int, v: np.ndarray) -> pa.RecordBatch:
    values = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), values], ["id", "v"])


def condensed(rows: DataFrame) -> DataFrame:
    """Rows (features, label, fold), persisted: equal rows as one with their number as weight, if there are REPEATS of each on average.

    How many are distinct is estimated in one pass; either form gives the same sums.
    """
    columns = ["features", "label", "fold"]
    rows = rows.select("features", "label", F.coalesce(F.col("fold").cast("long"), F.lit(NO_FOLD)).alias("fold"))
    number, distinct = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*columns))).first()
    if number < REPEATS * distinct:
        return rows.persist()
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("weight")).coalesce(1 + distinct // DISTINCT_ROWS).persist()


def _block(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, n)
    weight = batch.column("weight").to_numpy().astype(float) if "weight" in batch.schema.names else np.ones(batch.num_rows)
    return x, batch.column("label").to_numpy(zero_copy_only=False).astype(float), batch.column("fold").to_numpy(zero_copy_only=False), weight


class Moments:
    """Count, mean, squared deviations, least and largest value of each feature over some rows."""

    def __init__(self, v: np.ndarray, n: int):
        self.n, (self.mean, self.square, self.low, self.high) = v[0], v[1:].reshape(4, n)

    @staticmethod
    def of(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        total = weight.sum()
        mean = weight @ x / total
        return np.concatenate([[total], mean, weight @ (x - mean) ** 2, x.min(axis=0), x.max(axis=0)])

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = (len(a) - 1) // 4
        total, step = a[0] + b[0], b[1 : n + 1] - a[1 : n + 1]
        mean = a[1 : n + 1] + step * (b[0] / total)
        square = a[n + 1 : 2 * n + 1] + b[n + 1 : 2 * n + 1] + step * step * (a[0] * b[0] / total)
        return np.concatenate([[total], mean, square, np.minimum(a[2 * n + 1 : 3 * n + 1], b[2 * n + 1 : 3 * n + 1]), np.maximum(a[3 * n + 1 :], b[3 * n + 1 :])])


@dataclass
class Side:
    """A training side: moments of all its rows and of each label's, means and deviations to scale by, and the largest scaled value."""

    whole: Moments
    labels: dict[int, Moments]
    scale: bool = True
    mean: np.ndarray = field(init=False)
    sd: np.ndarray = field(init=False)
    reach: float = field(init=False)

    def __post_init__(self):
        m = self.whole
        self.mean, sd = m.mean, np.sqrt(m.square / m.n)
        self.sd = np.where((sd == 0) | (m.low == m.high), 1.0, sd)
        if not self.scale:
            self.mean, self.sd = np.zeros_like(sd), np.ones_like(sd)
        self.reach = float((np.maximum(m.high - self.mean, self.mean - m.low) / self.sd).max(initial=0.0))

    def fisher(self) -> np.ndarray:
        """Fisher scores with the guards of the table operator; scaling doesn't change them."""
        far, below = np.zeros(len(self.mean)), np.zeros(len(self.mean))
        for cls in (1, -1):
            m = self.labels.get(cls)
            far = far + (np.nan if m is None else ((m.mean - self.mean) / self.sd) ** 2)
            below = below + (LEAST_VARIANCE if m is None or m.n < 2 else m.square / (m.n - 1) / self.sd**2)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.where(below == 0, 0.0, far / below), nan=0.0, posinf=0.0, neginf=0.0)


class Passes:
    """A table (features, label, fold) under repeated passes; write or persist it first. With a column weight a row counts as often.

    A side is named by what its test rows are: by default a fold, with tests any set of folds. scale=False leaves features
    as they are; otherwise tasks centre them on the whole table's means, so that no sum loses digits to a large mean.
    """

    def __init__(self, rows: DataFrame, tests: dict[int, set[int]] | None = None, scale: bool = True):
        self.rows = rows.select("features", "label", F.col("fold").cast("long").alias("fold"), *[c for c in rows.columns if c == "weight"])
        first = rows.select(F.size("features").alias("n")).first()
        if first is None:
            raise ValueError("no rows to fit")
        self.n, self.passes, self.tests, self.scale = first.n, 0, tests or {}, scale
        self._sides: dict[int | None, Side] = {}
        self.partitions = self.rows.rdd.getNumPartitions()
        self.centre, self.unit = np.zeros(self.n), np.ones(self.n)
        self.cells = self._moments()
        if scale:
            whole = self.side(None)
            self.centre, self.unit = whole.mean, whole.sd
            self.cells = {k: self._centred(v) for k, v in self.cells.items()}
            self._sides.clear()

    def tested(self, side: int | None) -> list[int]:
        """The folds of a side's test rows."""
        return [] if side in (None, RAW) else sorted(self.tests.get(side, {side}))

    @property
    def folds(self) -> list[int]:
        return sorted({f for f, _ in self.cells} - {NO_FOLD})

    def _moments(self) -> dict[tuple[int, int], np.ndarray]:
        """Moments of each (fold, label), in one pass."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, fold, weight = _block(batch, n)
                key = fold * 2 + (y > 0)
                for k in np.unique(key).tolist():
                    v = Moments.of(x[key == k], weight[key == k])
                    held[k] = v if k not in held else Moments.merge(held[k], v)
            for k, v in held.items():
                yield _row(k, v)

        found = reduced(self.rows.mapInArrow(run, "id int, v array<double>"), Moments.merge, self.partitions, 40 * n)
        return {(k // 2, 1 if k % 2 else -1): v for k, v in found.items()}

    def _centred(self, v: np.ndarray) -> np.ndarray:
        mean, square, low, high = v[1:].reshape(4, self.n)
        return np.concatenate([v[:1], (mean - self.centre) / self.unit, square / self.unit**2, (low - self.centre) / self.unit, (high - self.centre) / self.unit])

    def side(self, fold: int | None) -> Side:
        """The rows outside a fold, merged from the folds' moments."""
        if fold not in self._sides:
            out = set(self.tested(fold))
            own = {k: v for k, v in self.cells.items() if k[0] not in out}
            if not own:
                raise ValueError("a training side has no rows")
            merged: dict[int, np.ndarray] = {}
            for key in sorted(own):
                for k in (0, key[1]):
                    merged[k] = own[key] if k not in merged else Moments.merge(merged[k], own[key])
            side = self._sides[fold] = Side(Moments(merged.pop(0), self.n), {k: Moments(v, self.n) for k, v in merged.items()}, self.scale)
            if fold == RAW:
                side.mean, side.sd = -self.centre / self.unit, 1.0 / self.unit
                side.reach = float((np.maximum(side.whole.high - side.mean, side.mean - side.whole.low) / side.sd).max(initial=0.0))
        return self._sides[fold]

    def raw(self, fold: int | None, at: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of all features and intercept for rows as tasks see them, from those for the side's scaled rows."""
        s, w = self.side(fold), np.zeros(self.n)
        w[at] = u[:-1] / s.sd[at]
        return w, float(u[-1] - w @ s.mean)

    def ask(self, asks: list[Ask | Count]) -> list:
        """The answers to all questions from one pass."""
        self.passes += 1
        n, centre, unit = self.n, self.centre, self.unit
        sent = [(self.tested(a.fold), a.at, *self.raw(a.fold, a.at, a.u), (a.width, loss_pieces(a.spec.loss, a.spec.tau)) if isinstance(a, Ask) else None) for a in asks]
        groups: dict[tuple, list[int]] = {}
        for i, (out, _, _, _, how) in enumerate(sent):
            groups.setdefault((tuple(out), how is None), []).append(i)
        shared = self.rows.sparkSession.sparkContext.broadcast((sent, groups))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, grouped = shared.value
            held = [np.zeros(6 if a[4] is None else 2 + 4 * (len(a[1]) + 1) + (len(a[1]) + 1) ** 2) for a in asked]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, fold, weight = _block(batch, n)
                x = (x - centre) / unit
                for (out, counted), mine in grouped.items():
                    keep = np.isin(fold, out, invert=not (counted and out)) if out else slice(None)
                    xs, ys, ws = x[keep], y[keep], weight[keep]
                    scores = xs @ np.column_stack([asked[i][2] for i in mine]) + np.array([asked[i][3] for i in mine])
                    for j, i in enumerate(mine):
                        if counted:
                            held[i] += np.bincount((np.where(ys > 0, 0, 3) + 1 - np.sign(scores[:, j])).astype(int), ws, minlength=6)
                        else:
                            _add(held[i], xs[:, asked[i][1]], ys, ys * scores[:, j], ws, *asked[i][4])
            for i, v in enumerate(held):
                yield _row(i, v)

        found = reduced(self.rows.mapInArrow(run, "id int, v array<double>"), np.add, self.partitions, sum(a.numbers for a in asks))
        shared.unpersist()
        return [self._scaled(a, found[i]) if isinstance(a, Ask) else found[i].reshape(2, 3) for i, a in enumerate(asks)]

    def _scaled(self, a: Ask, v: np.ndarray) -> Sums:
        """Sums over unscaled rows as sums over the side's scaled rows: a scaled row is a linear map of (x, 1)."""
        s, k = self.side(a.fold), len(a.at) + 1
        t = np.eye(k)
        t[np.arange(k - 1), np.arange(k - 1)] = 1.0 / s.sd[a.at]
        t[:-1, -1] = -s.mean[a.at] / s.sd[a.at]
        return Sums(float(v[0]), float(v[1]), t @ v[2 : 2 + k], t @ v[2 + k : 2 + 2 * k], t @ v[2 + 2 * k : 2 + 3 * k], t @ v[2 + 3 * k : 2 + 4 * k], t @ v[2 + 4 * k :].reshape(k, k) @ t.T)

    def run(self, works: list[Work], deadline: float | None = None) -> list:
        """The results of all works, which move on together; an exception or, beyond the deadline (seconds since the epoch), None stands for a result."""
        out: list = [None] * len(works)
        waiting: list[tuple[int, list[Ask]]] = []

        def on(i: int, answer) -> None:
            try:
                waiting.append((i, next(works[i]) if answer is None else works[i].send(answer)))
            except StopIteration as e:
                out[i] = e.value
            except Exception as e:  # one work's failure is its own result
                out[i] = e

        for i in range(len(works)):
            on(i, None)
        while waiting and (deadline is None or time.time() <= deadline):
            now, size = [], 0
            while waiting and (not now or size + sum(a.numbers for a in waiting[0][1]) <= MOST_SUMS):
                now.append(waiting.pop(0))
                size += sum(a.numbers for a in now[-1][1])
            answers = iter(self.ask([a for _, asks in now for a in asks]))
            for i, asks in now:
                on(i, [next(answers) for _ in asks])
        for i, _ in waiting:
            works[i].close()
        return out


def together(works: list[Work]) -> Work:
    """Several works as one: the list of their results. An exception of one ends all."""
    out: list = [None] * len(works)
    asked = {}

    def on(i: int, answer) -> None:
        try:
            asked[i] = works[i].send(answer)
        except StopIteration as e:
            asked.pop(i, None)
            out[i] = e.value

    for i in range(len(works)):
        on(i, None)
    while asked:
        now = list(asked.items())
        answers = iter((yield [a for _, asks in now for a in asks]))
        for i, asks in now:
            on(i, [next(answers) for _ in asks])
    return out


def _add(held: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, weight: np.ndarray, width: float, pieces: tuple[float, float, float, float], flat: float = 1e-4) -> None:
    """Add some weighted rows' sums: smoothed loss, loss, gradient, the gradient's part of label 1, its change with the width, the curvature's last column of label 1, curvature.

    The curvature is of rows that bend more than the share `flat` of the most; only steps know of it.
    """
    a1, d1, a2, d2 = pieces
    k = x.shape[1] + 1
    second = a2 - d2 * m
    z = (a1 - d1 * m) - second
    root = np.sqrt(z * z + 4 * width * width)
    held[0] += float(weight @ (second + (z + root) / 2))
    held[1] += float(weight @ (second + np.maximum(z, 0.0)))
    share, cube, signed = (1 + z / root) / 2, 1.0 / (root * root * root), y * weight
    up, sides = y > 0, np.empty((3, len(y)))
    sides[0] = -(share * d1 + (1 - share) * d2) * signed
    sides[1] = np.where(up, sides[0], 0.0)
    sides[2] = 2 * (d1 - d2) * width * z * cube * signed
    parts = held[2 : 2 + 3 * k].reshape(3, k)
    parts[:, :-1] += sides @ x
    parts[:, -1] += sides.sum(axis=1)
    bend = 2 * width * width * (d1 - d2) ** 2 * cube
    near = bend > flat * (d1 - d2) ** 2 / (4 * width)
    x, bend, up = x[near], bend[near] * weight[near], up[near]
    bent = x.T * bend
    high = np.where(up, bend, 0.0)
    held[2 + 3 * k : 2 + 4 * k] += np.r_[high @ x, high.sum()]
    side, curve = bent.sum(axis=1), held[2 + 4 * k :].reshape(k, k)
    curve[:-1, :-1] += bent @ x
    curve[:-1, -1] += side
    curve[-1, :-1] += side
    curve[-1, -1] += bend.sum()


def model_step(h: np.ndarray, c: np.ndarray, t: np.ndarray, low: np.ndarray, high: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Minimise v.h.v / 2 + c.v + t.|v| within bounds, for positive definite h, by active sets from v on.

    A coordinate is fixed (at a bound, or at 0 where t bends the objective there) or free on one side of 0. Free ones move
    to their joint optimum as far as their sides allow, then the fixed one that promises most is set free.
    """
    v, d = np.clip(v, low, high), len(v)
    bent = (t > 0) & (low < 0) & (high > 0)
    sign = np.where(v < 0, -1.0, 1.0)
    free = (v > low) & (v < high) & ~(bent & (v == 0))
    eps = 1e-11 * (1 + np.abs(c).max(initial=0.0))
    for _ in range(20 * d + 50):
        grad = h @ v + c
        f = np.flatnonzero(free)
        move = np.zeros(d)
        if len(f):
            move[f] = -np.linalg.solve(h[np.ix_(f, f)], grad[f] + t[f] * sign[f])
        floor = np.where(bent & (sign > 0), 0.0, low)
        roof = np.where(bent & (sign < 0), 0.0, high)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(move < 0, (floor - v) / move, np.where(move > 0, (roof - v) / move, np.inf))
        reach = np.where(np.isnan(reach), np.inf, np.maximum(reach, 0.0))
        rate = min(1.0, float(reach[f].min(initial=np.inf)))
        v = v + rate * move
        if rate < 1.0:
            hit = free & (reach <= rate)
            v = np.where(hit, np.where(move < 0, floor, roof), v)
            free &= ~hit
            continue
        grad = h @ v + c
        rise = grad + t * np.where(v >= 0, 1.0, -1.0)
        fall = grad + t * np.where(v > 0, 1.0, -1.0)
        gain = np.where(free, 0.0, np.maximum(np.where(v < high, -rise, 0.0), np.where(v > low, fall, 0.0)))
        j = int(np.argmax(gain))
        if gain[j] <= eps:
            break
        sign[j] = 1.0 if v[j] < high[j] and -rise[j] >= gain[j] else -1.0
        free[j] = True
    return v


#: (costs of the features that count, room): a limit on the sum of cost times |weight| / box.
Row = tuple[np.ndarray, float]


def lower_bound(s: Sums, spec: Spec, best: float, reach: float, row: Row | None = None) -> float:
    """A value that no fit is below, from the slopes of the smoothed loss as multipliers of its pieces.

    What the multipliers leave is linear in weights and intercept. They may be scaled towards 0: those of one label so
    that both labels' sums agree, which frees the intercept, and all of them so that an L1 regulariser outweighs the
    rest. Fits better than `best` have weights that the regulariser or the box bounds, and with them the intercept.
    """
    nonneg = spec.domain == "nonneg"
    up, down = spec.c * s.up, spec.c * (s.grad - s.up)
    more, less = -up[-1], down[-1]
    if more > 0 and less > 0:
        if more > less:
            up, more = up * (less / more), less
        elif not nonneg:
            down, less = down * (more / less), more
    return _bound(up + down, more + less, spec, best, reach, row)


def moved_bound(s: Sums, move: np.ndarray, width: float, spec: Spec, best: float, reach: float, row: Row | None = None) -> float:
    """The same from the slopes that the curvature predicts after a move, whose sums balance as the model's optimum does.

    The smoothed share of a piece is at least (width / root)^2 from 0 and 1, where root >= 2 * width divides its change
    2 * width^2 * step / root^3; so as long as no row's step is above the width, the predicted slopes are multipliers, too.
    """
    _, d1, _, d2 = loss_pieces(spec.loss, spec.tau)
    if (d1 - d2) * (float(np.abs(move[:-1]).sum()) * reach + abs(move[-1])) > width:
        return -np.inf
    left = spec.c * (s.grad + s.curve @ move)
    return _bound(left, left[-1] - 2 * spec.c * float(s.up[-1] + s.lift @ move), spec, best, reach, row)


def _bound(left: np.ndarray, fixed: float, spec: Spec, best: float, reach: float, row: Row | None) -> float:
    """The bound that multipliers with the gradient `left` and the constant `fixed` prove."""
    nonneg = spec.domain == "nonneg"
    pull = np.maximum(-left[:-1], 0.0) if nonneg else np.abs(left[:-1])
    n = len(pull)
    low, high = spec.box if spec.box else (-np.inf, np.inf)
    box = max(high, 0.0 if nonneg else -low)
    total = min(best, n * box) if spec.reg == "l1" else np.sqrt(2 * best * n) if spec.reg == "l2" else n * box
    rest = min(0.0, left[-1]) if nonneg else -abs(left[-1])
    if rest < -1e-12 * (1 + fixed):
        fixed += rest * (1.0 + total * reach) if np.isfinite(total) else -np.inf
    if spec.reg == "l2":
        return fixed - 0.5 * float(pull @ pull)  # without the box, hence no higher
    gain = np.maximum(pull - (1.0 if spec.reg == "l1" else 0.0), 0.0)
    out = -np.inf
    if np.isfinite(box):
        taken = gain * box
        if row is not None:
            costs, room = row
            loose = costs > 0
            order = np.argsort(-(taken[loose] / costs[loose]), kind="stable")
            before = np.cumsum(costs[loose][order]) - costs[loose][order]
            part = np.clip((room - before) / costs[loose][order], 0.0, 1.0)
            out = fixed - float(taken[~loose].sum()) - float((taken[loose][order] * part).sum())
        else:
            out = fixed - float(taken.sum())
    if spec.reg == "l1":
        top = float(pull.max(initial=0.0))
        out = max(out, fixed - (total * max(0.0, top - 1.0) if top > 1.0 else 0.0), fixed / max(1.0, top) if rest >= -1e-12 * (1 + abs(fixed)) else -np.inf)
    return out


def newton(side: Side, fold: int | None, at: np.ndarray, spec: Spec, tolerance: float = 1e-4, start: np.ndarray | None = None, width: float = 1.0, row: Row | None = None, goal: Callable[[], float] | None = None, coarse: float | None = None, rooms: tuple[np.ndarray, list[float]] | None = None, least: float = -np.inf) -> Work:
    """A fit of the features `at`, as a work: Newton steps on the smoothed loss, whose width shrinks as steps settle.

    Ends when no fit can be better by tolerance * (1 + objective), as soon as the bound reaches goal(), when the width is
    down to LEAST_WIDTH or after MOST_PASSES. row limits the summed cost of |weights|. coarse: the relative gap that will do
    for a fit that is better than goal(). rooms: costs, and limits on their sum that the slopes prove bounds for, too.
    least: where the sums are below those of the problem to be bounded, a value of that problem; bounds hold for better fits.
    """
    at, k = np.asarray(at, dtype=int), len(at) + 1
    free = spec.domain == "free"
    low, high = spec.box if spec.box else (-np.inf, np.inf)
    lower = np.r_[np.full(k - 1, low if free else 0.0), -np.inf if free else 0.0]
    upper = np.r_[np.full(k - 1, high), np.inf]
    slope = np.r_[np.full(k - 1, 1.0 if spec.reg == "l1" else 0.0), 0.0]
    ridge = np.r_[np.full(k - 1, 1.0 if spec.reg == "l2" else 0.0), 0.0]
    reg = lambda u: float(slope @ np.abs(u) + 0.5 * (ridge * u) @ u)
    u = np.zeros(k) if start is None else np.clip(start, lower, upper)
    best, bound, held, passes, centred = (np.inf, u), -np.inf, None, 0, 0
    bounds = None if rooms is None else np.full(len(rooms[1]), -np.inf)
    while True:
        (s,) = yield [Ask(fold, at, u, width, spec)]
        passes += 1
        value = reg(u) + spec.c * s.exact
        inside = row is None or float(row[0] @ np.abs(u[:-1])) / high <= row[1] + 1e-9
        if inside and value < best[0]:
            best = (value, u)
        known = max(best[0] if np.isfinite(best[0]) else value, least)
        bound = max(bound, lower_bound(s, spec, known, side.reach, row))
        if rooms is not None:
            bounds = np.maximum(bounds, [lower_bound(s, spec, known, side.reach, (rooms[0], room)) for room in rooms[1]])
        if goal is not None and bound >= goal():
            return Fit(at, best[1][:-1], float(best[1][-1]), float(best[0]), float(bound), passes, True, bounds)
        size = 1 + abs(best[0] if np.isfinite(best[0]) else value)
        near, open_ = tolerance * size, coarse is not None and best[0] < goal() and best[0] - bound <= coarse * size
        if best[0] - bound <= near or open_ or width < LEAST_WIDTH or passes >= MOST_PASSES:
            return Fit(at, best[1][:-1], float(best[1][-1]), float(best[0]), float(bound), passes, False, bounds)
        smooth = reg(u) + spec.c * s.loss
        if held is not None and held[3] == width and smooth > held[1] + 1e-10 * (1 + abs(held[1])) and held[4] > 1e-4:
            point, before, move, _, rate = held  # too far: half the way
            held = (point, before, move, width, rate / 2)
            u = point + rate / 2 * move
            continue
        grad, curve = spec.c * s.grad, spec.c * s.curve
        h = curve + np.diag(ridge + 1e-10 * (1 + np.trace(curve) / k))
        step = lambda grad: _limited_step(h, grad - h @ u + ridge * u, slope, lower, upper, u, row, high)
        new = step(grad)
        move = new - u if row is not None else _fine_move(h, grad + ridge * u, slope, lower, upper, u, new)
        bound = max(bound, moved_bound(s, move, width, spec, known, side.reach, row))
        if rooms is not None:
            bounds = np.maximum(bounds, [moved_bound(s, move, width, spec, known, side.reach, (rooms[0], room)) for room in rooms[1]])
        if goal is not None and bound >= goal():
            return Fit(at, best[1][:-1], float(best[1][-1]), float(best[0]), float(bound), passes, True, bounds)
        if best[0] - bound <= near:
            return Fit(at, best[1][:-1], float(best[1][-1]), float(best[0]), float(bound), passes, False, bounds)
        drop = smooth - (reg(new) + spec.c * s.loss + grad @ (new - u) + 0.5 * (new - u) @ curve @ (new - u))
        # what the smoothing alone leaves open, were the slopes in balance
        slack = spec.c * (s.exact + s.up[-1] - (s.grad - s.up)[-1]) - grad @ u
        centred = centred + 1 if slack <= 0.5 * near and drop <= slack else 0
        if centred > CENTRED or (slack > 0.5 * near and drop <= SETTLED * slack):
            less, centred = width * max(SHRINK, min(0.3 * near / slack, 0.5)), 0
            new = step(grad + (less - width) * spec.c * s.drift)  # towards the optimum of the smaller width
            width = less
        held = (u, smooth, new - u, width, 1.0)
        u = new


def _fine_move(h: np.ndarray, grad: np.ndarray, slope: np.ndarray, lower: np.ndarray, upper: np.ndarray, u: np.ndarray, new: np.ndarray) -> np.ndarray:
    """new - u, solved for what new leaves free: a short move keeps digits that the difference of two near points has lost."""
    move = new - u
    free = (new > lower) & (new < upper) & ~((slope > 0) & (new == 0))
    move[free] = -np.linalg.solve(h[np.ix_(free, free)], (grad + slope * np.sign(new) + h[:, ~free] @ move[~free])[free])
    return move


def _limited_step(h: np.ndarray, c: np.ndarray, slope: np.ndarray, lower: np.ndarray, upper: np.ndarray, u: np.ndarray, row: Row | None, box: float) -> np.ndarray:
    """The model's optimum; a row's limit is met by the least multiplier of its costs that keeps it."""
    new = model_step(h, c, slope, lower, upper, u)
    if row is None:
        return new
    costs, room = np.r_[row[0], 0.0] / box, row[1]
    if costs @ np.abs(new) <= room + 1e-12:
        return new
    less, more = 0.0, 1.0
    while costs @ np.abs(new := model_step(h, c, slope + more * costs, lower, upper, new)) > room and more < 1e15:
        less, more = more, more * 8
    for _ in range(40):
        mid = (less + more) / 2
        trial = model_step(h, c, slope + mid * costs, lower, upper, new)
        if costs @ np.abs(trial) > room:
            less = mid
        else:
            more, new = mid, trial
        if more - less <= 1e-9 * more:
            break
    return new


@dataclass
class Node:
    """Features kept in and left out, a point to start from, and by budget the bound so far; the budgets that are open."""

    keep: np.ndarray
    out: np.ndarray
    start: np.ndarray
    width: float
    bounds: np.ndarray
    open: list[int]


def budget_search(side: Side, fold: int | None, n: int, spec: Spec, budgets: list[float], costs: np.ndarray | None = None, tolerance: float = 1e-4) -> Work:
    """The best fits whose features' summed cost is at most each of the budgets, as a work: one branch and bound for all, all its open nodes in each pass.

    A node keeps some features, leaves others out and relaxes the rest to |weight| / box, whose cost the middle one of its
    open budgets limits; the slopes of that fit prove a bound for each of the others, too. A budget is done with a node
    whose bound reaches the best fit found for it, which roundings of relaxations supply; a node's relaxation need only be
    near its optimum to be branched, on the largest loose weight. The bound of a result is the least of the nodes that
    were closed for its budget, so its gap is proven.
    """
    costs = np.ones(n) if costs is None else np.asarray(costs, dtype=float)
    best = [Fit(np.arange(n), np.zeros(n), 0.0, np.inf, -np.inf, 0) for _ in budgets]
    closed, tried, passes = np.full(len(budgets), np.inf), set(), 0
    goal = lambda k: best[k].value - tolerance * (1 + abs(best[k].value)) if np.isfinite(best[k].value) else np.inf
    none, top = np.zeros(n, dtype=bool), max(abs(v) for v in spec.box)
    waiting, running = [Node(none, none, np.zeros(n + 1), 1.0, np.full(len(budgets), -np.inf), list(range(len(budgets))))], []

    def left_open(node: Node) -> list[int]:
        """Its budgets that it may still hold a better fit for; those that its bounds rule out are closed."""
        spent, still = costs[node.keep].sum(), []
        for k in node.open:
            if spent > budgets[k] + 1e-9:
                continue  # holds no fit of this budget
            if node.bounds[k] >= goal(k):
                closed[k] = min(closed[k], node.bounds[k])
            else:
                still.append(k)
        return still

    def begin(node: Node) -> None:
        node.open = left_open(node)
        if not node.open:
            return
        k = node.open[len(node.open) // 2]
        room = budgets[k] - costs[node.keep].sum()
        loose = ~node.keep & ~node.out & (costs <= room + 1e-9)
        final = costs[loose].sum() <= room + 1e-9
        at = np.flatnonzero(node.keep | loose) if final else np.flatnonzero(~node.out)
        counted = np.where(node.keep, 0.0, costs)[at]
        rooms = [max(budgets[j] - costs[node.keep].sum(), 0.0) for j in node.open]
        whole = len(at) == (~node.out).sum()  # bounds hold for what the fit could use only
        row = None if final else (counted, max(room, 0.0))
        work = newton(side, fold, at, spec, tolerance / 2, np.r_[node.start[at], node.start[-1]], node.width, row, lambda: goal(k), None if final else LOOSE, (counted, rooms) if whole else None)
        running.append([node, k, final, work, next(work)])

    def candidate(k: int, use: np.ndarray, start: np.ndarray) -> None:
        key = tuple(np.flatnonzero(use).tolist())
        if key not in tried:
            tried.add(key)
            at = np.flatnonzero(use)
            # worth its passes only as long as it may beat what is known; a leaf of the tree proves the rest
            work = newton(side, fold, at, spec, tolerance / 2, np.r_[start[at], start[-1]], 0.05, goal=lambda: goal(k))
            running.append([None, None, True, work, next(work)])

    def rounded(node: Node, w: np.ndarray, budget: float) -> np.ndarray:
        use, room = np.zeros(n, dtype=bool), budget
        for i in sorted(np.flatnonzero(~node.out), key=lambda i: (not node.keep[i], -abs(w[i]), i)):
            if costs[i] <= room + 1e-9 and (node.keep[i] or w[i] != 0):
                use[i], room = True, room - costs[i]
        return use

    def finish(node: Node | None, k: int | None, final: bool, fit: Fit) -> None:
        spent = costs[fit.full(n) != 0].sum()
        for j, budget in enumerate(budgets):
            if spent <= budget + 1e-9 and fit.value < best[j].value:
                best[j] = fit
        if node is None:
            return
        if fit.bounds is not None:
            node.bounds[node.open] = np.maximum(node.bounds[node.open], fit.bounds)
        node.bounds[k] = max(node.bounds[k], fit.bound)
        if final:  # the node's best fit of this budget
            closed[k] = min(closed[k], node.bounds[k])
            node.open = [j for j in node.open if j != k]
        node.open, w = left_open(node), fit.full(n)
        if not node.open:
            return
        start = np.r_[w, fit.b]
        if final:
            waiting.append(Node(node.keep, node.out, start, 0.05, node.bounds, node.open))
            return
        for j in node.open if len(tried) < ROUNDINGS else []:
            candidate(j, rounded(node, w, budgets[j]), start)
        keep, most = node.keep.copy(), max(budgets[j] for j in node.open)
        for j in sorted(np.flatnonzero(~node.keep & ~node.out), key=lambda j: (-abs(w[j]), j)):
            without = node.out.copy()
            without[j] = True
            waiting.append(Node(keep.copy(), without, start, 0.05, node.bounds.copy(), list(node.open)))
            keep[j] = True
            # with j kept the relaxation is this one again, unless its limit or the last of the room changes it
            loose, room = ~keep & ~node.out, most - costs[keep].sum()
            if not w[j] or room < costs[loose].min(initial=np.inf) - 1e-9 or float(costs[loose] @ np.abs(w[loose])) / top > min(budgets[i] for i in node.open) - costs[keep].sum():
                break
        waiting.append(Node(keep, node.out, start, 0.05, node.bounds, node.open))

    while waiting or running:
        waiting.sort(key=lambda x: -x.bounds[x.open].min())
        while waiting and len(running) < MOST_OPEN:
            begin(waiting.pop())
        if not running:
            continue
        now, running = running, []
        answers = iter((yield [a for r in now for a in r[4]]))
        passes += 1
        for r in now:
            try:
                r[4] = r[3].send([next(answers) for _ in r[4]])
                running.append(r)
            except StopIteration as e:
                finish(*r[:3], e.value)
    return [Fit(f.at, f.w, f.b, f.value, float(min(c, f.value)), passes) for f, c in zip(best, closed)]


def elimination(side: Side, fold: int | None, n: int, spec: Spec, keep: int, drop: str = "one", tolerance: float = 1e-4) -> Work:
    """(fit, remaining features after each step): the feature of least squared weight goes (the first of equals), or half of them.

    A fit stays the optimum when a feature of weight 0 goes, so only the loss of a weight asks for another fit, which
    starts from the one before.
    """
    at, steps = np.arange(n), []
    fit = yield from newton(side, fold, at, spec, tolerance)
    while len(at) > keep:
        w = fit.full(n)
        gone = 1 if drop == "one" else min(len(at) // 2, len(at) - keep)
        worst = sorted(at.tolist(), key=lambda j: (w[j] ** 2, j))[:gone]
        at = np.setdiff1d(at, worst)
        steps.append(at.tolist())
        if any(w[j] != 0 for j in worst):
            fit = yield from newton(side, fold, at, spec, tolerance, np.r_[w[at], fit.b], 0.05)
        else:
            fit = Fit(at, w[at], fit.b, fit.value, fit.bound, fit.passes)
    return fit, steps


def cost_path(side: Side, fold: int | None, at: np.ndarray, spec: Spec, low: float, high: float, tolerance: float = 1e-7) -> Work:
    """[(from, to, fit)] by ascending C from low to high: the intervals of C on each of which one fit is the optimum, as a work.

    With an L1 or no regulariser an optimum is a vertex, whose objective is linear in C, and the least objective is the
    lower envelope of such lines. Where the lines of two neighbours cross, a fit either proves that nothing is below, so
    that the crossing is a breakpoint, or is another vertex of the path, and both sides are searched on. All open
    intervals share their passes. A vertex that is better by less than the tolerance everywhere may be passed over.
    """
    if spec.reg == "l2":
        raise ValueError("with an L2 regulariser weights change all along the path")
    weight = lambda f: float(np.abs(f.w).sum()) if spec.reg == "l1" else 0.0
    fine = lambda c: tolerance * min(1.0, c * side.whole.n)  # noqa: E731 - so that losses, not only objectives, are known as well

    def line(c: float, f: Fit) -> tuple[float, float]:
        return weight(f), (f.value - weight(f)) / c

    def fits(cs: list[float], starts: list, goals: list) -> Work:
        return (yield from together([newton(side, fold, at, replace(spec, c=c), fine(c), u, 1.0 if u is None else 0.05, goal=goal) for c, u, goal in zip(cs, starts, goals)]))

    def same(x: tuple, y: tuple) -> bool:
        return abs(x[1] - y[1]) <= 20 * tolerance * (1 + x[1]) and abs(x[0] - y[0]) <= 20 * tolerance * (1 + x[0])

    ends = yield from fits([low, high], [None, None], [None, None])
    found = {low: (*line(low, ends[0]), ends[0]), high: (*line(high, ends[1]), ends[1])}
    breaks: list[tuple[float, float, float]] = []  # (C, the point left of it, the point right of it)
    open_ = [(low, high)]
    while open_:
        crossed = []
        for a, b in open_:
            (ra, la, _), (rb, lb, _) = found[a], found[b]
            if not same(found[a], found[b]) and la > lb:
                c = min(max((rb - ra) / (la - lb), a), b)
                crossed.append((a, b, c, ra + c * la - 4 * fine(c) * (1 + abs(ra + c * la))))
        tried = yield from fits([x[2] for x in crossed], [np.r_[found[a][2].w, found[a][2].b] for a, *_ in crossed], [lambda v=x[3]: v for x in crossed])
        open_ = []
        for (a, b, c, least), f in zip(crossed, tried):
            if f.beaten or f.value >= least or not a < c < b:
                breaks.append((c, a, b))
            else:
                found[c] = (*line(c, f), f)
                open_ += [(a, c), (c, b)]
    out, start, here = [], low, low
    for c, a, b in sorted(breaks):
        if not same(found[here], found[b]):
            out.append((start, c, found[here][2]))
            start, here = c, b
    return [*out, (start, high, found[here][2])]
