"""SQL that finds the optimum of one-feature fits by listing candidates, to hold the solvers against.

For one feature x the score is w x + b with w, b >= 0, and the loss is made of pieces that meet on the lines
y_i (w x_i + b) = 1. With an L1 or no regulariser some optimum is a corner: where two such lines cross, or one crosses
w = 0, b = 0 or the upper bound of w. With an L2 regulariser some optimum lies on such a line or on b = 0, at a corner
or where the derivative along the line vanishes. So the best of all corners (and of these points) is the optimum.
"""

from __future__ import annotations

TABLE = "embeddings"
#: Features, from 1; the label is the sign of the sum of three of them, so that each tells something about it.
ONE, SOME = 21, (21, 36, 43)
LABEL = "CASE WHEN " + " + ".join(f"embedding[{j}]::DOUBLE" for j in SOME) + " > 0 THEN 1 ELSE -1 END"


def rows(features: tuple[int, ...]) -> str:
    """e: (vec_id, fold, y, j, r), a row a vector and feature."""
    return f"e AS (SELECT vec_id, vec_id % 10 AS fold, {LABEL} AS y, j, embedding[j]::DOUBLE AS r FROM {TABLE}, (SELECT unnest([{', '.join(map(str, features))}]) AS j))"


#: z: scaled rows of the problems g; here a problem a feature, all rows.
WHOLE = "z AS (SELECT j AS g, y, (r - avg(r) OVER (PARTITION BY j)) / stddev_pop(r) OVER (PARTITION BY j) AS x FROM e)"
#: ft: the feature with the highest Fisher score, ties to the larger.
FISHER_TOP = """ft AS (SELECT j FROM (SELECT j, power(avg(r) FILTER (y = 1) - avg(r), 2) + power(avg(r) FILTER (y = -1) - avg(r), 2) AS far, var_samp(r) FILTER (y = 1) + var_samp(r) FILTER (y = -1) AS wide FROM e GROUP BY j)
  ORDER BY CASE WHEN wide = 0 THEN 0 ELSE far / wide END DESC, j DESC LIMIT 1)"""
#: A problem a fold: its training rows, and t: its test rows, scaled alike.
BY_FOLD = """k AS (SELECT DISTINCT fold AS g FROM e), m AS (SELECT g, avg(r) AS mean, stddev_pop(r) AS sd FROM e, k WHERE fold <> g GROUP BY g),
z AS (SELECT g, y, (r - mean) / sd AS x FROM e, m WHERE fold <> g), t AS (SELECT g, vec_id, y, (r - mean) / sd AS x FROM e, m WHERE fold = g)"""


def corners(top: float | None = None) -> str:
    """c: (g, w, b), the corners of each problem; top bounds w."""
    bound = "" if top is None else f" UNION SELECT g, {top}, y - {top} * x FROM z"
    limit = "" if top is None else f" AND w <= {top}"
    return f"""c AS (SELECT g, w, b FROM (
  SELECT p.g, 2 / (p.x - n.x) AS w, 1 - 2 / (p.x - n.x) * p.x AS b FROM z p JOIN z n ON p.g = n.g AND p.y = 1 AND n.y = -1 AND p.x > n.x
  UNION SELECT g, y / x, 0 FROM z WHERE y * x > 0 UNION SELECT DISTINCT g, 0, 1 FROM z UNION SELECT DISTINCT g, 0, 0 FROM z{bound}) WHERE b >= 0 AND w >= 0{limit})"""


def flat_points(c: float, tau: float) -> str:
    """f: (g, w, b) where the derivative along a line, or along b = 0, vanishes, with an L2 regulariser."""
    return f"""h AS (
  SELECT i.g, i.y AS yi, i.x AS xi, 1 - k.y * i.y AS gap, k.y * (k.x - i.x) AS s FROM z i JOIN z k ON i.g = k.g
  UNION ALL SELECT g, NULL, NULL, 1, y * x FROM z),
ho AS (SELECT g, yi, xi, sum(s) AS total, coalesce(sum(s) FILTER (s < 0 OR s = 0), 0) AS fixed FROM h GROUP BY g, yi, xi),
hb AS (SELECT g, yi, xi, gap / s AS until, sum(s) OVER (PARTITION BY g, yi, xi ORDER BY gap / s DESC, s) AS more, lead(gap / s, 1, 0) OVER (PARTITION BY g, yi, xi ORDER BY gap / s DESC, s) AS since FROM h WHERE s > 0 AND gap > 0
  UNION ALL SELECT g, yi, xi, 1e300, 0, max(CASE WHEN s > 0 AND gap > 0 THEN gap / s ELSE 0 END) FROM h GROUP BY g, yi, xi),
hw AS (SELECT g, yi, xi, {c} * ((1 + {tau}) * (fixed + more) - {tau} * total) AS w, since, until FROM hb JOIN ho USING (g, yi, xi) WHERE yi IS NOT NULL
  UNION ALL SELECT hb.g, NULL, NULL, {c} * ((1 + {tau}) * (fixed + more) - {tau} * total), since, until FROM hb JOIN ho ON hb.g = ho.g AND hb.yi IS NULL AND ho.yi IS NULL),
f AS (SELECT g, w, coalesce(yi - w * xi, 0) AS b FROM hw WHERE w >= 0 AND w >= since - 1e-9 AND w <= until + 1e-9 AND coalesce(yi - w * xi, 0) >= 0)"""


#: l: summed losses of each candidate, short of the margin and beyond it.
LOSSES = "l AS (SELECT c.g, c.w, c.b, sum(greatest(0, 1 - z.y * (c.w * z.x + c.b))) AS short, sum(greatest(0, z.y * (c.w * z.x + c.b) - 1)) AS far FROM c JOIN z ON c.g = z.g GROUP BY c.g, c.w, c.b)"


def fitted(features: tuple[int, ...], reg: str, c: float, tau: float = 0.0, top: float | None = None, by_fisher: bool = False) -> str:
    """The best one-feature fit: feature (from 1 among the given), objective, w, b; by_fisher: of the feature with the highest Fisher score."""
    cost = {"none": "0", "l1": "w", "l2": "w * w / 2"}[reg]
    both = f", {flat_points(c, tau)}, q AS (SELECT * FROM c UNION SELECT * FROM f)" if reg == "l2" else ""
    losses = LOSSES.replace("FROM c JOIN", "FROM q c JOIN") if both else LOSSES
    place = f"list_position([{', '.join(map(str, features))}], g)::INT"
    source = f"{rows(features)}, {FISHER_TOP}, {WHOLE.replace('FROM e', 'FROM (SELECT * FROM e WHERE j = (SELECT j FROM ft))')}" if by_fisher else f"{rows(features)}, {WHOLE}"
    return f"""WITH {source}, {corners(top)}{both}, {losses}
SELECT feature, round(objective, 4) AS objective, round(w, 4) AS w, round(b, 4) AS b FROM (
  SELECT {place} AS feature, w, b, {cost} + {c} * (short + {tau} * far) AS objective FROM l ORDER BY objective, w LIMIT 1)"""


def cross_validated(grid: list[tuple[float, float]], top: float | None = None) -> str:
    """CTEs up to v: (combo_id, fold, w, b, accuracy, auc, f1_score, g_mean) of L1 fits at each (C, tau) of the grid, by fold."""
    points = ", ".join(f"({i}, {c}::DOUBLE, {t}::DOUBLE)" for i, (c, t) in enumerate(grid))
    return f"""WITH {rows((ONE,))}, {BY_FOLD}, {corners(top)}, {LOSSES}, p(combo_id, c, tau) AS (VALUES {points}),
b AS (SELECT combo_id, g, arg_min(w, (w + c * (short + tau * far), w)) AS w, arg_min(b, (w + c * (short + tau * far), w)) AS b FROM l, p GROUP BY combo_id, g),
s AS (SELECT combo_id, t.g, y, sign(w * x + b)::INT AS pred FROM b JOIN t ON b.g = t.g),
n AS (SELECT combo_id, g, avg((y = pred)::INT) AS accuracy, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 1 AND pred = -1) AS fn, count(*) FILTER (y = -1 AND pred = -1) AS tn, count(*) FILTER (y = -1 AND pred = 1) AS fp FROM s GROUP BY combo_id, g),
v AS (SELECT n.combo_id::BIGINT AS combo_id, n.g::BIGINT AS fold, w, b, accuracy, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 ELSE 0 END AS auc,
  CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN sqrt(tp / (tp + fn) * tn / (tn + fp)) ELSE 0 END AS g_mean FROM n JOIN b ON n.combo_id = b.combo_id AND n.g = b.g)"""


# ---- several features: line items whose features have three levels each, so that rows fall into few classes

#: Five features of a line item with values 0, 1 or 4, and a label that three of them tell something about.
COARSE = (
    "power(floor(l_extendedprice / 36000), 2)",
    "power(least(floor((l_linenumber - 1) / 2), 2), 2)",
    "power(floor(l_discount * 25), 2)",
    "power(floor(l_tax * 30), 2)",
    "power(floor(l_quantity / 17), 2)",
)
COARSE_LABEL = "CASE WHEN l_extendedprice / 1000 + 200 * l_discount + 4 * l_linenumber + 5 * (l_partkey % 7) > 90 THEN 1 ELSE -1 END"


def determinant(m: list[list[str]]) -> str:
    """Of a matrix of SQL expressions, along the first row; zeros and ones as numbers are left out."""
    if len(m) == 1:
        return m[0][0]
    terms = []
    for j, x in enumerate(m[0]):
        if x != "0":
            minor = determinant([row[:j] + row[j + 1 :] for row in m[1:]])
            terms.append(f"{'-' if j % 2 else '+'} {x} * ({minor})" if x != "1" else f"{'-' if j % 2 else '+'} ({minor})")
    return " ".join(terms) or "0"


#: Whether a line item is held out, for each of five seeds.
HELD = "[" + ", ".join(f"('0x' || substr(md5('{42 + i}:' || (l_orderkey * 8 + l_linenumber)), 1, 8))::BIGINT < {int(0.2 * (1 << 32))}" for i in range(5)) + "]"


def classes(problems: str, sets: dict[int, tuple[int, ...]], test: str = "coalesce(r.fold = q.fold, false)") -> str:
    """CTEs a (g, s, test, y, n, x1..xk) and z, its training rows: the classes of rows of each problem (g, s), scaled by its training rows.

    problems is a CTE q(g, fold): the fold that problem g leaves out (null: none); sets the features (from 1) of each s.
    test tells a problem's test rows by their fold, or by held, a list of booleans.
    """
    k = len(next(iter(sets.values())))
    rows = " UNION ALL ".join(f"SELECT {s} AS s, fold, held, y, {', '.join(f'c{j} AS r{i}' for i, j in enumerate(at, 1))} FROM o" for s, at in sets.items())
    of = lambda f: ", ".join(f.format(i=i) for i in range(1, k + 1))
    return f"""o AS (SELECT (l_orderkey * 7 + l_linenumber) % 10 AS fold, {HELD if 'held' in test else '[]'} AS held, {COARSE_LABEL} AS y, {', '.join(f'{e}::DOUBLE AS c{j}' for j, e in enumerate(COARSE, 1))} FROM lineitem),
r AS ({rows}), q AS ({problems}),
d AS (SELECT g, s, {test} AS test, y, {of('r{i}')}, count(*) AS n FROM r, q GROUP BY ALL),
m AS (SELECT g, s, {of('sum(n * r{i}) / sum(n) AS m{i}, sqrt(sum(n * r{i} * r{i}) / sum(n) - power(sum(n * r{i}) / sum(n), 2)) AS sd{i}')} FROM d WHERE NOT test GROUP BY g, s),
a AS (SELECT g, s, test, y, n, {of('(r{i} - m{i}) / sd{i} AS x{i}')} FROM d JOIN m USING (g, s)), z AS (SELECT * FROM a WHERE NOT test)"""


def vertices(k: int, domain: str, box: float | None) -> str:
    """CTE c (g, s, w1..wk, b): where k + 1 of the planes meet on which the objective bends: margins of 1, weights of 0 or at the box, b = 0."""
    names = [*(f"a{i}" for i in range(1, k + 1)), "a0"]
    unit = lambda i, rhs: "SELECT DISTINCT g, s, " + ", ".join(f"{int(i == j)}::DOUBLE" for j in range(1, k + 1)) + f", {int(i == 0)}::DOUBLE, {rhs}::DOUBLE FROM z"
    planes = ["SELECT DISTINCT g, s, " + ", ".join(f"x{i}" for i in range(1, k + 1)) + ", 1::DOUBLE, y::DOUBLE FROM z"]
    planes += [unit(i, v) for i in range(1, k + 1) for v in (0, *((box,) if box else ()), *((-box,) if box and domain == "free" else ()))]
    if domain == "nonneg":
        planes.append(unit(0, 0))
    d = range(k + 1)
    matrix = [[f"p{i}.{n}" for n in names] for i in d]
    cramer = [determinant([[f"p{i}.r" if j == at else x for j, x in enumerate(matrix[i])] for i in d]) for at in d]
    joins = " ".join(f"JOIN p p{i} ON p{i}.g = p0.g AND p{i}.s = p0.s AND p{i}.i > p{i - 1}.i" for i in d if i)
    snapped = ", ".join(f"CASE WHEN abs(w{i}) < 1e-9 THEN 0 ELSE round(w{i}, 11) END AS w{i}" for i in range(1, k + 1))
    inside = " AND ".join([*(f"w{i} >= -1e-9" for i in range(1, k + 1) if domain == "nonneg"), *(f"abs(w{i}) <= {box + 1e-9}" for i in range(1, k + 1) if box), *(["b >= -1e-9"] if domain == "nonneg" else []), "true"])
    values = ", ".join(f"{cramer[i]} AS n{i}" for i in d)
    solved = ", ".join(f"n{i} / det AS {'b' if i == k else f'w{i + 1}'}" for i in d)
    return f"""p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g, s ORDER BY {', '.join(names)}, r) AS i FROM ({' UNION ALL '.join(planes)}) t(g, s, {', '.join(names)}, r)),
v AS (SELECT g, s, {solved} FROM (SELECT p0.g, p0.s, {determinant(matrix)} AS det, {values} FROM p p0 {joins}) WHERE abs(det) > 1e-7),
c AS (SELECT DISTINCT g, s, {snapped}, round(b, 11) AS b FROM v WHERE {inside})"""


def optima(k: int, reg: str, domain: str, grid: list[tuple[float, float]], box: float | None = None, keep: str = "true", by: str = "g, combo") -> str:
    """CTEs from c up to f (by, objective, s, w1..wk, b): the vertex of least objective among those that satisfy keep, at each (C, tau) of the grid."""
    w = [f"w{i}" for i in range(1, k + 1)]
    cost = {"none": "0", "l1": " + ".join(f"abs({x})" for x in w)}[reg]
    score = " + ".join(f"c.{x} * z.x{i}" for i, x in enumerate(w, 1)) + " + c.b"
    points = ", ".join(f"({i}, {c}::DOUBLE, {t}::DOUBLE)" for i, (c, t) in enumerate(grid))
    return f"""{vertices(k, domain, box)},
l AS (SELECT c.g, c.s, {', '.join(f'c.{x}' for x in w)}, c.b, sum(n * greatest(0, 1 - y * ({score}))) AS short, sum(n * greatest(0, y * ({score}) - 1)) AS far FROM c JOIN z ON c.g = z.g AND c.s = z.s GROUP BY ALL),
u(combo, cc, tau) AS (VALUES {points}), h AS (SELECT *, {cost} + cc * (short + tau * far) AS objective FROM l, u),
f AS (SELECT {by}, unnest(arg_min(struct_pack(objective := objective, s := s, {', '.join(f'{x} := {x}' for x in w)}, b := b), (round(objective, 9), s))) FROM h WHERE {keep} GROUP BY {by})"""


def scored(k: int, fits: str = "f", keys: str = "g, combo", to: str = "") -> str:
    """CTE k<to> (keys, accuracy, auc, f1_score, g_mean) of fits (keys, s, w1..wk, b) on their problems' test rows."""
    score = " + ".join(f"w{i} * x{i}" for i in range(1, k + 1)) + " + b"
    return f"""t{to} AS (SELECT {', '.join(f'{fits}.{x}' for x in keys.split(', '))}, y, n, sign(round({score}, 7))::INT AS pred FROM {fits} JOIN a ON {fits}.g = a.g AND {fits}.s = a.s WHERE test),
n{to} AS (SELECT {keys}, sum(n) AS n, coalesce(sum(n) FILTER (y = pred), 0) AS hits, coalesce(sum(n) FILTER (y = 1), 0) AS pos, coalesce(sum(n) FILTER (y = -1), 0) AS neg, coalesce(sum(n) FILTER (y = 1 AND pred = 1), 0) AS tp, coalesce(sum(n) FILTER (y = -1 AND pred = -1), 0) AS tn, coalesce(sum(n) FILTER (y = -1 AND pred = 1), 0) AS fp FROM t{to} GROUP BY {keys}),
k{to} AS (SELECT {keys}, hits / n AS accuracy, CASE WHEN pos > 0 AND neg > 0 THEN (tp / pos + tn / neg) / 2 ELSE 0 END AS auc, CASE WHEN tp + fp + (pos - tp) > 0 THEN 2 * tp / (2 * tp + fp + (pos - tp)) ELSE 0 END AS f1_score, CASE WHEN pos > 0 AND neg > 0 THEN sqrt(tp / pos * tn / neg) ELSE 0 END AS g_mean FROM n{to})"""


#: fs (j, score): Fisher scores of three features of the one problem's classes.
FISHER_CLASSES = "fl AS (" + " UNION ALL ".join(f"SELECT {j} AS j, y, n, x{j} AS x FROM z" for j in (1, 2, 3)) + """),
fs AS (SELECT j, (power(up - mean, 2) + power(down - mean, 2)) / (up_var + down_var) AS score FROM (
  SELECT j, sum(n * x) / sum(n) AS mean, sum(n * x) FILTER (y = 1) / sum(n) FILTER (y = 1) AS up, sum(n * x) FILTER (y = -1) / sum(n) FILTER (y = -1) AS down,
         (sum(n * x * x) FILTER (y = 1) - power(sum(n * x) FILTER (y = 1), 2) / sum(n) FILTER (y = 1)) / (sum(n) FILTER (y = 1) - 1) AS up_var,
         (sum(n * x * x) FILTER (y = -1) - power(sum(n * x) FILTER (y = -1), 2) / sum(n) FILTER (y = -1)) / (sum(n) FILTER (y = -1) - 1) AS down_var FROM fl GROUP BY j))"""
