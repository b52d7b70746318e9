"""Every query against its SQL, and the operators on small fixtures."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hingeworks import catalogue
from hingeworks.functions import metrics
from hingeworks.operators import folds, ranking, scaling, selection
from hingeworks.operators.solvers.ipm import Spec, fit, objective
from hingeworks.operators.solvers.passes import Passes, newton
from hingeworks.plans import experiment, search, shared
from hingeworks.sources import datasets, sinks
from hingeworks.streaming import scoring

SLOW = {"cv_grid_search"}
#: Fits and searches, whose ties and winners show at a scale of their own.
LARGER = ("experiment_best", "tune_fit_c", "cv_fit_summary", "experiment_items", "cv_items_folds", "sweep_fit_b", "fit_milp1_items", "fit_rfe_three", "grid_argmax")


@pytest.fixture(scope="module")
def duck(sf):
    import os

    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{sf}/{t}')")
    return con


def canon(rows):
    fix = lambda v: round(float(v), 5) if isinstance(v, (float, np.floating)) else v
    return sorted((tuple(fix(r[k]) for k in sorted(r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    got = [r.asDict() for r in entry.queries()[name](spark, sf).collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", LARGER)
def test_query_matches_sql_on_a_larger_scale(spark, sf, name):
    sf = sf.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(entry.oracle_sql()[name])
    assert canon([r.asDict() for r in entry.queries()[name](spark, sf).collect()]) == canon([dict(zip(rel.columns, r)) for r in rel.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_fit_query_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() == 1


def test_entry(spark, sf):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("m,sizes", [(351, [36] + [35] * 9), (569, [57] * 9 + [56]), (768, [77] * 8 + [76] * 2)])
def test_exact_folds(m, sizes):
    f = folds.exact_folds(m)
    assert [int((f == k).sum()) for k in range(10)] == sizes
    order = np.arange(m)
    np.random.RandomState(42).shuffle(order)
    assert set(np.flatnonzero(f == 0)) == set(order[: sizes[0]])


def test_constant_column_and_one_row_class(spark):
    df = spark.createDataFrame([(0.0, float(i), 1 if i == 0 else -1, i % 2) for i in range(6)], "a double, b double, label int, fold int")
    z = scaling.apply(df, scaling.stats(df, ["a", "b"]), ["a", "b"]).collect()
    assert all(r.z_a == 0 for r in z)
    s = {r.feature: r.score for r in ranking.fisher_scores(df, ["a", "b"]).collect()}
    assert s["a"] == 0 and s["b"] > 0
    per = {r.fold: r for r in scaling.fold_stats(df, ["a", "b"], 2).collect()}
    for k in (0, 1):
        rest = np.array([float(i) for i in range(6) if i % 2 != k])
        assert np.isclose(per[k].mean_b, rest.mean()) and np.isclose(per[k].sd_b, rest.std()) and per[k].sd_a == 1


def test_tied_scores_go_to_the_larger_position(spark):
    s = spark.createDataFrame([(1, "a", 2.0), (2, "b", 2.0), (3, "c", 1.0)], "j int, feature string, score double")
    assert [r.j for r in ranking.top_k(s, 2).orderBy("rank").collect()] == [2, 1]
    assert [r.threshold for r in ranking.thresholds(s).orderBy("percentile").collect()] == [1.5, 2.0, 2.0]


def test_metrics_policy(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", -1, 0), ("x", -1, -1), ("y", 1, 1), ("y", 1, -1)], "g string, y int, p int")
    got = {r.g: r for r in metrics.evaluate(df, "y", "p", ["g"]).collect()}
    assert got["x"].g_mean == 0 and got["x"].auc == 1.0 and got["y"].auc == 0 and got["y"].accuracy == 0.5
    ranks = {r.g: r.auc for r in metrics.auc_rank(df, "y", "p", ["g"]).collect()}
    assert ranks == {"x": 1.0, "y": 0.0}
    assert [r.g for r in metrics.evaluate(df, "y", "p", ["g"], zero_pred="drop_fold").collect()] == ["y"]


def test_published_confusion(spark):
    rows = [(1, 1)] * 16 + [(1, -1)] + [(-1, -1)] * 38 + [(-1, 1)] * 2
    r = metrics.evaluate(spark.createDataFrame(rows, "y int, p int"), "y", "p", []).first()
    assert np.allclose([r.accuracy, r.auc, r.f1_score, r.g_mean], [54 / 57, 0.9455882, 32 / 35, 0.9455779], atol=1e-7)


@pytest.mark.parametrize("sets,want", [([[1, 2], [2, 3], []], 1 / 9), ([[1]], 1.0), ([[], []], 0.0)])
def test_stability(spark, sets, want):
    df = spark.createDataFrame([("m", i, s) for i, s in enumerate(sets)], "model string, fold int, selected array<int>")
    assert abs(selection.stability(df, ["model"]).first().stability - want) < 1e-12


def test_scan_labels_variants_and_missing(spark, tmp_path):
    (tmp_path / "wdbc.txt").write_text("".join(f"{i},{'M' if i % 3 else 'B'}," + ",".join(str(i + j) for j in range(30)) + "\n" for i in range(7)))
    df = datasets.scan(spark, str(tmp_path / "wdbc.txt"), datasets.spec_for("wdbc"))
    rows = df.orderBy("row_id").collect()
    assert [r.label for r in rows] == [-1, 1, 1, -1, 1, 1, -1] and rows[2].features[:2] == [2.0, 3.0] and len(rows[0].features) == 30
    (tmp_path / "a.txt").write_text(" ".join(["1"] * 14 + ["0"]) + "\n" + " ".join(["2"] * 14 + ["3"]) + "\n")
    assert [r.label for r in datasets.scan(spark, str(tmp_path / "a.txt"), datasets.spec_for("australia"), keep_others=True).collect()] == [-1, 3]
    with pytest.raises(datasets.DatasetMissing):
        datasets.scan(spark, str(tmp_path / "none.txt"), datasets.spec_for("sonar"))
    assert datasets.scan(spark, str(tmp_path / "none.txt"), datasets.spec_for("sonar"), on_missing="skip") is None
    assert datasets.spec_for("australia", "noise").sep == ","


@pytest.fixture(scope="module")
def tiny(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 4))
    y = np.where(x[:, 0] + 0.3 * r.normal(size=60) > 0, 1, -1)
    data = spark.createDataFrame([(i, "tiny", "original", x[i].tolist(), int(y[i])) for i in range(60)], "row_id long, dataset string, variant string, features array<double>, label int")
    return data, folds.exact_table(spark, 60, 5), x, y


def test_cross_validation_matches_a_loop(tiny):
    data, fold, x, y = tiny
    points = search.grid({"C": (0.5, 2.0), "B": (1, 2)})
    got = search.cross_validate(data, fold, {"MILP1": points}).collect()
    assert len(got) == 4 * 5 and {r.status for r in got} == {"optimal"}
    f = folds.exact_folds(60, 5)
    from hingeworks.operators.models import MILP1

    for r in got:
        a, b = search.scaled(x[f != r.fold], x[f == r.fold])
        m = MILP1(**points[r.combo_id]).fit(a, y[f != r.fold])
        assert abs(r.objective - m.fitted.objective) < 1e-6 * (1 + r.objective)
    same = {(r.fold, points[r.combo_id]["B"]): set() for r in got}
    for r in got:
        same[(r.fold, points[r.combo_id]["B"])].add(r.objective)
    assert all(len(v) == 1 for v in same.values())


def test_failures_are_rows_and_the_best_is_first(tiny, spark):
    data, fold, _, _ = tiny
    metrics_, best = experiment.run(data, fold, {"RFESVM": search.grid({"n_features": (0, 1), "C": (1.0,)}), "L1SVM": search.grid({"C": (1.0, 1.0)})})
    rows = metrics_.collect()
    assert {r.status for r in rows if r.model == "RFESVM" and r.combo_id == 0} == {"failed"}
    winners = {r.model: r for r in best.collect()}
    assert winners["L1SVM"].combo_id == 0 and winners["RFESVM"].combo_id == 1 and winners["L1SVM"].type == "Not noise"
    assert search.cross_validate(data, fold, {"L1SVM": []}).count() == 0
    late = search.cross_validate(data, fold, {"L1SVM": [{"C": 1.0}]}, deadline=1.0).collect()
    assert {r.status for r in late} == {"skipped"}


def test_tuning_and_sweeps(tiny):
    data, fold, x, y = tiny
    curve, best = experiment.tune(data, fold, "L1SVM", {"C": (0.01, 1.0)})
    assert {r.C for r in curve.collect()} == {0.01, 1.0} and best["C"] in (0.01, 1.0)
    assert experiment.sweep(data, fold, "B", (1, 2), {"C": 1.0, "tau": 0.5}).count() == 2
    for method in ("tasks", "passes"):
        found = search.fisher_search(data, None if method == "tasks" else fold, (0.5, 1.0), method)
        assert found["auc"] > 0.8 and 1 in found["selected"]


def test_rfe_search_by_passes_matches_tasks(tiny, monkeypatch):
    data, fold, x, y = tiny
    monkeypatch.setattr(search, "exact_folds", lambda m, k, seed: folds.exact_folds(m, 5, 42))
    a = search.rfe_in_tasks((x, y.astype(float)), (0.1, 1.0), folds=5)
    b = search.rfe_search(data, fold, (0.1, 1.0), "passes", tolerance=1e-7)
    assert a["C"] == b["C"] and a["selected"] == b["selected"] and abs(a["auc"] - b["auc"]) < 1e-9
    assert search.rfe_search(data, fold, (0.1, 1.0), "passes", rank="unscaled")["auc"] > 0.8


@pytest.mark.parametrize("reg,domain,scale", [("l1", "free", False), ("l2", "free", False), ("l1", "nonneg", False), ("l2", "nonneg", True)])
def test_a_fit_by_passes_is_near_the_exact_one(tiny, reg, domain, scale):
    data, _, x, y = tiny
    spec = Spec("hinge", reg, 1.0, domain=domain)
    passes = Passes(data.withColumn("fold", F.lit(0)).repartition(3), scale=scale)
    (got,) = passes.run([newton(passes.side(None), None, range(4), spec, 1e-6)])
    z = search.scaled(x, x)[0] if scale else x
    ew, eb, _ = fit(z, y.astype(float), spec)
    exact = objective(z, y, ew, eb, spec)
    assert exact - 1e-6 <= got.value <= exact + 1e-6 * (1 + exact) and got.bound <= exact + 1e-9 and got.gap <= 1e-6 * (1 + exact)
    assert abs(objective(z, y, got.full(4), got.b, spec) - got.value) < 1e-6 and passes.passes < 60


def test_a_degenerate_fit_is_proven(spark):
    """Labels that the features tell nothing of: weights are 0 and every row of one label lies on the bend."""
    r = np.random.default_rng(0)
    x, y = r.normal(size=(3000, 4)), np.where(r.random(3000) < 0.25, 1, -1)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(3000)], "features array<double>, label int")
    got = shared.fit_table(df, search.MODELS["L1SVM"](C=1.0, domain="free"), 1e-3)
    assert got.status == "optimal" and got.gap <= 1e-3 * (1 + got.objective)


def test_a_gap_that_is_not_closed_is_told(tiny, monkeypatch):
    from hingeworks.operators.solvers import passes

    data, _, _, _ = tiny
    monkeypatch.setattr(passes, "MOST_PASSES", 3)
    got = shared.fit_table(data, search.MODELS["L1SVM"](C=1.0))
    assert got.status == "gap_open" and got.gap > shared.TOLERANCE


def test_all_models_by_passes_match_tasks(tiny, monkeypatch):
    """Beyond MOST_NUMBERS nothing is refused, budgets neither, and the passes don't grow with points and folds."""
    data, fold, x, y = tiny
    grids = {
        "L1SVM": search.grid({"C": (0.5, 2.0)}), "L2SVM": [{"C": 1.0}], "PinballSVM": [{"C": 1.0, "tau": 0.3}], "FisherSVM": [{"n_features": 2}], "RFESVM": [{"n_features": 2}, {"n_features": 0}],
        "PinFSSVM": search.grid({"B": (1, 2, 3)}), "MILP1": [{"B": 2, "C": 1.0}, {"B": 2, "C": 9.0}],
    }
    want = {(r.model, r.combo_id, r.fold): r for r in search.cross_validate(data, fold, grids).collect()}
    counted = []
    run = Passes.run
    monkeypatch.setattr(Passes, "run", lambda self, *a: (run(self, *a), counted.append(self.passes))[0])
    monkeypatch.setattr(search, "MOST_NUMBERS", 10)
    rows = search.cross_validate(data, fold, grids).collect()
    assert len(rows) == len(want) == 12 * 5 and counted[0] < 120
    for r in rows:
        e = want[(r.model, r.combo_id, r.fold)]
        assert r.status == e.status
        if r.status != "failed":
            assert abs(r.objective - e.objective) <= 2e-6 * (1 + e.objective) and abs(r.accuracy - e.accuracy) < 0.11 and r.gap <= 1.01e-6 * (1 + r.objective)
    assert search.cross_validate(data, fold.where("fold < 2"), {"MILP1": [{"B": 2}]}).count() == 2 and counted[1] > counted[0] / 5
    late = search.cross_validate(data, fold, {"L1SVM": [{"C": 1.0}]}, deadline=1.0).collect()
    assert {r.status for r in late} == {"skipped"}


def test_one_tree_finds_the_fits_of_all_budgets(spark):
    from hingeworks.operators.solvers.bnb import fit_budget

    r = np.random.default_rng(5)
    x = r.normal(size=(200, 8))
    y = np.where(x @ r.normal(size=8) + 2 * r.normal(size=200) + 0.4 > 0, 1, -1)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(200)], "features array<double>, label int")
    grid = search.grid({"B": tuple(range(1, 9))}, {"C": 1.0, "tau": 0.5, "domain": "free"})
    fits = shared.fit_grid(df, {"PinFSSVM": grid}, tolerance=1e-5)["PinFSSVM"]
    z = search.scaled(x, x)[0]
    for b, f in enumerate(fits, 1):
        want = fit_budget(z, y.astype(float), Spec("pinball", "l1", 1.0, 0.5, "free", (-2.0, 2.0)), b)
        assert f.status == "optimal" and len(f.selected) <= b and abs(f.objective - want[2]) <= 2e-5 * (1 + want[2])


def test_the_path_in_c_equals_fits_on_the_way(spark):
    from dataclasses import replace

    r = np.random.default_rng(2)
    x = r.normal(size=(120, 3))
    y = np.where(x @ r.normal(size=3) + r.normal(size=120) + 0.3 > 0, 1, -1)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(120)], "features array<double>, label int").coalesce(1)
    spec, z = Spec("hinge", "l1", 1.0, domain="free"), search.scaled(x, x)[0]
    rows = shared.path(df, spec, 0.01, 0.05, 1e-6).orderBy("c_from").collect()
    assert rows[0].c_from == 0.01 and rows[-1].c_to == 0.05 and all(a.c_to == b.c_from for a, b in zip(rows, rows[1:])) and len(rows) > 3
    for c in np.geomspace(0.011, 0.049, 25):
        own = replace(spec, c=c)
        (row,) = [q for q in rows if q.c_from <= c < q.c_to]
        best = objective(z, y.astype(float), *fit(z, y.astype(float), own)[:2], own)
        assert objective(z, y.astype(float), np.array(row.w), row.b, own) <= best + 1e-4 * (1 + best)
    with pytest.raises(ValueError):
        shared.path(df, Spec("hinge", "l2", 1.0), 0.1, 1.0)


def test_scores_of_all_fits_are_ranked(tiny):
    data, fold, x, y = tiny
    a, b = ({(r.combo_id, r.fold): r.auc for r in search.cross_validate(data, fold, {"L2SVM": search.grid({"C": (0.1, 1.0)})}, auc_from="score", method=m).collect()} for m in ("tasks", "passes"))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.05 for k in a)


def test_the_winner_does_not_depend_on_how_rows_are_dealt(spark):
    """Points of equal folds tie, in whatever order their folds are summed."""
    aucs = [0.1, 0.2, 0.3, 0.7, 0.11, 0.13, 1 / 3, 2 / 3, 0.57, 0.91]
    rows = [("m", "d", "v", c, "{}", f, 0.5, a, 0.5, 0.5, 1.0, 1) for c in range(9) for f, a in enumerate(aucs)]
    df = spark.createDataFrame(rows, "model string, dataset string, variant string, combo_id long, params string, fold long, accuracy double, auc double, f1_score double, g_mean double, train_time double, num_features int")
    for seed in range(4):
        dealt = df.orderBy(F.rand(seed)).repartition(5 + seed)
        assert search.best(search.summary(dealt)).first().combo_id == 0
        assert search.summary(dealt).select("auc_mean").distinct().count() == 1


def test_a_stopped_experiment_goes_on(tiny, tmp_path, monkeypatch):
    data, fold, _, _ = tiny
    grid, store = {"L1SVM": search.grid({"C": (0.1, 0.5, 1.0, 2.0)}), "MILP1": [{"B": 1}]}, str(tmp_path / "store")
    monkeypatch.setattr(experiment, "AT_A_TIME", 2)
    real, calls = search.cross_validate, []

    def counted(data, folds, models, **k):
        calls.append(models)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(data, folds, models, **k)

    monkeypatch.setattr(search, "cross_validate", counted)
    with pytest.raises(KeyboardInterrupt):
        experiment.run(data, fold, grid, store=store)
    metrics_, best = experiment.run(data, fold, grid, store=store)
    assert [len(p) for m in calls for p in m.values()] == [2, 2, 2, 1] and calls[2] == {"L1SVM": grid["L1SVM"][2:]}
    rows = metrics_.collect()
    assert len(rows) == 25 and {r.status for r in rows} == {"optimal"} and best.count() == 2
    assert experiment.run(data, fold, grid, store=store)[0].count() == 25 and len(calls) == 4
    late = experiment.resumed(data, fold, grid | {"L2SVM": [{"C": 1.0}]}, store, deadline=1.0).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in late} == {"optimal": 25, "skipped": 5}


def test_running_jobs_end_at_the_deadline(spark):
    import time

    began = time.time()
    with pytest.raises(Exception), experiment.stopped_at(spark, began + 2):
        spark.range(4).repartition(4).mapInArrow(lambda batches: (time.sleep(60) or b for b in batches), "id long").collect()
    assert time.time() - began < 30
    assert spark.range(3).count() == 3  # later jobs aren't of the cancelled group


def test_permuted_folds_have_exact_sizes(spark):
    for m in (0, 3, 351):
        got = folds.permuted(spark.range(m).repartition(3).withColumnRenamed("id", "k"))
        sizes = sorted((r["count"] for r in got.groupBy("fold").count().collect()), reverse=True)
        assert sizes == [m // 10 + (i < m % 10) for i in range(10) if m // 10 + (i < m % 10)]
    a, b = (sorted(map(tuple, folds.permuted(spark.range(100).repartition(n).withColumnRenamed("id", "k")).collect())) for n in (1, 7))
    assert a == b


def test_files_are_numbered_in_order_at_any_width(spark, tmp_path):
    spec = datasets.DatasetSpec("s", 1)
    for f in range(3):
        (tmp_path / f"part-{f}.csv").write_text("".join(f"{f * 1000 + i}.5,1\n" for i in range(1000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = datasets.scan(spark, str(tmp_path), spec).repartition(4).collect()
            assert sorted(r.row_id for r in rows) == list(range(3000)) and all(r.features[0] == r.row_id + 0.5 for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "h.csv").write_text("a,b\n1,1\n2,0\n")
    assert [r.row_id for r in datasets.scan(spark, str(tmp_path / "h.csv"), datasets.DatasetSpec("h", 1, header=True)).orderBy("row_id").collect()] == [0, 1]


def test_budgets_searched_in_tasks_match_one_task(spark, tiny):
    from hingeworks.operators.models import MILP1, PinFSSVM
    from hingeworks.operators.solvers.bnb import Search

    _, _, x, y = tiny
    r = np.random.default_rng(3)
    x = np.hstack([x, r.normal(size=(60, 8))])
    for m in (MILP1(B=3), PinFSSVM(B=2, C=1.0, tau=0.5, domain="free"), PinFSSVM(B=40)):
        got, want = search.budgeted(spark, x, y.astype(float), m, 8), type(m).fit(m, x, y.astype(float)).fitted
        serial = Search(x, y.astype(float), m.spec, m.budget, m.costs)
        serial.run(serial.begin())
        assert got.passes <= max(1.2 * serial.explored, serial.explored + 8)
        assert got.status == want.status == "optimal" and abs(got.objective - want.objective) < 1e-5 * (1 + want.objective)


def test_hold_out_and_fold_sides(spark):
    df = spark.range(1000)
    sides = folds.hold_out(df, F.col("id"), 0.2, 2)
    for train, test in sides:
        assert train.count() + test.count() == 1000 and 140 < test.count() < 260 and train.join(test, "id").count() == 0
    assert sides[0][1].exceptAll(sides[1][1]).count() > 50
    numbered = df.withColumn("fold", F.col("id") % 10)
    assert folds.train_of(numbered, 3).count() == 900 and folds.test_of(numbered, 3).count() == 100


def test_chained_tuning(tiny):
    data, fold, _, _ = tiny
    got = experiment.chained(data, fold.where("fold < 2"), 2)
    assert got["C"]["C"] in experiment.TUNE_C and got["tau"]["tau"] in experiment.TUNE_TAU and set(got["both"]) == {"C", "tau", "B"}


def test_wide_correlations(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 45)) @ r.normal(size=(45, 45)) + 1e6
    names = [f"c{j}" for j in range(45)]
    df = spark.createDataFrame([tuple(row) for row in x.tolist()], names).repartition(5)
    got = {(c.feature_i, c.feature_j): c.corr for c in ranking.correlations(df, names).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 45 * 45 and all(abs(got[f"c{i}", f"c{j}"] - want[i, j]) < 1e-9 for i in range(45) for j in range(45))


@pytest.mark.parametrize("guards", [True, False])
def test_wide_fisher_scores_equal_the_narrow_ones(spark, monkeypatch, guards):
    r = np.random.default_rng(9)
    x = r.normal(size=(90, 6)) * [1, 2, 3, 4, 5, 0] + [0, 1e5, -3, 4, 5, 7]
    gone = r.random(x.shape) < 0.15
    rows = [tuple(None if g else float(v) for v, g in zip(a, b)) + (1 if i % 3 else -1,) for i, (a, b) in enumerate(zip(x, gone))]
    rows += [(None,) * 6 + (1,)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(6)) + ", label int").repartition(3)
    names = [f"c{j}" for j in range(6)]
    want = {c.j: c.score for c in ranking.fisher_scores(df, names, guards=guards).collect()}
    monkeypatch.setattr(ranking, "PAIRWISE", 2)
    got = {c.j: c.score for c in ranking.fisher_scores(df, names, guards=guards).collect()}
    assert got.keys() == want.keys()
    for j in got:
        assert got[j] == want[j] if want[j] is None else abs(got[j] - want[j]) < 1e-7 * (1 + want[j])


def test_correlations_in_blocks_leave_out_nulls_by_pair(spark, monkeypatch):
    from hingeworks.operators import gram

    monkeypatch.setattr(gram, "MOST_HELD", 6 * 7 * 7 * 2)  # two cells a pass
    r = np.random.default_rng(6)
    x = r.normal(size=(120, 23)) @ r.normal(size=(23, 23)) - 1e5
    x[:, 4] = 3.0
    gone = r.random(x.shape) < 0.1
    rows = [([None if g else float(v) for v, g in zip(a, b)],) for a, b in zip(x, gone)]
    got = {(c.a, c.b): c.corr for c in gram.correlations(spark.createDataFrame(rows, "features array<double>").repartition(4), 23, 7).collect()}
    assert len(got) == 23 * 23
    for i in range(23):
        for j in range(23):
            both = ~gone[:, i] & ~gone[:, j]
            if 4 in (i, j):
                assert got[i, j] is None
            else:
                assert abs(got[i, j] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-8


def test_results_are_appended(spark, tmp_path):
    names = ["Model", "Type of model", "Accuracy", "AUC", "Time", "Features selected", "Number of features", "C"]
    row = spark.createDataFrame([("L1SVM", "Noise", 0.5, 0.5, 0.1, [1, 2], 2, 1.0)], names)
    sinks.append_results(row, str(tmp_path / "r"), tau=False)
    sinks.append_results(row, str(tmp_path / "r"), tau=False)
    back = spark.read.csv(str(tmp_path / "r"), header=True)
    assert back.columns == names and back.count() == 2 and back.first()["Features selected"] == "1, 2"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", "d", "v", 1, [2, 6])], "model string, dataset string, variant string, fold int, selected array<int>")
    sinks.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    sinks.export_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().selected == "2, 6"
    assert sinks.detail_name("MILP1", "wdbc", "both", {"C": 0.125, "B": 1}, "20250101-000000") == "MILP1_wdbc_both_C0.125_B1_20250101-000000.csv"
    assert sinks.sweep_name("wdbc", "Noise + Outlier") == "wdbc_c_auc_log_noise_outlier.csv"


def test_stream_is_scored(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(src.schema).parquet(f"{sf}/events.parquet*")
    out = scoring.scored(stream, ["value"], [1.0], -50.0).withColumn("label", F.when(F.col("event_type") == "click", 1).otherwise(-1))
    q = scoring.windowed_confusion(out, "ts", "label", "1 day").writeStream.format("memory").queryName("conf").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(tn + fp + fn + tp) AS n FROM conf").first().n == src.count()


def test_equal_rows_are_one_weighted_row(spark, tiny):
    """F3, F4, F13 to F24: passes over many rows of few kinds go over the kinds; rows that don't repeat stay as they are."""
    from hingeworks.operators.solvers.passes import condensed

    data, fold, x, y = tiny
    rows = data.join(fold, "row_id").select("features", "label", "fold")
    assert condensed(rows).columns == ["features", "label", "fold"]
    often = rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(7))))
    few = condensed(often)
    assert few.count() == rows.distinct().count() and few.agg(F.sum("weight")).first()[0] == 7 * rows.count()
    plain, whole = Passes(rows), Passes(few)
    spec = Spec("hinge", "l1", 7.0, domain="free"), Spec("hinge", "l1", 1.0, domain="free")
    (a,), (b,) = plain.run([newton(plain.side(1), 1, range(4), spec[0], 1e-8)]), whole.run([newton(whole.side(1), 1, range(4), spec[1], 1e-8)])
    assert np.allclose(whole.side(1).sd, plain.side(1).sd) and np.allclose(whole.side(None).mean, plain.side(None).mean)
    assert abs(a.value - b.value) < 1e-6 * (1 + a.value) and abs(a.bound - b.bound) < 1e-6 * (1 + a.value)
    got = {r.combo_id: r.asDict() for r in search.summary(shared.cross_validate(data, fold, {"L1SVM": [{"C": 0.7}]}, auc_from="score")).collect()}
    many = data.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(7)))).join(fold, "row_id")
    same = {r.combo_id: r.asDict() for r in search.summary(shared.cross_validate(many, "fold", {"L1SVM": [{"C": 0.1}]}, auc_from="score")).collect()}
    for c in ("accuracy_mean", "auc_mean", "f1_score_mean", "g_mean_mean"):
        assert abs(got[0][c] - same[0][c]) < 1e-9


@pytest.fixture(scope="module")
def thrice(spark, sf, tmp_path_factory):
    """Line items three times over, with keys of their own that leave folds and labels as they are."""
    path = str(tmp_path_factory.mktemp("thrice"))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows.withColumns({"l_orderkey": F.col("l_orderkey") + F.col("copy") * 10_000_000, "l_partkey": F.col("l_partkey") + F.col("copy") * 7_000_000}).drop("copy").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ("cv_items_folds", "fit_all_budgets", "fit_rfe_three", "fit_milp1_items", "path_l1_items", "sweep_fit_b", "fit_fisher_three", "fit_budget_items", "fit_l1_three", "fit_l1_three_strong"))
def test_passes_do_not_grow_with_the_table(spark, sf, thrice, name, monkeypatch):
    """F14 to F23: the rows that a query's passes go over are the kinds of rows, as many in a larger table as in a small one."""

    class Seen(Exception):
        pass

    def seen(rows):
        raise Seen(rows.count())

    monkeypatch.setattr(shared, "Passes", seen)
    found = []
    for d in (sf, thrice):
        with pytest.raises(Seen) as e:
            catalogue.QUERIES[name](spark, d)
        found.append(e.value.args[0])
    assert found[0] == found[1] <= 540


def test_heavy_rows_are_fitted_to_a_proven_gap(spark):
    """F8, F10: where thousands of equal rows lie on the bend, slopes lose digits before the gap closes; predicted slopes don't."""
    r = np.random.default_rng(3)
    x = np.array([(a, b, c) for a in (0, 1, 4) for b in (0, 1, 4) for c in (0, 1, 4)], dtype=float)
    rows = []
    for p in x:
        up = 1 / (1 + np.exp(4 - 1.6 * p[0] - 0.2 * p[1]))
        n = int(r.integers(2_000, 60_000))
        rows += [(p.tolist(), 1, 0, int(n * up) + 1), (p.tolist(), -1, 0, n - int(n * up) + 1)]
    passes = Passes(spark.createDataFrame(rows, "features array<double>, label int, fold int, weight long").coalesce(1))
    for c in (1e-4, 1.0, 50.0):
        (got,) = passes.run([newton(passes.side(None), None, range(3), Spec("hinge", "l1", c, domain="free"), 1e-8)])
        assert got.gap <= 1e-8 * (1 + got.value) and got.bound <= got.value and got.passes < 60


def test_rows_without_a_fold_are_trained_on_only(tiny):
    data, fold, x, y = tiny
    own = data.join(fold, "row_id").withColumn("fold", F.when(F.col("fold") > 0, F.col("fold")))
    got = shared.cross_validate(own, "fold", {"L1SVM": [{"C": 1.0}]}).collect()
    want = {r.fold: r for r in shared.cross_validate(data, fold, {"L1SVM": [{"C": 1.0}]}).collect()}
    assert sorted(r.fold for r in got) == [1, 2, 3, 4] and all(abs(r.objective - want[r.fold].objective) < 1e-5 * (1 + r.objective) for r in got)


def test_predictions_of_zero_are_outside_the_cells(spark):
    """a score of exactly 0 is in no cell of the SQL, and doesn't make g_mean 0."""
    rows = [("x", 1, 1), ("x", 1, 1), ("x", 1, -1), ("x", 1, 0), ("x", -1, -1), ("x", -1, 1), ("x", -1, 0), ("y", 1, 1), ("y", 1, 0)]
    got = {r.g: r for r in metrics.evaluate(spark.createDataFrame(rows, "g string, y int, p int"), "y", "p", ["g"], "outside").collect()}
    assert np.allclose([got["x"].accuracy, got["x"].auc, got["x"].f1_score, got["x"].g_mean], [3 / 7, (2 / 3 + 1 / 2) / 2, 4 / 6, (1 / 3) ** 0.5])
    assert got["y"].accuracy == 0.5 and got["y"].auc is None and got["y"].g_mean is None and got["y"].f1_score == 1.0


def test_a_score_is_never_below_itself(spark):
    """percentile masks of scores whose evaluations differ in the last digit, here by a random order."""
    scores = spark.createDataFrame([(j, f"f{j}", float(j)) for j in range(1, 6)], "j int, feature string, score double").repartition(3)
    shaky = scores.withColumn("score", F.col("score") + F.rand() * 1e-12)
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    got = ranking.percentile_masks(shaky.mapInArrow(counted, shaky.schema)).where("selected").groupBy("percentile").count().collect()
    assert {r.percentile: r["count"] for r in got} == {0.25: 4, 0.5: 3, 0.75: 2} and calls.value == 5


def test_eliminations_and_searches_leave_tasks_earlier(spark, sf, monkeypatch):
    """One task does many fits there, so beyond MOST_HELD numbers they go by passes, while one budgeted fit stays in tasks up to MOST_NUMBERS."""
    rows = catalogue._wide(spark, sf).select("row_id", F.slice("features", 1, 4).alias("features"), "label")
    assert search.fit_any(rows, search.MODELS["RFESVM"](n_features=2)).passes is None
    assert search._small(rows, None) is not None
    monkeypatch.setattr(search, "MOST_HELD", 10)
    assert search.fit_any(rows, search.MODELS["RFESVM"](n_features=2)).passes > 0
    assert search._small(rows, None) is None


def test_winners_evaluate_the_fits_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("m", "d", "v", c, "{}", k, 0.5, 0.5 + c / 10, 0.5, 0.5, 0.0, 1) for c in range(3) for k in range(2)]
    schema = "model string, dataset string, variant string, combo_id long, params string, fold long, accuracy double, auc double, f1_score double, g_mean double, train_time double, num_features int"
    made = search.summary(spark.createDataFrame(rows, schema).mapInArrow(run, schema))
    top = search.best(made)
    assert top.columns == made.columns and [r.combo_id for r in top.collect()] == [2]
    assert seen.value == len(rows)
