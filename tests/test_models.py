import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import bootstrap, estimators, frozen, hazard, preprocess, validation

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.8 * rng.normal(size=60) > 0).astype(int)
    rows = [(f"e{i:02d}", int(y[i]), float(x[i, 0]), float(x[i, 1]) if i % 7 else None, float(x[i, 2])) for i in range(60)]
    return spark.createDataFrame(rows, "entity_id string, label int, a double, b double, c double").persist()


def test_preparation_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (10.0, None), (20.0, None), (None, None)], "x double, y double")
    p = preprocess.fit_preparation(df, ["x", "y"], indicators=True)
    assert p.medians == {"x": 6.0, "y": 0.0} and p.indicators == ["x", "y"]
    filled = np.array([1, 2, 10, 20, 6.0])
    assert p.means["x"] == pytest.approx(filled.mean()) and p.scales["x"] == pytest.approx(filled.std())
    assert p.scales["y"] == 1.0 and p.scales["missing_y"] == 1.0 and p.scales["missing_x"] == pytest.approx(0.4)


def test_one_hot_ignores_unknown(spark):
    train = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string")
    coded, levels = preprocess.categorical_encode(train, spark.createDataFrame([("y",), (None,), ("z",)], "v string"), "v", "h")
    assert levels == ["x", "y"] and [r.h for r in coded.collect()] == [[0.0, 1.0], [1.0, 0.0], [0.0, 0.0]]


def test_logistic_meets_its_optimum(frame):
    fit = estimators.fit_logistic(frame, ["a", "c"], C=0.5)
    pdf = frame.toPandas()
    z = (pdf[["a", "c"]] - pdf[["a", "c"]].mean()) / pdf[["a", "c"]].std(ddof=0)
    w = np.array(fit.coef)
    p = 1 / (1 + np.exp(-(fit.intercept + z.to_numpy() @ w)))
    # Gradient of the summed loss plus the penalty |w|^2 / (2 C) vanishes at the fit.
    assert np.abs(z.to_numpy().T @ (p - pdf.label) + w / 0.5).max() < 1e-2
    assert abs((p - pdf.label).sum()) < 1e-2


def test_frozen_parameters_give_the_same_scores(frame):
    fit = estimators.fit_logistic(frame, COLS, C=1.0, l1_ratio=0.5, indicators=True)
    table = frozen.parameter_table(frame, fit)
    inputs = frame.select("entity_id", *COLS)
    assert frozen.formula_gap(inputs, fit, table, ["entity_id"]).first().max_error < 1e-12
    with pytest.raises(ValueError):
        frozen.score_frozen(inputs.drop("c"), table, ["entity_id"])


def test_nested_cv_contract_and_repeat(frame):
    kw = dict(outer=3, inner=2, grid=[{"C": 0.1, "l1_ratio": 0.0}, {"C": 1.0, "l1_ratio": 0.0}], seed=4)
    r = validation.nested_cv(frame, COLS, **kw)
    rows = {x.entity_id: (x.fold, round(x.score, 8), x.prediction) for x in r.oof.collect()}
    assert len(rows) == 60 and {f for f, _, _ in rows.values()} == {1, 2, 3} and r.folds.count() == 3
    again = {x.entity_id: (x.fold, round(x.score, 8), x.prediction) for x in validation.nested_cv(frame, COLS, **kw).oof.collect()}
    assert rows == again
    with pytest.raises(ValueError):
        validation.nested_cv(frame.unionByName(frame), COLS, **kw)


def test_repeated_cv_shapes(frame):
    oof, per_seed, summary = validation.repeated_cv(frame, COLS, models=["prior"], seeds=[2, 5], outer=3, inner=2)
    assert oof.count() == 120 and per_seed.count() == 2 and summary.count() == 8


def test_selector_picks_a_recipe_per_fold(frame):
    r = validation.recipe_selector_cv(frame, {"GOOD": ["a", "c"], "POOR": ["c"]}, seed=1, outer=2, inner=2, grid=[{"C": 1.0, "l1_ratio": 0.0}])
    assert {x.selected_recipe for x in r.folds.collect()} == {"GOOD"}
    stages = {x.stage: x.fits for x in validation.diagnostics_by_stage(validation.fit_diagnostics(frame, r.fits)).collect()}
    assert stages == {"recipe_screening": 8, "hyperparameter_search": 4, "outer_final_refit": 2}


def test_trees_and_odds_ratios(frame):
    fit = estimators.fit_forest(frame, COLS, {"n_estimators": 5, "max_depth": 3, "min_samples_leaf": 2}, seed=1)
    assert fit.scored(frame).filter(~F.col("score").between(0, 1)).count() == 0
    t = {r.feature: r for r in frozen.odds_ratio_bootstrap(frame, ["a", "c"], replicates=3, seed=1).collect()}
    assert t["a"].odds_ratio == pytest.approx(np.exp(t["a"].coef)) and t["a"].or_ci_low <= t["a"].or_ci_high and t["a"].coef > 0


@pytest.mark.parametrize("l1_ratio,balanced", [(0.0, True), (0.5, False)])
def test_refits_equal_one_fit_per_replicate(frame, l1_ratio, balanced):
    from cohortflow.operators.bootstrap import drawn_lists

    prep = preprocess.fit_preparation(frame, COLS)
    ready = frame.select("entity_id", F.array(*prep.scaled().values()).alias("x"), F.col("label").cast("long").alias("y"))
    fits = frozen.weighted_refits(drawn_lists(ready, frame, 3, 11), len(COLS), C=0.5, l1_ratio=l1_ratio, balanced=balanced)
    assert sorted(fits) == [0, 1, 2]
    weights = bootstrap.bootstrap_draws(frame, 3, 11)
    for rep, coef in fits.items():
        drawn = frame.join(weights.filter(F.col("rep") == rep), "entity_id")
        r = drawn.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("p")).first()
        share = estimators.class_weight(r["n"], r["p"]) if balanced else F.lit(1.0)
        one = estimators.fit_logistic(drawn, COLS, C=0.5, l1_ratio=l1_ratio, prep=prep, weight=F.col("weight") * share)
        assert coef == pytest.approx([one.intercept, *one.coef], abs=2e-5)


def test_search_and_refit_on_all_rows(frame):
    chosen = validation.search_and_refit(frame, {"GOOD": ["a", "c"], "POOR": ["c"]}, seed=1, inner=2, grid=[{"C": 1.0, "l1_ratio": 0.0}, {"C": 0.1, "l1_ratio": 0.0}])
    assert chosen.recipe == "GOOD" and chosen.params["C"] in (0.1, 1.0) and len(chosen.fits) == 4 + 4 + 1
    whole = estimators.fit_logistic(frame, ["a", "c"], indicators=True, **chosen.params)
    assert chosen.fit.coef == pytest.approx(whole.coef, abs=1e-6)
    alone = validation.search_and_refit(frame, {"ONE": ["a"]}, inner=2, grid=[{"C": 1.0, "l1_ratio": 0.0}])
    assert alone.screening == alone.inner_score


def test_tree_draws_do_not_repeat():
    for seed in (2, 42):
        draws = estimators.tree_draws(200, seed)
        assert len({tuple(sorted(d.items(), key=str)) for d in draws}) == 200
        assert {d["max_depth"] for d in draws} == {None, 4, 6, 8, 10, 14} and {d["min_samples_split"] for d in draws} == {2, 4, 6, 8, 10}
    assert sorted(map(str, estimators.tree_draws(9, 1, {"a": [1, 2], "b": [None, 3]}))) == sorted(map(str, [{"a": x, "b": y} for x in (1, 2) for y in (None, 3)]))


def _efron(x, t, e, penalty):
    """Newton steps over explicit risk sets."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        r = np.exp(x @ b)
        g, h = -len(x) * penalty * b, len(x) * penalty * np.eye(len(b))
        for s in sorted(set(t[e == 1])):
            at, dead = t >= s, (t == s) & (e == 1)
            d = dead.sum()
            g = g + x[dead].sum(axis=0)
            for k in range(d):
                w = r * at - k / d * r * dead
                m = (w[:, None] * x).sum(axis=0) / w.sum()
                g = g - m
                h = h + (w[:, None] * x).T @ x / w.sum() - np.outer(m, m)
        b = b + np.linalg.solve(h, g)
    return b


def test_hazard_matches_explicit_risk_sets(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2))
    t, e = rng.integers(1, 12, 60).astype(float), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d)) for (a, b), c, d in zip(x, t, e)], "x double, y double, days double, ev int")
    fit = hazard.fit_hazard(df, ["x", "y"], "days", "ev")
    assert fit.coef == pytest.approx(_efron(x, t, e, 0.1), abs=1e-8)
    last = hazard.baseline_cumulative_hazard(df, fit, "days", "ev").orderBy(F.desc("days")).first()
    r = np.exp(x @ np.array(fit.coef))
    want = sum(((t == s) & (e == 1)).sum() / r[t >= s].sum() for s in set(t))
    assert last.cumulative_hazard == pytest.approx(want)


# ---- randomised trees ----

def _slow_forest(x, y, spec, seed):
    """Nodes of one forest by plain recursion: {(tree, path): (n, positives, input, threshold)}."""
    import hashlib

    out = {}

    def weigh(labels):
        a, b = (len(labels) - sum(labels)) * spec.zero, sum(labels) * spec.one
        return (a * a + b * b) / (a + b)

    def grow(tree, path, rows):
        labels = [y[r] for r in rows]
        best = None
        if 0 < sum(labels) < len(rows) and len(rows) >= max(spec.min_split, 2 * spec.min_leaf) and (spec.max_depth is None or len(path) < spec.max_depth):
            digest = [hashlib.md5(f"{seed}|{tree}|{path}|{i}".encode()).hexdigest() for i in range(len(x[0]))]
            order = sorted(range(len(x[0])), key=lambda i: (digest[i][:8], i))
            spread = [i for i in order if len({x[r][i] for r in rows}) > 1]
            for i in [i for i in order[:spec.inputs] if i in spread] or spread[:1]:
                low, high = min(x[r][i] for r in rows), max(x[r][i] for r in rows)
                at = low + int(digest[i][8:20], 16) / 2.0**48 * (high - low)
                left, right = [r for r in rows if x[r][i] <= at], [r for r in rows if x[r][i] > at]
                if min(len(left), len(right)) >= spec.min_leaf:
                    gain = weigh([y[r] for r in left]) + weigh([y[r] for r in right])
                    if best is None or gain > best[0]:
                        best = (gain, i, at, left, right)
        out[(tree, path)] = (len(rows), sum(labels), *(best[1:3] if best else (None, None)))
        if best:
            grow(tree, path + "0", best[3])
            grow(tree, path + "1", best[4])

    for tree in range(spec.trees):
        grow(tree, "", list(range(len(y))))
    return out


@pytest.mark.parametrize("params,in_parts", [({}, 70), ({"max_depth": 2, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": 0.7, "class_weight": "1:3"}, 0)])
def test_trees_equal_plain_recursion_whole_and_in_parts(spark, params, in_parts):
    from cohortflow.operators import trees

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 4)), 2)
    x[:, 3] = 1.0
    y = (x[:, 0] - x[:, 1] + rng.normal(size=150) > 0.4).astype(int)
    spec = trees.forest_spec(0, 0, {"n_estimators": 2, **params}, 4, 150, int(y.sum()))
    rows = spark.createDataFrame([(0, [float(v) for v in r], int(t)) for r, t in zip(x, y)], "members int, x array<double>, y int").repartition(3)
    want = _slow_forest(x.tolist(), y.tolist(), spec, 9)
    for local_rows in (20_000, in_parts):  # in one task; with the lower levels in tasks, or level by level to the end
        nodes = trees.grow_forests(rows, [spec], seed=9, local_rows=local_rows)
        assert {(r.tree, r.path): (r.n, r.positives, r.input, r.threshold) for r in nodes.collect()} == want
    if not params:
        assert max(len(p) for _, p in want) > 5 and all(n >= 2 for n, *_ in want.values())
    asked = rows.limit(20).selectExpr("x", "array(0) AS forests")
    a, b = ({tuple(r.x): r.score for r in trees.score_forests(asked, nodes, keep=["x"], model_nodes=m).collect()} for m in (10**6, 0))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    for point, score in a.items():
        leaves = []
        for tree in range(2):
            path = ""
            while want[(tree, path)][2] is not None:
                _, _, i, at = want[(tree, path)]
                path += "0" if point[i] <= at else "1"
            n, p = want[(tree, path)][:2]
            leaves.append(p * spec.one / ((n - p) * spec.zero + p * spec.one))
        assert score == pytest.approx(sum(leaves) / 2)


def test_a_level_is_one_pass_and_rows_meet_subtrees(spark):
    from cohortflow.operators import trees

    rng = np.random.default_rng(8)
    x = np.exp(3 * rng.normal(size=(400, 2)))
    y = rng.integers(0, 2, 400)
    spec = trees.forest_spec(0, 0, {"n_estimators": 3}, 2, 400, int(y.sum()))
    rows = spark.createDataFrame([(0, [float(v) for v in r], int(t)) for r, t in zip(x, y)], "members int, x array<double>, y int").repartition(3).persist()
    rows.count()
    spark.sparkContext.setJobGroup("grown", "")
    nodes = trees.grow_forests(rows, [spec], seed=3, local_rows=60)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    depth = max(len(r.path) for r in nodes.filter("n > 60").collect())
    assert depth > 3 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("grown")) <= 2 * (depth + 1) + 12
    asked = rows.selectExpr("x", "array(0) AS forests")
    whole, met = ({tuple(r.x): r.score for r in trees.score_forests(asked, nodes, keep=["x"], model_nodes=m, local_rows=60).collect()} for m in (10**6, 0))
    assert whole == met


def test_a_fitted_forest_of_many_nodes_scores_the_rows_it_gets(spark, monkeypatch):
    from cohortflow.operators import estimators, trees

    # `_row` and `_kept` are names that scoring uses itself
    df = spark.range(60).selectExpr("id AS entity_id", "cast(id % 7 AS double) AS a", "cast(id % 5 AS double) AS b", "cast(id % 3 = 0 AS int) AS label", "id AS _row", "id + 1 AS _kept")
    fit = estimators.fit_forest(df, ["a", "b"], {"n_estimators": 2})
    whole = sorted(fit.scored(df).collect())
    inner = trees._score_by_subtrees
    monkeypatch.setattr(trees, "score_forests", lambda rows, nodes, *, keep: inner(rows, nodes, keep, trees.LOCAL_ROWS))
    met = fit.scored(df)
    assert met.columns == [*df.columns, "score"] and sorted(met.collect()) == whole and len(whole) == 60


def test_forests_of_several_sets_grow_together(spark):
    from cohortflow.operators import trees

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 2)), rng.integers(0, 2, 60)
    rows = spark.createDataFrame([(i % 3, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "members int, x array<double>, y int")
    specs = [trees.forest_spec(f, f % 3, {"n_estimators": 2 + f}, 2, 20, int(y[f % 3::3].sum())) for f in range(4)]
    together = trees.grow_forests(rows, specs, seed=1)
    for s in specs:
        alone = trees.grow_forests(rows, [s], seed=1)
        assert sorted(map(str, together.filter(f"forest = {s.forest}").collect())) == sorted(map(str, alone.collect()))
    assert trees.inputs_tried("sqrt", 100) == 10 and trees.inputs_tried("log2", 100) == 6 and trees.inputs_tried(0.5, 9) == 4 and trees.inputs_tried("sqrt", 1) == 1
    assert trees.class_weights("balanced", 10, 4) == (10 / 12, 10 / 8) and trees.class_weights("1:2", 10, 4) == (1.0, 2.0)


def test_trees_are_tuned_inside_the_folds(frame):
    grid = [{"n_estimators": 5, "max_depth": None}, {"n_estimators": 5, "max_depth": 2, "min_samples_split": 2, "min_samples_leaf": 4}]
    r = validation.nested_cv(frame, COLS, model="trees", outer=3, inner=2, grid=grid, seed=4)
    rows = r.oof.collect()
    assert len({x.entity_id for x in rows}) == 60 and all(0 <= x.score <= 1 for x in rows) and r.folds.count() == 3 and r.fits == []
    folds = {x.entity_id: x.fold for x in rows}
    best = {x.fold: x.best_params for x in r.folds.collect()}
    import json

    for k in (1, 2):  # each fold equals one forest grown on the other folds
        inside = [e for e, f in folds.items() if f != k]
        fit = estimators.fit_forest(frame.filter(F.col("entity_id").isin(inside)), COLS, json.loads(best[k]), seed=4)
        want = {x.entity_id: x.score for x in fit.scored(frame.filter(~F.col("entity_id").isin(inside))).collect()}
        assert want == pytest.approx({x.entity_id: x.score for x in rows if x.fold == k})


# ---- the batched solver ----

@pytest.mark.parametrize("balanced,C,l1_ratio", [(False, 1.0, 0.0), (True, 0.5, 0.3), (False, 0.05, 1.0), (True, 1e6, 0.0)])
def test_batched_fits_equal_single_fits(frame, monkeypatch, balanced, C, l1_ratio):
    from cohortflow.operators import batched

    sets = validation.TrainingSets(frame, COLS, [3, 8], 3, 2, indicators=True)
    specs = [batched.ModelSpec(s, cols, C, l1_ratio) for s in sorted(sets.preps) for cols in (("a", "b", "c"), ("b",))]
    together = batched.fit_models(sets.rows, sets.features, specs, balanced=balanced)
    monkeypatch.setattr(batched, "PASS_BYTES", 8 * 60 * 7)
    assert all(np.allclose(a.beta, b.beta, atol=1e-7) for a, b in zip(together, batched.fit_models(sets.rows, sets.features, specs, balanced=balanced)))
    assert len(specs) == 2 * 3 * 3 * 2 and all(s.converged for s in together)
    for spec, found in list(zip(specs, together))[::7]:
        train = frame.join(sets.rows.filter(F.array_contains("train", spec.members)).select("entity_id"), "entity_id")
        weight = estimators.balanced_weight(train) if balanced else None
        one = estimators.fit_logistic(train, list(spec.inputs), C=C, l1_ratio=l1_ratio, indicators=True, weight=weight)
        same = validation.logistic_fit(sets, spec.members, list(spec.inputs), {"C": C, "l1_ratio": l1_ratio}, found)
        assert [same.intercept, *same.coef] == pytest.approx([one.intercept, *one.coef], abs=2e-4) and same.prep.outputs == one.prep.outputs


def test_medians_of_sets_without_repeating_rows(spark):
    from cohortflow.operators import batched

    rng = np.random.default_rng(4)
    values = [[float(rng.integers(0, 6)), float(rng.normal()) if rng.random() > 0.4 else None, None, float("inf") if rng.random() > 0.9 else float(rng.normal())] for _ in range(300)]
    sets = [sorted(rng.choice(7, size=3, replace=False).tolist()) for _ in values]
    rows = spark.createDataFrame(list(zip(values, sets)), "x array<double>, train array<int>").repartition(3)
    for buckets in (16, 1024):
        got = batched.set_medians(rows, COLS4, 7, buckets=buckets)
        for s in range(7):
            for i, c in enumerate(COLS4):
                own = [v[i] for v, t in zip(values, sets) if s in t and v[i] is not None]
                assert got[s][c] == (pytest.approx(float(np.median(own))) if own else None)


COLS4 = ["a", "b", "c", "d"]


def test_a_fit_that_is_cut_short_says_so(frame):
    r = validation.nested_cv(frame, COLS, outer=2, inner=2, grid=[{"C": 1.0, "l1_ratio": 0.0}], max_iter=2)
    assert r.fits and not any(f["converged"] for f in r.fits) and {f["iterations"] for f in r.fits} == {2}


def test_jobs_do_not_grow_with_settings(spark, frame):
    def jobs(grid, seeds):
        spark.sparkContext.setJobGroup("count", "count")
        validation.nested_runs(frame, {"x": COLS}, seeds=seeds, outer=2, inner=2, grid=grid).oof.count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("count"))

    few = jobs([{"C": 1.0, "l1_ratio": 0.0}], [1])
    total = jobs([{"C": c, "l1_ratio": 0.0} for c in (0.1, 0.2, 0.5, 0.8, 1.0)], [1, 2])
    assert total - few <= few + 10


def test_customers_are_not_broadcast_to_their_orders(spark, sf):
    from cohortflow.plans import model_queries

    plan = model_queries._frame(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
