"""Queries over fitted preparation, models and validation loops.

Inputs are the order windows of every customer; labels come from the outcomes of the subjects.
Logistic grids are the full ones in `nested_cv` and `elastic_net_cv`; forests are small, so that SQL can grow them too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_to_long, seeded_hash
from ..operators import endpoints, estimators, frozen, hazard, population, preprocess, validation
from ..operators.metrics import ranking_metrics, run_metrics
from . import fit_sql
from . import tables as t
from .fit_sql import LABELLED_SQL
from .registry import query

INPUTS = ["x0", "x1", "x2", "x3"]
GRID = [{"C": 0.1, "l1_ratio": 0.5}, {"C": 1.0, "l1_ratio": 0.5}]


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _frame(spark, sf):
    """One row per customer: spending inputs, one of them with gaps, and a label that depends on them."""
    o = t.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(
        (F.count("*") / 10.0).alias("x0"), (F.avg("o_totalprice") / 100000.0).alias("x1"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("x2")
    )
    c = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 1000.0).alias("x3"), "c_mktsegment")
    noise = hash_to_long(seeded_hash(5, F.col("entity_id")), 4) / 65536.0
    risk = F.col("x2") + 0.3 * F.coalesce("x3", F.lit(0.0)) / 10 + noise
    # merged, not broadcast: customers compress to few bytes, which Spark takes for few rows
    return c.join(o.hint("merge"), "entity_id").select("entity_id", *INPUTS, "c_mktsegment", (risk > 1.1).cast("int").alias("label"))


FRAME_SQL = """ord AS (SELECT o_custkey AS entity_id, count(*) / 10.0::DOUBLE AS x0, avg(o_totalprice) / 100000.0::DOUBLE AS x1, avg((o_orderstatus = 'F')::INT::DOUBLE) AS x2 FROM orders GROUP BY 1),
frame AS (SELECT c_custkey AS entity_id, x0, x1, x2, CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000.0::DOUBLE END AS x3, c_mktsegment FROM customer JOIN ord ON entity_id = c_custkey)"""


@query("impute_median", f"WITH {FRAME_SQL} SELECT entity_id, round(x0, 6) AS x0, round(coalesce(x3, (SELECT quantile_cont(x3, 0.5) FROM frame)), 6) AS x3 FROM frame")
def _(spark, sf):
    df = preprocess.impute_median(_frame(spark, sf).select("entity_id", "x0", "x3"), ["x0", "x3"])
    return _rounded(df, ["x0", "x3"])


@query("missing_indicators", f"WITH {FRAME_SQL} SELECT entity_id, (x3 IS NULL)::INT::DOUBLE AS missing_x3 FROM frame")
def _(spark, sf):
    return preprocess.missing_indicators(_frame(spark, sf).select("entity_id", "x0", "x3"), ["x0", "x3"]).drop("x0", "x3")


@query(
    "standard_scale",
    f"WITH {FRAME_SQL}, s AS (SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1 FROM frame) SELECT entity_id, round((x0 - m0) / s0, 6) AS x0, round((x1 - m1) / s1, 6) AS x1 FROM frame, s",
)
def _(spark, sf):
    return _rounded(preprocess.standard_scale(_frame(spark, sf).select("entity_id", "x0", "x1"), ["x0", "x1"]), ["x0", "x1"])


@query(
    "categorical_encode",
    """WITH f AS (SELECT CASE WHEN c_acctbal < 0 THEN NULL WHEN c_nationkey = 3 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer), m AS (SELECT v FROM f WHERE v <> 'NEW' GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
    SELECT level, count(*) FILTER (coalesce(v, (SELECT v FROM m)) = level) AS n FROM f, (SELECT DISTINCT v AS level FROM f WHERE v IS NOT NULL AND v <> 'NEW') GROUP BY 1""",
)
def _(spark, sf):
    c = t.read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, None).when(F.col("c_nationkey") == 3, "NEW").otherwise(F.col("c_mktsegment")).alias("v"))
    coded, levels = preprocess.categorical_encode(c.filter("v <> 'NEW' or v is null"), c, "v", "hot")
    sums = coded.agg(*[F.sum(F.col("hot")[i]).cast("long").alias(n) for i, n in enumerate(levels)])
    return sums.unpivot([], levels, "level", "n")


@query(
    "detect_categorical",
    """SELECT 'c_name' AS name, 'categorical' AS kind, count(DISTINCT c_name) AS levels, count(*) FILTER (c_name IS NULL) AS missing FROM customer UNION ALL SELECT 'c_mktsegment', 'categorical', count(DISTINCT c_mktsegment), count(*) FILTER (c_mktsegment IS NULL) FROM customer
    UNION ALL SELECT 'c_custkey', 'other', NULL, count(*) FILTER (c_custkey IS NULL) FROM customer UNION ALL SELECT 'c_nationkey', 'other', NULL, count(*) FILTER (c_nationkey IS NULL) FROM customer
    UNION ALL SELECT 'c_acctbal', 'other', NULL, count(*) FILTER (c_acctbal IS NULL) FROM customer""",
)
def _(spark, sf):
    # Levels of the columns found categorical, gaps of all columns, in one pass.
    c = t.read(spark, sf, "customer")
    cat, rest = preprocess.detect_categorical(c)
    facts = c.agg(*[F.struct(F.lit(n).alias("name"), F.lit("categorical" if n in cat else "other").alias("kind"), (F.countDistinct(n) if n in cat else F.lit(None).cast("long")).alias("levels"), F.count_if(F.col(n).isNull()).alias("missing")).alias(n) for n in [*cat, *rest]])
    return facts.select(F.inline(F.array(*[F.col(n) for n in [*cat, *rest]])))


def _coefficients(spark, fit):
    rows = [("intercept", round(fit.intercept, 3))] + [(n, round(c, 3)) for n, c in zip(fit.prep.outputs, fit.coef)]
    return spark.createDataFrame(rows, "input string, coefficient double")


@query("logistic_l2", f"WITH RECURSIVE {LABELLED_SQL}, {fit_sql.single(INPUTS, [], 1.0, 0.0)} {fit_sql.coefficients(INPUTS, [])}")
def _(spark, sf):
    return _coefficients(spark, estimators.fit_logistic(_frame(spark, sf), INPUTS, C=1.0))


@query("logistic_elastic_net", f"WITH RECURSIVE {LABELLED_SQL}, {fit_sql.single(INPUTS, ['x3'], 0.1, 0.5)} {fit_sql.coefficients(INPUTS, ['x3'])}")
def _(spark, sf):
    return _coefficients(spark, estimators.fit_logistic(_frame(spark, sf), INPUTS, C=0.1, l1_ratio=0.5, indicators=True))


@query(
    "logistic_balanced_l1_l2",
    f"""WITH RECURSIVE {LABELLED_SQL}, {fit_sql.single(INPUTS, [], 0.1, 1.0, weight=fit_sql.BALANCED, name="a")}, {fit_sql.single(INPUTS, [], 0.1, 0.0, weight=fit_sql.BALANCED, name="b")}
    SELECT *, 'l1' AS penalty FROM ({fit_sql.coefficients(INPUTS, [], "a")}) UNION ALL SELECT *, 'l2' FROM ({fit_sql.coefficients(INPUTS, [], "b")})""",
)
def _(spark, sf):
    f = _frame(spark, sf).persist()
    w = estimators.balanced_weight(f)
    a, b = [estimators.fit_logistic(f, INPUTS, C=0.1, l1_ratio=r, weight=w) for r in (1.0, 0.0)]
    f.unpersist()
    return _coefficients(spark, a).withColumn("penalty", F.lit("l1")).unionByName(_coefficients(spark, b).withColumn("penalty", F.lit("l2")))


TREE_PARAMS = {"n_estimators": 12}
HALVES_SQL = f"""raw AS (SELECT h::VARCHAR AS key, entity_id, label AS y, (entity_id % 4 < 2) = (h = 0) AS train, {", ".join(INPUTS)} FROM frame, (SELECT unnest([0, 1]) AS h)),
med AS (SELECT key, {", ".join(f"quantile_cont({c}, 0.5) FILTER (train) AS {c}" for c in INPUTS)} FROM raw GROUP BY key),
half AS (SELECT r.key, entity_id, y, train, {", ".join(f"coalesce(r.{c}, m.{c}) AS x{i}" for i, c in enumerate(INPUTS))} FROM raw r JOIN med m ON r.key = m.key),
sizes AS (SELECT key, count(*) AS n, sum(y) AS positives FROM half WHERE train GROUP BY key), specs AS ({fit_sql.tree_specs([("one", TREE_PARAMS)], "sizes", len(INPUTS))}),
{fit_sql.forest("half", "specs", len(INPUTS), 42, "f")},
nodes AS (SELECT key, count(DISTINCT tree || ':' || path) AS nodes, max(length(path)) AS depth FROM f_walk GROUP BY key)"""


@query("extra_trees", f"WITH RECURSIVE {LABELLED_SQL}, {HALVES_SQL} SELECT entity_id, y AS label, round(score, 6) AS score, nodes, depth FROM f_score JOIN nodes USING (key) WHERE NOT train")
def _(spark, sf):
    # Two halves by entity; the trees of one, with the study's settings and no bound on depth, score the other.
    f = _frame(spark, sf)
    half = F.col("entity_id") % 4 < 2
    parts = []
    for train, test in ((f.filter(half), f.filter(~half)), (f.filter(~half), f.filter(half))):
        fit = estimators.fit_forest(train, INPUTS, TREE_PARAMS)
        size = fit.nodes.agg(F.count("*").alias("nodes"), F.max(F.length("path")).cast("long").alias("depth"))
        parts.append(fit.scored(test).select("entity_id", "label", F.round("score", 6).alias("score")).crossJoin(F.broadcast(size)))
    return parts[0].unionByName(parts[1])


@query("prior_model", f"WITH {t.PREDICTIONS_SQL} SELECT entity_id, round((SELECT avg(label) FROM base), 8) AS score FROM base")
def _(spark, sf):
    b = t.predictions(spark, sf).filter("model = 'price'").select("entity_id", "label")
    return b.select("entity_id", F.round(estimators.fit_prior(b).score(), 8).alias("score"))


def _named(grid):
    import json

    return [(json.dumps(g, sort_keys=True), "ALL", INPUTS, g["C"], g["l1_ratio"]) for g in grid]


# The candidate with the best mean inner precision of each outer fold, and what follows from it.
BEST_SQL = "best AS (SELECT k, min_by(cand, (-ap, cand)) AS cand, max(ap) AS ap FROM n_inner GROUP BY k)"
PICKED_SQL = "picked AS (SELECT o.* FROM n_oof o JOIN best ON k = fold AND o.cand = best.cand)"
POOLED_SQL = """pool AS (SELECT h.k, entity_id, label, score FROM n_held h JOIN best USING (k, cand)),
ptied AS (SELECT k, score, sum(label) AS p, count(*) AS n FROM pool GROUP BY ALL),
prun AS (SELECT *, sum(p) OVER w AS pu, sum(n) OVER w AS nu FROM ptied WINDOW w AS (PARTITION BY k ORDER BY score DESC)),
pap AS (SELECT k, sum(p * pu / nu::DOUBLE) / sum(p)::DOUBLE AS pooled_ap FROM prun GROUP BY k),
cuts AS (SELECT k, score AS cut FROM (SELECT k, score, row_number() OVER (PARTITION BY k ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY k) AS n FROM pool WHERE label = 0) WHERE r = least(floor(0.7::DOUBLE * n), n - 1))"""
#: Axes of the random search over trees, small enough for the SQL twin.
SEARCH_AXES = {"n_estimators": [4, 6], "max_depth": [None, 4], "min_samples_split": [2, 6], "min_samples_leaf": [1, 3], "max_features": ["sqrt", 0.7], "class_weight": ["balanced", "1:2"]}
SEARCH_DRAWS = estimators.tree_draws(4, 42, SEARCH_AXES)


def _settings(grid):
    import json

    return [(json.dumps(g, sort_keys=True), g) for g in grid]


@query(
    "param_search",
    f"""WITH RECURSIVE {LABELLED_SQL}, {fit_sql.nested_forests(_settings(SEARCH_DRAWS), INPUTS, seed=42, outer=2, inner=2)}, {BEST_SQL}, {POOLED_SQL}
    SELECT k::INTEGER AS fold, cand AS best_params, round(pooled_ap, 4) AS "inner_oof_AP" FROM best JOIN pap USING (k)""",
)
def _(spark, sf):
    # Random search: seeded settings of forests, compared inside every outer fold.
    r = validation.nested_cv(_frame(spark, sf), INPUTS, model="trees", outer=2, inner=2, grid=SEARCH_DRAWS)
    return r.folds.select("fold", "best_params", F.round("inner_oof_AP", 4).alias("inner_oof_AP"))


@query(
    "nested_cv",
    f"""WITH RECURSIVE {LABELLED_SQL}, {fit_sql.nested(_named(estimators.l2_grid()), INPUTS, seed=42, outer=5, inner=3)}, {BEST_SQL}, {PICKED_SQL}, {POOLED_SQL}
    SELECT entity_id, label, fold, round(score, 4) AS score, (score > cut)::INTEGER AS prediction, 'logistic' AS model, 42 AS seed FROM picked JOIN cuts ON k = fold""",
)
def _(spark, sf):
    r = validation.nested_cv(_frame(spark, sf), INPUTS)
    return r.oof.select("entity_id", "label", "fold", F.round("score", 4).alias("score"), "prediction", "model", "seed")


HOURLY_GRID = [{"n_estimators": 5}, {"n_estimators": 5, "max_depth": 4, "min_samples_leaf": 4}]


@query(
    "legacy_nested_cv",
    f"""WITH RECURSIVE {LABELLED_SQL}, {fit_sql.nested_forests(_settings(HOURLY_GRID), INPUTS, seed=42, outer=5, inner=3)}, {BEST_SQL}, {PICKED_SQL}, {POOLED_SQL}
    SELECT entity_id, label, fold, round(score, 6) AS score, (score > cut)::INTEGER AS prediction FROM picked JOIN cuts ON k = fold""",
)
def _(spark, sf):
    r = validation.hourly_nested_cv(_frame(spark, sf), INPUTS, model="trees", grid=HOURLY_GRID)
    return r.oof.select("entity_id", "label", "fold", F.round("score", 6).alias("score"), "prediction")


REPEATED_GRID = [{"C": 0.1, "l1_ratio": 0.0}, {"C": 1.0, "l1_ratio": 0.0}]
REPEATED_SEEDS = [1, 2, 3]


def _repeated_sql():
    runs = ", ".join(fit_sql.nested(_named(REPEATED_GRID), INPUTS, seed=s, outer=5, inner=3, name=f"s{s}") for s in REPEATED_SEEDS)
    best = ", ".join(f"b{s} AS (SELECT k, min_by(cand, (-ap, cand)) AS cand FROM s{s}_inner GROUP BY k)" for s in REPEATED_SEEDS)
    priors = ", ".join(f"f{s} AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('{s}|' || entity_id), entity_id) - 1) % 5 + 1 AS INTEGER) AS fold FROM frame)" for s in REPEATED_SEEDS)
    rows = " UNION ALL ".join(
        f"SELECT 'logistic' AS model, {s} AS seed, label, score FROM s{s}_oof o JOIN b{s} b ON k = fold AND o.cand = b.cand UNION ALL SELECT 'prior', {s}, label, (SELECT avg(o.label) FROM f{s} o WHERE o.fold <> f{s}.fold) FROM f{s}" for s in REPEATED_SEEDS)
    return f"""WITH RECURSIVE {LABELLED_SQL}, {runs}, {best}, {priors}, scored AS ({rows}), {fit_sql.metrics("scored", "model, seed")}
    SELECT model, count(*) AS seed_count, round(avg(auc), 4) AS "AUC_mean", round(quantile_cont(brier, 0.5), 4) AS "Brier_median" FROM facts GROUP BY model"""


@query("repeated_cv", _repeated_sql())
def _(spark, sf):
    _, per_seed, summary = validation.repeated_cv(_frame(spark, sf), INPUTS, models=["logistic"], seeds=REPEATED_SEEDS, grid=REPEATED_GRID)
    _, _, prior = validation.repeated_cv(_frame(spark, sf), INPUTS, models=["prior"], seeds=REPEATED_SEEDS)
    return validation.repeated_wide(summary.unionByName(prior)).select("model", "seed_count", F.round("AUC_mean", 4).alias("AUC_mean"), F.round("Brier_median", 4).alias("Brier_median"))


FACTS = 'round(auc, 4) AS "AUC", round(ap, 4) AS "AP", round(brier, 4) AS "Brier", round(bss, 4) AS "BSS"'


@query(
    "elastic_net_cv",
    f"""WITH RECURSIVE {LABELLED_SQL}, {fit_sql.nested(_named(estimators.elastic_grid()), INPUTS, seed=3, outer=5, inner=3, flags=["x3"])}, {BEST_SQL}, {PICKED_SQL}, run AS (SELECT 'BASE' AS model, 3 AS seed, * FROM picked), {fit_sql.metrics("run", "model, seed")}
    SELECT model, seed, {FACTS} FROM facts""",
)
def _(spark, sf):
    r = validation.elastic_net_cv(_frame(spark, sf), INPUTS, run="BASE", seed=3)
    return _rounded(run_metrics(r.oof, ["model", "seed"]), ["AUC", "AP", "Brier", "BSS"], 4)


RECIPE_GRID = estimators.elastic_grid([0.01, 0.1, 1.0], [0.0, 0.5])
RECIPES = {"ALL": INPUTS, "SHORT": ["x0", "x2"], "PAIR": ["x1", "x3"]}


def _recipe_sql(recipes, grid, seed, outer, inner, columns):
    import json

    screen = [(f"screen {n}", n, c, 0.1, 0.5) for n, c in recipes.items()]
    tuned = [(f"{json.dumps(g, sort_keys=True)} {n}", n, c, g["C"], g["l1_ratio"]) for n, c in recipes.items() for g in grid]
    every = sorted({c for cols in recipes.values() for c in cols})
    sizes = "CASE recipe " + " ".join(f"WHEN '{n}' THEN {len(c)}" for n, c in recipes.items()) + " END"
    flags = ["x3"] if "x3" in every else []
    return f"""WITH RECURSIVE {LABELLED_SQL}, {fit_sql.nested([*screen, *tuned], every, seed=seed, outer=outer, inner=inner, flags=flags)},
    chosen AS (SELECT k, min_by(recipe, (-ap, recipe)) AS recipe, max(ap) AS screening FROM n_inner WHERE starts_with(cand, 'screen') GROUP BY k),
    best AS (SELECT k, recipe, screening, min_by(cand, (-ap, cand)) AS cand FROM n_inner JOIN chosen USING (k, recipe) WHERE NOT starts_with(cand, 'screen') GROUP BY ALL), {PICKED_SQL}, {fit_sql.metrics("picked", "fold")}
    SELECT fold, recipe AS selected_recipe, {sizes} AS input_count, round(screening, 4) AS "screening_AP", {columns} FROM best JOIN facts ON k = fold"""


@query("recipe_selector_cv", _recipe_sql(RECIPES, RECIPE_GRID, 1, 5, 3, 'round(auc, 4) AS "AUC"'))
def _(spark, sf):
    r = validation.recipe_selector_cv(_frame(spark, sf), RECIPES, seed=1, grid=RECIPE_GRID)
    return r.folds.select("fold", "selected_recipe", "input_count", F.round("screening_AP", 4).alias("screening_AP"), F.round("AUC", 4).alias("AUC"))


@query("fixed_recipe_cv", _recipe_sql({"SHORT": ["x0", "x2"]}, RECIPE_GRID, 1, 5, 3, 'round(ap, 4) AS "AP"'))
def _(spark, sf):
    r = validation.fixed_recipe_cv(_frame(spark, sf), "SHORT", ["x0", "x2"], seed=1, grid=RECIPE_GRID)
    return r.folds.select("fold", "selected_recipe", "input_count", F.round("screening_AP", 4).alias("screening_AP"), F.round("AP", 4).alias("AP"))


def _selection_sql():
    import json

    screen = [(f"screen {n}", n, c, 0.1, 0.5) for n, c in RECIPES.items()]
    tuned = [(f"{json.dumps(g, sort_keys=True)} {n}", n, c, g["C"], g["l1_ratio"]) for n, c in RECIPES.items() for g in GRID]
    names = [*INPUTS, "missing_x3"]
    rows = " UNION ALL ".join(
        ["SELECT 'intercept' AS input, b AS w, 1 AS used FROM n_fit JOIN best USING (cand) WHERE key = '1:0'"]
        + [f"SELECT '{f}', w{i}, u{i} FROM n_fit JOIN best USING (cand) JOIN n_cands USING (cand) WHERE key = '1:0'" for i, f in enumerate(names)])
    return f"""WITH RECURSIVE {LABELLED_SQL}, {fit_sql.nested([*screen, *tuned], INPUTS, seed=42, outer=0, inner=3, flags=["x3"])},
    chosen AS (SELECT k, min_by(recipe, (-ap, recipe)) AS recipe, max(ap) AS screening FROM n_inner WHERE starts_with(cand, 'screen') GROUP BY k),
    best AS (SELECT k, recipe, screening, min_by(cand, (-ap, cand)) AS cand, max(ap) AS tuned FROM n_inner JOIN chosen USING (k, recipe) WHERE NOT starts_with(cand, 'screen') GROUP BY ALL), coefs AS ({rows})
    SELECT recipe, replace(cand, ' ' || recipe, '') AS params, round(screening, 4) AS "screening_AP", round(tuned, 4) AS "inner_AP", input, round(w, 3) AS coefficient FROM coefs, best WHERE used = 1"""


@query("search_and_refit", _selection_sql())
def _(spark, sf):
    # Selection on all rows, the refitted model as parameter rows, and those rows read back into a model.
    import json

    f = _frame(spark, sf)
    chosen = validation.search_and_refit(f, RECIPES, grid=GRID)
    loaded = frozen.load_parameters(frozen.parameter_table(f, chosen.fit))
    facts = [F.lit(chosen.recipe).alias("recipe"), F.lit(json.dumps(chosen.params, sort_keys=True)).alias("params"), F.lit(round(chosen.screening, 4)).alias("screening_AP"), F.lit(round(chosen.inner_score, 4)).alias("inner_AP")]
    return _coefficients(spark, loaded).select(*facts, "input", "coefficient")


SWEEP = {"BASE": ["x0"], "PLUS_X2": ["x0", "x2"]}


def _sweep_sql():
    seeds = [1, 2]
    runs, rows = [], []
    for n, cols in SWEEP.items():
        for seed in seeds:
            name = f"{n.lower()}{seed}"
            runs.append(fit_sql.nested(_named(GRID), cols, seed=seed, outer=3, inner=2, name=name))
            runs.append(f"b_{name} AS (SELECT k, min_by(cand, (-ap, cand)) AS cand FROM {name}_inner GROUP BY k)")
            rows.append(f"SELECT '{n}' AS model, {seed} AS seed, label, score FROM {name}_oof o JOIN b_{name} b ON k = fold AND o.cand = b.cand")
    return f"WITH RECURSIVE {LABELLED_SQL}, {', '.join(runs)}, scored AS ({' UNION ALL '.join(rows)}), {fit_sql.metrics('scored', 'model, seed')} SELECT model, seed, {FACTS} FROM facts"


@query("candidate_sweep", _sweep_sql())
def _(spark, sf):
    oof = validation.candidate_sweep(_frame(spark, sf), SWEEP, seeds=[1, 2], outer=3, inner=2, grid=GRID)
    return _rounded(run_metrics(oof, ["model", "seed"]), ["AUC", "AP", "Brier", "BSS"], 4)


@query(
    "fit_diagnostics",
    f"""WITH plan AS (SELECT * FROM (VALUES ('recipe_screening', {len(RECIPES)} * 3), ('hyperparameter_search', 2 * 3), ('outer_final_refit', 1)) v(stage, per_fold)), folds AS (SELECT unnest(range(5)) AS k FROM (SELECT 1 FROM orders LIMIT 1))
    SELECT run, stage, sum(per_fold)::BIGINT AS fits, CASE run WHEN 'cut short' THEN sum(per_fold) ELSE 0 END::BIGINT AS not_converged, CASE run WHEN 'cut short' THEN 2 END AS max_iterations
    FROM plan, folds, (SELECT unnest(['whole', 'cut short']) AS run) GROUP BY run, stage""",
)
def _(spark, sf):
    # One run to the end and one stopped after two steps.
    f = _frame(spark, sf).persist()
    parts = []
    for run, steps in (("whole", 100), ("cut short", 2)):
        r = validation.recipe_selector_cv(f, RECIPES, seed=2, grid=GRID, max_iter=steps)
        table = validation.diagnostics_by_stage(validation.fit_diagnostics(f, r.fits))
        parts.append(table.select(F.lit(run).alias("run"), "stage", "fits", "not_converged", F.when(F.lit(run == "cut short"), F.col("max_iterations")).alias("max_iterations")))
    f.unpersist()
    return parts[0].unionByName(parts[1])


FREEZE = [*INPUTS, "missing_x3"]
FREEZE_SQL = " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{n}' AS name, '{n.removeprefix('missing_')}' AS source, {'TRUE' if i == 4 else 'FALSE'} AS is_indicator, {'NULL::DOUBLE' if i == 4 else f'round(fit_med.{n}, 6)'} AS median, round(m_{n}, 6) AS mean, "
    f"round(s_{n}, 6) AS scale, round(w{i}, 3) AS coefficient, round(b, 3) AS intercept, (SELECT count(*) FROM frame) AS n, TRUE AS same FROM fit JOIN fit_med USING (key) JOIN fit_std USING (key)" for i, n in enumerate(FREEZE)
)


@query("model_freeze", f"WITH RECURSIVE {LABELLED_SQL}, {fit_sql.single(INPUTS, ['x3'], 1.0, 0.5)} {FREEZE_SQL}")
def _(spark, sf):
    f = _frame(spark, sf)
    fit = estimators.fit_logistic(f, INPUTS, C=1.0, l1_ratio=0.5, indicators=True)
    table = frozen.parameter_table(f, fit)
    gap = frozen.formula_gap(f.select("entity_id", *INPUTS), fit, table, ["entity_id"])
    rounded = _rounded(_rounded(table, ["median", "mean", "scale"]), ["coefficient", "intercept"], 3)
    return rounded.crossJoin(F.broadcast(gap.select("n", (F.col("max_error") < 1e-12).alias("same"))))


SCORE_SQL = " + ".join(["b", *[f"w{i} * z{i}" for i in range(len(INPUTS))]])


@query("score_frozen", f"WITH RECURSIVE {LABELLED_SQL}, {fit_sql.single(INPUTS, [], 1.0, 0.0)} SELECT entity_id, round(1 / (1 + exp(-({SCORE_SQL}))), 4) AS probability FROM fit_z JOIN fit USING (key)")
def _(spark, sf):
    f = _frame(spark, sf)
    table = frozen.parameter_table(f, estimators.fit_logistic(f, INPUTS, C=1.0))
    return frozen.score_frozen(f.select("entity_id", *INPUTS), table, ["entity_id"]).withColumn("probability", F.round("probability", 4))


OR_REPS = 200
ODDS_SQL = f"""WITH RECURSIVE {LABELLED_SQL}, {fit_sql.single(INPUTS, [], 1.0, 0.0, weight=fit_sql.BALANCED)},
    idx AS (SELECT entity_id, row_number() OVER (ORDER BY md5('7|' || entity_id), entity_id) - 1 AS k, count(*) OVER () AS n FROM frame),
    dr AS (SELECT rep, ('0x' || substr(md5('7|' || rep || '|' || i.k), 1, 15))::BIGINT % n AS k FROM idx i, (SELECT unnest(range({OR_REPS})) AS rep)),
    drawn AS (SELECT rep, entity_id, count(*) AS weight FROM dr JOIN idx USING (k) GROUP BY 1, 2),
    classes AS (SELECT rep, sum(weight)::DOUBLE AS total, sum(weight * y)::DOUBLE AS pos FROM drawn JOIN fit_z USING (entity_id) GROUP BY 1),
    boot_z AS (SELECT rep AS key, y, weight * CASE WHEN y = 1 THEN total / (2 * pos) ELSE total / (2 * (total - pos)) END AS wt, {", ".join(f"z{i}" for i in range(len(INPUTS)))}
      FROM drawn JOIN fit_z f USING (entity_id) JOIN classes USING (rep)),
    boot_set AS (SELECT DISTINCT key, 'one' AS cand, 1.0::DOUBLE AS c, 0.0::DOUBLE AS l1, {", ".join(f"1 AS u{i}" for i in range(len(INPUTS)))} FROM boot_z),
    {fit_sql.descent("boot_z", "boot_set", len(INPUTS), "boot", 1200)},
    long AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, w{i} AS w FROM boot" for i, n in enumerate(INPUTS))}),
    ci AS (SELECT feature, quantile_cont(w, 0.025) AS lo, quantile_cont(w, 0.975) AS hi FROM long GROUP BY 1),
    point AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, w{i} AS w FROM fit" for i, n in enumerate(INPUTS))})
    SELECT feature, round(w, 3) AS coef, round(exp(w), 3) AS odds_ratio, round(lo, 3) AS coef_ci_low, round(hi, 3) AS coef_ci_high, round(exp(lo), 3) AS or_ci_low, round(exp(hi), 3) AS or_ci_high, round(abs(w), 3) AS abs_coef
    FROM point JOIN ci USING (feature)"""


@query("odds_ratio_bootstrap", ODDS_SQL)
def _(spark, sf):
    df = frozen.odds_ratio_bootstrap(_frame(spark, sf), INPUTS, replicates=OR_REPS, seed=7)
    return _rounded(df, [c for c in df.columns if c != "feature"], 3)


def _hazard_frame(spark, sf):
    s = t.subjects(spark, sf).filter("source_valid and followup_days is not null")
    timed = endpoints.cause_specific_times(s).join(_frame(spark, sf).select("entity_id", "x0", "x1", "x2"), "entity_id")
    return preprocess.standard_scale(timed, ["x0", "x1", "x2"])


HAZARD_SQL = f"""WITH RECURSIVE {t.ENDPOINTS_SQL}, {LABELLED_SQL},
    timed AS (SELECT least(time_to_event, 365) AS days, (state = 'POSITIVE')::INT AS event_primary, (state = 'COMPETING_EVENT')::INT AS event_competing, x0, x1, x2
      FROM labelled JOIN frame USING (entity_id) WHERE horizon_days = 365 AND source_valid AND time_to_event IS NOT NULL),
    moments AS (SELECT {", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in range(3))} FROM timed),
    cases AS (SELECT key, days, CASE key WHEN 'primary' THEN event_primary ELSE event_competing END AS d, {", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in range(3))}
      FROM timed, moments, (SELECT unnest(['primary', 'competing']) AS key)),
    {fit_sql.hazard("cases", 3)}
    SELECT key AS cause, predictor, round(w, 6) AS coefficient, CASE WHEN w > 0 THEN 'positive' WHEN w < 0 THEN 'negative' ELSE 'zero' END AS direction, 0.1::DOUBLE AS penalty, events::BIGINT AS events, n::BIGINT AS n
    FROM ({" UNION ALL ".join(f"SELECT key, 'x{i}' AS predictor, w{i} AS w, events, n FROM hz" for i in range(3))})"""


@query("cause_specific_hazard", HAZARD_SQL)
def _(spark, sf):
    f = _hazard_frame(spark, sf).persist()
    tables = [hazard.hazard_table(f, cause, hazard.fit_hazard(f, ["x0", "x1", "x2"], "days", f"event_{cause}")) for cause in ("primary", "competing")]
    f.unpersist()
    return _rounded(tables[0].unionByName(tables[1]), ["coefficient"], 6)


@query(
    "baseline_cumulative_hazard",
    f"""WITH {t.ENDPOINTS_SQL}, e AS (SELECT least(time_to_event, 365) AS days, (state = 'POSITIVE')::INT AS d FROM labelled WHERE horizon_days = 365 AND source_valid AND time_to_event IS NOT NULL),
    g AS (SELECT days, sum(d) AS d, count(*) AS n FROM e GROUP BY 1), r AS (SELECT days, d / sum(n) OVER (ORDER BY days DESC)::DOUBLE AS h FROM g) SELECT days, round(sum(h) OVER (ORDER BY days), 8) AS cumulative_hazard FROM r""",
)
def _(spark, sf):
    # With all coefficients at zero the risk sums are plain counts.
    f = endpoints.cause_specific_times(t.subjects(spark, sf).filter("source_valid and followup_days is not null")).withColumn("x0", F.lit(0.0))
    fit = hazard.HazardFit(["x0"], [0.0], 0, 0, 0)
    return _rounded(hazard.baseline_cumulative_hazard(f, fit, "days", "event_primary"), ["cumulative_hazard"], 8)
