"""Nested, repeated and recipe-selecting cross-validation, all fits of a stage in one batch.

Folds are columns, training sets are numbers: a row lists the sets that train on it and the sets that predict it. All
settings of all inner folds, outer folds and seeds are fitted together (`batched` for logistic models, `trees` for forests),
scored in one pass and compared in one grouped job, so the number of jobs does not depend on folds, seeds or settings.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SCREEN_C, SCREEN_L1_RATIO
from ..functions.parsing import nan_to_null
from ..session import cut_lineage
from . import trees
from .batched import Features, ModelSpec, Solution, fit_models, score_models, set_medians
from .distributions import repeated_summary, repeated_summary_wide
from .estimators import LogisticFit, elastic_grid, l2_grid, tree_draws
from .metrics import apply_cut, compute_metrics, ranking_metrics, run_metrics, threshold_target_specificity
from .ordered import HASH_DIGITS, HOT_ROWS, ONE_BUCKET, hash_rank
from .preprocess import Preparation, fit_preparations
from .relational import assert_unique, stack_frames

#: Rows over all training sets up to which hashed ranks take few buckets.
FEW_ROWS = 20_000_000
#: Every row belongs to at most this many training sets at a time; more seeds are run group by group.
MAX_SETS = 4000


@dataclass
class CVResult:
    """Out-of-fold predictions, fold table and fit records of one run."""

    oof: DataFrame
    folds: DataFrame
    fits: list[dict]


@dataclass
class Unit:
    """One tuning problem: the training rows of an outer fold under a seed, with the settings to compare there."""

    run: str
    seed: int
    fold: int
    candidates: list[tuple[str, list[str], dict]]


class TrainingSets:
    """All training sets of some seeds: set j > 0 of an outer fold leaves out its inner fold j, set 0 is all of its training rows.

    Without outer folds (0) fold 1 trains on every row and predicts none.
    """

    def __init__(self, frame: DataFrame, cols: list[str], seeds: list[int], outer: int, inner: int, *, indicators: bool):
        self.cols, self.seeds, self.outer, self.inner, self.indicators = list(cols), list(seeds), outer, inner, indicators
        base = frame.select("entity_id", F.col("label").cast("int").alias("label"), *cols).persist()
        n = base.count()
        digits = 1 if n * len(seeds) * max(1, outer) <= FEW_ROWS else HASH_DIGITS
        self.splits = ONE_BUCKET if n <= HOT_ROWS else None
        number = F.create_map(*[F.lit(v) for i, s in enumerate(self.seeds) for v in (int(s), i)])
        labelled = base.select("entity_id", "label", F.explode(F.array(*[F.lit(int(s)) for s in self.seeds])).alias("seed"))
        if outer:
            dealt = hash_rank(labelled, ["seed", "label"], "entity_id", F.col("seed"), digits=digits)
            dealt = dealt.select("entity_id", "label", "seed", (F.col("rank") % outer + 1).cast("int").alias("fold"))
            trained = dealt.select("*", F.explode(F.filter(F.sequence(F.lit(1), F.lit(outer)), lambda k: k != F.col("fold"))).alias("k"))
        else:
            trained = labelled.select("*", F.lit(0).alias("fold"), F.lit(1).alias("k"))
        placed = hash_rank(trained, ["seed", "k", "label"], "entity_id", F.col("seed"), digits=digits)
        placed = placed.withColumn("j", (F.col("rank") % inner + 1).cast("int"))
        first = (number[F.col("seed")] * max(1, outer) + F.col("k") - 1) * (inner + 1)
        others = F.filter(F.sequence(F.lit(0), F.lit(inner)), lambda j: j != F.col("j"))
        lists = placed.groupBy("entity_id").agg(
            F.flatten(F.collect_list(F.transform(others, lambda j: (first + j).cast("int")))).alias("train"), F.collect_list((first + F.col("j")).cast("int")).alias("held"))
        if outer:
            own = (number[F.col("seed")] * outer + F.col("fold") - 1) * (inner + 1)
            lists = lists.join(dealt.groupBy("entity_id").agg(F.collect_list(own.cast("int")).alias("test")), "entity_id")
        else:
            lists = lists.withColumn("test", F.array().cast("array<int>"))
        x = F.array(*[nan_to_null(F.col(c).cast("double")) for c in cols])
        self.rows = cut_lineage(base.select("entity_id", "label", x.alias("x")).join(lists, "entity_id"))
        base.unpersist()
        spread = self.rows.select("label", F.explode("train").alias("_members"), *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(cols)])
        self.preps: dict[int, Preparation] = fit_preparations(spread, self.cols, "_members", indicators=indicators, label="label", medians=lambda n: set_medians(self.rows, self.cols, n))
        self.features = Features(self.cols, self.preps, indicators)

    def number(self, unit: Unit, j: int) -> int:
        return (self.seeds.index(unit.seed) * max(1, self.outer) + unit.fold - 1) * (self.inner + 1) + j


@dataclass
class Setup:
    """What all fits of one run share."""

    kind: str = "logistic"
    balanced: bool = False
    metric: str = "AP"
    max_iter: int = 100


def _scored(sets: TrainingSets, setup: Setup, asked: list[tuple[int, int, int, list[str], dict]], column: str) -> tuple[DataFrame, dict]:
    """Fit every (unit, candidate, set, inputs, parameters) and score the rows that list the set in `column`.

    Returns entity_id, label, members, unit, candidate, score, and the solutions of logistic fits by (unit, candidate, set).
    """
    keep = ["entity_id", "label"]
    if setup.kind == "prior":
        facts = [(s, u, c, sets.preps[s].positives / sets.preps[s].rows) for u, c, s, _, _ in asked if s in sets.preps]
        table = F.broadcast(sets.rows.sparkSession.createDataFrame(facts, "members int, unit int, candidate int, score double"))
        return cut_lineage(sets.rows.select(*keep, F.explode(column).alias("members")).join(table, "members")), {}
    if setup.kind == "trees":
        return _forest_scores(sets, asked, column, keep), {}
    specs = [ModelSpec(s, tuple(cols), float(p["C"]), float(p["l1_ratio"])) for _, _, s, cols, p in asked]
    solved = fit_models(sets.rows, sets.features, specs, balanced=setup.balanced, max_iter=setup.max_iter)
    models: dict[int, list] = {}
    for (u, c, s, _, _), solution in zip(asked, solved):
        models.setdefault(s, []).append((u, c, solution.beta))
    return cut_lineage(score_models(sets.rows, sets.features, models, column, keep)), {(u, c, s): f for (u, c, s, _, _), f in zip(asked, solved)}


def _forest_scores(sets: TrainingSets, asked: list[tuple[int, int, int, list[str], dict]], column: str, keep: list[str]) -> DataFrame:
    """Forests of all sets and settings grown together; inputs are filled with the medians of the set."""
    spark = sets.rows.sparkSession
    wanted = sorted({s for _, _, s, _, _ in asked})
    if any(cols != sets.cols for _, _, _, cols, _ in asked):
        raise ValueError("forests use all inputs of the frame")
    medians = F.broadcast(spark.createDataFrame([(s, [sets.preps[s].medians[c] for c in sets.cols]) for s in wanted], "members int, median array<double>"))
    seeds = {s: sets.seeds[s // ((sets.inner + 1) * max(1, sets.outer))] for s in wanted}

    def filled(lists: str) -> DataFrame:
        rows = sets.rows.select(*keep, "x", F.explode(lists).alias("members")).join(medians, "members")
        return rows.select(*keep, "members", F.zip_with("x", "median", lambda v, m: F.coalesce(v, m)).alias("x"))

    training, parts = filled("train"), []
    for seed in sorted(set(seeds.values())):  # the draws of a forest follow its seed
        specs, tags, forests = [], [], {}
        for u, c, s, _, p in asked:
            if seeds[s] == seed:
                specs.append(trees.forest_spec(len(specs), s, p, len(sets.cols), sets.preps[s].rows, sets.preps[s].positives))
                tags.append((specs[-1].forest, u, c))
                forests.setdefault(s, []).append(specs[-1].forest)
        listed = F.broadcast(spark.createDataFrame(sorted(forests.items()), "members int, forests array<int>"))
        nodes = trees.grow_forests(training.withColumn("y", F.col("label")), specs, seed=seed)
        scored = trees.score_forests(filled(column).join(listed, "members"), nodes, keep=[*keep, "members"])
        named = F.broadcast(spark.createDataFrame(tags, "forest int, unit int, candidate int"))
        parts.append(cut_lineage(scored.join(named, "forest").select(*keep, "members", "unit", "candidate", "score")))
    return stack_frames(parts)


@dataclass
class Choice:
    """What the search of one unit chose."""

    candidate: int
    score: float | None


def _search(sets: TrainingSets, units: list[Unit], setup: Setup) -> tuple[list[Choice], DataFrame, dict]:
    """The best candidate of every unit by the mean metric over its inner folds (equal: the first name), all held-out scores, all solutions."""
    asked = [(u, c, sets.number(unit, j), cols, params) for u, unit in enumerate(units) for c, (_, cols, params) in enumerate(unit.candidates) for j in range(1, sets.inner + 1)]
    scores, solved = _scored(sets, setup, asked, "held")
    by_fold = ranking_metrics(scores, ["unit", "candidate", "members"], splits=sets.splits)
    means = {(r["unit"], r["candidate"]): r["mean"] for r in by_fold.groupBy("unit", "candidate").agg(F.avg(setup.metric).alias("mean")).collect()}
    picks = []
    for u, unit in enumerate(units):
        ranked = [(-means[(u, c)] if means.get((u, c)) is not None else float("inf"), name, c) for c, (name, _, _) in enumerate(unit.candidates)]
        worst, _, best = min(ranked)
        picks.append(Choice(best, None if worst == float("inf") else -worst))
    return picks, scores, solved


def _refit(sets: TrainingSets, units: list[Unit], picks: list[Choice], setup: Setup) -> tuple[DataFrame, dict]:
    """Every unit's chosen setting fitted on all its training rows, and the scores of its test rows."""
    asked = [(u, p.candidate, sets.number(unit, 0), *unit.candidates[p.candidate][1:]) for u, (unit, p) in enumerate(zip(units, picks))]
    return _scored(sets, setup, asked, "test")


def _tags(frame: DataFrame, units: list[Unit]) -> DataFrame:
    """Run, seed and fold of every unit."""
    return F.broadcast(frame.sparkSession.createDataFrame([(u, x.run, x.seed, x.fold) for u, x in enumerate(units)], "unit int, model string, seed int, fold int"))


def _fit_records(sets: TrainingSets, units: list[Unit], solved: dict, stage: str, recipe=lambda unit, name: unit.run) -> list[dict]:
    out = []
    for (u, c, s), fit in solved.items():
        name, _, params = units[u].candidates[c]
        out.append({
            "seed": units[u].seed, "outer_fold": units[u].fold, "inner_fold": s % (sets.inner + 1), "stage": stage, "recipe": recipe(units[u], name),
            "C": float(params["C"]), "l1_ratio": float(params["l1_ratio"]), "iterations": fit.iterations, "converged": fit.converged})
    return out


def logistic_fit(sets: TrainingSets, members: int, cols: list[str], params: dict, solution: Solution) -> LogisticFit:
    """A solution as a model over its own inputs."""
    prep = sets.preps[members].subset(list(cols))
    weight = dict(zip(sets.features.names, solution.beta[1:].tolist()))
    return LogisticFit(prep, [weight[n] for n in prep.outputs], float(solution.beta[0]), solution.iterations, solution.converged, dict(params))


def _groups(seeds: list[int], outer: int, inner: int) -> list[list[int]]:
    size = max(1, MAX_SETS // (max(1, outer) * (inner + 1)))
    return [seeds[i:i + size] for i in range(0, len(seeds), size)]


def nested_runs(
    frame: DataFrame, runs: dict[str, list[str]], *, seeds: list[int], model: str = "logistic", outer: int = 5, inner: int = 3, grid: list[dict] | None = None,
    n_iter: int = 24, target_specificity: float = 0.70, indicators: bool = False, balanced: bool = False, metric: str = "AP", profile: str | None = None,
    check: bool = True, max_iter: int = 100,
) -> CVResult:
    """Nested validation of several input lists under several seeds: every run of `runs` (name, inputs) with every seed.

    Outer folds are scored by models tuned inside their training rows only; one prediction per entity and run. The threshold
    of a fold comes from the inner held-out scores of the chosen setting.
    """
    if check:
        assert_unique(frame, ["entity_id"], "model frame")
    every = list(dict.fromkeys(c for cols in runs.values() for c in cols))
    setup = Setup(model, balanced, metric, max_iter)
    oofs, tables, fits = [], [], []
    for part in _groups(list(seeds), outer, inner):
        sets = TrainingSets(frame, every, part, outer, inner, indicators=indicators)
        units = []
        for run, cols in runs.items():
            for seed in part:
                settings = [{}] if model == "prior" else grid or (tree_draws(n_iter, seed) if model == "trees" else l2_grid())
                units += [Unit(run, seed, k, [(json.dumps(p, sort_keys=True), cols, p) for p in settings]) for k in range(1, outer + 1)]
        picks, scores, searched = _search(sets, units, setup)
        tested, final = _refit(sets, units, picks, setup)
        chosen = F.broadcast(frame.sparkSession.createDataFrame([(u, p.candidate) for u, p in enumerate(picks)], "unit int, candidate int"))
        kept = cut_lineage(scores.join(chosen, ["unit", "candidate"]))
        cuts = threshold_target_specificity(kept, ["unit"], target=target_specificity, splits=sets.splits)
        pooled = ranking_metrics(kept, ["unit"], splits=sets.splits).select("unit", F.col("AP").alias("inner_oof_AP"))
        best = frame.sparkSession.createDataFrame([(u, units[u].candidates[p.candidate][0]) for u, p in enumerate(picks)], "unit int, best_params string")
        facts = cut_lineage(cuts.join(pooled, "unit").join(F.broadcast(best), "unit"))
        tagged = apply_cut(tested.drop("members", "candidate"), F.broadcast(facts.select("unit", "cut", "inclusive")), ["unit"]).join(_tags(frame, units), "unit")
        oof = cut_lineage(tagged.select("fold", "entity_id", "label", "score", "cut", "prediction", "model", (F.lit(profile) if profile else F.col("model")).alias("profile"), "seed"))
        of_fold = facts.join(_tags(frame, units), "unit").select("model", "seed", "fold", F.col("cut").alias("threshold"), "inner_oof_AP", "best_params")
        oofs.append(oof)
        tables.append(compute_metrics(oof, ["model", "profile", "seed", "fold"], splits=sets.splits).join(of_fold, ["model", "seed", "fold"]))
        named = lambda unit, name: profile or unit.run
        fits += _fit_records(sets, units, searched, "hyperparameter_search", named) + _fit_records(sets, units, final, "outer_final_refit", named)
    return CVResult(stack_frames(oofs), stack_frames(tables), fits)


def nested_cv(frame: DataFrame, cols: list[str], *, model: str = "logistic", seed: int = 42, profile: str = "all20", run: str | None = None, **kw) -> CVResult:
    """`nested_runs` of one input list under one seed."""
    return nested_runs(frame, {run or model: cols}, seeds=[seed], model=model, profile=profile, **kw)


def elastic_net_cv(frame: DataFrame, cols: list[str], *, run: str, seed: int, outer: int = 5, inner: int = 3, grid: list[dict] | None = None, **kw) -> CVResult:
    """Nested validation of one input list with elastic net, median fill and missing indicators."""
    return nested_cv(frame, cols, seed=seed, outer=outer, inner=inner, grid=grid or elastic_grid(), indicators=True, run=run, profile=run, **kw)


def _screened(sets: TrainingSets, units: list[Unit], recipes: dict[str, list[str]], grid: list[dict], setup: Setup) -> tuple[list[str], list[float | None], list[Unit], list[Choice], list[dict]]:
    """Recipes picked at fixed settings, then tuned: recipe and screening score of every unit, tuning units, choices and records."""
    screen = {"C": SCREEN_C, "l1_ratio": SCREEN_L1_RATIO}
    trial = [Unit(u.run, u.seed, u.fold, [(n, recipes[n], screen) for n in sorted(recipes)]) for u in units]
    first, _, screened = _search(sets, trial, setup)
    chosen = [trial[u].candidates[p.candidate][0] for u, p in enumerate(first)]
    tuning = [Unit(u.run, u.seed, u.fold, [(json.dumps(p, sort_keys=True), recipes[r], p) for p in grid]) for u, r in zip(units, chosen)]
    picks, _, searched = _search(sets, tuning, setup)
    recipe_of = {id(u): r for u, r in zip(tuning, chosen)}
    records = _fit_records(sets, trial, screened, "recipe_screening", lambda unit, name: name)
    records += _fit_records(sets, tuning, searched, "hyperparameter_search", lambda unit, name: recipe_of[id(unit)])
    return chosen, [p.score for p in first], tuning, picks, records


def recipe_selector_cv(
    frame: DataFrame, recipes: dict[str, list[str]], *, seed: int | None = None, seeds: list[int] | None = None, outer: int = 5, inner: int = 3, grid: list[dict] | None = None,
    run: str = "RECIPE_SELECTOR", max_iter: int = 100,
) -> CVResult:
    """Inside each outer fold pick the recipe by inner average precision at fixed settings, tune it, predict the fold; under one or many seeds."""
    every = sorted({c for cols in recipes.values() for c in cols})
    setup = Setup(max_iter=max_iter)
    kind = "unit int, selected_recipe string, input_count int, screening_AP double, best_C double, best_l1_ratio double, inner_best_AP double"
    oofs, tables, fits = [], [], []
    for part in _groups([seed] if seeds is None else list(seeds), outer, inner):
        sets = TrainingSets(frame, every, part, outer, inner, indicators=True)
        units = [Unit(run, s, k, []) for s in part for k in range(1, outer + 1)]
        chosen, screening, tuning, picks, records = _screened(sets, units, recipes, grid or elastic_grid(), setup)
        tested, final = _refit(sets, tuning, picks, setup)
        oof = cut_lineage(tested.join(_tags(frame, units), "unit").select("entity_id", "label", "fold", "score", "model", "seed"))
        best = [tuning[u].candidates[p.candidate][2] for u, p in enumerate(picks)]
        rows = [(u, r, len(recipes[r]), screening[u], float(best[u]["C"]), float(best[u]["l1_ratio"]), picks[u].score) for u, r in enumerate(chosen)]
        facts = frame.sparkSession.createDataFrame(rows, kind).join(_tags(frame, units), "unit").drop("unit")
        oofs.append(oof)
        tables.append(run_metrics(oof, ["model", "seed", "fold"], splits=sets.splits).join(F.broadcast(facts), ["model", "seed", "fold"]))
        recipe_of = {id(u): r for u, r in zip(tuning, chosen)}
        fits += records + _fit_records(sets, tuning, final, "outer_final_refit", lambda unit, name, of=recipe_of: of[id(unit)])
    return CVResult(stack_frames(oofs), stack_frames(tables), fits)


@dataclass
class Selection:
    """What a search over all rows chose, and the model refitted on them."""

    recipe: str
    params: dict
    screening: float
    inner_score: float
    fit: LogisticFit
    fits: list[dict]


def search_and_refit(
    frame: DataFrame, recipes: dict[str, list[str]], *, seed: int = 42, inner: int = 3, grid: list[dict] | None = None, indicators: bool = True,
    balanced: bool = False, metric: str = "AP",
) -> Selection:
    """Screen the recipes at fixed settings, tune the best one, and refit it, all on the whole frame: the step before freezing a model.

    One recipe is not screened; its screening value is then its tuned one.
    """
    every = sorted({c for cols in recipes.values() for c in cols})
    setup = Setup(balanced=balanced, metric=metric)
    sets = TrainingSets(frame, every, [seed], 0, inner, indicators=indicators)
    units = [Unit("SELECTION", seed, 1, [])]
    settings = grid or elastic_grid()
    if len(recipes) > 1:
        (recipe,), (screening,), tuning, (pick,), records = _screened(sets, units, recipes, settings, setup)
    else:
        recipe, screening, records = next(iter(recipes)), None, []
        tuning = [Unit("SELECTION", seed, 1, [(json.dumps(p, sort_keys=True), recipes[recipe], p) for p in settings])]
        (pick,), _, searched = _search(sets, tuning, setup)
        records += _fit_records(sets, tuning, searched, "hyperparameter_search", lambda unit, name: recipe)
    members = sets.number(tuning[0], 0)
    _, cols, params = tuning[0].candidates[pick.candidate]
    (solution,) = fit_models(sets.rows, sets.features, [ModelSpec(members, tuple(cols), float(params["C"]), float(params["l1_ratio"]))], balanced=balanced)
    records += _fit_records(sets, tuning, {(0, pick.candidate, members): solution}, "final_refit", lambda unit, name: recipe)
    for r in records:
        r["outer_fold"] = 0
    return Selection(recipe, params, pick.score if screening is None else screening, pick.score, logistic_fit(sets, members, cols, params, solution), records)


def fixed_recipe_cv(frame: DataFrame, recipe: str, cols: list[str], **kw) -> CVResult:
    return recipe_selector_cv(frame, {recipe: cols}, run=f"FIXED_{recipe}", **kw)


def candidate_sweep(frame: DataFrame, candidates: dict[str, list[str]], *, seeds: list[int], outer: int = 5, inner: int = 3, grid: list[dict] | None = None) -> DataFrame:
    """Out-of-fold predictions of every candidate list and seed, fitted together."""
    oof = nested_runs(frame, candidates, seeds=seeds, outer=outer, inner=inner, grid=grid or elastic_grid(), indicators=True).oof
    return oof.select("entity_id", "label", "fold", "score", "prediction", "model", "profile", "seed")


def repeated_cv(
    frame: DataFrame, cols: list[str], *, models: list[str], seeds: list[int], outer: int = 5, inner: int = 3, **kw
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Several models over several seeds on shared outer folds: predictions, per-seed metrics and their summary."""
    kept = frame.persist()
    oof = stack_frames([nested_runs(kept, {m: cols}, seeds=seeds, model=m, outer=outer, inner=inner, check=not i, profile="all20", **kw).oof for i, m in enumerate(models)])
    kept.unpersist()
    per_seed = cut_lineage(compute_metrics(oof, ["model", "seed"]))
    return oof, per_seed, repeated_summary(per_seed)


def repeated_wide(summary: DataFrame) -> DataFrame:
    return repeated_summary_wide(summary)


def hourly_nested_cv(frame: DataFrame, cols: list[str], *, outer: int = 5, inner: int = 3, **kw) -> CVResult:
    """The small-cohort variant: inner folds never exceed the smaller class of the training rows."""
    r = frame.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    smallest = min(r["p"], r["n"])
    return nested_cv(frame, cols, outer=outer, inner=max(2, min(inner, smallest - -(-smallest // outer))), **kw)


def fit_diagnostics(frame: DataFrame, fits: list[dict]) -> DataFrame:
    """Fit records as a table."""
    schema = "seed int, outer_fold int, inner_fold int, stage string, recipe string, C double, l1_ratio double, iterations int, converged boolean"
    names = [p.split()[0] for p in schema.split(", ")]
    return frame.sparkSession.createDataFrame([tuple(f[n] for n in names) for f in fits], schema)


def diagnostics_by_stage(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("stage").agg(
        F.count("*").alias("fits"), F.count_if(~F.col("converged")).alias("not_converged"), F.max("iterations").alias("max_iterations")
    )
