import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions.constants import METRICS
from cohortflow.operators import bootstrap, folds, metrics, quality
from cohortflow.operators.ordered import ONE_BUCKET, value_splits

SCHEMA = "run string, entity_id int, label int, score double"


def _preds(spark, y, p, run="r"):
    return spark.createDataFrame([(run, i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], SCHEMA)


def _auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def _ap(y, p):
    total, ap, last = y.sum(), 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        hit = p >= s
        recall = (y & hit).sum() / total
        ap += (recall - last) * (y & hit).sum() / hit.sum()
        last = recall
    return ap


def test_auc_and_ap_match_pair_counts_with_ties(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 200), np.round(rng.uniform(size=200), 1)
    df = _preds(spark, y, p)
    for splits in (ONE_BUCKET, value_splits(df, ["score"], 8)["score"]):
        r = metrics.ranking_metrics(df, ["run"], splits=splits).first()
        assert r.AUC == pytest.approx(_auc(y, p)) and r.AP == pytest.approx(_ap(y, p))
    flipped = metrics.roc_auc(df.withColumn("score", 1 - F.col("score")), ["run"]).first().AUC
    assert flipped == pytest.approx(1 - _auc(y, p))


def test_one_class_and_empty_denominators(spark):
    r = metrics.compute_metrics(_preds(spark, [0, 0, 0], [0.1, 0.2, 0.3]), ["run"]).first()
    assert r.AUC is None and r.AP is None and r.Sens is None and r.PPV is None and r.Spec == 1.0 and r.F1 == 0.0


def test_threshold_fixture(spark):
    p = _preds(spark, [0, 0, 0, 0, 1], [0.1, 0.2, 0.3, 0.4, 0.8])
    cut = metrics.threshold_target_specificity(p, ["run"], target=0.7).first()
    assert cut.cut == 0.3 and not cut.inclusive
    hit = metrics.apply_cut(p, metrics.threshold_target_specificity(p, ["run"], target=0.7), ["run"])
    assert [r.prediction for r in hit.orderBy("entity_id").collect()] == [0, 0, 0, 1, 1]
    top = metrics.apply_cut(p, metrics.threshold_target_specificity(p, ["run"], target=1.0), ["run"])
    assert top.filter("label = 0").agg(F.sum("prediction")).first()[0] == 0
    alone = metrics.threshold_target_specificity(_preds(spark, [1, 1], [0.5, 0.4]), ["run"])
    assert (alone.first().cut, alone.first().inclusive) == (0.5, True)
    with pytest.raises(ValueError):
        metrics.threshold_target_specificity(p, ["run"], target=1.5)


def test_draws_sum_to_n_and_repeat(spark):
    e = spark.range(50).withColumnRenamed("id", "entity_id")
    a = bootstrap.bootstrap_draws(e, 6, 42)
    assert {r.s for r in a.groupBy("rep").agg(F.sum("weight").alias("s")).collect()} == {50}
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, bootstrap.bootstrap_draws(e.repartition(7), 6, 42).collect()))


def _shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("replicates,tasks,block", [(7, 3, 16), (1, 9, 5), (400, 2, 2048)])
def test_totals_of_draws_are_summed_where_they_are_made(spark, monkeypatch, replicates, tasks, block):
    monkeypatch.setattr(bootstrap, "DRAW_BLOCK", block)
    e = spark.range(40).select((F.col("id") * 7).alias("name")).unionByName(spark.createDataFrame([(None,)], "name long"))
    draws = bootstrap.bootstrap_draws(e, replicates, 42, id_col="name")
    want = draws.groupBy("name").agg(F.sum("weight"), F.count("*"), F.sum(F.col("weight") * F.col("rep")))
    got = bootstrap.draw_totals(e, replicates, 42, id_col="name", partitions=tasks)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_draws_are_not_shuffled(spark, sf, monkeypatch):
    from cohortflow import plans
    from cohortflow.plans.registry import QUERIES

    plans.load()
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    before = _shuffled(spark)
    assert QUERIES["bootstrap_draws"](spark, sf).count() == n
    assert _shuffled(spark) - before < 200 * n  # 2 000 draws an entity


@pytest.mark.parametrize("name", ["bootstrap_ci", "paired_bootstrap"])
def test_predictions_are_not_copied_to_the_batches(spark, monkeypatch, name):
    rows = [(i, m, i % 3 % 2, (i * 37 % 1000) / 1000.0) for i in range(3000) for m in ("price", "other")]
    df = spark.createDataFrame(rows, "entity_id int, model string, label int, score double").persist()
    run = {"bootstrap_ci": lambda: bootstrap.bootstrap_ci(df, ["model"], replicates=160), "paired_bootstrap": lambda: bootstrap.paired_bootstrap(df, "price", replicates=160)}[name]
    shuffled, out = [], []
    for replicates in (160, 1):  # kept by a task: two batches a slot, then one replicate a batch
        monkeypatch.setattr(bootstrap, "COUNT_BYTES", 3000 * replicates)
        before = _shuffled(spark)
        out.append(sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in run().collect()))
        shuffled.append(_shuffled(spark) - before)
    df.unpersist()
    assert out[0] == out[1] and shuffled[1] < 2 * shuffled[0]


def test_weighted_metrics_equal_repeated_rows(spark):
    rng = np.random.default_rng(5)
    y, p, w = rng.integers(0, 2, 60), np.round(rng.uniform(size=60), 2), rng.integers(0, 4, 60)
    df = _preds(spark, y, p)
    weights = spark.createDataFrame([(i, int(k)) for i, k in enumerate(w) if k], "entity_id int, weight long")
    a = metrics.compute_metrics(df.join(weights, "entity_id"), ["run"], weight="weight").first()
    b = metrics.compute_metrics(_preds(spark, np.repeat(y, w), np.repeat(p, w)), ["run"]).first()
    for m in ("AUC", "AP", "Brier", "Sens", "Spec", "F1", "PPV", "NPV"):
        assert a[m] == pytest.approx(b[m])


def test_bootstrap_interval_holds_point(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 80)
    p = np.clip(y * 0.3 + rng.uniform(size=80) * 0.7, 0, 1)
    df = _preds(spark, y, p)
    r = {x.metric: x for x in bootstrap.bootstrap_ci(df, ["run"], replicates=40, seed=1).collect()}
    assert r["AUC"].lower < r["AUC"].point < r["AUC"].upper and r["AUC"].n_valid == 40


def test_folds_partition_and_balance(spark):
    df = spark.range(103).select(F.col("id").alias("entity_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    f = folds.stratified_folds(df, 5, [1, 2])
    sizes = folds.validate_folds(f).collect()
    assert len(sizes) == 10 and all(r.valid for r in sizes)
    assert max(r.test_positive for r in sizes) - min(r.test_positive for r in sizes) <= 1
    a, b = ({r.entity_id: r.fold for r in f.filter(F.col("seed") == s).collect()} for s in (1, 2))
    assert len(a) == 103 and a != b
    assert quality.leakage(f.withColumn("part", F.lit("test"))).count() == 0
    held = folds.stratified_holdout(df, 0.2, 1).groupBy("label", "part").count().collect()
    assert {(r.label, r.part): r["count"] for r in held} == {(0, "test"): 16, (0, "train"): 61, (1, "test"): 6, (1, "train"): 20}


def test_drift_guard_and_gate(spark):
    df = _preds(spark, [0, 1, 1], [0.1, 0.2, 0.3])
    assert quality.cohort_drift_guard(df, (3, 2, 1)).count() == 3
    with pytest.raises(ValueError):
        quality.cohort_drift_guard(df, (3, 1, 2))
    gate = quality.hard_gate(spark.createDataFrame([("a", 0), ("b", 2)], "check string, failures long"))
    assert tuple(gate.select("failed_checks", "passed").first()) == ("b", False)
    with pytest.raises(Exception, match="failed checks"):
        quality.require_gate(gate).collect()


def test_many_runs_share_the_work_in_groups(spark):
    """A block of predictions goes to the batches of its group of runs only, not to every task."""
    sets = spark.range(40).select(F.col("id").alias("entity_id"), (F.col("id") % 3 == 0).cast("int").alias("label")).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(39))))
    sets = sets.withColumn("score", F.pmod(F.xxhash64("seed", "entity_id"), F.lit(7)) / 7.0)
    numbered, _ = bootstrap._numbered(sets, ["seed"], clip=False)
    values = bootstrap._whole_replicates(numbered, sets, 64, 3, every=False)
    kinds = values.select("_run", "rep", F.spark_partition_id().alias("p")).groupBy("_run").agg(F.count_distinct("p").alias("tasks"), F.count("*").alias("n")).collect()
    assert len(kinds) == 40 and all(k.n == 64 and k.tasks <= 2 * spark.sparkContext.defaultParallelism for k in kinds)
    a, b = (sorted(tuple(r) for r in bootstrap.shared_draw_median(sets, replicates=9, seed=2, local_rows=n).select("rep", "median_auc", "positive_draws", "negative_draws").collect()) for n in (10**6, 0))
    assert [r[::2] for r in a] == [r[::2] for r in b] and [r[1] for r in a] == pytest.approx([r[1] for r in b], abs=1e-12)


def test_whole_replicates_equal_weighted_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, k, int(rng.random() < 0.4), None if i % 11 == 0 else float(round(rng.normal(0.5, 0.5), 1))) for i in range(60) for k in ("a", None)]
    df = spark.createDataFrame(rows, "entity_id int, run string, label int, score double")
    a, b = ([tuple(r) for r in bootstrap.replicate_metrics(df, ["run"], replicates=12, seed=5, local_rows=n).select("run", "rep", *METRICS).collect()] for n in (10**6, 0))
    key = lambda r: (r[0] or "", r[1])
    assert len(a) == len(b) == 24
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], nan_ok=True)
    sets = df.filter("run is not null").drop("run").withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(5)]))).withColumn("score", F.col("score") * F.col("seed") % 0.7)
    a, b = (sorted(tuple(r) for r in bootstrap.shared_draw_median(sets, replicates=6, seed=2, local_rows=n).select("rep", "median_auc", "positive_draws", "negative_draws").collect()) for n in (10**6, 0))
    assert all(x == pytest.approx(y) for x, y in zip(a, b)) and len(a) == len(b) == 6


def test_draws_in_blocks_equal_the_hash_of_each(spark):
    from cohortflow.functions.digest import draw_counts, seeded_indexes
    from cohortflow.functions.hashing import seeded_index

    n = 20_013
    want = spark.range(n).select(seeded_index(F.lit(n), 42, F.lit(1999), F.col("id")).alias("k")).toPandas()["k"].to_numpy()
    assert (seeded_indexes(n, 42, 1999, {}) == want).all() and (draw_counts(n, 42, range(1999, 2000))[0] == np.bincount(want, minlength=n)).all()
    assert draw_counts(1, 7, range(3)).tolist() == [[1]] * 3


def test_predictions_pass_replicates_in_blocks_without_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, k, int(rng.random() < 0.4), None if i % 13 == 0 else float(round(rng.uniform(), 1))) for i in range(120) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "entity_id int, run string, label int, score double")
    get = lambda **o: sorted(tuple(r) for r in bootstrap.replicate_metrics(df, ["run"], replicates=9, seed=5, **o).select("run", "rep", *METRICS).collect())
    plain = get(local_rows=0)
    for name, value in (("BLOCK_ROWS", 7), ("PART_ROWS", 50), ("CELLS", 10), ("COUNT_BYTES", 240)):
        monkeypatch.setattr(bootstrap, name, value)
    monkeypatch.setattr("pyspark.sql.DataFrame.toPandas", None)
    for x, y in zip(plain, get(), strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], nan_ok=True)


def test_predictions_are_not_broadcast_to_their_cuts(spark, sf):
    from cohortflow.plans import tables

    preds = tables.seeded_predictions(spark, sf)  # exploded from one small file
    hit = metrics.apply_cut(preds, metrics.threshold_target_specificity(preds, ["model", "seed"]), ["model", "seed"])
    assert "Inner, BuildRight" in hit._jdf.queryExecution().executedPlan().toString() and hit.count() == preds.count()


def test_summary_makes_the_replicates_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    per_rep = spark.range(20).select(F.col("id").alias("rep"), (F.col("id") / 20).alias("median_auc")).mapInPandas(count, "rep long, median_auc double")
    preds = _preds(spark, [0, 1, 1], [0.1, 0.2, 0.3]).withColumn("seed", F.lit(1))
    got = bootstrap.shared_draw_summary(per_rep, preds).first()
    assert (got.replicates, got.observed, got.bootstrap_median) == (20, 1.0, pytest.approx(0.475)) and made.value == 20
