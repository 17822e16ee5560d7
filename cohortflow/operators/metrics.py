"""Scores of probability predictions: curves, areas, rates, thresholds and calibration.

Predictions are rows of (run keys, entity_id, label 0/1, score).  Rows with equal
scores are summed first and the cumulative sums run bucket by bucket, so one run may
hold all rows.  An optional weight column serves bootstrap replicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import nan_to_null
from .ordered import HOT_ROWS, exact_quantiles, join_by_keys, prefix_sums


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def score_curve(
    preds: DataFrame, keys: list[str], *, weight: str | None = None, splits: list[float] | None = None
) -> DataFrame:
    """One row per run and distinct score: positives and negatives at it, strictly below it, and in total."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col("label").cast("double")
    rows = preds.withColumn("score", nan_to_null(F.col("score").cast("double")))
    return prefix_sums(
        rows, keys, "score", {"pos": F.sum(w * y), "neg": F.sum(w * (1.0 - y))}, splits=splits
    )


def _null_if_one_class(value: Column) -> Column:
    return F.when((F.max("pos_total") > 0) & (F.max("neg_total") > 0), value)


def roc_auc_from(curve: DataFrame, keys: list[str]) -> DataFrame:
    wins = F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
    pairs = F.max("pos_total") * F.max("neg_total")
    return curve.groupBy(*keys).agg(_null_if_one_class(F.try_divide(wins, pairs)).alias("AUC"))


def _precision(curve_pos_from: Column, curve_neg_from: Column) -> Column:
    return F.try_divide(curve_pos_from, curve_pos_from + curve_neg_from)


def ranking_metrics(preds: DataFrame, keys: list[str], *, weight: str | None = None, splits: list[float] | None = None) -> DataFrame:
    """Rank AUC (ties half) and step average precision per run from one curve; null for one class."""
    curve = score_curve(preds, keys, weight=weight, splits=splits)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
    steps = F.sum(F.col("pos") * F.coalesce(_precision(tp, fp), F.lit(0.0)))
    return curve.groupBy(*keys).agg(
        _null_if_one_class(F.try_divide(wins, F.max("pos_total") * F.max("neg_total"))).alias("AUC"),
        _null_if_one_class(F.try_divide(steps, F.max("pos_total"))).alias("AP"),
    )


def roc_auc(preds: DataFrame, keys: list[str], *, weight: str | None = None) -> DataFrame:
    return roc_auc_from(score_curve(preds, keys, weight=weight), keys)


def average_precision(preds: DataFrame, keys: list[str], *, weight: str | None = None) -> DataFrame:
    return ranking_metrics(preds, keys, weight=weight).drop("AUC")


def brier(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(F.pow(clip01(F.col("score")) - F.col("label"), 2)).alias("Brier"))


def rate_columns(prediction: Column, weight: Column | None = None) -> dict[str, Column]:
    """Confusion counts and rates as aggregates; a rate without cases is null, F1 is then 0."""
    w = weight if weight is not None else F.lit(1.0)
    y = F.col("label")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(F.lit(0.0)))

    tp, fp = total((y == 1) & (prediction == 1)), total((y == 0) & (prediction == 1))
    tn, fn = total((y == 0) & (prediction == 0)), total((y == 1) & (prediction == 0))
    return {
        "TP": tp, "FP": fp, "TN": tn, "FN": fn,
        "Sens": F.try_divide(tp, tp + fn),
        "Spec": F.try_divide(tn, tn + fp),
        "PPV": F.try_divide(tp, tp + fp),
        "NPV": F.try_divide(tn, tn + fn),
        "F1": F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)),
    }


def confusion_rates(preds: DataFrame, keys: list[str], prediction: str = "prediction") -> DataFrame:
    cols = rate_columns(F.col(prediction))
    counts = ("TP", "FP", "TN", "FN")
    return preds.groupBy(*keys).agg(*[(e.cast("long") if n in counts else e).alias(n) for n, e in cols.items()])


def confusion_rates_smoothed(preds: DataFrame, keys: list[str], prediction: str = "prediction") -> DataFrame:
    """The fixed-schedule form: 1e-12 added to the denominators instead of nulls."""
    r = confusion_rates(preds, keys, prediction)
    return r.withColumns(
        {
            "Sens": F.col("TP") / (F.col("TP") + F.col("FN") + 1e-12),
            "Spec": F.col("TN") / (F.col("TN") + F.col("FP") + 1e-12),
        }
    ).drop("PPV", "NPV")


def compute_metrics(preds: DataFrame, keys: list[str], *, threshold: float = 0.5, weight: str | None = None, splits: list[float] | None = None) -> DataFrame:
    """All eight metrics per run.  `prediction` is used where the column exists, else score >= threshold."""
    clipped = preds.withColumn("score", clip01(F.col("score")))
    pred = F.col("prediction") if "prediction" in preds.columns else (F.col("score") >= threshold).cast("int")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rates = {n: e for n, e in rate_columns(pred, w).items() if n not in ("TP", "FP", "TN", "FN")}
    squared = F.sum(w * F.pow(F.col("score") - F.col("label"), 2)) / F.sum(w)
    simple = clipped.groupBy(*keys).agg(squared.alias("Brier"), *[e.alias(n) for n, e in rates.items()])
    return join_by_keys(ranking_metrics(clipped, keys, weight=weight, splits=splits), simple, keys)


# Readable names of the metrics.
ALIASES = {
    "auc": "AUC", "average_precision": "AP", "ap": "AP", "brier": "Brier", "sensitivity": "Sens",
    "specificity": "Spec", "f1": "F1", "ppv": "PPV", "npv": "NPV",
}


def metric_aliases(df: DataFrame, suffix: str = "") -> DataFrame:
    """Readable copies beside the metric columns.  Spark names ignore case, so a copy that differs
    from its metric only in case is left out unless a suffix keeps them apart."""
    present = {c.lower() for c in df.columns}
    return df.withColumns({a + suffix: F.col(m) for a, m in ALIASES.items() if m in df.columns and (a + suffix).lower() not in present})


def brier_skill(preds: DataFrame, keys: list[str]) -> DataFrame:
    """1 - Brier / (q(1-q)) with q the prevalence; null without both classes."""
    q = F.avg(F.col("label").cast("double"))
    b = F.avg(F.pow(F.col("score") - F.col("label"), 2))
    return preds.groupBy(*keys).agg(b.alias("Brier"), F.when(q * (1 - q) > 0, 1.0 - b / (q * (1 - q))).alias("BSS"))


def run_metrics(preds: DataFrame, keys: list[str], *, splits: list[float] | None = None) -> DataFrame:
    """AUC, AP, Brier and Brier skill per run."""
    return ranking_metrics(preds, keys, splits=splits).join(brier_skill(preds, keys), keys)


def threshold_target_specificity(preds: DataFrame, keys: list[str], *, target: float = 0.70, splits: list[float] | None = None) -> DataFrame:
    """Cut value per run such that scores strictly above it are predicted positive.

    The cut is the negative score of rank min(floor(target*n), n-1); a prediction is
    `score > cut`, the same as comparing with the next double above it.  Without
    negatives the rule is `score >= 0.5`, flagged by `inclusive`.
    """
    if not 0.0 <= target <= 1.0:
        raise ValueError("target must lie in [0, 1]")
    clipped = preds.withColumn("score", clip01(F.col("score")))
    ranked = prefix_sums(clipped.filter("label = 0"), keys, "score", {"n": F.count("*")}, splits=splits)
    at = F.least(F.floor(F.lit(float(target)) * F.col("n_total")), F.col("n_total") - 1)
    at = F.col("n_total") - 1 if target >= 1.0 else at
    here = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
    cuts = ranked.filter(here).select(*keys, F.col("score").alias("cut"))
    runs = preds.select(*keys).distinct()
    return runs.join(cuts, keys, "left").select(
        *keys, F.coalesce("cut", F.lit(0.5)).alias("cut"), F.col("cut").isNull().alias("inclusive")
    )


def apply_cut(preds: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Add the 0/1 prediction of each row under its run's cut; the cuts, one a run, travel to the rows, which Spark may take for the smaller side."""
    hit = (F.col("score") > F.col("cut")) | (F.col("inclusive") & (F.col("score") >= F.col("cut")))
    return preds.join(F.broadcast(cuts), keys).withColumn("prediction", hit.cast("int")).drop("inclusive")


def curve_points(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Rates, precision and recall when scores >= each distinct score are positive."""
    curve = score_curve(preds, keys)
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    return curve.select(
        *keys, F.col("score").alias("threshold"), F.try_divide(tp, F.col("pos_total")).alias("tpr"),
        F.try_divide(fp, F.col("neg_total")).alias("fpr"), _precision(tp, fp).alias("precision"),
    )


def roc_points(preds: DataFrame, keys: list[str]) -> DataFrame:
    return curve_points(preds, keys).select(*keys, "threshold", "fpr", "tpr")


def pr_points(preds: DataFrame, keys: list[str]) -> DataFrame:
    return curve_points(preds, keys).select(*keys, "threshold", "precision", F.col("tpr").alias("recall"))


def threshold_f1(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Score with the highest F1; among equals the lowest score."""
    p = curve_points(preds, keys)
    f1 = 2.0 * F.col("precision") * F.col("tpr") / (F.col("precision") + F.col("tpr") + 1e-12)
    best = F.min(F.struct((-f1).alias("f"), F.col("threshold").alias("t"))).alias("b")
    return p.groupBy(*keys).agg(best).select(*keys, F.col("b.t").alias("threshold"), (-F.col("b.f")).alias("best_f1"))


def threshold_youden(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Score with the highest tpr - fpr; among equals the highest score."""
    p = curve_points(preds, keys)
    best = F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), F.col("threshold").alias("t"))).alias("b")
    return p.groupBy(*keys).agg(best).select(*keys, F.col("b.t").alias("threshold"), F.col("b.j").alias("youden"))


def calibration_bins(preds: DataFrame, keys: list[str], *, bins: int = 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean prediction and observed rate in quantile bins; a bin number is the count of inner edges below the score."""
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(preds, keys, ["score"], probs, hot_rows=hot_rows)
    inner = [F.col(f"score_e{i}") for i in range(1, bins)]
    number = sum(((e < F.col("score")).cast("int") for e in inner[1:]), (inner[0] < F.col("score")).cast("int"))
    return preds.join(edges, keys).withColumn("bin", number).groupBy(*keys, "bin").agg(
        F.avg("score").alias("mean_predicted"), F.avg(F.col("label").cast("double")).alias("observed_rate"), F.count("*").alias("n")
    )


