"""Data-quality checks, reconciliation and gates.  A check returns the offending rows or its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import nan_to_null
from .relational import duplicate_keys, key_differences

unique_key = duplicate_keys


def orphans_and_childless(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child keys without parent and parent keys without child."""
    return key_differences(child, parent, [key]).withColumn(
        "kind", F.when(F.col("side") == "LEFT_ONLY", "ORPHAN").otherwise("NO_CHILD")
    ).drop("side")


def key_set_equality(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: sizes of both differences and equality."""
    return key_differences(left, right, keys).agg(
        F.count_if(F.col("side") == "LEFT_ONLY").alias("only_left"), F.count_if(F.col("side") == "RIGHT_ONLY").alias("only_right")
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def column_pair_equality(left: DataFrame, right: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Mismatch count per column pair, nulls being equal."""
    a = left.select(*keys, *[F.col(x).alias(f"_a{i}") for i, (x, _) in enumerate(pairs)])
    b = right.select(*keys, *[F.col(y).alias(f"_b{i}") for i, (_, y) in enumerate(pairs)])
    counts = a.join(b, keys).agg(
        *[F.count_if(~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))).alias(x) for i, (x, _) in enumerate(pairs)]
    )
    return counts.unpivot([], [x for x, _ in pairs], "column_name", "mismatches")


def allowed_values(df: DataFrame, col: str, allowed: list[str], *, split: bool = False) -> DataFrame:
    """Values outside the domain with their counts; `split` checks each `;`-joined code."""
    v = df.select((F.explode(F.split(col, ";")) if split else F.col(col)).alias("value"))
    return v.filter(F.col("value").isNotNull() & (F.col("value") != "") & ~F.col("value").isin(allowed)).groupBy("value").agg(
        F.count("*").alias("n")
    )


def regex_check(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Rows whose text does not match."""
    return df.filter(~F.coalesce(F.col(col).rlike(pattern), F.lit(False)))


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str] = []) -> DataFrame:
    """Rows that break each named rule, one row per rule, one pass; a null outcome counts as broken."""
    counts = df.groupBy(*keys).agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    return counts.unpivot(keys, list(rules), "rule", "violations")


def numeric_ranges(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside their bounds per column; nulls pass."""
    rules = {}
    for c, (low, high) in bounds.items():
        ok = F.lit(True)
        if low is not None:
            ok = ok & (F.col(c) >= low)
        if high is not None:
            ok = ok & (F.col(c) <= high)
        rules[c] = F.col(c).isNull() | ok
    return violations(df, rules)


def derived_relationships(df: DataFrame, relations: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """Rows where two sides differ by more than the tolerance; pairs with a null side pass."""
    return violations(df, {n: F.coalesce(F.abs(a - b) <= tol, F.lit(True)) for n, (a, b, tol) in relations.items()})


def validity_bits_consistent(df: DataFrame, features: list[str]) -> DataFrame:
    """Bit must be set exactly where the value is finite."""
    return violations(
        df, {f: F.coalesce(F.col(f"{f}_valid"), F.lit(False)) == nan_to_null(F.col(f)).isNotNull() for f in features}
    )


def qc_status_consistent(df: DataFrame) -> DataFrame:
    return violations(
        df,
        {
            "pass_iff_valid": F.col("qc_valid") == (F.col("qc_status") == "PASS"),
            "reason_iff_fail": F.col("qc_valid") == (F.coalesce(F.col("qc_reason"), F.lit("")) == ""),
        },
    )


def window_sequence(windows: DataFrame, records: DataFrame, *, first: int = 60, stride: int = 300, length: int = 300) -> DataFrame:
    """Per entity: expected and observed windows, gap-free ids and the start/end formula."""
    from .windows import window_count

    fits = (F.col("start_sec") == first + F.col("window_id") * stride) & (F.col("end_sec") == F.col("start_sec") + length)
    seen = windows.groupBy("entity_id").agg(
        F.count("*").alias("observed"), F.min("window_id").alias("_lo"), F.max("window_id").alias("_hi"),
        F.countDistinct("window_id").alias("_d"), F.count_if(~fits).alias("formula_errors"),
    )
    expected = records.select("entity_id", window_count(F.col("sample_count") / F.col("fs"), first, stride, length).alias("expected"))
    j = expected.join(seen, "entity_id", "full")
    gap_free = F.when(F.col("observed").isNull(), True).otherwise(
        (F.col("_lo") == 0) & (F.col("_hi") == F.col("observed") - 1) & (F.col("_d") == F.col("observed"))
    )
    return j.select(
        "entity_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"),
        gap_free.alias("gap_free"), F.coalesce("formula_errors", F.lit(0)).alias("formula_errors"),
    )


def sort_order_check(files: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring rows of a file that are out of key order.

    `files` carries `file` and `row_index`; each row meets its follower through an
    equi-join on the row number, which spreads a file of any size.
    """
    a = files.select("file", "row_index", F.struct(*keys).alias("_k"))
    b = files.select("file", (F.col("row_index") - 1).alias("row_index"), F.struct(*keys).alias("_next"))
    return a.join(b, ["file", "row_index"]).groupBy("file").agg(F.count_if(F.col("_k") > F.col("_next")).alias("out_of_order"))


def manifest_check(observed: DataFrame, declared: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Declared and observed file facts side by side with a verdict."""
    a = declared.select(key, *[F.col(f).alias(f"declared_{f}") for f in fields], F.lit(True).alias("_d"))
    b = observed.select(key, *[F.col(f).alias(f"observed_{f}") for f in fields], F.lit(True).alias("_o"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"declared_{f}").eqNullSafe(F.col(f"observed_{f}"))
    verdict = F.when(F.col("_o").isNull(), "MISSING").when(F.col("_d").isNull(), "EXTRA").when(same, "OK").otherwise("MISMATCH")
    return a.join(b, key, "full").withColumn("verdict", verdict).drop("_d", "_o")


#: Cells that one task counts in `value_preservation`, on average.
TASK_CELLS = 500_000


def value_preservation(source: DataFrame, stored: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Cells that differ between two tables, blank text counting as null; a cell as often as its side holds it more often.

    Cells of both tables are shuffled once and counted with a sign.  The number of tasks follows the number of cells: such
    cells compress so well that partitions merged by their bytes would hold many millions of them in one task's memory.
    """
    def cells(df: DataFrame, sign: int) -> DataFrame:
        wide = df.select(key, *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in cols])
        return wide.unpivot([key], cols, "column_name", "value").withColumn("_n", F.lit(sign).cast("long"))

    both = cells(source, 1).unionByName(cells(stored, -1))
    tasks = max(source.sparkSession.sparkContext.defaultParallelism, -(-both.count() // TASK_CELLS))
    same = [key, "column_name", "value"]
    counts = both.repartition(tasks, *same).groupBy(*same).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))
    return counts.select(*same, F.when(F.col("_n") > 0, "SOURCE").otherwise("STORED").alias("side"), times.alias("_time")).drop("_time")


def stored_equals_recomputed(stored: DataFrame, recomputed: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mismatches per column and rows found on one side only."""
    a = stored.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(True).alias("_l"))
    b = recomputed.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(True).alias("_r"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    counts = a.join(b, keys, "full").agg(
        *[F.count_if(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(c) for c in cols],
        F.count_if(~both).alias("one_side_only"),
    )
    return counts.unpivot([], [*cols, "one_side_only"], "check", "mismatches")


def table_reconcile(new: DataFrame, old: DataFrame, keys: list[str], cols: list[str], *, atol: float = 1e-12, rtol: float = 0.0) -> DataFrame:
    """Per numeric column: rows on both sides, mismatches beyond the tolerance and the largest difference."""
    a = new.select(*keys, *[F.col(c).cast("double").alias(f"_a_{c}") for c in cols], F.lit(True).alias("_l"))
    b = old.select(*keys, *[F.col(c).cast("double").alias(f"_b_{c}") for c in cols], F.lit(True).alias("_r"))
    j = a.join(b, keys, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    exprs = [F.count_if(both).alias("_n"), F.count_if(F.col("_r").isNull()).alias("_ln"), F.count_if(F.col("_l").isNull()).alias("_rn")]
    for c in cols:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        close = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))
        exprs += [F.count_if(both & ~close).alias(f"m_{c}"), F.max(F.when(both, F.abs(x - y))).alias(f"d_{c}")]
    s = j.agg(*exprs)
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("shared"), F.col("_ln").alias("only_new"), F.col("_rn").alias("only_old"),
                 F.col(f"m_{c}").alias("mismatches"), F.col(f"d_{c}").alias("max_abs_diff"))
        for c in cols
    ]
    return s.select(F.inline(F.array(*rows)))


def expected_counts(observed: DataFrame, expected: dict[str, float]) -> DataFrame:
    """Compare a one-row table of counts with documented values."""
    rows = [
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("observed"), F.lit(float(v)).alias("expected"),
                 (F.col(n) - F.lit(float(v))).alias("difference"), (F.col(n) == F.lit(float(v))).alias("equal"))
        for n, v in expected.items()
    ]
    return observed.select(F.inline(F.array(*rows)))


def class_counts(frame: DataFrame, label: str = "label") -> DataFrame:
    return frame.agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative")
    )


def cohort_drift_guard(frame: DataFrame, expected: tuple[int, int, int]) -> DataFrame:
    """The same frame; raises if its size and class counts moved."""
    r = class_counts(frame).first()
    if (r["n"], r["positive"], r["negative"]) != tuple(expected):
        raise ValueError(f"cohort drift: observed {tuple(r)}, expected {expected}")
    return frame


def oof_contract(oof: DataFrame, keys: list[str] = ["model"]) -> DataFrame:
    """Per model: seeds, entities, rows, duplicates, label conflicts and scores outside [0, 1]."""
    per_entity = oof.groupBy(*keys, "entity_id").agg(
        F.count("*").alias("_n"), F.countDistinct("seed").alias("_s"), F.min("label").alias("_lo"), F.max("label").alias("_hi"),
        F.count_if(~F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("_bad"),
    )
    seeds = oof.select(*keys, "seed").distinct().groupBy(*keys).agg(F.count("*").alias("seeds"))
    sums = per_entity.groupBy(*keys).agg(
        F.count("*").alias("entities"), F.sum("_n").alias("rows"), F.sum(F.col("_n") - F.col("_s")).alias("duplicates"),
        F.count_if(F.col("_lo") != F.col("_hi")).alias("label_conflicts"), F.sum("_bad").alias("bad_scores"),
    )
    ok = (F.col("rows") == F.col("seeds") * F.col("entities")) & (F.col("duplicates") + F.col("label_conflicts") + F.col("bad_scores") == 0)
    return sums.join(seeds, keys).withColumn("holds", ok)


def fold_conservation(folds: DataFrame, oof: DataFrame) -> DataFrame:
    """Per seed and fold: train plus test and the positives are conserved and the predictions match the fold sizes."""
    totals = oof.groupBy("seed").agg(F.count("*").alias("_n"), F.sum("label").alias("_p"))
    seen = oof.groupBy("seed", "fold").agg(F.count("*").alias("oof_n"), F.sum("label").alias("oof_positive"))
    j = folds.join(seen, ["seed", "fold"], "full").join(totals, "seed")
    same = (
        (F.col("train_n") + F.col("test_n") == F.col("_n"))
        & (F.col("train_positive") + F.col("test_positive") == F.col("_p"))
        & (F.col("oof_n") == F.col("test_n")) & (F.col("oof_positive") == F.col("test_positive"))
    )
    return j.select("seed", "fold", "oof_n", "oof_positive", F.coalesce(same, F.lit(False)).alias("conserved"))


def metric_mismatch(stored: DataFrame, recomputed: DataFrame, keys: list[str], metrics: list[str], *, tolerance: float = 1e-10) -> DataFrame:
    """Largest gap of every metric between stored and recomputed runs."""
    out = table_reconcile(stored, recomputed, keys, metrics, atol=tolerance)
    return out.select(F.col("column_name").alias("metric"), "mismatches", "max_abs_diff")


def leakage(splits: DataFrame) -> DataFrame:
    """Entities that stand in both parts of one fold (`seed, fold, entity_id, part`)."""
    return splits.groupBy("seed", "fold", "entity_id").agg(
        F.min("part").alias("_a"), F.max("part").alias("_b")
    ).filter("_a <> _b").drop("_a", "_b")


def entity_table_check(table: DataFrame, subjects: DataFrame, double_columns: list[str]) -> DataFrame:
    """One row: repeated and null keys, key differences to the subjects and columns that are no doubles."""
    wrong = [c for c in double_columns if dict(table.dtypes).get(c) != "double"]
    keys = key_set_equality(table, subjects, ["entity_id"])
    repeats = table.groupBy("entity_id").count().agg(
        F.count_if((F.col("count") > 1) & F.col("entity_id").isNotNull()).alias("repeated"),
        F.count_if(F.col("entity_id").isNull()).alias("null_keys"),
    )
    one = keys.withColumn("_k", F.lit(1)).join(repeats.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("untyped_columns", F.lit(len(wrong)))


def hash_manifest_check(files: DataFrame, manifest: DataFrame, prohibited: str | None = None) -> DataFrame:
    """Verdict per path: OK, MISSING, MISMATCH, EXTRA, DUPLICATE or PROHIBITED."""
    listed = manifest.groupBy("path").agg(F.min("digest").alias("expected"), F.count("*").alias("_n"))
    found = files.select("path", F.col("digest").alias("actual"))
    banned = F.col("path").rlike(prohibited) if prohibited else F.lit(False)
    verdict = (
        F.when(banned & F.col("actual").isNotNull(), "PROHIBITED").when(F.col("_n") > 1, "DUPLICATE")
        .when(F.col("actual").isNull(), "MISSING").when(F.col("expected").isNull(), "EXTRA")
        .when(F.col("actual") == F.col("expected"), "OK").otherwise("MISMATCH")
    )
    return listed.join(found, "path", "full").select("path", "expected", "actual", verdict.alias("verdict"))


def declared_size_check(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Files shorter or longer than their header implies, or absent."""
    gap = F.col("length") - F.col("expected_bytes")
    verdict = F.when(F.col("length").isNull(), "MISSING").when(gap < 0, "SHORTER").when(gap > 0, "TRAILING_BYTES").otherwise("OK")
    return declared.join(files, "path", "left").select("path", "expected_bytes", "length", gap.alias("difference"), verdict.alias("verdict"))


def declared_vs_present(declared: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys declared but absent and keys present but undeclared."""
    return key_differences(declared, present, [key]).withColumn(
        "kind", F.when(F.col("side") == "LEFT_ONLY", "DECLARED_NOT_PRESENT").otherwise("PRESENT_NOT_DECLARED")
    ).drop("side")


def window_validation_summary(windows: DataFrame, *, expected_per_entity: int | None = None) -> DataFrame:
    """One row: windows, successes, extremes per entity, interval counts without removal and removed total."""
    per = windows.groupBy("entity_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("window_status") == "SUCCESS").alias("_s"),
        F.count_if(F.col("raw_rr_count") == F.col("valid_rr_count")).alias("_e"), F.sum("removed_rr_count").alias("_r"),
    )
    out = per.agg(
        F.count("*").alias("entities"), F.sum("_n").alias("windows"), F.sum("_s").alias("successes"),
        F.min("_s").alias("min_success"), F.max("_s").alias("max_success"), F.sum("_e").alias("raw_equals_valid"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("removed_total"),
    )
    if expected_per_entity is not None:
        out = out.withColumn("expected_windows", F.col("entities") * expected_per_entity)
    return out


def model_frame_check(frame: DataFrame, features: list[str]) -> DataFrame:
    """One row: repeated or null ids, labels outside 0/1, missing classes and features that are no numbers."""
    bad = [F.count_if(F.col(f).isNotNull() & F.col(f).try_cast("double").isNull()).alias(f"_f{i}") for i, f in enumerate(features)]
    base = frame.agg(
        F.count_if(F.col("entity_id").isNull()).alias("null_ids"),
        F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("bad_labels"),
        F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), *bad,
    )
    repeats = frame.groupBy("entity_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids"))
    j = base.withColumn("_k", F.lit(1)).join(repeats.withColumn("_k", F.lit(1)), "_k")
    total = sum((F.col(f"_f{i}") for i in range(len(features))), F.lit(0)).cast("long")
    usable = (F.col("null_ids") + F.col("bad_labels") + F.col("repeated_ids") + F.col("non_numeric") == 0) & (F.least("positive", "negative") > 0)
    return j.withColumn("non_numeric", total).withColumn("usable", usable).select(
        "null_ids", "repeated_ids", "bad_labels", "positive", "negative", "non_numeric", "usable"
    )


def contract_check(observed: DataFrame, contract: dict[str, float]) -> DataFrame:
    """Documented facts against observed ones, one row per fact."""
    return expected_counts(observed, contract).withColumnRenamed("equal", "holds")


def metric_vs_reference(metrics: DataFrame, quoted: dict[str, float]) -> DataFrame:
    """Absolute difference of each metric (`metric, value`) to a quoted value."""
    from ..functions.parsing import decode

    q = decode(F.col("metric"), {k: float(v) for k, v in quoted.items()})
    return metrics.filter(F.col("metric").isin(list(quoted))).select(
        "metric", "value", q.alias("quoted"), F.abs(F.col("value") - q).alias("abs_diff")
    )


def hard_gate(checks: DataFrame) -> DataFrame:
    """Gate row from check rows (`check`, `failures`): failed checks as text, passed iff none."""
    failed = F.sort_array(F.collect_set(F.when(F.col("failures") > 0, F.col("check"))))
    return checks.agg(F.concat_ws(";", failed).alias("failed_checks"), F.count("*").alias("checks")).withColumn(
        "passed", F.col("failed_checks") == ""
    )


def require_gate(gate: DataFrame) -> DataFrame:
    """The gate row, or a stopped job naming the failed checks."""
    return gate.withColumn(
        "passed", F.when(F.col("passed"), True).otherwise(F.raise_error(F.concat(F.lit("failed checks: "), F.col("failed_checks"))).cast("boolean"))
    )


def batch_coverage(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Per batch: seeds expected, found, missing and unexpected."""
    seen = runs.select("batch", "seed").distinct().withColumn("_s", F.lit(True))
    want = expected.select("batch", "seed").withColumn("_e", F.lit(True))
    return want.join(seen, ["batch", "seed"], "full").groupBy("batch").agg(
        F.count("_e").alias("expected"), F.count("_s").alias("found"),
        F.count_if(F.col("_s").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"),
    )
