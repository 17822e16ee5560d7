"""Queries over filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import INTERVAL_FEATURES
from ..functions.derive import all_finite
from ..operators import aggregate, cohort, population, relational, signal
from ..operators.endpoints import build_endpoint
from . import tables as t
from .registry import query


def _key_table(df, key, *cols):
    return df.select(F.col(key).alias("entity_id"), *cols)


@query(
    "evaluable_filter",
    f"WITH {t.ENDPOINTS_SQL} SELECT entity_id, horizon_days, state, label FROM labelled WHERE state IN ('POSITIVE', 'NEGATIVE')",
)
def _(spark, sf):
    return population.evaluable(build_endpoint(t.subjects(spark, sf), check_keys=False)).select("entity_id", "horizon_days", "state", "label")


@query("optional_eligibility_filter", "SELECT c_custkey AS entity_id, c_acctbal FROM customer WHERE c_acctbal > 1000")
def _(spark, sf):
    c = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), "c_acctbal", F.when(F.col("c_acctbal") > 1000, True).alias("eligible"))
    return population.optional_eligibility(population.optional_eligibility(c).drop("eligible"))


@query(
    "all_finite_filter",
    f"WITH {t.WINDOWS_SQL} SELECT entity_id, window_id FROM windows WHERE sig_mean IS NOT NULL AND sig_std IS NOT NULL AND sig_std > 0",
)
def _(spark, sf):
    w = t.windows(spark, sf).withColumn("inverse", F.when(F.col("sig_std") > 0, 1 / F.col("sig_std")).when(F.col("sig_std") == 0, float("inf")))
    return w.filter(all_finite(["sig_mean", "sig_std", "inverse"])).select("entity_id", "window_id")


@query(
    "case_only_cohort",
    f"""WITH {t.SUBJECTS_SQL} SELECT entity_id, followup_days, (followup_days <= 365)::INT AS label, CASE WHEN followup_days <= 365 THEN 'LE_365D_SCD' ELSE 'GT_365D_SCD' END AS "group"
      FROM subjects WHERE cause_raw = '3' AND source_valid AND has_record""",
)
def _(spark, sf):
    return cohort.case_only_cohort(t.subjects(spark, sf))


@query(
    "processed_signal_filter",
    f"WITH {t.WINDOWS_SQL} SELECT entity_id, count(*) FILTER (extraction_success) AS n_windows_successful FROM windows GROUP BY 1 HAVING bool_or(qc_valid) AND count(*) FILTER (extraction_success) > 0",
)
def _(spark, sf):
    c = aggregate.window_counts(t.windows(spark, sf), ["entity_id"]).withColumn("processed", F.col("n_windows_qc_valid") > 0)
    return population.processed_with_windows(c).select("entity_id", "n_windows_successful")


@query(
    "success_and_qc_masks",
    f"""WITH {t.WINDOWS_SQL} SELECT count(*) FILTER (extraction_success) AS by_flag, count(*) FILTER (window_status = 'SUCCESS') AS by_status, count(*) AS by_nothing,
      count(*) FILTER (qc_valid) AS qc, count(*) FILTER (extraction_success) AS qc_fallback, count(*) FILTER (sig_std IS NOT NULL AND sig_std_valid) AS usable FROM windows""",
)
def _(spark, sf):
    w = t.windows(spark, sf)
    a, b, c = aggregate.success_mask(w), aggregate.success_mask(w.drop("extraction_success")), aggregate.success_mask(w.select("entity_id"))
    return w.agg(
        F.count_if(a).alias("by_flag"), F.count_if(b).alias("by_status"), F.count_if(c).alias("by_nothing"), F.count_if(aggregate.qc_mask(w)).alias("qc"),
        F.count_if(aggregate.qc_mask(w.drop("qc_valid"))).alias("qc_fallback"), F.count_if(aggregate.value_mask(w, "sig_std")).alias("usable"),
    )


@query(
    "conditional_null_policy",
    f"""WITH {t.WINDOWS_SQL} SELECT w.entity_id, window_id, round(sig_mean, 6) AS sig_mean, CASE WHEN NOT f THEN round(mean_rr, 6) END AS mean_rr,
      CASE WHEN f THEN FALSE ELSE mean_rr_valid END AS mean_rr_valid, CASE WHEN f THEN FALSE ELSE qc_valid END AS qc_valid,
      CASE WHEN f THEN CASE WHEN extraction_success THEN 'AF_INCOMPATIBLE_HRV' ELSE window_status END ELSE '' END AS qc_reason
      FROM windows w JOIN (SELECT c_custkey, c_mktsegment = 'BUILDING' AS f FROM customer) ON c_custkey = w.entity_id""",
)
def _(spark, sf):
    w = t.windows(spark, sf).withColumns(
        {"failure_reason": F.col("window_status"), "qc_status": F.when(F.col("qc_valid"), "PASS").otherwise("FAIL"), "qc_reason": F.lit("")}
    )
    flags = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_mktsegment") == "BUILDING").alias("af_flag"))
    df = signal.interval_null_policy(w.join(flags, "entity_id"), F.col("af_flag"), INTERVAL_FEATURES)
    return df.select("entity_id", "window_id", F.round("sig_mean", 6).alias("sig_mean"), F.round("mean_rr", 6).alias("mean_rr"), "mean_rr_valid", "qc_valid", "qc_reason")


LAST_SQL = "SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1"


@query("inner_join_one_to_one", f"SELECT c_custkey AS entity_id, c_acctbal, top FROM customer JOIN ({LAST_SQL}) ON o_custkey = c_custkey")
def _(spark, sf):
    a = _key_table(t.read(spark, sf, "customer"), "c_custkey", "c_acctbal")
    b = t.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.max("o_totalprice").alias("top"))
    return relational.join_one_to_one(a, b, ["entity_id"])


@query("left_join_one_to_one", f"SELECT c_custkey AS entity_id, c_acctbal, top FROM customer LEFT JOIN ({LAST_SQL} HAVING max(o_totalprice) > 400000) ON o_custkey = c_custkey")
def _(spark, sf):
    a = _key_table(t.read(spark, sf, "customer"), "c_custkey", "c_acctbal")
    b = t.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.max("o_totalprice").alias("top")).filter("top > 400000")
    return relational.join_one_to_one(a, b, ["entity_id"], "left")


@query("left_join_many_to_one", "SELECT l_orderkey AS k, l_linenumber, l_quantity, o_orderstatus, o_orderpriority FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def _(spark, sf):
    lines = t.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity")
    heads = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    return relational.join_many_to_one(lines, heads, ["k"])


GROUPS_SQL = """a AS (SELECT c_custkey AS entity_id, c_mktsegment AS g FROM customer WHERE c_acctbal > 0),
    b AS (SELECT c_custkey AS entity_id, CASE WHEN c_nationkey > 20 THEN 'X' ELSE c_mktsegment END AS g FROM customer WHERE c_acctbal < 9000)"""


@query(
    "full_outer_with_indicator",
    f"""WITH {GROUPS_SQL} SELECT entity_id, a.g AS g_new, b.g AS g_old, a.g IS NOT NULL AS in_new, b.g IS NOT NULL AS in_old, coalesce(a.g = b.g, FALSE) AS agreement,
      CASE WHEN b.g IS NULL THEN 'NEW_ONLY' WHEN a.g IS NULL THEN 'OLD_ONLY' WHEN a.g = b.g THEN 'MATCH' ELSE 'GROUP_MISMATCH' END AS reason FROM a FULL JOIN b USING (entity_id)""",
)
def _(spark, sf):
    c = t.read(spark, sf, "customer")
    a = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("g"))
    b = c.filter("c_acctbal < 9000").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_nationkey") > 20, "X").otherwise(F.col("c_mktsegment")).alias("g"))
    return relational.outer_with_indicator(a, b, ["entity_id"], "g")


@query(
    "lookup_join",
    """SELECT c_custkey AS entity_id, n AS long_n, price AS long_price FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS price FROM orders
      WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""",
)
def _(spark, sf):
    a = _key_table(t.read(spark, sf, "customer"), "c_custkey")
    r = t.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id"), "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("price"))
    return relational.lookup(a, r, ["entity_id"], F.col("o_orderstatus") == "F", "long_").drop("long_o_orderstatus")


@query(
    "semi_anti_difference",
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT user_id AS k FROM events UNION SELECT -1)
    SELECT k, 'LEFT_ONLY' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'RIGHT_ONLY' FROM b WHERE k NOT IN (SELECT k FROM a)""",
)
def _(spark, sf):
    a = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    e = t.read(spark, sf, "events")
    b = e.select(F.col("user_id").alias("k")).union(e.agg(F.lit(-1).cast("long").alias("k")))
    return relational.key_differences(a, b, ["k"])


@query("key_spine", "SELECT DISTINCT c_custkey AS entity_id FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events")
def _(spark, sf):
    frames = [_key_table(t.read(spark, sf, n), k) for n, k in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))]
    return relational.key_spine(["entity_id"], *frames)


@query(
    "union_all",
    "SELECT o_orderstatus AS batch, o_orderkey AS k FROM orders",
)
def _(spark, sf):
    o = t.read(spark, sf, "orders")
    return relational.stack_frames([o.filter(F.col("o_orderstatus") == s).select(F.col("o_orderstatus").alias("batch"), F.col("o_orderkey").alias("k")) for s in ("F", "O", "P")])


@query(
    "intersect_except",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS shared, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_left,
      (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_right""",
)
def _(spark, sf):
    o = t.read(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return relational.key_overlap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority = '1-URGENT'"), ["k"])


@query("distinct_keys", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def _(spark, sf):
    return t.read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").dropDuplicates()


@query("scan_parquet", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity > 45")
def _(spark, sf):
    from ..sources.readers import scan_parquet

    return scan_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_discount"]).filter("l_quantity > 45")
