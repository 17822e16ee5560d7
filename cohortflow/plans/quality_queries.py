"""Queries over data-quality checks, reconciliation, gates and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.derive import row_fingerprint
from ..operators import endpoints, incremental, metrics, population, quality, windows
from ..session import scratch_path
from . import tables as t
from .outcome_queries import FOLD_SQL, _folds
from .registry import query


def _orders(spark, sf):
    return t.read(spark, sf, "orders")


@query("unique_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return quality.unique_key(t.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "orphan_and_missing_keys",
    """WITH c AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), p AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P')
    SELECT k, 'ORPHAN' AS kind FROM c WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT k, 'NO_CHILD' FROM p WHERE k NOT IN (SELECT k FROM c)""",
)
def _(spark, sf):
    child = t.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    parent = _orders(spark, sf).filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return quality.orphans_and_childless(child, parent, "k")


@query(
    "key_set_equality",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer) SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_left,
    (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_right, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) = 0 AND (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) = 0 AS equal""",
)
def _(spark, sf):
    return quality.key_set_equality(_orders(spark, sf).withColumnRenamed("o_custkey", "k"), t.read(spark, sf, "customer").withColumnRenamed("c_custkey", "k"), ["k"])


def _copies(spark, sf):
    o = _orders(spark, sf).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"), F.col("o_orderstatus").alias("s"))
    changed = o.withColumns({"y": F.when(F.col("s") == "F", F.col("y") + 0.5).otherwise(F.col("y")), "s": F.when(F.col("x") > 1000, None).otherwise(F.col("s"))})
    return o.filter("y > 2000"), changed.filter("y < 499000")


COPIES_SQL = """a0 AS (SELECT o_orderkey AS k, o_custkey::DOUBLE AS x, o_totalprice AS y, o_orderstatus AS s FROM orders), a AS (SELECT * FROM a0 WHERE y > 2000),
b AS (SELECT k, x, CASE WHEN s = 'F' THEN y + 0.5 ELSE y END AS y, CASE WHEN x > 1000 THEN NULL ELSE s END AS s FROM a0 WHERE CASE WHEN s = 'F' THEN y + 0.5 ELSE y END < 499000)"""


@query(
    "column_pair_equality",
    f"""WITH {COPIES_SQL}, j AS (SELECT a.x AS ax, b.x AS bx, a.y AS ay, b.y AS bY_, a.s AS "as_", b.s AS bs FROM a JOIN b USING (k))
    SELECT 'x' AS column_name, count(*) FILTER (ax IS DISTINCT FROM bx) AS mismatches FROM j UNION ALL SELECT 'y', count(*) FILTER (ay IS DISTINCT FROM bY_) FROM j UNION ALL SELECT 's', count(*) FILTER (as_ IS DISTINCT FROM bs) FROM j""",
)
def _(spark, sf):
    a, b = _copies(spark, sf)
    return quality.column_pair_equality(a, b, ["k"], [("x", "x"), ("y", "y"), ("s", "s")])


@query("allowed_values", "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1")
def _(spark, sf):
    return quality.allowed_values(_orders(spark, sf), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("allowed_codes_in_lists", "SELECT v AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS v FROM part) WHERE v NOT IN ('small', 'red', 'ring') GROUP BY 1")
def _(spark, sf):
    p = t.read(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit(";")).alias("codes"))
    return quality.allowed_values(p, "codes", ["small", "red", "ring"], split=True)


@query("regex_check", "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^https?://[a-z.]+/[a-z]{2}/[0-9]+$')")
def _(spark, sf):
    return quality.regex_check(t.read(spark, sf, "pages"), "url", "^https?://[a-z.]+/[a-z]{2}/[0-9]+$").select("page_id")


@query(
    "numeric_ranges",
    """SELECT 'l_quantity' AS rule, count(*) FILTER (NOT (l_quantity >= 5 AND l_quantity <= 40)) AS violations FROM lineitem UNION ALL SELECT 'l_discount', count(*) FILTER (NOT l_discount <= 0.05) FROM lineitem
    UNION ALL SELECT 'l_tax', count(*) FILTER (NOT l_tax >= 0) FROM lineitem""",
)
def _(spark, sf):
    return quality.numeric_ranges(t.read(spark, sf, "lineitem"), {"l_quantity": (5, 40), "l_discount": (None, 0.05), "l_tax": (0, None)})


@query(
    "derived_relationships",
    f"""WITH {t.WINDOWS_SQL} SELECT 'raw_is_sum' AS rule, count(*) FILTER (abs(raw_rr_count - valid_rr_count - removed_rr_count) > 0) AS violations FROM windows
    UNION ALL SELECT 'beats_are_raw', count(*) FILTER (abs(beats - raw_rr_count) > 1e-9) FROM windows UNION ALL SELECT 'spread_above_sd', count(*) FILTER (abs(sig_p2p - sig_std) > 20) FROM windows""",
)
def _(spark, sf):
    c = F.col
    return quality.derived_relationships(
        t.windows(spark, sf),
        {"raw_is_sum": (c("raw_rr_count"), c("valid_rr_count") + c("removed_rr_count"), 0.0), "beats_are_raw": (c("beats"), c("raw_rr_count"), 1e-9), "spread_above_sd": (c("sig_p2p"), c("sig_std"), 20.0)},
    )


@query(
    "validity_bit_consistency",
    f"""WITH {t.WINDOWS_SQL} SELECT 'sig_std' AS rule, count(*) FILTER (coalesce(sig_std_valid, FALSE) <> (sig_std IS NOT NULL)) AS violations FROM windows
    UNION ALL SELECT 'mean_rr', count(*) FILTER (coalesce(mean_rr_valid, FALSE) <> (mean_rr IS NOT NULL)) FROM windows""",
)
def _(spark, sf):
    return quality.validity_bits_consistent(t.windows(spark, sf), ["sig_std", "mean_rr"])


@query(
    "qc_status_consistency",
    f"""WITH {t.WINDOWS_SQL}, q AS (SELECT qc_valid, window_status = 'SUCCESS' AS pass, CASE WHEN qc_valid THEN '' ELSE window_status END AS reason FROM windows)
    SELECT 'pass_iff_valid' AS rule, count(*) FILTER (qc_valid <> pass) AS violations FROM q UNION ALL SELECT 'reason_iff_fail', count(*) FILTER (qc_valid <> (reason = '')) FROM q""",
)
def _(spark, sf):
    w = t.windows(spark, sf).withColumns(
        {"qc_status": F.when(F.col("window_status") == "SUCCESS", "PASS").otherwise("FAIL"), "qc_reason": F.when(F.col("qc_valid"), "").otherwise(F.col("window_status"))}
    )
    return quality.qc_status_consistent(w)


@query(
    "window_sequence_check",
    f"""WITH {t.SAMPLES_SQL}, kept AS (SELECT * FROM theory WHERE NOT (sample_count > 1500 AND window_id = 1)), g AS (SELECT entity_id, count(*) AS o, max(window_id) AS hi FROM kept GROUP BY 1)
    SELECT entity_id, n AS expected, coalesce(o, 0) AS observed, coalesce(hi = o - 1, TRUE) AS gap_free, 0::BIGINT AS formula_errors FROM counted LEFT JOIN g USING (entity_id)""",
)
def _(spark, sf):
    r = t.records(spark, sf)
    w = windows.complete_windows(r, **t.SHORT_SCHEDULE).filter("not (sample_count > 1500 and window_id = 1)")
    return quality.window_sequence(w, r, **t.SHORT_SCHEDULE)


@query(
    "source_value_preservation",
    f"""WITH {COPIES_SQL}, s AS (SELECT k, s AS v FROM a UNION ALL SELECT k, x::BIGINT::VARCHAR FROM a WHERE FALSE), l AS (SELECT k, 's' AS column_name, s AS value FROM a), r AS (SELECT k, 's' AS column_name, s AS value FROM b)
    SELECT *, 'SOURCE' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'STORED' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""",
)
def _(spark, sf):
    a, b = _copies(spark, sf)
    return quality.value_preservation(a, b, "k", ["s"])


@query(
    "endpoint_recompute",
    f"""WITH {t.ENDPOINTS_SQL} SELECT 'state' AS "check", count(*) FILTER (state = 'COMPETING_EVENT' AND horizon_days <> 90) AS mismatches FROM labelled UNION ALL SELECT 'label', count(*) FILTER (state = 'COMPETING_EVENT' AND horizon_days <> 90) FROM labelled UNION ALL SELECT 'one_side_only', count(*) FILTER (horizon_days = 90) FROM labelled""",
)
def _(spark, sf):
    fresh = endpoints.build_endpoint(t.subjects(spark, sf), check_keys=False)
    stored = endpoints.competing_as_negative(fresh).filter("horizon_days <> 90")
    return quality.stored_equals_recomputed(stored, fresh, ["entity_id", "horizon_days"], ["state", "label"])


@query(
    "table_reconcile",
    f"""WITH {COPIES_SQL}, j AS (SELECT a.k AS ak, b.k AS bk, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS byy FROM a FULL JOIN b ON a.k = b.k), c AS (SELECT count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL) AS s, count(*) FILTER (bk IS NULL) AS l, count(*) FILTER (ak IS NULL) AS r FROM j)
    SELECT 'x' AS column_name, s AS shared, l AS only_new, r AS only_old, (SELECT count(*) FILTER (ax <> bx) FROM j) AS mismatches, (SELECT max(abs(ax - bx)) FROM j) AS max_abs_diff FROM c
    UNION ALL SELECT 'y', s, l, r, (SELECT count(*) FILTER (abs(ay - byy) > 1e-9) FROM j), (SELECT round(max(abs(ay - byy)), 6) FROM j) FROM c""",
)
def _(spark, sf):
    a, b = _copies(spark, sf)
    return quality.table_reconcile(a, b, ["k"], ["x", "y"], atol=1e-9).withColumn("max_abs_diff", F.round("max_abs_diff", 6))


@query(
    "expected_counts",
    """WITH c AS (SELECT count(*)::DOUBLE AS orders, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS finished FROM orders) SELECT 'orders' AS name, orders AS observed, 15000.0::DOUBLE AS expected, orders - 15000 AS difference, orders = 15000 AS equal FROM c
    UNION ALL SELECT 'finished', finished, 5000.0, finished - 5000, finished = 5000 FROM c""",
)
def _(spark, sf):
    c = _orders(spark, sf).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    return quality.expected_counts(c, {"orders": 15000, "finished": 5000})


@query("cohort_drift_guard", f"WITH {t.PREDICTIONS_SQL} SELECT label, count(*) AS n FROM base GROUP BY 1")
def _(spark, sf):
    b = t.predictions(spark, sf).filter("model = 'price'")
    c = quality.class_counts(b).first()
    return quality.cohort_drift_guard(b, (c["n"], c["positive"], c["negative"])).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "oof_contract",
    f"""WITH {t.SEEDED_SQL} SELECT model, count(DISTINCT entity_id) AS entities, count(*) AS rows, 0::BIGINT AS duplicates, 0::BIGINT AS label_conflicts, count(*) FILTER (NOT score BETWEEN 0 AND 1) AS bad_scores,
      count(DISTINCT seed) AS seeds, count(*) FILTER (NOT score BETWEEN 0 AND 1) = 0 AS holds FROM seeded GROUP BY 1""",
)
def _(spark, sf):
    return quality.oof_contract(t.seeded_predictions(spark, sf))


@query(
    "fold_conservation",
    f"""WITH {FOLD_SQL} SELECT seed, fold, count(*) AS oof_n, sum(label)::BIGINT AS oof_positive, TRUE AS conserved FROM folds GROUP BY 1, 2""",
)
def _(spark, sf):
    from ..operators.folds import validate_folds

    f = _folds(spark, sf)
    return quality.fold_conservation(validate_folds(f), f)


@query(
    "metric_recompute",
    f"""WITH {t.PREDICTIONS_SQL},{t.curve_sql('preds', 'model')} SELECT 'AUC' AS metric, count(*) FILTER (model = 'rounded') AS mismatches, 0.001::DOUBLE AS max_abs_diff FROM ranked UNION ALL SELECT 'AP', 0, 0.0""",
)
def _(spark, sf):
    fresh = metrics.ranking_metrics(t.predictions(spark, sf), ["model"])
    stored = fresh.withColumn("AUC", F.when(F.col("model") == "rounded", F.col("AUC") + 0.001).otherwise(F.col("AUC")))
    return quality.metric_mismatch(stored, fresh, ["model"], ["AUC", "AP"]).withColumn("max_abs_diff", F.round("max_abs_diff", 9))


@query(
    "leakage_check",
    f"""WITH {FOLD_SQL} SELECT seed, 1 AS fold, entity_id FROM folds WHERE fold = 1 AND label = 1""",
)
def _(spark, sf):
    f = _folds(spark, sf)
    parts = f.select("seed", F.lit(1).alias("fold"), "entity_id", F.when(F.col("fold") == 1, "test").otherwise("train").alias("part"))
    leak = f.filter("fold = 1 and label = 1").select("seed", F.lit(1).alias("fold"), "entity_id", F.lit("train").alias("part"))
    return quality.leakage(parts.unionByName(leak))


@query(
    "entity_table_check",
    """SELECT 0::BIGINT AS only_left, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_right, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) = 0 AS equal,
    (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated, 0::BIGINT AS null_keys, 1 AS untyped_columns""",
)
def _(spark, sf):
    table = _orders(spark, sf).withColumnRenamed("o_custkey", "entity_id")
    subjects = t.read(spark, sf, "customer").withColumnRenamed("c_custkey", "entity_id")
    return quality.entity_table_check(table, subjects, ["o_totalprice", "o_orderstatus"])


DIGESTS_SQL = """files AS (SELECT page_id::VARCHAR AS path, sha256(html) AS digest FROM pages WHERE url NOT LIKE '%/fr/%'),
listed AS (SELECT page_id::VARCHAR AS path, CASE WHEN url LIKE '%page=2%' THEN sha256(url) ELSE sha256(html) END AS digest FROM pages WHERE url NOT LIKE '%/en/%' UNION ALL SELECT page_id::VARCHAR, sha256(html) FROM pages WHERE url LIKE '%/de/%' AND url LIKE 'https%')"""


def _digests(spark, sf):
    p = t.read(spark, sf, "pages").select("url", F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("digest"), F.sha2("url", 256).alias("other"))
    files = p.filter("url not like '%/fr/%'").select("path", "digest")
    stale = F.when(F.col("url").like("%page=2%"), F.col("other")).otherwise(F.col("digest"))
    listed = p.filter("url not like '%/en/%'").select("path", stale.alias("digest"))
    return files, listed.unionByName(p.filter("url like '%/de/%' and url like 'https%'").select("path", "digest"))


@query(
    "hash_manifest_check",
    f"""WITH {DIGESTS_SQL}, m AS (SELECT path, min(digest) AS expected, count(*) AS n FROM listed GROUP BY 1)
    SELECT path, expected, digest AS actual, CASE WHEN regexp_matches(path, '^9') AND digest IS NOT NULL THEN 'PROHIBITED' WHEN n > 1 THEN 'DUPLICATE' WHEN digest IS NULL THEN 'MISSING' WHEN expected IS NULL THEN 'EXTRA'
      WHEN digest = expected THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM m FULL JOIN files USING (path)""",
)
def _(spark, sf):
    files, listed = _digests(spark, sf)
    return quality.hash_manifest_check(files, listed, prohibited="^9")


@query(
    "declared_size_check",
    """WITH d AS (SELECT doc_id::VARCHAR AS path, n_chars AS expected_bytes FROM documents), f AS (SELECT doc_id::VARCHAR AS path, octet_length(encode(text))::BIGINT AS length FROM documents WHERE source <> (SELECT min(source) FROM documents))
    SELECT path, expected_bytes, length, length - expected_bytes AS difference, CASE WHEN length IS NULL THEN 'MISSING' WHEN length < expected_bytes THEN 'SHORTER' WHEN length > expected_bytes THEN 'TRAILING_BYTES' ELSE 'OK' END AS verdict FROM d LEFT JOIN f USING (path)""",
)
def _(spark, sf):
    d = t.read(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string"))
    least = d.agg(F.min("source").alias("first_source"))
    files = d.join(least, d.source != least.first_source).select("path", F.octet_length("text").cast("long").alias("length"))
    return quality.declared_size_check(files, d.select("path", F.col("n_chars").alias("expected_bytes")))


@query(
    "declared_vs_present",
    """WITH d AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000)
    SELECT k, 'DECLARED_NOT_PRESENT' AS kind FROM d WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT k, 'PRESENT_NOT_DECLARED' FROM p WHERE k NOT IN (SELECT k FROM d)""",
)
def _(spark, sf):
    d = t.read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    p = _orders(spark, sf).filter("o_totalprice > 450000").select(F.col("o_custkey").alias("k"))
    return quality.declared_vs_present(d, p, "k")


@query(
    "window_validation_summary",
    f"""WITH {t.WINDOWS_SQL}, e AS (SELECT entity_id, count(*) AS n, count(*) FILTER (window_status = 'SUCCESS') AS s, count(*) FILTER (raw_rr_count = valid_rr_count) AS q, sum(removed_rr_count) AS r FROM windows GROUP BY 1)
    SELECT count(*) AS entities, sum(n)::BIGINT AS windows, sum(s)::BIGINT AS successes, min(s) AS min_success, max(s) AS max_success, sum(q)::BIGINT AS raw_equals_valid, sum(r)::BIGINT AS removed_total, count(*) * 24 AS expected_windows FROM e""",
)
def _(spark, sf):
    return quality.window_validation_summary(t.windows(spark, sf), expected_per_entity=24)


@query(
    "model_frame_check",
    """SELECT 0::BIGINT AS null_ids, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, count(*) FILTER (o_orderstatus = 'P') AS bad_labels, count(*) FILTER (o_orderstatus = 'F') AS positive,
      count(*) FILTER (o_orderstatus = 'O') AS negative, count(*) AS non_numeric, FALSE AS usable FROM orders""",
)
def _(spark, sf):
    label = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    f = _orders(spark, sf).select(F.col("o_custkey").alias("entity_id"), label.alias("label"), "o_totalprice", "o_orderpriority")
    return quality.model_frame_check(f, ["o_totalprice", "o_orderpriority"])


@query(
    "contract_check",
    """WITH c AS (SELECT count(*)::DOUBLE AS windows, count(DISTINCT label)::DOUBLE AS entities, max(len(embedding))::DOUBLE AS samples FROM embeddings)
    SELECT 'windows' AS name, windows AS observed, 500.0::DOUBLE AS expected, windows - 500 AS difference, windows = 500 AS holds FROM c UNION ALL SELECT 'entities', entities, 12.0, entities - 12, entities = 12 FROM c
    UNION ALL SELECT 'samples', samples, 64.0, samples - 64, samples = 64 FROM c""",
)
def _(spark, sf):
    c = t.read(spark, sf, "embeddings").agg(F.count("*").alias("windows"), F.countDistinct("label").alias("entities"), F.max(F.size("embedding")).alias("samples"))
    return quality.contract_check(c, {"windows": 500, "entities": 12, "samples": 64})


@query(
    "copy_equality",
    f"""WITH {DIGESTS_SQL}, m AS (SELECT path, min(digest) AS expected, count(*) AS n FROM files GROUP BY 1), z AS (SELECT page_id::VARCHAR AS path, sha256(html) AS digest FROM pages WHERE url NOT LIKE '%/en/%')
    SELECT path, expected, digest AS actual, CASE WHEN digest IS NULL THEN 'MISSING' WHEN expected IS NULL THEN 'EXTRA' WHEN digest = expected THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM m FULL JOIN z USING (path)""",
)
def _(spark, sf):
    files, _ = _digests(spark, sf)
    other = t.read(spark, sf, "pages").filter("url not like '%/en/%'").select(F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("digest"))
    return quality.hash_manifest_check(other, files)


@query(
    "metric_vs_reference",
    f"""WITH {t.PREDICTIONS_SQL},{t.curve_sql('preds', 'model')} SELECT 'AUC' AS metric, round("AUC", 8) AS value, 0.569687::DOUBLE AS quoted, round(abs("AUC" - 0.569687), 8) AS abs_diff FROM ranked WHERE model = 'price'
    UNION ALL SELECT 'AP', round("AP", 8), 0.484675, round(abs("AP" - 0.484675), 8) FROM ranked WHERE model = 'price'""",
)
def _(spark, sf):
    m = metrics.ranking_metrics(t.predictions(spark, sf).filter("model = 'price'"), ["model"]).unpivot(["model"], ["AUC", "AP"], "metric", "value")
    df = quality.metric_vs_reference(m, {"AUC": 0.569687, "AP": 0.484675})
    return df.withColumns({c: F.round(c, 8) for c in ("value", "abs_diff")})


@query(
    "hard_gate",
    """WITH c AS (SELECT count(*) FILTER (l_quantity > 40) AS q, count(*) FILTER (l_tax < 0) AS t, count(*) FILTER (l_discount > 0.05) AS d FROM lineitem)
    SELECT concat_ws(';', CASE WHEN d > 0 THEN 'l_discount' END, CASE WHEN q > 0 THEN 'l_quantity' END, CASE WHEN t > 0 THEN 'l_tax' END) AS failed_checks, 3::BIGINT AS checks, d + q + t = 0 AS passed FROM c""",
)
def _(spark, sf):
    v = quality.numeric_ranges(t.read(spark, sf, "lineitem"), {"l_quantity": (None, 40), "l_tax": (0, None), "l_discount": (None, 0.05)})
    return quality.hard_gate(v.select(F.col("rule").alias("check"), F.col("violations").alias("failures")))


@query(
    "batch_coverage",
    """WITH f AS (SELECT DISTINCT o_custkey // 100 AS batch, o_custkey AS seed FROM orders WHERE o_orderpriority = '1-URGENT'), e AS (SELECT c_custkey // 100 AS batch, c_custkey AS seed FROM customer WHERE c_acctbal > -500)
    SELECT batch, count(e.seed) AS expected, count(f.seed) AS found, count(*) FILTER (f.seed IS NULL) AS missing, count(*) FILTER (e.seed IS NULL) AS unexpected
    FROM (SELECT batch, seed, TRUE AS z FROM f) f FULL JOIN (SELECT batch, seed FROM e) e USING (batch, seed) GROUP BY 1""".replace("count(e.seed)", "count(*) FILTER (e.seed IS NOT NULL)").replace("count(f.seed)", "count(*) FILTER (f.seed IS NOT NULL)"),
)
def _(spark, sf):
    runs = _orders(spark, sf).filter("o_orderpriority = '1-URGENT'").select(F.floor(F.col("o_custkey") / 100).alias("batch"), F.col("o_custkey").alias("seed"))
    want = t.read(spark, sf, "customer").filter("c_acctbal > -500").select(F.floor(F.col("c_custkey") / 100).alias("batch"), F.col("c_custkey").alias("seed"))
    return quality.batch_coverage(runs, want)


DONE_SQL = """inputs AS (SELECT c_custkey AS entity_id, sha256('{"c_custkey":"' || c_custkey || '","c_mktsegment":"' || c_mktsegment || '"}') AS fingerprint FROM customer),
done AS (SELECT c_custkey AS entity_id, sha256('{"c_custkey":"' || c_custkey || '","c_mktsegment":"' || CASE WHEN c_nationkey < 5 THEN 'OTHER' ELSE c_mktsegment END || '"}') AS fingerprint,
  CASE WHEN c_nationkey = 7 THEN 'FAILED' ELSE 'COMPLETE' END AS status, c_nationkey AS row_count, CASE WHEN c_nationkey = 9 THEN 0 ELSE c_nationkey END AS stored_rows FROM customer WHERE c_acctbal > 1000)"""


def _work(spark, sf):
    c = t.read(spark, sf, "customer")
    inputs = c.select(F.col("c_custkey").alias("entity_id"), row_fingerprint("c_custkey", "c_mktsegment").alias("fingerprint"))
    old = c.filter("c_acctbal > 1000").withColumn("c_mktsegment", F.when(F.col("c_nationkey") < 5, "OTHER").otherwise(F.col("c_mktsegment")))
    done = old.select(
        F.col("c_custkey").alias("entity_id"), row_fingerprint("c_custkey", "c_mktsegment").alias("fingerprint"), F.when(F.col("c_nationkey") == 7, "FAILED").otherwise("COMPLETE").alias("status"),
        F.col("c_nationkey").alias("row_count"), F.when(F.col("c_nationkey") == 9, 0).otherwise(F.col("c_nationkey")).alias("stored_rows"), F.lit(1).alias("finished_at"),
    )
    return inputs, done


@query(
    "skip_completed",
    f"""WITH {DONE_SQL} SELECT entity_id, fingerprint FROM inputs i WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.entity_id = i.entity_id AND d.fingerprint = i.fingerprint AND status = 'COMPLETE' AND row_count = stored_rows)""",
)
def _(spark, sf):
    return incremental.pending_work(*_work(spark, sf)).select("entity_id", "fingerprint")


@query(
    "completeness_status",
    f"""WITH {DONE_SQL}, w AS (SELECT i.entity_id, CASE WHEN d.entity_id IS NULL THEN 'NEW' WHEN status = 'FAILED' THEN 'FAILED' WHEN d.fingerprint = i.fingerprint AND row_count = stored_rows THEN 'REUSED' ELSE 'STALE' END AS work_state
      FROM inputs i LEFT JOIN done d USING (entity_id)), b AS (SELECT count(*) AS entities, count(*) FILTER (work_state = 'FAILED') AS failed FROM w),
    p AS (SELECT CASE WHEN work_state = 'FAILED' THEN 'FAILED' WHEN work_state = 'REUSED' THEN 'COMPLETE' ELSE 'NOT_APPLICABLE' END AS processing_status, work_state FROM w)
    SELECT work_state, processing_status, count(*) AS n, any_value(entities) AS entities, any_value(failed) AS failed, CASE WHEN any_value(failed) > 0 THEN 'DEGRADED' ELSE 'COMPLETE' END AS status FROM p, b GROUP BY 1, 2""",
)
def _(spark, sf):
    report = incremental.reuse_report(*_work(spark, sf))
    state = population.completeness(report, F.col("work_state") == "FAILED", F.col("work_state") == "REUSED")
    counts = state.groupBy("work_state", "processing_status").agg(F.count("*").alias("n"))
    return counts.withColumn("_k", F.lit(1)).join(incremental.build_status(report).withColumn("_k", F.lit(1)), "_k").drop("_k")


@query(
    "incremental_build",
    """WITH n AS (SELECT o_custkey AS entity_id, count(*) AS rows FROM orders GROUP BY 1), c AS (SELECT c_custkey AS entity_id, c_nationkey, coalesce(rows, 0) AS rows FROM customer LEFT JOIN n ON entity_id = c_custkey)
    SELECT entity_id, CASE WHEN c_nationkey = 7 THEN 'FAILED' ELSE 'COMPLETE' END AS status, CASE WHEN c_nationkey = 7 THEN 'ValueError' END AS error_type, CASE WHEN c_nationkey = 7 THEN 0 ELSE rows END AS row_count,
      CASE WHEN c_nationkey = 7 THEN 3 WHEN c_nationkey < 3 THEN 2 ELSE 1 END AS built_by, CASE WHEN c_nationkey = 7 THEN 'FAILED' WHEN c_nationkey < 3 THEN 'STALE' ELSE 'REUSED' END AS second_run,
      CASE WHEN c_nationkey = 7 THEN 'FAILED' ELSE 'REUSED' END AS third_run, CASE WHEN c_nationkey = 7 THEN 0 ELSE rows END AS stored FROM c""",
)
def _(spark, sf):
    # Three builds of the orders of every customer: all, then the changed ones, then nothing but what failed.
    c = t.read(spark, sf, "customer")
    o = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), "o_orderkey", "o_totalprice")
    failing = c.filter("c_nationkey = 7").select(F.col("c_custkey").alias("entity_id"))
    store = scratch_path(spark, "store")

    def inputs(version):
        mark = F.when(F.col("c_nationkey") < 3, F.lit(version)).otherwise(F.lit(1))
        return c.select(F.col("c_custkey").alias("entity_id"), F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), mark.cast("string")), 256).alias("fingerprint"))

    def build(pending):
        nothing = F.lit(None).cast("string")
        good = o.join(pending, "entity_id", "left_semi").withColumns({"error_type": nothing, "message": nothing})
        bad = failing.join(pending, "entity_id", "left_semi").select("entity_id", F.lit("ValueError").alias("error_type"), F.lit("no signal").alias("message"))
        return good.unionByName(bad, allowMissingColumns=True)

    reports = [incremental.incremental_build(inputs(version), build, store, run=run, parts=8) for run, version in ((1, 1), (2, 2), (3, 2))]
    status = spark.read.parquet(f"{store}/status").select("entity_id", "status", "error_type", F.col("row_count").cast("long").alias("row_count"), F.col("finished_at").alias("built_by"))
    stored = spark.read.parquet(f"{store}/rows").groupBy("entity_id").agg(F.count("*").alias("stored"))
    out = status.join(stored, "entity_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0).cast("long")))
    for name, report in (("second_run", reports[1]), ("third_run", reports[2])):
        out = out.join(report.select("entity_id", F.col("work_state").alias(name)), "entity_id")
    return out
