"""Queries over field parsing, decoding and derived inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import derive as D
from ..functions import parsing as P
from ..functions.constants import CAUSE_LABELS, EVENT_TYPES
from ..operators import cohort, features, relational
from . import tables as t
from .registry import query

NUM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DOT = f"CASE WHEN regexp_matches(trim(replace(t, ',', '.')), '{NUM}') THEN try_cast(replace(t, ',', '.') AS DOUBLE) END"


@query(
    "nullable_string",
    f"WITH {t.NUMBER_SQL} SELECT o_orderkey, nullif(trim(raw), '') AS value FROM texts",
)
def _(spark, sf):
    return t.number_texts(spark, sf).select("o_orderkey", P.nullable_string(F.col("raw")).alias("value"))


@query(
    "parse_number_decimal_comma",
    f"WITH {t.NUMBER_SQL} SELECT o_orderkey, CASE WHEN upper(t) NOT IN ('', 'NA', 'NAN', 'NULL') THEN {DOT} END AS value FROM bare",
)
def _(spark, sf):
    return t.number_texts(spark, sf).select("o_orderkey", P.parse_number_decimal_comma(F.col("raw")).alias("value"))


@query(
    "parse_integer_code",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_linenumber::BIGINT END AS code FROM lineitem""",
)
def _(spark, sf):
    text = F.when(F.col("l_quantity") > 25, F.concat(F.col("l_linenumber").cast("string"), F.lit(",0"))).otherwise(
        F.concat(F.col("l_linenumber").cast("string"), F.lit(",5"))
    )
    return t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.parse_integer_code(text).alias("code"))


@query(
    "parse_float_mixed",
    f"""WITH {t.NUMBER_SQL} SELECT o_orderkey, CASE WHEN t NOT IN ('', 'NA', 'na', 'N/A', 'None', '<NA>') THEN coalesce(
      CASE WHEN regexp_matches(t, '{NUM}') THEN try_cast(t AS DOUBLE) END,
      CASE WHEN regexp_matches(t, '^[^.,]*,[0-9]{{1,3}}$') THEN try_cast(replace(t, ',', '.') AS DOUBLE) END,
      CASE WHEN regexp_matches(replace(t, ',', ''), '{NUM}') THEN try_cast(replace(t, ',', '') AS DOUBLE) END) END AS value FROM bare""",
)
def _(spark, sf):
    return t.number_texts(spark, sf).select("o_orderkey", P.parse_float_mixed(F.col("raw")).alias("value"))


@query(
    "parse_number_na_list",
    f"WITH {t.NUMBER_SQL} SELECT o_orderkey, CASE WHEN t NOT IN ('', 'NA', 'N/A', '<NA>', 'None') THEN {DOT} END AS value FROM bare",
)
def _(spark, sf):
    return t.number_texts(spark, sf).select("o_orderkey", P.parse_number_na_list(F.col("raw")).alias("value"))


@query(
    "parse_number_regex",
    f"""WITH {t.NUMBER_SQL}, r AS (SELECT o_orderkey, replace(regexp_replace(trim(raw), '([0-9]),([0-9]+)$', '\\1.\\2'), ',', '') AS v FROM texts)
    SELECT o_orderkey, CASE WHEN regexp_matches(v, '{NUM}') THEN try_cast(v AS DOUBLE) END AS value FROM r""",
)
def _(spark, sf):
    return t.number_texts(spark, sf).select("o_orderkey", P.parse_number_regex(F.col("raw")).alias("value"))


CODE_TEXT = "CASE o_orderpriority WHEN '1-URGENT' THEN concat(k, ',0') WHEN '2-HIGH' THEN concat(k, '.0') WHEN '3-MEDIUM' THEN concat(' ', k) WHEN '5-LOW' THEN '' ELSE concat('x', k) END"


@query(
    "normalise_code",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN 'x' || o_custkey ELSE o_custkey::VARCHAR END AS code FROM orders""",
)
def _(spark, sf):
    o = t.read(spark, sf, "orders").withColumn("k", F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", P.normalise_code(F.expr(CODE_TEXT)).alias("code"))


@query(
    "flag_01",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS flag FROM orders",
)
def _(spark, sf):
    code = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0,0").otherwise("2")
    return t.read(spark, sf, "orders").select("o_orderkey", P.flag_01(P.parse_integer_code(code)).alias("flag"))


@query(
    "decode_code_map",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 0 THEN 'SURVIVOR' WHEN 1 THEN 'NON_CARDIAC_DEATH' WHEN 3 THEN 'SCD'
      WHEN 6 THEN 'PUMP_FAILURE_DEATH' WHEN 7 THEN 'PUMP_FAILURE_DEATH' END AS cause FROM lineitem""",
)
def _(spark, sf):
    return t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.decode(F.col("l_linenumber"), CAUSE_LABELS).alias("cause"))


@query(
    "coalesce_two_sources",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 5 END AS l, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey % 5 END AS s FROM orders),
    d AS (SELECT *, coalesce(l, s) AS k, coalesce(l = 1, FALSE) OR coalesce(s = 1, FALSE) AS af FROM c)
    SELECT o_orderkey, k AS rhythm_code, CASE k WHEN 0 THEN 'SINUS' WHEN 1 THEN 'PERMANENT_AF' WHEN 2 THEN 'ATRIAL_FLUTTER' WHEN 3 THEN 'PACEMAKER' END AS rhythm_decoded,
      af AS af_flag, CASE WHEN af THEN 'AF' WHEN k = 0 THEN 'SINUS' WHEN k = 2 THEN 'ATRIAL_FLUTTER' WHEN k = 3 THEN 'PACED' ELSE 'UNKNOWN' END AS rhythm_group FROM d""",
)
def _(spark, sf):
    o = t.read(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 5).alias("l"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey") % 5).alias("s"),
    )
    return cohort.merge_rhythm(o, "l", "s").drop("l", "s")


@query(
    "cross_field_validity",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity - 5 AS f, l_linenumber AS cause, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 0 END AS e FROM lineitem)
    SELECT l_orderkey, l_linenumber, coalesce(f >= 0 AND CASE WHEN cause IN (1, 3, 6, 7) THEN coalesce(e = 3, FALSE) WHEN cause = 0 THEN e IS NULL OR e IN (0, 1, 2) END, FALSE) AS valid FROM c""",
)
def _(spark, sf):
    e = F.when(F.col("l_returnflag") == "A", "3").when(F.col("l_returnflag") == "N", "0,0").otherwise(" ")
    df = t.read(spark, sf, "lineitem")
    ok = cohort.source_valid(F.col("l_quantity") - 5, F.col("l_linenumber"), P.parse_integer_code(e), e)
    return df.select("l_orderkey", "l_linenumber", ok.alias("valid"))


AVAIL_SQL = """src AS (SELECT c_custkey AS entity_id, CASE WHEN c_acctbal > 8000 THEN NULL ELSE c_acctbal > 0 END AS declared, c_mktsegment <> 'MACHINERY' AS declared_short,
    bool_or(o_orderstatus = 'F') AS long_ok, bool_or(o_orderpriority = '1-URGENT') AS short_ok FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"""


@query(
    "availability_consistency",
    f"""WITH {AVAIL_SQL}, m AS (SELECT entity_id, declared IS NOT DISTINCT FROM coalesce(long_ok, FALSE) AND declared_short IS NOT DISTINCT FROM coalesce(short_ok, FALSE) AS ok FROM src)
    SELECT entity_id, ok AS mapping_consistent, CASE WHEN ok THEN 'OK' ELSE 'METADATA_FILE_MISMATCH' END AS integrity_status FROM m""",
)
def _(spark, sf):
    c = t.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.when(F.col("c_acctbal") <= 8000, F.col("c_acctbal") > 0).alias("declared"),
        (F.col("c_mktsegment") != "MACHINERY").alias("declared_short"),
    )
    kinds = t.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.bool_or(F.col("o_orderstatus") == "F").alias("long_ok"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("short_ok")
    )
    df = cohort.availability(c.join(kinds, "entity_id", "left"), ["declared", "declared_short"], ["long_ok", "short_ok"])
    return df.select("entity_id", "mapping_consistent", "integrity_status")


@query(
    "eligibility_tristate",
    f"""WITH {t.SUBJECTS_SQL} SELECT entity_id, CASE WHEN NOT has_record THEN FALSE END AS eligible_primary, CASE WHEN NOT has_record OR af_flag THEN FALSE END AS eligible_hrv,
      CASE WHEN NOT has_record THEN 'NO_HOLTER' ELSE 'PENDING_SIGNAL_QC' END AS reason_primary,
      CASE WHEN NOT has_record THEN 'NO_HOLTER' WHEN af_flag THEN 'AF' ELSE 'PENDING_SIGNAL_QC' END AS reason_hrv FROM subjects""",
)
def _(spark, sf):
    return cohort.eligibility(t.subjects(spark, sf)).select("entity_id", "eligible_primary", "eligible_hrv", "reason_primary", "reason_hrv")


@query(
    "binary_label_text",
    "SELECT doc_id, quality AS q, toxic AS t FROM labels",
)
def _(spark, sf):
    q = F.when(F.col("quality") == 1, F.lit(" Yes")).otherwise(F.lit("LOW "))
    tox = F.when(F.col("toxic") == 1, F.lit("Positive")).otherwise(F.lit("false"))
    return t.read(spark, sf, "labels").select("doc_id", P.required_binary_label(q).alias("q"), P.required_binary_label(tox).alias("t"))


NAME = "CASE WHEN o_orderstatus = 'F' THEN concat('P', k) WHEN o_orderstatus = 'O' THEN concat('P', k, '_H') ELSE concat('R', k) END"


@query(
    "entity_id_from_name",
    "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'P' || o_custkey END AS entity_id FROM orders",
)
def _(spark, sf):
    o = t.read(spark, sf, "orders").withColumn("k", F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", P.entity_id_from_name(F.expr(NAME)).alias("entity_id"))


@query("range_gate", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 10 AND 40 THEN l_quantity END AS gated FROM lineitem")
def _(spark, sf):
    return t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", D.range_gate(F.col("l_quantity"), 10, 40).alias("gated"))


@query(
    "binary_code_map",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (0, 1, 2, 3) THEN (l_linenumber IN (1, 2, 3))::INT::DOUBLE END AS coded,
      CASE WHEN l_linenumber IN (0, 1) THEN l_linenumber::DOUBLE END AS kept FROM lineitem""",
)
def _(spark, sf):
    x = F.col("l_linenumber").cast("double")
    return t.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", D.binary_code_map(x, [0.0, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0]).alias("coded"), D.keep_binary(x).alias("kept")
    )


@query(
    "threshold_flag",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN (o_totalprice > 120000)::INT::DOUBLE END AS flag FROM orders",
)
def _(spark, sf):
    return t.read(spark, sf, "orders").select("o_orderkey", D.threshold_flag(F.col("o_totalprice") > 120000, F.col("o_orderstatus") != "P").alias("flag"))


@query(
    "log_transforms",
    """SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END, 6) AS l1, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS l0 FROM customer""",
)
def _(spark, sf):
    x = F.col("c_acctbal")
    return t.read(spark, sf, "customer").select("c_custkey", F.round(D.log1p_nonneg(x), 6).alias("l1"), F.round(D.log_pos(x), 6).alias("l0"))


@query(
    "derived_index",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 4 AS w, l_extendedprice / 500 AS h, l_tax * 1000 AS la FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN w BETWEEN 30 AND 250 AND h BETWEEN 100 AND 230 THEN sqrt(w * h / 3600.0) END, 6) AS area,
      round(CASE WHEN w BETWEEN 30 AND 250 AND h BETWEEN 100 AND 230 THEN la / sqrt(w * h / 3600.0) END, 6) AS ratio FROM x""",
)
def _(spark, sf):
    w, h = F.col("l_quantity") * 4, F.col("l_extendedprice") / 500
    area = D.surface_index(w, h)
    return t.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(area, 6).alias("area"), F.round(F.col("l_tax") * 1000 / area, 6).alias("ratio")
    )


@query(
    "class_indicator",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS class_three FROM orders",
)
def _(spark, sf):
    c = F.when(F.col("o_orderstatus") == "F", 3.0).when(F.col("o_orderstatus") == "O", 2.0)
    return t.read(spark, sf, "orders").select("o_orderkey", D.class_indicator(c, 3.0, [2.0, 3.0]).alias("class_three"))


@query(
    "reason_list",
    """SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_quantity < 10 THEN 'SHORT' END, CASE WHEN l_discount > 0.05 THEN 'CHEAP' END,
      CASE WHEN l_returnflag = 'R' THEN 'RETURNED' END) AS reasons FROM lineitem""",
)
def _(spark, sf):
    r = D.reason_list((F.col("l_quantity") < 10, "SHORT"), (F.col("l_discount") > 0.05, "CHEAP"), (F.col("l_returnflag") == "R", "RETURNED"))
    return t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r.alias("reasons"))


@query(
    "row_fingerprint",
    """SELECT o_orderkey, sha256('{"o_orderkey":"' || o_orderkey || '","o_custkey":"' || o_custkey || '","o_orderstatus":"' || o_orderstatus || '"}') AS fingerprint FROM orders""",
)
def _(spark, sf):
    return t.read(spark, sf, "orders").select("o_orderkey", D.row_fingerprint("o_orderkey", "o_custkey", "o_orderstatus").alias("fingerprint"))


@query(
    "feature_alias",
    f"""WITH {t.WINDOWS_SQL} SELECT window_id, round(sig_mean, 6) AS sig_mean, round(mean_rr, 6) AS mean_rr, mean_rr_valid FROM windows""",
)
def _(spark, sf):
    w = t.windows(spark, sf).select(
        "window_id", F.round("sig_mean", 6).alias("feature_01"), F.round("mean_rr", 6).alias("feature_08"), F.col("mean_rr_valid").alias("feature_08_valid")
    )
    return features.rename_aliases(w)


def _entity_stats(spark, sf):
    from ..operators.aggregate import five_stats, success_mask, usable_values

    w = t.windows(spark, sf)
    return five_stats(usable_values(w, ["entity_id"], t.FEATURES, success_mask(w)), ["entity_id"], t.FEATURES)


STATS_SQL = t.WINDOWS_SQL + ", stats AS (SELECT entity_id, " + ", ".join(
    f"avg({f}) AS {f}_mean, CASE WHEN count({f}) > 0 THEN coalesce(stddev_samp({f}), 0.0) END AS {f}_std, quantile_cont({f}, 0.1) AS {f}_p10, "
    f"quantile_cont({f}, 0.5) AS {f}_p50, quantile_cont({f}, 0.9) AS {f}_p90, count({f}) AS {f}_valid_count" for f in t.FEATURES
) + " FROM usable GROUP BY entity_id)"


@query(
    "feature_profile",
    f"WITH {STATS_SQL} SELECT entity_id, " + ", ".join(f"round({f}_{s}, 6) AS {f}_{s}" for f in ("sig_mean", "beats") for s in ("mean", "std", "p10", "p50", "p90")) + " FROM stats",
)
def _(spark, sf):
    kept = [f for f in features.base_features("physiology_only") if f in ("sig_mean", "sig_skew", "beats")]
    df = features.select_profile(_entity_stats(spark, sf), ["entity_id"], kept)
    return df.select("entity_id", *[F.round(c, 6).alias(c) for c in df.columns if c != "entity_id"])


@query(
    "feature_recipes",
    """WITH x AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS d FROM lineitem)
    SELECT * FROM (SELECT 'BASE' AS recipe, 2::BIGINT AS inputs, round(sum(a + b), 2) AS total FROM x UNION ALL SELECT 'SINGLE_C', 3, round(sum(a + b + c), 2) FROM x
    UNION ALL SELECT 'SINGLE_D', 3, round(sum(a + b + d), 2) FROM x UNION ALL SELECT 'PAIR_D', 3, round(sum(a + c + d), 2) FROM x)""",
)
def _(spark, sf):
    x = t.read(spark, sf, "lineitem").selectExpr("l_quantity a", "l_discount b", "l_tax c", "l_extendedprice d")
    recipes = {"BASE": ["a", "b"], **features.additions(["a", "b"], ["c", "d"]), **features.pair_swaps(["a", "b"], "b", "c", ["c", "d"])}
    features.check_recipes(recipes, x.columns)
    sums = x.agg(*[F.round(F.sum(sum((F.col(c) for c in cols[1:]), F.col(cols[0]))), 2).alias(n) for n, cols in recipes.items()])
    counts = F.create_map(*[v for n, cols in recipes.items() for v in (F.lit(n), F.lit(len(cols)).cast("long"))])
    return sums.unpivot([], list(recipes), "recipe", "total").withColumn("inputs", F.element_at(counts, F.col("recipe")))


@query(
    "spread_features",
    f"WITH {STATS_SQL} SELECT entity_id, round(sig_mean_p50, 6) AS sig_mean_median, round(sig_mean_p90 - sig_mean_p10, 6) AS sig_mean_p90_p10 FROM stats",
)
def _(spark, sf):
    df = features.spread_features(_entity_stats(spark, sf), ["entity_id"], ["sig_mean"])
    return df.select("entity_id", *[F.round(c, 6).alias(c) for c in df.columns[1:]])


@query(
    "redundancy_drop",
    f"WITH {t.WINDOWS_SQL} SELECT entity_id, window_id, window_status, qc_valid FROM windows",
)
def _(spark, sf):
    w = t.windows(spark, sf)
    kept = ("entity_id", "window_id", "window_status", "qc_valid")
    return features.drop_redundant(w, [c for c in w.columns if c not in kept])


@query(
    "provenance_projection",
    """SELECT o_custkey AS entity_id, o_orderkey AS record_id, o_orderstatus AS record_type, 'ORDERS' AS source_dataset, '1.0' AS source_version,
      concat('blocks/', o_orderkey, '.dat') AS source_path, sha256(o_orderkey::VARCHAR) AS source_sha256, o_custkey AS source_file_size, '0.1' AS build_code_version FROM orders""",
)
def _(spark, sf):
    r = t.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("record_type"),
        F.concat(F.lit("blocks/"), "o_orderkey", F.lit(".dat")).alias("signal_path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("data_digest"),
        F.col("o_custkey").alias("data_size"),
    )
    return cohort.provenance(r, "ORDERS", "1.0", "0.1")


@query(
    "record_status",
    """WITH r AS (SELECT o_orderkey AS record_id, o_orderstatus <> 'P' AS header_ok, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS size, 500 AS expected,
      CASE WHEN o_orderpriority <> '2-HIGH' THEN 'x' END AS dg FROM orders),
    s AS (SELECT record_id, concat_ws(';', CASE WHEN size < expected THEN 'DAT_SHORTER_THAN_HEADER' END, CASE WHEN NOT header_ok THEN 'INVALID_HEADER' END,
      CASE WHEN size IS NULL THEN 'NO_DAT' END, CASE WHEN dg IS NULL THEN 'OFFICIAL_SHA256_MISSING' END) AS z FROM r)
    SELECT record_id, CASE WHEN z = '' THEN 'OK' ELSE z END AS integrity_status FROM s""",
)
def _(spark, sf):
    r = t.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record_id"), (F.col("o_orderstatus") != "P").alias("header_ok"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("data_size"), F.lit(500).alias("expected_bytes"),
        F.lit("y").alias("header_digest"), F.when(F.col("o_orderpriority") != "2-HIGH", "x").alias("data_digest"),
    )
    return cohort.record_status(r).select("record_id", "integrity_status")


@query(
    "coerce_window_types",
    f"""WITH {t.WINDOWS_SQL} SELECT entity_id, window_id, round(sig_mean, 6) AS sig_mean, round(sig_std, 6) AS sig_std, sig_mean IS NOT NULL AS sig_mean_valid,
      coalesce(sig_std_valid, FALSE) AS sig_std_valid, extraction_success, FALSE AS within_record FROM windows""",
)
def _(spark, sf):
    w = t.windows(spark, sf).select("entity_id", "window_id", "sig_mean", "sig_std", "sig_std_valid", "extraction_success")
    df = features.coerce_window_types(w, ["sig_mean", "sig_std"], ["extraction_success", "within_record"], ["entity_id", "window_id"])
    return df.withColumns({c: F.round(c, 6) for c in ("sig_mean", "sig_std")})


@query(
    "event_type_labels",
    f"WITH {t.SUBJECTS_SQL} SELECT coalesce(CASE cause_raw WHEN '0' THEN 'NO_SCD_RECORDED' WHEN '1' THEN 'NON_CARDIAC_DEATH' WHEN '3' THEN 'SCD' END, 'UNKNOWN') AS event_type, count(*) AS n FROM subjects GROUP BY 1",
)
def _(spark, sf):
    kind = F.coalesce(P.decode(F.col("cause_raw"), EVENT_TYPES), F.lit("UNKNOWN"))
    return t.subjects(spark, sf).groupBy(kind.alias("event_type")).agg(F.count("*").alias("n"))
