"""Stand-in tables: the study roles built from the generic test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 25
VECTOR = 64
RATE = 16.0
FEATURES = ["sig_mean", "sig_std", "sig_p2p", "beats", "mean_rr"]

# Schedule of the dense stand-in records, in seconds.
SHORT_SCHEDULE = {"first": 4, "stride": 20, "length": 20}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Entity = customer; follow-up from the first to the second order; cause from the second order.

    First and second order come from combining minima, so a customer with very many orders is no hot group.
    """
    o = read(spark, sf, "orders").select(
        "o_custkey", F.struct("o_orderdate", "o_orderkey", "o_orderstatus").alias("o")
    )
    first = o.groupBy("o_custkey").agg(F.min("o").alias("a"))
    second = o.join(first, "o_custkey").filter(F.col("o") > F.col("a")).groupBy("o_custkey").agg(F.min("o").alias("b"))
    pairs = first.join(second, "o_custkey", "left")
    code = F.when(F.col("b.o_orderstatus") == "F", "3").when(F.col("b.o_orderstatus") == "P", "1").when(F.col("b.o_orderstatus") == "O", "0")
    c = read(spark, sf, "customer")
    return c.join(pairs, c.c_custkey == pairs.o_custkey, "left").select(
        F.col("c_custkey").alias("entity_id"), "c_nationkey", "c_mktsegment", "c_acctbal",
        F.datediff(F.col("b.o_orderdate"), F.col("a.o_orderdate")).cast("double").alias("followup_days"),
        code.alias("cause_raw"), (F.col("c_acctbal") >= 0).alias("source_valid"),
        (F.col("c_mktsegment") != "MACHINERY").alias("has_record"),
        (F.col("c_mktsegment") == "BUILDING").alias("af_flag"),
        F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 100)).cast("double").alias("pvc_count_24h"),
    )


SUBJECTS_SQL = """
numbered AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
subjects AS (SELECT c.c_custkey AS entity_id, c_nationkey, c_mktsegment, c_acctbal,
    CAST(date_diff('day', a.o_orderdate, b.o_orderdate) AS DOUBLE) AS followup_days,
    CASE b.o_orderstatus WHEN 'F' THEN '3' WHEN 'P' THEN '1' WHEN 'O' THEN '0' END AS cause_raw,
    c_acctbal >= 0 AS source_valid, c_mktsegment <> 'MACHINERY' AS has_record, c_mktsegment = 'BUILDING' AS af_flag,
    CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal / 100) AS DOUBLE) END AS pvc_count_24h
  FROM customer c LEFT JOIN numbered a ON a.o_custkey = c.c_custkey AND a.rn = 1
  LEFT JOIN numbered b ON b.o_custkey = c.c_custkey AND b.rn = 2)"""

STATE_SQL = """CASE WHEN NOT coalesce(source_valid AND followup_days >= 0 AND cause_raw IN ('0','1','3','6','7'), FALSE) THEN 'UNKNOWN'
    WHEN cause_raw = '3' THEN CASE WHEN followup_days <= h THEN 'POSITIVE' ELSE 'NEGATIVE' END
    WHEN cause_raw <> '0' THEN CASE WHEN followup_days <= h THEN 'COMPETING_EVENT' ELSE 'NEGATIVE' END
    WHEN followup_days >= h THEN 'NEGATIVE' ELSE 'CENSORED' END"""

ENDPOINTS_SQL = SUBJECTS_SQL + f""",
endpoints AS (SELECT entity_id, CAST(h AS INTEGER) AS horizon_days, followup_days AS time_to_event, cause_raw, source_valid, {STATE_SQL} AS state
  FROM subjects, (VALUES (90), (180), (365), (730)) t(h)),
labelled AS (SELECT *, CASE state WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN 0 END AS label FROM endpoints)"""


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Window = order of a customer; its features come from the order's line items."""
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        (F.avg(price) / 997.0).alias("sig_mean"), F.stddev_pop(q).alias("sig_std"), (F.max(q) - F.min(q)).alias("sig_p2p"),
        F.count("*").cast("double").alias("beats"), F.avg(q).alias("mean_rr"), F.sum(q).cast("long").alias("raw_rpeak_count"),
        F.count("*").alias("raw_rr_count"), F.count_if(F.col("l_returnflag") != "R").alias("valid_rr_count"),
    )
    o = read(spark, sf, "orders")
    some = F.col("raw_rr_count").isNotNull()
    status = F.when(~some, "EMPTY_SIGNAL").when(F.col("o_orderstatus") == "P", "SHORT_READ").otherwise("SUCCESS")
    ok = status == "SUCCESS"
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("window_id"), status.alias("window_status"),
        ok.alias("extraction_success"), ok.alias("read_success"), (ok & (F.col("o_orderpriority") != "5-LOW")).alias("qc_valid"),
        *FEATURES, (F.col("raw_rr_count") > 1).alias("sig_std_valid"), (F.col("raw_rr_count") > 2).alias("mean_rr_valid"),
        F.coalesce("raw_rpeak_count", F.lit(0)).alias("raw_rpeak_count"), F.coalesce("raw_rr_count", F.lit(0)).alias("raw_rr_count"),
        F.coalesce("valid_rr_count", F.lit(0)).alias("valid_rr_count"),
        (F.coalesce("raw_rr_count", F.lit(0)) - F.coalesce("valid_rr_count", F.lit(0))).alias("removed_rr_count"),
    )


WINDOWS_SQL = """
linesum AS (SELECT l_orderkey, avg(l_extendedprice) / 997.0::DOUBLE AS sig_mean, stddev_pop(l_quantity) AS sig_std, max(l_quantity) - min(l_quantity) AS sig_p2p,
    CAST(count(*) AS DOUBLE) AS beats, avg(l_quantity) AS mean_rr, CAST(sum(l_quantity) AS BIGINT) AS peaks, count(*) AS raw,
    count(*) FILTER (l_returnflag <> 'R') AS good FROM lineitem GROUP BY l_orderkey),
win0 AS (SELECT o_custkey AS entity_id, o_orderkey AS window_id,
    CASE WHEN raw IS NULL THEN 'EMPTY_SIGNAL' WHEN o_orderstatus = 'P' THEN 'SHORT_READ' ELSE 'SUCCESS' END AS window_status,
    sig_mean, sig_std, sig_p2p, beats, mean_rr, raw > 1 AS sig_std_valid, raw > 2 AS mean_rr_valid, o_orderpriority,
    coalesce(peaks, 0) AS raw_rpeak_count, coalesce(raw, 0) AS raw_rr_count, coalesce(good, 0) AS valid_rr_count,
    coalesce(raw, 0) - coalesce(good, 0) AS removed_rr_count FROM orders LEFT JOIN linesum ON o_orderkey = l_orderkey),
windows AS (SELECT *, window_status = 'SUCCESS' AS extraction_success, window_status = 'SUCCESS' AND o_orderpriority <> '5-LOW' AS qc_valid FROM win0),
usable AS (SELECT entity_id, window_id, CASE WHEN extraction_success THEN sig_mean END AS sig_mean,
    CASE WHEN extraction_success AND sig_std_valid THEN sig_std END AS sig_std, CASE WHEN extraction_success THEN sig_p2p END AS sig_p2p,
    CASE WHEN extraction_success THEN beats END AS beats, CASE WHEN extraction_success AND mean_rr_valid THEN mean_rr END AS mean_rr FROM windows)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two models over all orders: a price score and the same score cut to two digits, which brings ties."""
    label = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    score = F.least(F.col("o_totalprice") / 500000.0, F.lit(1.0))
    pair = F.array(
        F.struct(F.lit("price").alias("model"), score.alias("score")), F.struct(F.lit("rounded").alias("model"), (F.floor(score * 100) / 100.0).alias("score"))
    )
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entity_id"), label.alias("label"), F.explode(pair).alias("e")
    ).select("entity_id", "label", "e.model", "e.score")


PREDICTIONS_SQL = """
base AS (SELECT o_orderkey AS entity_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label,
    least(o_totalprice / 500000.0::DOUBLE, 1.0::DOUBLE) AS s FROM orders),
preds AS (SELECT entity_id, label, 'price' AS model, CAST(s AS DOUBLE) AS score FROM base
  UNION ALL SELECT entity_id, label, 'rounded', CAST(floor(s * 100) / 100.0 AS DOUBLE) FROM base)"""


def seeded_predictions(spark: SparkSession, sf: str, seeds: int = 5) -> DataFrame:
    """Out-of-fold stand-in: for every seed two models, the label blurred by a seeded hash; folds from another hash."""
    from ..functions.hashing import hash_to_long, seeded_hash

    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("label"))
    rows = o.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in range(1, seeds + 1)])))
    noise = (hash_to_long(seeded_hash(F.col("seed"), F.col("entity_id")), 4) / 65536.0)
    fold = (hash_to_long(seeded_hash(F.col("seed") + 100, F.col("entity_id")), 4) % 5 + 1).cast("int")
    y = F.col("label")
    pair = F.array(
        F.struct(F.lit("weak").alias("model"), (noise * 0.9 + y * 0.1).alias("score")),
        F.struct(F.lit("strong").alias("model"), (noise * 0.7 + y * 0.3).alias("score")),
    )
    return rows.select("entity_id", "label", "seed", fold.alias("fold"), F.explode(pair).alias("e")).select(
        "entity_id", "label", "seed", "fold", "e.model", "e.score"
    )


SEEDED_SQL = """
noisy AS (SELECT o_orderkey AS entity_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label, CAST(seed AS INTEGER) AS seed,
    ('0x' || substr(md5(seed || '|' || o_orderkey), 1, 4))::BIGINT / 65536.0::DOUBLE AS z,
    CAST(('0x' || substr(md5((seed + 100) || '|' || o_orderkey), 1, 4))::BIGINT % 5 + 1 AS INTEGER) AS fold
  FROM orders, (SELECT unnest(range(1, 6)) AS seed)),
seeded AS (SELECT entity_id, label, seed, fold, 'weak' AS model, z * 0.9::DOUBLE + label * 0.1::DOUBLE AS score FROM noisy
  UNION ALL SELECT entity_id, label, seed, fold, 'strong', z * 0.7::DOUBLE + label * 0.3::DOUBLE FROM noisy)"""

CURVE_SQL = """
tied AS (SELECT {keys}, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM {source} GROUP BY {keys}, score),
curve AS (SELECT *, coalesce(sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_before,
    coalesce(sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before,
    sum(pos) OVER (PARTITION BY {keys}) AS pos_total, sum(neg) OVER (PARTITION BY {keys}) AS neg_total
  FROM tied WINDOW w AS (PARTITION BY {keys} ORDER BY score)),
ranked AS (SELECT {keys}, sum(pos * (neg_before + 0.5::DOUBLE * neg))::DOUBLE / (max(pos_total) * max(neg_total))::DOUBLE AS "AUC",
    sum(pos::DOUBLE * (pos_total - pos_before)::DOUBLE / (pos_total - pos_before + neg_total - neg_before)::DOUBLE) / max(pos_total)::DOUBLE AS "AP"
  FROM curve GROUP BY {keys})"""


def curve_sql(source: str, keys: str) -> str:
    return CURVE_SQL.format(source=source, keys=keys)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Record = block of consecutive vectors, their values joined into one regular series."""
    e = read(spark, sf, "embeddings").select((F.floor(F.col("vec_id") / BLOCK)).alias("entity_id"), F.size("embedding").alias("n"))
    return e.groupBy("entity_id").agg(F.sum("n").alias("sample_count")).withColumn("fs", F.lit(RATE))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return e.select(
        F.floor(F.col("vec_id") / BLOCK).alias("entity_id"),
        ((F.col("vec_id") % BLOCK) * VECTOR + F.col("pos")).alias("sample_idx"), F.col("value").cast("double").alias("value"),
    )


SAMPLES_SQL = f"""
flat AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings),
samples AS (SELECT vec_id // {BLOCK} AS entity_id, (vec_id % {BLOCK}) * {VECTOR} + pos AS sample_idx, v::DOUBLE AS value FROM flat),
records AS (SELECT vec_id // {BLOCK} AS entity_id, CAST(sum(len(embedding)) AS BIGINT) AS sample_count, {RATE}::DOUBLE AS fs FROM embeddings GROUP BY 1),
counted AS (SELECT *, CASE WHEN sample_count / fs + 1e-9 >= 24 THEN CAST(floor((sample_count / fs - 24) / 20.0 + 1e-9) + 1 AS BIGINT) ELSE 0 END AS n FROM records),
theory AS (SELECT entity_id, sample_count, fs, unnest(range(n)) AS window_id FROM counted),
placed AS (SELECT s.entity_id, CAST(floor((sample_idx / fs - 4) / 20.0) AS BIGINT) AS window_id, sample_idx, value, fs, n FROM samples s JOIN counted USING (entity_id)),
inwin AS (SELECT entity_id, window_id, sample_idx - (4 + window_id * 20) * {int(RATE)} AS pos, value, fs FROM placed WHERE window_id >= 0 AND window_id < n)"""


def vector_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as one window of 64 samples, its label the entity."""
    e = read(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("pos", "value"))
    return e.select(
        F.col("label").alias("entity_id"), F.col("vec_id").alias("window_id"), "pos", F.col("value").cast("double").alias("value"), F.lit(RATE).alias("fs")
    )


VECTORS_SQL = f"""
vec AS (SELECT label AS entity_id, vec_id AS window_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS value, {RATE}::DOUBLE AS fs FROM embeddings)"""

# Number text in the spellings that the readers must tell apart, built from a price.
PRICE_TEXT = "cast(cast(o_totalprice as decimal(12,2)) as string)"
NUMBER_TEXT = """CASE o_orderpriority WHEN '1-URGENT' THEN replace(p, '.', ',') WHEN '2-HIGH' THEN concat('''', p, '''')
  WHEN '3-MEDIUM' THEN concat(substr(p, 1, 2), ',', substr(p, 3)) WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'NA' WHEN 'O' THEN 'N/A' ELSE 'None' END
  ELSE CASE o_orderstatus WHEN 'F' THEN concat('  ', p, ' ') WHEN 'O' THEN '' ELSE concat(substr(p, 1, 3), ',', substr(p, 4, 2)) END END"""
NUMBER_SQL = f"""
texts AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, {NUMBER_TEXT} AS raw FROM (SELECT *, {PRICE_TEXT} AS p FROM orders)),
bare AS (SELECT *, trim(trim(trim(raw), ''''), '"') AS t FROM texts)"""


def number_texts(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumn("p", F.expr(PRICE_TEXT))
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.expr(NUMBER_TEXT).alias("raw"))
