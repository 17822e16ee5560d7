"""Exact prefix sums, ranks and quantiles that never put one group into one task.

A group is cut into value buckets; each bucket is summed on its own, the small
table of bucket totals carries the offsets, and rows are ordered inside buckets.
Every large group has bucket bounds of its own, from a mergeable quantile sketch of
its values, so no bucket outgrows its share wherever the values of a group lie, and
equal values are summed before any ordering.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..session import cut_lineage

HOT_ROWS = 1_000_000
BUCKET_ROWS = 200_000
MAX_BUCKETS = 16_384


def bucket_count(rows: int) -> int:
    """Value buckets for so many rows: about `BUCKET_ROWS` rows each."""
    return max(2, min(MAX_BUCKETS, -(-rows // BUCKET_ROWS)))


def value_splits(df: DataFrame, cols: list[str], buckets: int) -> dict[str, list[float]]:
    """Bucket bounds per column, at most `buckets` of them, from one pass over the columns.

    Bounds are finite; infinite values fall into the outer buckets.
    """
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(*cols).approxQuantile(cols, probs, 1.0 / (4 * buckets))
    return {c: [float("-inf"), *sorted({v for v in q if math.isfinite(v)}), float("inf")] for c, q in zip(cols, found)}


def join_by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet null keys, as they do in a grouping; the keys of the left side stay."""
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, how=how)
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), reduce(and_, same), how).drop(*names.values())


# Bounds of a single bucket, for groups known to be small.
ONE_BUCKET = [float("-inf"), float("inf")]


def choose_splits(df: DataFrame, col: str, *, hot_rows: int = HOT_ROWS, buckets: int | None = None) -> list[float]:
    """One bucket for a table of at most `hot_rows` rows, else bounds from its quantiles; buckets follow the row count."""
    rows = df.count()
    return ONE_BUCKET if rows <= hot_rows else value_splits(df, [col], buckets or bucket_count(rows))[col]


def add_bucket(df: DataFrame, col: str, splits: list[float], out: str = "_bucket") -> DataFrame:
    """Bucket number of a double column; rows keep their order across buckets."""
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def offsets_by_bucket(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: list[str]) -> DataFrame:
    """Add `<s>_before` (sum over earlier rows of the group) and `<s>_total` for every summed column.

    `bucket` must sort as `order` does, and `order` must be unique inside a bucket.
    """
    totals = rows.groupBy(*keys, bucket).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    across = Window.partitionBy(*keys)
    earlier = across.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(across).alias(f"{s}_total") for s in sums],
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_by_keys(rows, base, [*keys, bucket])
    before = {f"{s}_before": F.col(f"_b_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}
    return joined.withColumns(before).drop(*[f"_b_{s}" for s in sums])


def running_offsets(rows: DataFrame, keys: list[str], order: str, sums: list[str], splits: list[float]) -> DataFrame:
    """`offsets_by_bucket` over value buckets; with a single bucket a plain window per group."""
    if len(splits) >= 3:
        return offsets_by_bucket(add_bucket(rows, order, splits), keys, "_bucket", [F.col(order)], sums).drop("_bucket")
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns(
        {
            **{f"{s}_total": F.sum(s).over(whole) for s in sums},
            **{f"{s}_before": F.coalesce(F.sum(s).over(earlier), F.lit(0)) for s in sums},
        }
    )


#: Size of the quantile sketches: rank errors of about 2 / SKETCH, well below the share of a bucket up to some hundred buckets.
SKETCH = 4096
#: Groups with bounds up to which the table of bounds is broadcast.
BOUNDED_GROUPS = 20_000


def group_bounds(df: DataFrame, keys: list[str], cols: list[str], *, rows: int = BUCKET_ROWS, buckets: int | None = None) -> DataFrame:
    """Bucket bounds of every group of more than `rows` rows: the keys and per column an array `_bounds_<col>` of finite, distinct, rising values.

    A group gets as many buckets as its rows ask for, or `buckets`. Sketches are merged across tasks and asked for the ranks
    of the largest group, of which smaller ones take every so-manieth; the table is written once, so that all uses see the
    same bounds.
    """
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    sketches = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.kll_sketch_agg_double(finite(c), F.lit(SKETCH)).alias(f"_s_{c}") for c in cols], *[F.count(finite(c)).alias(f"_n_{c}") for c in cols])
    sketches = cut_lineage(sketches if buckets else sketches.filter(F.col("_rows") > rows))
    most = buckets or max(2, min(MAX_BUCKETS, -(-(sketches.agg(F.max("_rows")).first()[0] or 0) // rows)))
    ranks = F.array(*[F.lit(i / most) for i in range(1, most)])
    own = F.lit(most) if buckets else F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(F.col("_rows") / rows)))
    none = F.array().cast("array<double>")

    def bounds(c: str) -> tuple[Column, Column]:
        found = F.kll_sketch_get_quantile_double(f"_s_{c}", ranks)
        taken = F.transform(F.sequence(F.lit(1), own.cast("int") - 1), lambda i: F.get(F.col(f"_q_{c}"), (F.round(i * most / own) - 1).cast("int")))
        return F.when(F.col(f"_n_{c}") > 0, found), F.when(F.col(f"_n_{c}") > 0, F.array_sort(F.array_distinct(taken))).otherwise(none)

    asked = sketches.withColumns({f"_q_{c}": bounds(c)[0] for c in cols})
    return cut_lineage(asked.select(*keys, *[bounds(c)[1].alias(f"_bounds_{c}") for c in cols]))


def bucket_within(bounds: Column, value: Column) -> Column:
    """How many of the rising bounds lie at or below a value, by halving; 0 without bounds."""
    start = F.struct(F.lit(0).alias("low"), F.coalesce(F.size(bounds), F.lit(0)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        up = F.get(bounds, mid) <= value
        return F.when(s["low"] >= s["high"], s).when(up, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(bounds) + 1.0)).cast("int") + 1)
    return F.when(F.coalesce(F.size(bounds), F.lit(0)) == 0, 0).otherwise(F.aggregate(steps, start, halve, lambda s: s["low"]))


def with_bounds(df: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the bounds of their group, null where it has none."""
    if bounds.count() <= BOUNDED_GROUPS:
        bounds = F.broadcast(bounds)
    return join_by_keys(df, bounds, keys, "left")


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    value: str,
    sums: dict[str, Column],
    *,
    splits: list[float] | None = None,
    hot_rows: int = HOT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per group and distinct value with its sums, the sums before it and the group totals.

    Without given `splits` a table of at most `hot_rows` rows is summed by plain windows; in a larger one every group is cut
    into buckets by its own bounds, about `bucket_rows` distinct values each.
    """
    present = df.filter(F.col(value).isNotNull())
    grouped = present.groupBy(*keys, value).agg(*[e.alias(n) for n, e in sums.items()])
    if splits or present.count() <= hot_rows:
        return running_offsets(grouped, keys, value, list(sums), splits or ONE_BUCKET)
    grouped = cut_lineage(grouped)
    bounds = group_bounds(grouped.select(*keys, F.col(value).cast("double").alias("_v")), keys, ["_v"], rows=bucket_rows)
    placed = with_bounds(grouped, bounds, keys).withColumn("_bucket", bucket_within(F.col("_bounds__v"), F.col(value).cast("double"))).drop("_bounds__v")
    return offsets_by_bucket(placed, keys, "_bucket", [F.col(value)], list(sums)).drop("_bucket")


def rows_allowed(hot_rows: int, cols: list[str]) -> int:
    """Rows per group that keep the values of all columns within the limit."""
    return hot_rows // max(1, len(cols))


def hot_groups(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Groups above the limit with their rows `_rows`."""
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limit)


def _native_quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float]) -> DataFrame:
    ps = F.array(*[F.lit(float(p)) for p in probs.values()])
    grouped = df.groupBy(*keys).agg(*[F.percentile(F.col(c), ps).alias(f"_q_{c}") for c in cols])
    return grouped.select(
        *keys, *[F.col(f"_q_{c}")[i].alias(f"{c}_{name}") for c in cols for i, name in enumerate(probs)]
    )


def _bucketed_quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float], buckets: int | None) -> DataFrame:
    bounded = with_bounds(df.select(*keys, *cols), group_bounds(df, keys, cols, buckets=buckets), keys)
    entries = [F.struct(F.lit(c).alias("f"), F.col(c).alias("v"), bucket_within(F.col(f"_bounds_{c}"), F.col(c)).alias("b")) for c in cols]
    long = bounded.select(*keys, F.explode(F.array(*entries)).alias("e")).select(
        *keys, F.col("e.f").alias("_f"), F.col("e.v").alias("_v"), F.col("e.b").alias("_bucket")
    ).filter(F.col("_v").isNotNull())
    counted = long.groupBy(*keys, "_f", "_bucket", "_v").agg(F.count("*").alias("n"))
    placed = offsets_by_bucket(counted, [*keys, "_f"], "_bucket", [F.col("_v")], ["n"])
    picked = []
    for name, p in probs.items():
        position = (F.col("n_total") - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
            picked.append(F.max(F.when(here, F.col("_v"))).alias(f"_{tag}_{name}"))
    ends = placed.groupBy(*keys, "_f").agg(F.max("n_total").alias("_n"), *picked)
    values = []
    for name, p in probs.items():
        position = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        between = (F.ceil(position) - position) * low + (position - F.floor(position)) * high
        values.append(F.when(low == high, low).otherwise(between).alias(name))
    flat = ends.select(*keys, "_f", *values)
    back = flat.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_f") == c, F.col(name))).alias(f"{c}_{name}") for c in cols for name in probs]
    )
    # a group without any value keeps its row, as in the plain aggregate
    return join_by_keys(df.select(*keys).distinct(), back, keys, "left") if keys else back


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    cols: list[str],
    probs: dict[str, float],
    *,
    hot_rows: int | None = HOT_ROWS,
    buckets: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of double columns per group, named `<col>_<prob name>`.

    Groups that hold at most `hot_rows` values over all columns use the built-in aggregate,
    which keeps one group in memory.  Larger groups are split into value buckets by bounds of their
    own, as many as their rows ask for; both ways give the same values, null keys and infinities included.
    `hot_rows=None` states that the caller has checked the sizes.
    """
    narrow = df.select(*keys, *cols)
    if hot_rows is None:
        return _native_quantiles(narrow, keys, cols, probs)
    limit = rows_allowed(hot_rows, cols)
    if not keys:
        rows = narrow.count()
        if rows > limit:
            return _bucketed_quantiles(narrow, keys, cols, probs, buckets)
        return _native_quantiles(narrow, keys, cols, probs)
    hot = hot_groups(narrow, keys, limit)
    most = hot.agg(F.max("_rows")).first()[0]
    if most is None:
        return _native_quantiles(narrow, keys, cols, probs)
    names = hot.select(*keys)
    usual = _native_quantiles(join_by_keys(narrow, names, keys, "left_anti"), keys, cols, probs)
    large = _bucketed_quantiles(join_by_keys(narrow, names, keys, "left_semi"), keys, cols, probs, buckets)
    return usual.unionByName(large)


#: Leading hash digits that name a bucket: 65 536 parts, a bounded table of totals, millions of rows each at 1e12 rows.
HASH_DIGITS = 4


def hash_rank(df: DataFrame, keys: list[str], id_col: str, seed: int | Column, *, digits: int = HASH_DIGITS, out: str = "rank") -> DataFrame:
    """0-based rank of each id inside its group, ordered by the seeded hash and then the id.

    The leading hash digits are the buckets, so even a group that holds all rows is
    spread over 16**digits parts of equal size.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, F.col(id_col)))
    rows = hashed.withColumns({"_bucket": F.substring("_h", 1, digits), "_one": F.lit(1).cast("long")})
    placed = offsets_by_bucket(rows, keys, "_bucket", [F.col("_h"), F.col(id_col)], ["_one"])
    return placed.withColumn(out, F.col("_one_before")).withColumn(f"{out}_n", F.col("_one_total")).drop(
        "_h", "_bucket", "_one", "_one_before", "_one_total"
    )


def dense_index(df: DataFrame, id_col: str, *, seed: int = 0, digits: int = HASH_DIGITS, out: str = "row_index") -> DataFrame:
    """Gap-free 0-based index over all rows and the row count, in seeded hash order."""
    return hash_rank(df, [], id_col, seed, digits=digits, out=out)
