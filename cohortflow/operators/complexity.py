"""Entropies and fluctuation scaling of a series per window (`entity_id, window_id, pos, value`)."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["entity_id", "window_id"]

# Executors receive the small helpers of this module by value and need not install the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Cells of one block of candidates: pairs that are compared together.
BLOCK_CELLS = 1_000_000
#: Templates up to which all pairs are compared at once, without strips.
FEW_TEMPLATES = 256


def _template_neighbours(x: np.ndarray, radius: float, size: int) -> np.ndarray:
    """For each template of the given size, how many templates (itself included) lie within the radius.

    The last possible start is left out.  A few templates are compared all with all.  More are sorted into strips of the
    radius by their first value and inside a strip by their second; a template meets the part of three strips that its radius reaches, not the whole series.
    Candidates are compared value by value in blocks, so memory stays bounded.
    """
    count = len(x) - size
    out = np.zeros(max(count, 0))
    if count <= 0 or np.isnan(radius):
        return out
    if count <= FEW_TEMPLATES:
        close = np.ones((count, count), bool)
        for k in range(size):
            part = x[k:k + count]
            with np.errstate(invalid="ignore"):  # infinite values are near to nothing
                close &= np.abs(part[:, None] - part) <= radius
        return close.sum(axis=1).astype(float)
    second = x[1:count + 1] if size > 1 else np.zeros(count)
    usable = np.flatnonzero(np.isfinite(x[:count]) & np.isfinite(second))  # others are near to nothing
    if not len(usable):
        return out
    lead = x[usable]
    reach = radius + 8 * np.spacing(max(np.abs(lead).max(), np.abs(second[usable]).max()) + radius)  # a little more, so that rounding loses no candidate
    strip = np.floor((lead - lead.min()) / reach).astype(np.int64)
    by_cell = np.lexsort((second[usable], strip))
    order = usable[by_cell]
    known, first = np.unique(strip[by_cell], return_index=True)
    ends = np.append(first[1:], len(order))
    for own, start, stop in zip(known, first, ends, strict=True):
        at = np.searchsorted(known, [own - 1, own + 2])
        for lo, hi in zip(first[at[0]:at[1]], ends[at[0]:at[1]], strict=True):
            values = second[order[lo:hi]]
            mine = order[start:stop]
            left = lo + np.searchsorted(values, second[mine] - reach, "left")
            width = lo + np.searchsorted(values, second[mine] + reach, "right") - left
            done = np.cumsum(width)
            i = 0
            while i < len(mine):
                j = max(i + 1, int(np.searchsorted(done, done[i] - width[i] + BLOCK_CELLS, "right")))
                w = width[i:j]
                a = np.repeat(mine[i:j], w)
                b = order[np.arange(w.sum()) + np.repeat(left[i:j] - (np.cumsum(w) - w), w)]
                for k in range(size):
                    close = np.abs(x[a + k] - x[b + k]) <= radius
                    a, b = a[close], b[close]
                out += np.bincount(a, minlength=count)
                i = j
    return out


def _entropy_pair(x: np.ndarray, m: int, ratio: float) -> tuple[float | None, float | None]:
    """Sample and approximate entropy of one series."""
    sd = x.std() if len(x) else 0.0
    if len(x) < 10 or sd < 1e-12:
        return None, None
    near = [_template_neighbours(x, ratio * sd, size) for size in (m, m + 1)]
    pairs = [(c.sum() - len(c)) / 2 for c in near]
    phi = [np.log(c / len(c) + 1e-8).mean() if len(c) > 1 else 0.0 for c in near]
    return -np.log(pairs[1] / pairs[0]) if min(pairs) > 0 else None, phi[0] - phi[1]


def entropies_of(windows: DataFrame, values: Column, *, m: int = 2, ratio: float = 0.2) -> DataFrame:
    """Sample and approximate entropy of an array column per row, radius `ratio` population sds.

    The series of a window travels as one array; no pair of samples becomes a row.
    """

    @F.pandas_udf("rr_sampen double, rr_apen double")
    def both(arrays: pd.Series) -> pd.DataFrame:
        pairs = [_entropy_pair(np.asarray(v, dtype=float), m, ratio) for v in arrays]
        return pd.DataFrame(pairs, columns=["rr_sampen", "rr_apen"], dtype=float)

    out = windows.select(*KEYS, both(values).alias("_e"))
    return out.select(
        *KEYS,
        *[F.when(~F.isnan(f"_e.{c}"), F.col(f"_e.{c}")).alias(c) for c in ("rr_sampen", "rr_apen")],
    )


def entropies(series: DataFrame, *, m: int = 2, ratio: float = 0.2) -> DataFrame:
    """Entropies of a long series; null below ten values."""
    arrays = series.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_s"))
    return entropies_of(arrays, F.col("_s.value"), m=m, ratio=ratio)


def scale_list(max_scale: int) -> list[int]:
    """Distinct whole log-spaced scales from 4 to `max_scale`, at most ten."""
    points = np.logspace(np.log10(4), np.log10(max_scale), num=10)
    return [int(v) for v in np.unique(np.floor(points))]


def scale_ladder(max_scale: Column) -> Column:
    """`scale_list` as an array column, one rule for all sizes; meant for one row per window.

    The last digit of a power decides some scales, so the list comes from the rule itself and not from another spelling of it.
    """

    @F.pandas_udf("array<bigint>")
    def ladders(sizes: pd.Series) -> pd.Series:
        lists = {k: scale_list(int(k)) for k in sizes.unique()}
        return sizes.map(lists)

    return ladders(max_scale)


def dfa_alpha(series: DataFrame) -> DataFrame:
    """Slope of log fluctuation over log scale after linear detrending; null below sixteen values."""
    order = Window.partitionBy(*KEYS).orderBy("pos")
    sizes = series.groupBy(*KEYS).agg(F.count("value").alias("_n"), F.avg("value").alias("_m")).filter("_n >= 16")
    sizes = sizes.withColumn("_scales", scale_ladder(F.floor(F.col("_n") / 4)))
    base = series.withColumn("_i", F.row_number().over(order) - 1).join(sizes, KEYS)
    profile = base.withColumn(
        "_y", F.sum(F.col("value") - F.col("_m")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    scaled = profile.withColumn("_s", F.explode("_scales"))
    whole_segments = F.floor(F.col("_n") / F.col("_s"))
    inside = scaled.withColumn("_g", F.floor(F.col("_i") / F.col("_s"))).filter(
        (F.col("_s") >= 4) & (whole_segments >= 2) & (F.col("_g") < whole_segments)
    ).withColumn("_t", (F.col("_i") - F.col("_g") * F.col("_s")).cast("double"))
    cov = F.covar_pop("_t", "_y")
    residual = F.greatest(F.var_pop("_y") - cov * cov / F.var_pop("_t"), F.lit(0.0))
    segments = inside.groupBy(*KEYS, "_s", "_g").agg(residual.alias("_r"))
    levels = segments.groupBy(*KEYS, "_s").agg(F.sqrt(F.avg("_r")).alias("_f")).filter("_f > 0")
    slope = F.regr_slope(F.log("_f"), F.log(F.col("_s").cast("double")))
    return levels.groupBy(*KEYS).agg(F.when(F.count("*") >= 2, slope).alias("rr_dfa_alpha"))
