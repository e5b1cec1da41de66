"""Approximate distinct counts and percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gives 2^14 registers.
RELATIVE_SD = 0.0087
QUANTILE_MODES = ("exact", "approx", "hazen")


def _bits(v: Column, is_float: bool) -> Column:
    """Zeros of either sign count as two values, NaN as one."""
    return v.cast("string") if is_float else v


def distinct(v: Column, is_float: bool) -> Column:
    return F.approx_count_distinct(_bits(v, is_float), RELATIVE_SD)


def distinct_sketch(v: Column, is_float: bool) -> Column:
    return F.hll_sketch_agg(_bits(v, is_float), F.lit(14))


def _numbers(v: Column, is_float: bool) -> Column:
    v = v.cast("double")
    return F.when(~F.isnan(v), v) if is_float else v


def percentile(v: Column, q: float, is_float: bool, mode: str = "exact") -> Column:
    """q in (0, 100); NaN is skipped and a group without numbers gives NaN.

    exact: linear interpolation between order statistics, one map of values a group.
    approx: an element within 1/10000 of the rank, memory bound for any group.
    hazen: order statistics at (i - 1/2) / n, for parity on small groups.
    """
    x = _numbers(v, is_float)
    if mode == "approx":
        out = F.percentile_approx(x, q / 100, 10_000)
    elif mode == "hazen":
        xs = F.sort_array(F.collect_list(x))
        n = F.size(xs)
        at = F.greatest(F.lit(0.0), F.least(n - F.lit(1.0), n * F.lit(q / 100) - 0.5))
        low = F.floor(at).cast("int")
        a, b = F.get(xs, low), F.coalesce(F.get(xs, low + 1), F.get(xs, low))
        out = F.when(n > 0, a + (b - a) * (at - low))
    else:
        out = F.percentile(x, F.lit(q / 100))
    return F.coalesce(out, F.lit(float("nan")))


def percentile_sketch(v: Column, is_float: bool) -> Column:
    return F.kll_sketch_agg_double(_numbers(v, is_float))


def percentile_of_sketch(sketch: Column, q: float) -> Column:
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(q / 100))).otherwise(F.lit(float("nan")))
