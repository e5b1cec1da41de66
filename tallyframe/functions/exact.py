"""Exact aggregates whose edge rules differ from Spark's own: NaN, infinities, integer sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def is_nan(v: Column, is_float: bool) -> Column:
    return F.isnan(v) if is_float else F.lit(False)


def total(v: Column, is_float: bool, overflow: str = "error") -> Column:
    """Native-type sum. overflow="wrap" folds an integer sum into 64 bits; otherwise Spark's ANSI mode raises."""
    if is_float or overflow == "error":
        return F.sum(v)
    wide = F.sum(v.cast("decimal(20,0)"))
    return fold64(wide)


def fold64(wide: Column) -> Column:
    modulus, half = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")
    rest = F.pmod(wide.cast("decimal(38,0)") + half, modulus)
    return (rest - half).cast("bigint")


def least_of(low: Column, any_nan: Column) -> Column:
    """Minimum under NaN propagation: minus infinity wins, then NaN, then the plain minimum."""
    return F.when(low == -INF, F.lit(-INF)).when(any_nan, F.lit(NAN)).otherwise(low)


def greatest_of(high: Column, any_nan: Column, any_inf: Column) -> Column:
    return F.when(any_inf, F.lit(INF)).when(any_nan, F.lit(NAN)).otherwise(high)


def minimum(v: Column, is_float: bool) -> Column:
    return least_of(F.min(v), F.bool_or(F.isnan(v))) if is_float else F.min(v)


def maximum(v: Column, is_float: bool) -> Column:
    return greatest_of(F.max(v), F.bool_or(F.isnan(v)), F.bool_or(v == INF)) if is_float else F.max(v)


def average(v: Column, is_float: bool) -> Column:
    """Exact integer sums before one division; avg(bigint) would add in double."""
    if is_float:
        return F.sum(v) / F.count(F.lit(1))
    return F.sum(v.cast("decimal(20,0)")).cast("double") / F.count(F.lit(1))
