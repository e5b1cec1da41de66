"""Partial state as a DataFrame: export, merge, finalise.

One row a group: key columns, count, and for measure i the columns m{i}_sum,
m{i}_min, m{i}_max, m{i}_nan, m{i}_pinf (numeric columns) and m{i}_hll, m{i}_kll
(when asked for). States merge in any order; averages are only formed at the end.
Sums of integers are decimals, so that they meet the overflow rule only at the end, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.errors import SchemaError
from tallyframe.functions import exact, sketches
from tallyframe.model import AggSpec, ColumnType, InputSchema
from tallyframe.operators.aggregate import check_columns, key_order, keyed
from tallyframe.sources.text_scan import _exact_name


def _wants(spec: AggSpec, i: int, kind: str) -> bool:
    return any(f.kind == kind for f in spec.measures[i].funcs)


def partial_state(df: DataFrame, spec: AggSpec, schema: InputSchema) -> DataFrame:
    """Mergeable state of df, unordered."""
    spec.validate(schema)
    check_columns(df, spec, schema)
    at, out = schema.index(), [F.count(F.lit(1)).alias("count")]
    for i, m in enumerate(spec.measures):
        v, kind = F.col(_exact_name(m.column)), schema.columns[at[m.column]].type
        is_float = kind is ColumnType.FLOAT64
        if kind.numeric:
            sums = F.sum(v) if is_float else F.sum(v.cast("decimal(20,0)")).cast("decimal(38,0)")
            out += [sums.alias(f"m{i}_sum"), F.min(v).alias(f"m{i}_min"), F.max(v).alias(f"m{i}_max")]
            out += [F.bool_or(F.isnan(v) if is_float else F.lit(False)).alias(f"m{i}_nan"), F.bool_or(v == exact.INF if is_float else F.lit(False)).alias(f"m{i}_pinf")]
        if _wants(spec, i, "distinct"):
            out.append(sketches.distinct_sketch(v, is_float).alias(f"m{i}_hll"))
        if _wants(spec, i, "percentile"):
            out.append(sketches.percentile_sketch(v, is_float).alias(f"m{i}_kll"))
    keys, _ = keyed(df, spec, schema)
    state = df.groupBy(*keys).agg(*out)
    return state if keys else state.filter("count > 0")


def merge_states(states: list[DataFrame], spec: AggSpec, schema: InputSchema) -> DataFrame:
    """One state from several of the same spec; frames that do not fit are refused before anything is merged."""
    spec.validate(schema)
    if not states:
        raise SchemaError("no states to merge")
    first = [(f.name, f.dataType) for f in states[0].schema]
    for s in states[1:]:
        if [(f.name, f.dataType) for f in s.schema] != first:
            raise SchemaError("states differ in shape")
    names = [n for n, _ in first]
    for i, m in enumerate(spec.measures):
        need = [f"m{i}_{p}" for p in ("sum", "min", "max", "nan", "pinf")] if schema.columns[schema.index()[m.column]].type.numeric else []
        need += [f"m{i}_hll"] * _wants(spec, i, "distinct") + [f"m{i}_kll"] * _wants(spec, i, "percentile")
        if not set(need) <= set(names):
            raise SchemaError(f"state of measure {i} lacks {sorted(set(need) - set(names))}")
    how = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "nan": F.bool_or, "pinf": F.bool_or, "hll": F.hll_union_agg, "kll": F.kll_merge_agg_double}
    keys = [n for n in names if n[0] in "kz" and n[1:].isdigit()]
    merged = reduce(DataFrame.unionByName, states).groupBy(*keys).agg(*(how[n.rpartition("_")[2]](n).alias(n) for n in names if n not in keys))
    return merged if keys else merged.filter("count > 0")


def finalize(state: DataFrame, spec: AggSpec, schema: InputSchema, overflow: str = "error") -> DataFrame:
    """The result rows of a state, sorted by key. overflow: see functions.exact.total."""
    spec.validate(schema)
    at, out = schema.index(), []
    for i, f, name in spec.outputs():
        is_float = schema.columns[at[spec.measures[i].column]].type is ColumnType.FLOAT64
        part = lambda p, i=i: F.col(f"m{i}_{p}")
        match f.kind:
            case "sum":
                c = part("sum") if is_float else exact.fold64(part("sum")) if overflow == "wrap" else part("sum").cast("bigint")
            case "avg":
                c = part("sum").cast("double") / F.col("count")
            case "min":
                c = exact.least_of(part("min"), part("nan")) if is_float else part("min")
            case "max":
                c = exact.greatest_of(part("max"), part("nan"), part("pinf")) if is_float else part("max")
            case "distinct":
                c = F.hll_sketch_estimate(part("hll"))
            case _:
                c = sketches.percentile_of_sketch(part("kll"), f.quantile)
        out.append(c.alias(name))
    _, back = keyed(state, spec, schema)
    result = state.select(*back, "count", *out)
    return result.orderBy(*key_order(spec, schema)) if spec.group_by else result
