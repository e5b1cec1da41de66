"""The group-by aggregate: keys, count, then measures, sorted by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.errors import SchemaError
from tallyframe.functions import exact, sketches
from tallyframe.model import AggFunc, AggSpec, ColumnType, InputSchema
from tallyframe.sources.text_scan import _exact_name


def measure(v: Column, f: AggFunc, is_float: bool, overflow: str = "error", quantile: str = "exact") -> Column:
    match f.kind:
        case "sum":
            return exact.total(v, is_float, overflow)
        case "min":
            return exact.minimum(v, is_float)
        case "max":
            return exact.maximum(v, is_float)
        case "avg":
            return exact.average(v, is_float)
        case "distinct":
            return sketches.distinct(v, is_float)
        case _:
            return sketches.percentile(v, f.quantile, is_float, quantile)


def keyed(df: DataFrame, spec: AggSpec, schema: InputSchema) -> tuple[list[Column], list[Column]]:
    """Grouping columns, and the columns that restore each key afterwards.

    Spark groups the two zeros together, so a float key is grouped with a flag that tells them apart.
    """
    at, keys, back = schema.index(), [], []
    for i, name in enumerate(spec.group_by):
        c = F.col(_exact_name(name))
        keys.append(c.alias(f"k{i}"))
        if schema.columns[at[name]].type is ColumnType.FLOAT64:
            keys.append((c.cast("string") == "-0.0").alias(f"z{i}"))
            back.append(F.when(F.col(f"z{i}"), F.lit(-0.0)).otherwise(F.col(f"k{i}")).alias(name))
        else:
            back.append(F.col(f"k{i}").alias(name))
    return keys, back


def key_order(spec: AggSpec, schema: InputSchema) -> list[Column]:
    """Ascending by key tuple; NaN first."""
    at, out = schema.index(), []
    for name in spec.group_by:
        c = F.col(_exact_name(name))
        if schema.columns[at[name]].type is ColumnType.FLOAT64:
            out.append(F.isnan(c).desc())
        out.append(c.asc())
    return out


def aggregate(df: DataFrame, spec: AggSpec, schema: InputSchema, overflow: str = "error", quantile: str = "exact", sort: bool = True) -> DataFrame:
    """Run spec over df. Keyless specs give one row, or none when df has no rows."""
    spec.validate(schema)
    check_columns(df, spec, schema)
    at = schema.index()
    keys, back = keyed(df, spec, schema)
    outputs = [(f"m{n}", name, measure(F.col(_exact_name(c := spec.measures[i].column)), f, schema.columns[at[c]].type is ColumnType.FLOAT64, overflow, quantile)) for n, (i, f, name) in enumerate(spec.outputs())]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(c.alias(a) for a, _, c in outputs))
    if not keys:
        grouped = grouped.filter("n > 0")
    out = grouped.select(*back, F.col("n").alias("count"), *(F.col(a).alias(name) for a, name, _ in outputs))
    return out.orderBy(*key_order(spec, schema)) if sort and spec.group_by else out


def check_columns(df: DataFrame, spec: AggSpec, schema: InputSchema) -> None:
    """The frame must carry each column the spec names, in the schema's type."""
    at, types = schema.index(), {f.name: f.dataType for f in df.schema}
    for name in [*spec.group_by, *(m.column for m in spec.measures)]:
        want = schema.columns[at[name]].type.spark
        if types.get(name) != want:
            raise SchemaError(f"column {name!r}: the frame has {types.get(name)}, the schema {want}")
