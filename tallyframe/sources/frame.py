"""An existing DataFrame as input: widen numbers, check types, keep NULL out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.errors import SchemaError
from tallyframe.model import AggSpec, ColumnSpec, ColumnType, InputSchema
from tallyframe.sources.text_scan import _exact_name

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def column_type(kind: T.DataType) -> ColumnType | None:
    if isinstance(kind, T.StringType):
        return ColumnType.STRING
    if isinstance(kind, INTEGRAL):
        return ColumnType.INT64
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return ColumnType.FLOAT64
    return None


def schema_of(df: DataFrame) -> InputSchema:
    """The columns of df that have one of the three types; others are not visible to a query."""
    return InputSchema(tuple(ColumnSpec(f.name, column_type(f.dataType)) for f in df.schema if column_type(f.dataType) is not None))


def referenced(spec: AggSpec) -> list[str]:
    return list(dict.fromkeys([*spec.group_by, *(m.column for m in spec.measures)]))


def from_dataframe(df: DataFrame, spec: AggSpec, on_null: str = "skip") -> DataFrame:
    """The columns the spec refers to, widened to bigint and double. Rows with NULL in one of them are skipped or raise."""
    types = {f.name: f.dataType for f in df.schema}
    out = []
    for name in referenced(spec):
        kind = column_type(types[name]) if name in types else None
        if kind is None:
            raise SchemaError(f"column {name!r} is missing or of an unsupported type")
        out.append(F.col(_exact_name(name)).cast(kind.spark).alias(name))
    narrow = df.select(*out)
    if not out:
        return narrow
    whole = F.lit(True)
    for name in referenced(spec):
        whole = whole & F.col(_exact_name(name)).isNotNull()
    if on_null == "fail":
        whole = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("NULL in a column of the query")).cast("boolean"))
    return narrow.filter(whole)
