"""Grouped summaries over large tabular data, declared on Spark DataFrames."""

from tallyframe.errors import EngineError, SchemaError, SpecError
from tallyframe.model import AggFunc, AggSpec, ColumnKind, ColumnSpec, ColumnType, InputSchema, MeasureSpec
from tallyframe.plans.engine import Engine
from tallyframe.plans.grammar import parse

__all__ = [
    "AggFunc",
    "AggSpec",
    "ColumnKind",
    "ColumnSpec",
    "ColumnType",
    "Engine",
    "EngineError",
    "InputSchema",
    "MeasureSpec",
    "SchemaError",
    "SpecError",
    "parse",
]
