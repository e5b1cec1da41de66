"""Logical model: column types, input schema and the aggregation spec."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import types as T

from tallyframe.errors import SchemaError, SpecError

FLOAT_TEXT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


class ColumnType(IntEnum):
    STRING = 0
    INT64 = 1
    FLOAT64 = 2

    @property
    def display(self) -> str:
        return self.name.lower()

    @property
    def spark(self) -> T.DataType:
        return {0: T.StringType(), 1: T.LongType(), 2: T.DoubleType()}[self.value]

    @property
    def numeric(self) -> bool:
        return self is not ColumnType.STRING


class ColumnKind(IntEnum):
    """Descriptive only: any column can be grouped or measured whatever its kind."""

    DIMENSION = 0
    MEASURE = 1
    IGNORE = 2

    @property
    def display(self) -> str:
        return self.name.lower()


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: ColumnType = ColumnType.STRING
    kind: ColumnKind = ColumnKind.DIMENSION


@dataclass(frozen=True)
class InputSchema:
    columns: tuple[ColumnSpec, ...] = ()
    delimiter: str = ","
    has_header: bool = False
    quote_aware: bool = False

    def __post_init__(self):
        if len(self.delimiter.encode()) != 1:
            raise SchemaError(f"delimiter must be one byte, got {self.delimiter!r}")

    def index(self) -> dict[str, int]:
        """Column positions by name; of columns with one name the last wins."""
        return {c.name: i for i, c in enumerate(self.columns)}

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark, False, {"kind": c.kind.display}) for c in self.columns])


@dataclass(frozen=True)
class AggFunc:
    """sum, min, max, avg, distinct, or percentile with 0 < quantile < 100."""

    kind: str
    quantile: float | None = None

    @classmethod
    def parse(cls, text: str) -> AggFunc:
        name = text.strip().lower()
        if name in ("sum", "min", "max", "avg", "distinct"):
            return cls(name)
        if name.startswith("p") and FLOAT_TEXT.fullmatch(name[1:]):
            return cls.percentile(float(name[1:]))
        raise SpecError(f"unknown aggregate function {text!r}")

    @classmethod
    def percentile(cls, q: float) -> AggFunc:
        if not math.isfinite(q) or not 0 < q < 100:
            raise SpecError(f"percentile must lie between 0 and 100, got {q}")
        return cls("percentile", float(q))

    @property
    def needs_number(self) -> bool:
        return self.kind != "distinct"

    def __str__(self) -> str:
        if self.kind != "percentile":
            return self.kind
        text = f"{self.quantile:.17f}" if "e" in repr(self.quantile) else repr(self.quantile)
        return "p" + (text.rstrip("0").rstrip(".") if "." in text else text)


@dataclass(frozen=True)
class MeasureSpec:
    column: str
    funcs: tuple[AggFunc, ...]

    @classmethod
    def parse(cls, text: str) -> MeasureSpec:
        """column:f1,f2 as the command line spells it."""
        column, colon, funcs = text.partition(":")
        if not colon or not column:
            raise SpecError(f"measure must be column:func[,func], got {text!r}")
        return cls(column, tuple(AggFunc.parse(f) for f in funcs.split(",")))


@dataclass(frozen=True)
class AggSpec:
    group_by: tuple[str, ...] = ()
    measures: tuple[MeasureSpec, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, group_by=(), **measures: str) -> AggSpec:
        """AggSpec.of(["city"], temp="min,avg") for short."""
        return cls(tuple(group_by), tuple(MeasureSpec.parse(f"{c}:{f}") for c, f in measures.items()))

    def outputs(self) -> list[tuple[int, AggFunc, str]]:
        """(measure number, function, output name) in output order; repeats get #2, #3, ..."""
        seen: dict[str, int] = {}
        out = []
        for i, m in enumerate(self.measures):
            for f in m.funcs:
                name = f"{f}({m.column})"
                seen[name] = seen.get(name, 0) + 1
                out.append((i, f, name if seen[name] == 1 else f"{name}#{seen[name]}"))
        return out

    def validate(self, schema: InputSchema) -> None:
        """Raise SpecError unless every name resolves and every function fits its column's type."""
        at = schema.index()
        seen = set()
        for name in self.group_by:
            if name not in at:
                raise SpecError(f"unknown group-by column {name!r}")
            if name in seen:
                raise SpecError(f"duplicate group-by column {name!r}")
            seen.add(name)
        for m in self.measures:
            if m.column not in at:
                raise SpecError(f"unknown measure column {m.column!r}")
            for f in m.funcs:
                if f.needs_number and not schema.columns[at[m.column]].type.numeric:
                    raise SpecError(f"{f} needs a numeric column, {m.column!r} is a string")

    def validate_distributable(self) -> None:
        """The strict rule of the multi-process tier: no percentiles."""
        for m in self.measures:
            if any(f.kind == "percentile" for f in m.funcs):
                raise SpecError(f"percentile of {m.column!r} is refused in strict distributed mode")
