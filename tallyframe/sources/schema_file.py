"""Schema JSON and header inference."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tallyframe.errors import SchemaError
from tallyframe.model import ColumnKind, ColumnSpec, ColumnType, InputSchema


def schema_from_json(text: str) -> InputSchema:
    try:
        raw = json.loads(text)
        columns = tuple(ColumnSpec(c["name"], ColumnType(c.get("type", 0)), ColumnKind(c.get("kind", 0))) for c in raw.get("columns") or ())
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise SchemaError(f"bad schema: {e}") from e
    return InputSchema(columns, raw.get("delimiter") or ",", bool(raw.get("hasHeader", False)), bool(raw.get("quoteAware", False)))


def schema_to_json(schema: InputSchema) -> str:
    columns = [{"name": c.name, "type": int(c.type), "kind": int(c.kind)} for c in schema.columns]
    return json.dumps({"delimiter": schema.delimiter, "hasHeader": schema.has_header, "quoteAware": schema.quote_aware, "columns": columns})


def load_schema_file(path: str) -> InputSchema:
    with open(path, encoding="utf-8") as f:
        return schema_from_json(f.read())


def infer_from_header(spark: SparkSession, path: str, schema: InputSchema) -> InputSchema:
    """All-string columns named by the first line; no columns for an empty input. The header is always split unquoted."""
    if schema.columns:
        return schema
    if not schema.has_header:
        raise SchemaError("a schema without columns needs a header line")
    first = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    if not first:
        return schema
    line = first[0][0].removesuffix("\r")
    return InputSchema(tuple(ColumnSpec(n) for n in line.split(schema.delimiter)), schema.delimiter, True, schema.quote_aware)
