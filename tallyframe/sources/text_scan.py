"""Delimited text to typed columns, with every malformed row rejected or reported.

Lines end at newline only and lose one trailing carriage return. A row is good
when it has exactly one field per column and every field parses, whether or not
a query uses that column; so the check is one filter over the whole line and
cannot be pruned away. Everything is built-in column expressions. Bytes that are
not UTF-8 survive in string columns, except in quoted mode.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.errors import SchemaError, SpecError
from tallyframe.model import ColumnType, InputSchema

INT = "[+-]?[0-9]+"
FLOAT = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?|nan))"
POLICIES = ("skip", "fail")


def parse_policy(text: str) -> str:
    if text in POLICIES:
        return text
    raise SpecError(f"unknown error policy {text!r}, expected skip or fail")


def _exact_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _split_pattern(d: str) -> str:
    """One character, or a backslash before a non-alphanumeric one: Java splits on both without a regex machine."""
    return d if d.isalnum() or d.isspace() else "\\" + d


def _fields(line: Column, schema: InputSchema) -> Column:
    d = schema.delimiter
    if not schema.quote_aware:
        return F.split(line, _split_pattern(d), -1)
    quoted = "\"(?:[^\"]++|\"\")*+\"|(?!\")[^%s]*+" % re.escape(d)
    raw = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(f"\\Q{d}\\E({quoted})"), 1)
    return F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def _field(i: int, kind: ColumnType, schema: InputSchema) -> Column:
    """Field i of a line. substring_index cuts bytes without decoding them, but walks the line anew for each column."""
    if not schema.quote_aware and (kind is ColumnType.STRING or len(schema.columns) <= 8):
        return F.substring_index(F.substring_index("line", schema.delimiter, i + 1), schema.delimiter, -1)
    return F.get("f", F.lit(i))


def _shape(schema: InputSchema) -> str:
    """A pattern for a line with the right number of fields and, unquoted, the right syntax in each."""
    d = schema.delimiter
    if schema.quote_aware:
        field = "(?:\"(?:[^\"]++|\"\")*+\"|(?!\")[^%s]*+)" % re.escape(d)
        return "^" + f"\\Q{d}\\E".join([field] * len(schema.columns)) + "\\z"
    of = {ColumnType.STRING: "[^%s]*+" % re.escape(d), ColumnType.INT64: INT, ColumnType.FLOAT64: FLOAT}
    return "^" + f"\\Q{d}\\E".join(of[c.type] for c in schema.columns) + "\\z"


def _parsed(text: Column, kind: ColumnType, strict: bool) -> tuple[Column, Column]:
    """Value and whether it is good. strict: the syntax has not been checked on the whole line."""
    if kind is ColumnType.STRING:
        return text, F.lit(True)
    value = text.try_cast("bigint" if kind is ColumnType.INT64 else "double")
    good = value.isNotNull()
    if kind is ColumnType.FLOAT64:  # a finite literal that overflows is an error
        good = good & (~F.abs(value).eqNullSafe(F.lit(float("inf"))) | text.rlike("(?i)inf"))
    if strict:
        good = text.rlike("^" + (INT if kind is ColumnType.INT64 else FLOAT) + "\\z") & good
    return value, good


@dataclass
class TextScan:
    """One scan of one file: good rows, and the rejected ones with line numbers and reasons."""

    spark: SparkSession
    path: str
    schema: InputSchema
    on_error: str = "skip"
    min_partitions: int | None = None

    def __post_init__(self):
        parse_policy(self.on_error)
        if not self.schema.columns and not self.schema.has_header:
            raise SchemaError("a schema without columns needs a header line")

    def lines(self) -> DataFrame:
        """line and its number, from 1, within the file split that holds it; the header is dropped and not counted."""
        df = self.spark.read.option("lineSep", "\n").text(self.path)
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        first = (F.col("_metadata.file_block_start") == 0).cast("long") if self.schema.has_header else F.lit(0).cast("long")
        df = df.select("value", first.alias("first"), row.alias("row"))
        if self.schema.has_header:
            df = df.filter((F.col("first") == 0) | (F.col("row") > 0))
        line = F.when(F.col("value").endswith("\r"), F.expr("substr(value, 1, length(value) - 1)")).otherwise(F.col("value"))
        return df.select(line.alias("line"), (F.col("row") + 1 - F.col("first")).alias("line_no"))

    def _judged(self) -> tuple[DataFrame, Column]:
        df = self.lines()
        if self.min_partitions:
            df = df.repartition(self.min_partitions)
        checks = F.col("line").rlike(_shape(self.schema))
        for i, c in enumerate(self.schema.columns):
            if c.type.numeric:
                _, good = _parsed(_field(i, c.type, self.schema), c.type, self.schema.quote_aware)
                checks = checks & good
        return df.select("line", "line_no", _fields(F.col("line"), self.schema).alias("f")), F.coalesce(checks, F.lit(False))

    def _typed(self, df: DataFrame) -> DataFrame:
        last = self.schema.index()
        columns = [_parsed(_field(i, c.type, self.schema), c.type, False)[0].alias(c.name) for i, c in enumerate(self.schema.columns) if last[c.name] == i]
        return df.select(*columns)

    def rows(self) -> DataFrame:
        """Good rows, typed. Policy fail raises on the first bad one, whatever columns the query uses."""
        if not self.schema.columns:
            return self.spark.createDataFrame([], "struct<>")
        df, good = self._judged()
        if self.on_error == "fail":
            good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed row: "), F.col("line"))).cast("boolean"))
        return self._typed(df.filter(good))

    def observed(self, observation) -> DataFrame:
        """Like rows(), with the exact number of rows and skipped rows reported to the Observation by the same job."""
        df, good = self._judged()
        df = df.withColumn("good", good)
        if self.on_error == "fail":
            df = df.withColumn("good", F.when(F.col("good"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed row: "), F.col("line"))).cast("boolean")))
        df = df.observe(observation, F.count_if("good").alias("rows"), F.count_if(~F.col("good")).alias("skipped"))
        return self._typed(df.filter("good"))

    def rejects(self) -> DataFrame:
        """Bad rows: line_no (within its file split), line, reason."""
        df, good = self._judged()
        n = len(self.schema.columns)
        reason = F.when(F.size("f") != n, F.format_string(f"expected {n} fields, got %d", F.size("f")))
        for i, c in enumerate(self.schema.columns):
            if c.type.numeric:
                _, ok = _parsed(F.get("f", F.lit(i)), c.type, True)
                reason = reason.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"column {c.name}: not a {c.type.display}: "), F.get("f", F.lit(i))))
        return df.filter(~good).select("line_no", "line", reason.otherwise("bad quoting").alias("reason"))
