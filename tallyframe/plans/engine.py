"""One dataset, many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tallyframe.model import AggSpec, InputSchema
from tallyframe.operators.aggregate import aggregate
from tallyframe.operators.state import finalize, merge_states, partial_state
from tallyframe.plans.grammar import parse
from tallyframe.sources.frame import from_dataframe, schema_of
from tallyframe.sources.schema_file import infer_from_header
from tallyframe.sources.text_scan import TextScan


class Engine:
    """Queries over a delimited text file or an existing DataFrame.

    Specs are validated before any input is read. overflow, quantile: see
    functions.exact.total and functions.sketches.percentile. strict_distributed
    refuses percentiles, as a tier without mergeable percentile state would.
    """

    def __init__(self, spark: SparkSession, source: str | DataFrame, schema: InputSchema | None = None, on_error: str = "skip", overflow: str = "error", quantile: str = "exact", strict_distributed: bool = False, min_partitions: int | None = None):
        self.spark, self.source, self.on_error = spark, source, on_error
        self.overflow, self.quantile, self.strict = overflow, quantile, strict_distributed
        if isinstance(source, DataFrame):
            self.schema, self.scan = schema or schema_of(source), None
        else:
            self.schema = infer_from_header(spark, source, schema or InputSchema(has_header=True))
            self.scan = TextScan(spark, source, self.schema, on_error, min_partitions)

    def _checked(self, spec: AggSpec) -> None:
        spec.validate(self.schema)
        if self.strict:
            spec.validate_distributable()

    def input(self, spec: AggSpec) -> DataFrame:
        return self.scan.rows() if self.scan else from_dataframe(self.source, spec, self.on_error)

    def run(self, spec: AggSpec, where: Column | None = None, observation=None) -> DataFrame:
        """where is an extension over the query text: a predicate on the typed input."""
        self._checked(spec)
        df = self.scan.observed(observation) if observation is not None and self.scan else self.input(spec)
        if where is not None:
            df = df.filter(where)
        return aggregate(df, spec, self.schema, self.overflow, self.quantile)

    def query(self, text: str) -> DataFrame:
        return self.run(parse(text))

    def state(self, spec: AggSpec, where: Column | None = None) -> DataFrame:
        self._checked(spec)
        df = self.input(spec)
        return partial_state(df if where is None else df.filter(where), spec, self.schema)

    def finish(self, states: list[DataFrame], spec: AggSpec) -> DataFrame:
        return finalize(merge_states(states, spec, self.schema), spec, self.schema, self.overflow)
