"""The engine's own queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.model import AggSpec, ColumnKind, ColumnSpec, ColumnType, InputSchema
from tallyframe.plans.engine import Engine
from tallyframe.sources.schema_file import infer_from_header, schema_from_json, schema_to_json
from tallyframe.sources.text_scan import TextScan
from tallyframe.storage import fresh_path
from tallyframe.synth import readings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINE_SCHEMA = InputSchema((ColumnSpec("l_returnflag"), ColumnSpec("l_linenumber", ColumnType.INT64, ColumnKind.MEASURE), ColumnSpec("l_quantity", ColumnType.FLOAT64, ColumnKind.MEASURE)), ";", False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, names: dict[str, str] | None = None, digits: int = 4) -> DataFrame:
    """Plain column names, and doubles rounded so that the order of additions does not show."""
    names = names or {}
    out = []
    for c, t in df.dtypes:
        v = F.col(f"`{c}`")
        out.append((F.round(v, digits) if t == "double" else v).alias(names.get(c, c.replace("(", "_").replace(")", "").replace("#", "_").replace(".", "_"))))
    return df.select(*out)


def add(name: str, sql: str | None = None):
    def of(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return of


def spec_query(name: str, tab: str, group_by: list[str], sql: str, **measures: str) -> None:
    add(name, sql)(lambda spark, sf: tidy(Engine(spark, table(spark, sf, tab)).run(AggSpec.of(group_by, **measures))))


def text_query(name: str, tab: str, text: str, sql: str) -> None:
    add(name, sql)(lambda spark, sf: tidy(Engine(spark, table(spark, sf, tab)).query(text)))


# Exact aggregates
spec_query("flagship_min_avg_max", "lineitem", ["l_returnflag"], "SELECT l_returnflag, count(*) AS count, min(l_quantity) AS min_l_quantity, round(avg(l_quantity), 4) AS avg_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 1", l_quantity="min,avg,max")
spec_query("count_by_key", "events", ["event_type"], "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
spec_query("sum_int", "lineitem", ["l_returnflag"], "SELECT l_returnflag, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem GROUP BY 1", l_linenumber="sum")
spec_query("sum_float", "events", ["event_type"], "SELECT event_type, count(*) AS count, round(sum(value), 4) AS sum_value FROM events GROUP BY 1", value="sum")
spec_query("min_max_int", "lineitem", ["l_linestatus"], "SELECT l_linestatus, count(*) AS count, CAST(min(l_linenumber) AS BIGINT) AS min_l_linenumber, CAST(max(l_linenumber) AS BIGINT) AS max_l_linenumber FROM lineitem GROUP BY 1", l_linenumber="min,max")
spec_query("min_max_float", "events", ["event_type"], "SELECT event_type, count(*) AS count, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value FROM events GROUP BY 1", value="min,max")
spec_query("avg_int", "lineitem", ["l_returnflag"], "SELECT l_returnflag, count(*) AS count, round(CAST(sum(l_linenumber) AS DOUBLE) / count(*), 4) AS avg_l_linenumber FROM lineitem GROUP BY 1", l_linenumber="avg")
spec_query("avg_float", "events", ["event_type"], "SELECT event_type, count(*) AS count, round(avg(value), 4) AS avg_value FROM events GROUP BY 1", value="avg")
spec_query("global_agg", "lineitem", [], "SELECT count(*) AS count, round(min(l_quantity), 4) AS min_l_quantity, round(sum(l_quantity), 4) AS sum_l_quantity FROM lineitem", l_quantity="min,sum")
spec_query("composite_key", "lineitem", ["l_returnflag", "l_linestatus"], "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 4) AS sum_l_quantity FROM lineitem GROUP BY 1, 2", l_quantity="sum")
spec_query("int_key", "events", ["user_id"], "SELECT user_id, count(*) AS count, round(avg(value), 4) AS avg_value FROM events GROUP BY 1", value="avg")
spec_query("float_key", "lineitem", ["l_discount"], "SELECT round(l_discount, 4) AS l_discount, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem GROUP BY 1", l_linenumber="sum")
spec_query("high_card_key", "lineitem", ["l_orderkey"], "SELECT l_orderkey, count(*) AS count, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, CAST(max(l_linenumber) AS BIGINT) AS max_l_linenumber FROM lineitem GROUP BY 1", l_extendedprice="sum", l_linenumber="max")
QUERIES["high_card_key"] = lambda spark, sf: tidy(Engine(spark, table(spark, sf, "lineitem")).run(AggSpec.of(["l_orderkey"], l_extendedprice="sum", l_linenumber="max")), digits=2)


@add("global_agg_empty", "SELECT count(*) AS count, max(l_quantity) AS max_l_quantity FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
def global_agg_empty(spark, sf):
    return tidy(Engine(spark, table(spark, sf, "lineitem")).run(AggSpec.of([], l_quantity="max"), where=F.col("l_quantity") < 0))


@add("multi_func_measure", "SELECT l_returnflag, count(*) AS count, round(avg(l_quantity), 4) AS avg_l_quantity, min(l_quantity) AS min_l_quantity, round(avg(l_quantity), 4) AS avg_l_quantity_2, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem GROUP BY 1")
def multi_func_measure(spark, sf):
    from tallyframe.model import MeasureSpec

    spec = AggSpec(("l_returnflag",), tuple(map(MeasureSpec.parse, ("l_quantity:avg,min", "l_quantity:avg", "l_linenumber:sum"))))
    return tidy(Engine(spark, table(spark, sf, "lineitem")).run(spec))


# Sketches: the exact count, and whether the estimate is within the documented error
def _distinct(name: str, column: str, kind: str) -> None:
    @add(f"distinct_{kind}", f"SELECT l_returnflag, count(DISTINCT {column}) AS exact, TRUE AS within FROM lineitem GROUP BY 1")
    def run(spark, sf):
        df = table(spark, sf, "lineitem").withColumn("d", F.col(column).cast("string") if kind == "string" else F.col(column))
        estimate = Engine(spark, df).run(AggSpec.of(["l_returnflag"], d="distinct"))
        truth = df.groupBy("l_returnflag").agg(F.countDistinct("d").alias("exact"))
        return truth.join(estimate, "l_returnflag").select("l_returnflag", "exact", (F.abs(F.col("`distinct(d)`") - F.col("exact")) <= 0.0325 * F.col("exact")).alias("within"))


for _kind, _column in (("string", "l_partkey"), ("int", "l_partkey"), ("float", "l_extendedprice")):
    _distinct(f"distinct_{_kind}", _column, _kind)

for _q in ("50", "90", "99", "99.9", "37.5"):
    _name = "p" + _q.replace(".", "_")
    spec_query(f"pctl_{_name}", "lineitem", ["l_returnflag"], f"SELECT l_returnflag, count(*) AS count, round(quantile_cont(l_extendedprice, {float(_q) / 100}), 4) AS {_name}_l_extendedprice FROM lineitem GROUP BY 1", l_extendedprice=f"p{_q}")


@add("pctl_approx", "SELECT l_returnflag, TRUE AS within FROM lineitem GROUP BY 1")
def pctl_approx(spark, sf):
    df = table(spark, sf, "lineitem")
    got = Engine(spark, df, quantile="approx").run(AggSpec.of(["l_returnflag"], l_extendedprice="p90"))
    rank = F.avg((F.col("l_extendedprice") <= F.col("`p90(l_extendedprice)`")).cast("double"))
    return df.join(F.broadcast(got), "l_returnflag").groupBy("l_returnflag").agg((F.abs(rank - 0.9) < 0.01).alias("within"))


# State
@add("merge_states", "SELECT l_returnflag, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, round(avg(l_quantity), 4) AS avg_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 1")
def state_round_trip(spark, sf):
    df, spec = table(spark, sf, "lineitem"), AggSpec.of(["l_returnflag"], l_linenumber="sum", l_quantity="avg,max")
    engine = Engine(spark, df)
    states = [engine.state(spec, where=F.col("l_orderkey") % 3 == i) for i in range(3)]
    return tidy(engine.finish(states, spec))


@add("merge_states_sketch", "SELECT l_returnflag, count(*) AS count, TRUE AS distinct_within, TRUE AS percentile_within FROM lineitem GROUP BY 1")
def state_sketches(spark, sf):
    df, spec = table(spark, sf, "lineitem"), AggSpec.of(["l_returnflag"], l_partkey="distinct", l_quantity="p50")
    engine = Engine(spark, df)
    got = engine.finish([engine.state(spec, where=F.col("l_orderkey") % 2 == i) for i in range(2)], spec)
    truth = df.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("d"))
    # the median's rank lies within a hundredth of one half
    ranks = df.join(F.broadcast(got), "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_quantity") < F.col("`p50(l_quantity)`")).cast("double")).alias("under"), F.avg((F.col("l_quantity") <= F.col("`p50(l_quantity)`")).cast("double")).alias("upto"))
    near = F.abs(F.col("`distinct(l_partkey)`") - F.col("d")) <= 0.0325 * F.col("d")
    return got.join(truth, "l_returnflag").join(ranks, "l_returnflag").select("l_returnflag", "count", near.alias("distinct_within"), ((F.col("under") <= 0.51) & (F.col("upto") >= 0.49)).alias("percentile_within"))


# Float edge rules
_EDGE = "CASE WHEN event_id % 50 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 50 = 1 AND event_type = 'click' THEN CAST('-Infinity' AS DOUBLE) ELSE value END"


@add("nan_poison", f"SELECT event_type, count(*) AS count, bool_or(v = CAST('-Infinity' AS DOUBLE)) AS min_is_inf, bool_or(isnan(v)) AND NOT bool_or(v = CAST('-Infinity' AS DOUBLE)) AS min_is_nan, bool_or(isnan(v)) AS max_is_nan FROM (SELECT event_type, {_EDGE} AS v FROM events) GROUP BY 1")
def nan_poison(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_type", f"{_EDGE} AS v")
    low, high = F.col("`min(v)`"), F.col("`max(v)`")
    return Engine(spark, df).run(AggSpec.of(["event_type"], v="min,max")).select("event_type", "count", (low == float("-inf")).alias("min_is_inf"), F.isnan(low).alias("min_is_nan"), F.isnan(high).alias("max_is_nan"))


@add("neg_zero_key", "SELECT CAST(CASE event_id % 3 WHEN 0 THEN '-0.0' WHEN 1 THEN '0.0' ELSE '1.0' END AS VARCHAR) AS k, count(*) AS count FROM events GROUP BY 1")
def neg_zero_key(spark, sf):
    df = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, F.lit(-0.0)).when(F.col("event_id") % 3 == 1, F.lit(0.0)).otherwise(F.lit(1.0)).alias("z"))
    return Engine(spark, df).run(AggSpec(("z",))).select(F.col("z").cast("string").alias("k"), "count")


def _numbered(df: DataFrame) -> DataFrame:
    """The position of each row of a sorted result; results are O(groups)."""
    return df.withColumn("at", F.monotonically_increasing_id()).selectExpr("* EXCEPT (at)", "row_number() OVER (ORDER BY at) AS position")


@add("sorted_output", "SELECT l_linestatus, l_returnflag, count(*) AS count, CAST(row_number() OVER (ORDER BY l_linestatus, l_returnflag) AS INTEGER) AS position FROM lineitem GROUP BY 1, 2")
def sorted_output(spark, sf):
    return _numbered(Engine(spark, table(spark, sf, "lineitem")).run(AggSpec.of(["l_linestatus", "l_returnflag"])).coalesce(1))


@add("nan_sort", "SELECT CASE WHEN event_id % 4 = 0 THEN 'NaN' ELSE CAST(event_id % 4 AS VARCHAR) END AS k, count(*) AS count, CAST(row_number() OVER (ORDER BY CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id % 4 END) AS INTEGER) AS position FROM events GROUP BY event_id % 4")
def nan_sort(spark, sf):
    df = table(spark, sf, "events").select(F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise((F.col("event_id") % 4).cast("double")).alias("v"))
    out = _numbered(Engine(spark, df).run(AggSpec(("v",))).coalesce(1))
    return out.select(F.when(F.isnan("v"), F.lit("NaN")).otherwise(F.col("v").cast("bigint").cast("string")).alias("k"), "count", "position")


@add("sum_wraps", "SELECT event_type, count(*) AS count, CAST(((sum(CAST(9223372036854775807 - event_id AS HUGEINT)) + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS sum_big FROM events GROUP BY 1")
def sum_wraps(spark, sf):
    df = table(spark, sf, "events").select("event_type", (F.lit((1 << 63) - 1) - F.col("event_id")).alias("big"))
    return tidy(Engine(spark, df, overflow="wrap").run(AggSpec.of(["event_type"], big="sum")))


@add("merge_states_wrap", "SELECT event_type, count(*) AS count, CAST(((sum(CAST(9223372036854775807 - event_id AS HUGEINT)) + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS sum_big, TRUE AS avg_near FROM events GROUP BY 1")
def state_wraps(spark, sf):
    df, spec = table(spark, sf, "events").select("event_id", "event_type", (F.lit((1 << 63) - 1) - F.col("event_id")).alias("big")), AggSpec.of(["event_type"], big="sum,avg")
    engine = Engine(spark, df, overflow="wrap")
    got = engine.finish([engine.state(spec, where=F.col("event_id") % 2 == i) for i in range(2)], spec)
    return got.select("event_type", "count", F.col("`sum(big)`").alias("sum_big"), (F.abs(F.col("`avg(big)`") / float(1 << 63) - 1) < 1e-9).alias("avg_near"))


spec_query("pctl_int", "lineitem", ["l_returnflag"], "SELECT l_returnflag, count(*) AS count, round(quantile_cont(l_linenumber, 0.75), 4) AS p75_l_linenumber FROM lineitem GROUP BY 1", l_linenumber="p75")


# Query text
text_query("query_text_flagship", "lineitem", "SELECT l_returnflag, MIN(l_quantity), AVG(l_quantity), MAX(l_quantity) GROUP BY l_returnflag", SQL["flagship_min_avg_max"])
text_query("query_text_count_only", "events", "select count(*)", "SELECT count(*) AS count FROM events")
text_query("query_text_regrouped", "lineitem", "SELECT AVG(l_quantity), SUM(l_linenumber), MIN(l_quantity), COUNT(*) GROUP BY l_linestatus", "SELECT l_linestatus, count(*) AS count, round(avg(l_quantity), 4) AS avg_l_quantity, min(l_quantity) AS min_l_quantity, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem GROUP BY 1")
text_query("query_text_two_keys", "lineitem", "SELECT l_linestatus, Sum(l_linenumber) group by l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem GROUP BY 1, 2")
text_query("query_text_percentile", "lineitem", "SELECT p95(l_extendedprice) GROUP BY l_linestatus", "SELECT l_linestatus, count(*) AS count, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95_l_extendedprice FROM lineitem GROUP BY 1")


# Text scans: a table goes out as delimited text and is scanned back
def _written(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = fresh_path(spark, name)
    df.write.text(path)
    return path


_LINES = "concat_ws(';', l_returnflag, cast(l_linenumber as string), cast(l_quantity as string))"


@add("text_scan", "SELECT l_returnflag, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, min(l_quantity) AS min_l_quantity, round(avg(l_quantity), 4) AS avg_l_quantity FROM lineitem GROUP BY 1")
def text_scan(spark, sf):
    path = _written(spark, table(spark, sf, "lineitem").selectExpr(f"{_LINES} AS value"), "text-scan")
    return tidy(Engine(spark, path, LINE_SCHEMA).run(AggSpec.of(["l_returnflag"], l_linenumber="sum", l_quantity="min,avg")))


_BAD = "CASE l_orderkey % 10 WHEN 0 THEN concat(l_returnflag, ';x;1.5') WHEN 1 THEN l_returnflag WHEN 2 THEN concat(l_returnflag, ';1;') WHEN 3 THEN '' ELSE {good} END"


@add("text_skip", "SELECT l_returnflag, count(*) AS count, round(max(l_quantity), 4) AS max_l_quantity FROM lineitem WHERE l_orderkey % 10 > 3 GROUP BY 1")
def text_skip(spark, sf):
    path = _written(spark, table(spark, sf, "lineitem").selectExpr(_BAD.format(good=_LINES) + " AS value"), "text-skip")
    return tidy(Engine(spark, path, LINE_SCHEMA, "skip").run(AggSpec.of(["l_returnflag"], l_quantity="max")))


@add("text_rejects", "SELECT CASE l_orderkey % 10 WHEN 0 THEN 'column l_linenumber: not a int64: x' WHEN 1 THEN 'expected 3 fields, got 1' WHEN 2 THEN 'column l_quantity: not a float64: ' ELSE 'expected 3 fields, got 1' END AS reason, count(*) AS n FROM lineitem WHERE l_orderkey % 10 <= 3 GROUP BY 1")
def text_rejects(spark, sf):
    path = _written(spark, table(spark, sf, "lineitem").selectExpr(_BAD.format(good=_LINES) + " AS value"), "text-rejects")
    return TextScan(spark, path, LINE_SCHEMA).rejects().groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@add("text_fail", "SELECT TRUE AS refused, count(*) FILTER (l_orderkey % 10 > 3) AS count FROM lineitem")
def text_fail(spark, sf):
    """A malformed row ends a scan under the policy fail; the same file is counted under skip."""
    path = _written(spark, table(spark, sf, "lineitem").selectExpr(_BAD.format(good=_LINES) + " AS value"), "text-fail")
    try:
        Engine(spark, path, LINE_SCHEMA, "fail").query("SELECT COUNT(*)").collect()
        refused = False
    except Exception as e:  # noqa: BLE001  Spark wraps the reason
        refused = "malformed row" in str(e)
    return Engine(spark, path, LINE_SCHEMA, "skip").query("SELECT COUNT(*)").select(F.lit(refused).alias("refused"), "count")


@add("text_schema_json", "SELECT l_returnflag, count(*) AS count, CAST(max(l_linenumber) AS BIGINT) AS max_l_linenumber FROM lineitem GROUP BY 1")
def text_schema_json(spark, sf):
    """The schema goes out as JSON text and comes back."""
    path = _written(spark, table(spark, sf, "lineitem").selectExpr(f"{_LINES} AS value"), "text-schema")
    return tidy(Engine(spark, path, schema_from_json(schema_to_json(LINE_SCHEMA))).run(AggSpec.of(["l_returnflag"], l_linenumber="max")))


@add("generated_readings", "SELECT 104 AS stations, 100000 AS count, TRUE AS spread_within, TRUE AS same_again")
def generated_readings(spark, sf):
    """The generator: all stations, the asked number of rows and deviation, and the same rows from the same seed."""
    one, again = (readings(spark, 100_000, 7, 3.0, partitions=4) for _ in range(2))
    per = one.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.stddev("temperature").alias("s"))
    out = per.agg(F.count(F.lit(1)).cast("int").alias("stations"), F.sum("n").cast("int").alias("count"), (F.abs(F.avg("s") - 3) < 0.1).alias("spread_within"))
    digest = lambda df: df.agg(F.sum(F.xxhash64("station", "temperature").cast("decimal(38,0)")).alias("h"))
    return out.withColumn("same_again", F.lit(digest(one).first() == digest(again).first()))


@add("text_quoted", "SELECT concat(event_type, ',\"', CAST(user_id % 3 AS VARCHAR), '\"') AS note, count(*) AS count, round(sum(value), 4) AS sum_value FROM events GROUP BY 1")
def text_quoted(spark, sf):
    line = "concat('\"', event_type, ',\"\"', cast(user_id % 3 as string), '\"\"\"', ',', cast(value as string))"
    path = _written(spark, table(spark, sf, "events").selectExpr(f"{line} AS value"), "text-quoted")
    schema = InputSchema((ColumnSpec("note"), ColumnSpec("value", ColumnType.FLOAT64)), ",", False, True)
    return tidy(Engine(spark, path, schema).run(AggSpec.of(["note"], value="sum")))


@add("header_infer", "SELECT r_name, count(*) AS count FROM region GROUP BY 1")
def header_infer(spark, sf):
    rows = table(spark, sf, "region").selectExpr("concat_ws(',', r_regionkey, r_name) AS value", "r_regionkey AS k")
    head = spark.createDataFrame([("r_regionkey,r_name", -1)], "value string, k int")
    path = _written(spark, head.union(rows).repartition(1).sortWithinPartitions("k").select("value"), "header-infer")
    schema = infer_from_header(spark, path, InputSchema((), ",", True))
    return tidy(Engine(spark, path, schema).query("SELECT r_name GROUP BY r_name"))

