import math

import pytest
from pyspark.sql import functions as F

from tallyframe import AggSpec, Engine, MeasureSpec, SchemaError, SpecError
from tallyframe.model import ColumnSpec, ColumnType, InputSchema
from tallyframe.operators.aggregate import aggregate

ROWS = [("Quito", 14.5, 4), ("Lima", 19.25, 9), ("Lima", 22.75, 2), ("Cusco", 11.0, 6), ("Quito", 13.1, 1), ("Lima", 18.0, 11)]
NAN, INF = math.nan, math.inf


def frame(spark, rows=ROWS, schema="city string, temp double, hits bigint"):
    return spark.createDataFrame(rows, schema)


def run(spark, rows, schema, spec, **more):
    return [tuple(r) for r in Engine(spark, frame(spark, rows, schema), **more).run(spec).collect()]


def test_exact(spark):
    got = run(spark, ROWS, "city string, temp double, hits bigint", AggSpec.of(["city"], temp="sum,min,max,avg", hits="sum,min,max,avg"))
    assert [r[0] for r in got] == ["Cusco", "Lima", "Quito"]
    assert got[2][1] == 2 and got[2][2] == pytest.approx(27.6) and got[2][3:6] == (13.1, 14.5, pytest.approx(13.8))
    assert got[1][6:] == (22, 2, 11, pytest.approx(22 / 3))


def test_global_and_empty(spark):
    schema = "city string, temp double, hits bigint"
    assert run(spark, ROWS, schema, AggSpec.of([], hits="sum")) == [(6, 33)]
    assert run(spark, [], schema, AggSpec.of([], hits="sum")) == []
    assert run(spark, [], schema, AggSpec.of(["city"], hits="sum")) == []


@pytest.mark.parametrize("spec", [AggSpec(("nope",)), AggSpec(("city", "city")), AggSpec.of(["city"], nope="sum"), AggSpec.of([], city="sum"), AggSpec.of([], city="p50"), AggSpec(("CITY",))])
def test_refused(spark, spec):
    with pytest.raises(SpecError):
        Engine(spark, frame(spark)).run(spec)


def test_frame_must_match_schema(spark):
    schema = InputSchema((ColumnSpec("city"), ColumnSpec("temp", ColumnType.INT64)))
    with pytest.raises(SchemaError):
        aggregate(frame(spark), AggSpec.of(["city"], temp="sum"), schema)


@pytest.mark.parametrize("values, low, high", [((NAN, 5.0), NAN, NAN), ((5.0, NAN), NAN, NAN), ((-INF, NAN), -INF, NAN), ((INF, NAN), NAN, INF), ((1.0, 2.0), 1.0, 2.0)])
def test_nan(spark, values, low, high):
    [(_, got_low, got_high, total)] = run(spark, [(v,) for v in values], "v double", AggSpec.of([], v="min,max,sum"))
    same = lambda a, b: a == b or (math.isnan(a) and math.isnan(b))
    assert same(got_low, low) and same(got_high, high)
    assert math.isnan(total) == any(map(math.isnan, values))


def test_float_keys(spark):
    got = run(spark, [(0.0,), (-0.0,), (NAN,), (1.0,), (-0.0,)], "v double", AggSpec(("v",)))
    assert math.isnan(got[0][0])
    assert sorted((str(k), n) for k, n in got) == [("-0.0", 2), ("0.0", 1), ("1.0", 1), ("nan", 1)]


def test_composite_keys_stay_apart(spark):
    assert len(run(spark, [("x\x1fy", "z"), ("x", "y\x1fz")], "a string, b string", AggSpec(("a", "b")))) == 2


def test_int_average_is_exact(spark):
    big = (1 << 53) + 1
    [(_, mean)] = run(spark, [(big,), (big,), (big + 2,)], "v bigint", AggSpec.of([], v="avg"))
    assert mean == float(3 * big + 2) / 3


def test_overflow(spark):
    rows = [((1 << 63) - 1,), (1,)]
    with pytest.raises(Exception, match="(?i)overflow"):
        run(spark, rows, "v bigint", AggSpec.of([], v="sum"))
    assert run(spark, rows, "v bigint", AggSpec.of([], v="sum"), overflow="wrap") == [(2, -(1 << 63))]


def test_distinct(spark):
    got = run(spark, [("a", "x"), ("a", "y"), ("a", "x"), ("b", "x")], "k string, v string", AggSpec.of(["k"], v="distinct"))
    assert got == [("a", 3, 2), ("b", 1, 1)]
    assert run(spark, [(0.0,), (-0.0,), (NAN,), (NAN,)], "v double", AggSpec.of([], v="distinct")) == [(4, 3)]


@pytest.mark.parametrize("n", [1, 5, 100, 10_000, 200_000])
def test_distinct_error(spark, n):
    [(_, got)] = [tuple(r) for r in Engine(spark, spark.range(n).union(spark.range(n))).run(AggSpec.of([], id="distinct")).collect()]
    assert abs(got - n) <= max(3 if n < 10 else 0, 0.0325 * n)


def test_percentiles(spark):
    df = spark.range(1, 1001).selectExpr("cast(id as double) AS v", "id")
    [(_, a, b, c)] = [tuple(r) for r in Engine(spark, df).run(AggSpec.of([], v="p50,p37.5,p99.9")).collect()]
    assert (a, b) == (500.5, pytest.approx(375.625)) and c >= 999
    [(_, p)] = [tuple(r) for r in Engine(spark, df, quantile="approx").run(AggSpec.of([], id="p90")).collect()]
    assert abs(p - 900) <= 1
    assert run(spark, [(10.0,), (20.0,), (NAN,)], "v double", AggSpec.of([], v="p50,p70,p90"), quantile="hazen") == [(3, 15.0, 19.0, 20.0)]
    [(_, empty)] = run(spark, [(NAN,)], "v double", AggSpec.of([], v="p50"))
    assert math.isnan(empty)


def test_strict_distributed(spark):
    with pytest.raises(SpecError):
        Engine(spark, frame(spark), strict_distributed=True).run(AggSpec.of([], temp="p50"))


def test_names_are_exact(spark):
    df = spark.createDataFrame([(1, 2)], "a bigint, `a.b` bigint")
    assert Engine(spark, df).query("SELECT sum(a.b) GROUP BY a").collect()[0][2] == 2
    with pytest.raises(SpecError):
        Engine(spark, df).query("SELECT sum(A)")


def test_nulls(spark):
    rows = [("a", 1.0, 1), ("a", None, 1), (None, 2.0, 1)]
    df = frame(spark, rows)
    assert [tuple(r) for r in Engine(spark, df).run(AggSpec.of(["city"], temp="sum")).collect()] == [("a", 1, 1.0)]
    with pytest.raises(Exception, match="NULL"):
        Engine(spark, df, on_error="fail").run(AggSpec.of(["city"], temp="sum")).collect()


def test_duplicate_measures(spark):
    spec = AggSpec((), (MeasureSpec.parse("temp:avg,avg"), MeasureSpec.parse("temp:max")))
    assert Engine(spark, frame(spark)).run(spec).columns == ["count", "avg(temp)", "avg(temp)#2", "max(temp)"]


def test_plan_is_partial_then_final(spark):
    plan = Engine(spark, frame(spark)).run(AggSpec.of(["city"], temp="min,avg"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("hashpartitioning") == 1


def test_state_round_trip(spark):
    rows = [(f"c{i % 5}", i * 0.37, i % 13) for i in range(500)]
    df, spec = frame(spark, rows), AggSpec.of(["city"], temp="sum,min,max,avg,p50", hits="sum,distinct")
    engine = Engine(spark, df)
    whole = engine.run(spec).collect()
    parts = [engine.state(spec, where=F.col("hits") % 3 == i) for i in range(3)]
    merged = engine.finish(parts, spec).collect()
    for a, b in zip(whole, merged, strict=True):
        assert tuple(a)[:2] == tuple(b)[:2]
        assert tuple(b)[2:6] == pytest.approx(tuple(a)[2:6])
        assert abs(a[6] - b[6]) <= 2
        assert tuple(a)[7:] == tuple(b)[7:]


def test_state_refuses_other_shapes(spark):
    engine = Engine(spark, frame(spark))
    a, b = AggSpec.of(["city"], temp="sum"), AggSpec.of(["city"], temp="distinct")
    with pytest.raises(SchemaError):
        engine.finish([engine.state(a), engine.state(b)], a)
    with pytest.raises(SchemaError):
        engine.finish([engine.state(a)], b)
    with pytest.raises(SchemaError):
        engine.finish([], a)


def test_state_keeps_nan_and_zero_signs(spark):
    engine = Engine(spark, frame(spark, [(-0.0, NAN), (-0.0, -INF), (0.0, 1.0)], "k double, v double"))
    spec = AggSpec.of(["k"], v="min,max,p50")
    got = {str(r[0]): tuple(r)[1:] for r in engine.finish([engine.state(spec), engine.state(spec)], spec).collect()}
    assert got["-0.0"][:2] == (4, -INF) and math.isnan(got["-0.0"][2])
    assert got["0.0"] == (2, 1.0, 1.0, 1.0)


def test_state_overflow(spark):
    """Sums of integers in states meet the overflow rule only when they are finished."""
    rows = [((1 << 63) - 1,), (5,)]
    spec = AggSpec.of([], v="sum,avg")
    for overflow, want in (("wrap", -(1 << 63) + 4), ("error", None)):
        engine = Engine(spark, frame(spark, rows, "v bigint"), overflow=overflow)
        done = engine.finish([engine.state(spec, where=F.col("v") == v) for (v,) in rows], spec)
        if want is None:
            with pytest.raises(Exception, match="(?i)overflow"):
                done.collect()
        else:
            assert [tuple(r) for r in done.collect()] == [(2, want, ((1 << 63) + 4) / 2)]
