import pytest

from tallyframe import AggFunc, AggSpec, InputSchema, MeasureSpec, SchemaError, SpecError, parse
from tallyframe.model import ColumnKind, ColumnSpec, ColumnType
from tallyframe.render import number
from tallyframe.sources.schema_file import load_schema_file, schema_from_json, schema_to_json


@pytest.mark.parametrize("text, shown", [("sum", "sum"), ("SUM", "sum"), (" min ", "min"), ("max", "max"), ("avg", "avg"), ("distinct", "distinct"), ("p50", "p50"), ("P99.9", "p99.9"), ("p1e1", "p10"), ("p0.00001", "p0.00001")])
def test_function_names(text, shown):
    assert str(AggFunc.parse(text)) == shown


@pytest.mark.parametrize("text", ["", "mode", "p", "p0", "p100", "p-12", "p7q", "p 5", "pnan", "pinf", "count", "sum!"])
def test_function_names_refused(text):
    with pytest.raises(SpecError):
        AggFunc.parse(text)


def funcs(spec):
    return [(m.column, [str(f) for f in m.funcs]) for m in spec.measures]


@pytest.mark.parametrize(
    "text, keys, measures",
    [
        ("SELECT COUNT(*)", (), []),
        ("select count(*) group by a", ("a",), []),
        ("SELECT a, AVG(x) GROUP BY a", ("a",), [("x", ["avg"])]),
        ("SELECT a.b, p95(x) GROUP BY a.b,c", ("a.b", "c"), [("x", ["p95"])]),
        ("SELECT AVG(a), SUM(b), MIN(a)", (), [("a", ["avg", "min"]), ("b", ["sum"])]),
        ("SELECT group, sum(select) GROUP BY group", ("group",), [("select", ["sum"])]),
        ("\tSELECT\nmax( x )\r\n", (), [("x", ["max"])]),
        ("SELECT min(x), min(x)", (), [("x", ["min", "min"])]),
    ],
)
def test_queries(text, keys, measures):
    spec = parse(text)
    assert spec.group_by == keys
    assert funcs(spec) == measures


@pytest.mark.parametrize("text", ["", "  ", "FOO a", "SELECT", "SELECT a,", "SELECT a GROUP a", "SELECT a GROUP BY", "SELECT a", "SELECT a GROUP BY b", "SELECT count(*) LIMIT 3", "SELECT *", "SELECT count(x)", "SELECT sum(*)", "SELECT mode(x)", "SELECT sum(x", "SELECT sum(x) WHERE y", "SELECT 1x", "SELECT a-b GROUP BY a"])
def test_queries_refused(text):
    with pytest.raises(SpecError):
        parse(text)


def test_bad_character_position():
    with pytest.raises(SpecError, match="byte 9"):
        parse("SELECT a ; b")


def test_measure_flag():
    m = MeasureSpec.parse("temp:min,p99.9")
    assert m.column == "temp" and [str(f) for f in m.funcs] == ["min", "p99.9"]
    with pytest.raises(SpecError):
        MeasureSpec.parse("temp")


def test_repeats_get_numbers():
    spec = AggSpec((), (MeasureSpec.parse("x:avg,avg"), MeasureSpec.parse("x:avg")))
    assert [n for _, _, n in spec.outputs()] == ["avg(x)", "avg(x)#2", "avg(x)#3"]


def test_schema_json(tmp_path):
    text = '{"delimiter": ";", "hasHeader": true, "columns": [{"name": "station", "type": 0, "kind": 0}, {"name": "t", "type": 2, "kind": 1}]}'
    schema = schema_from_json(text)
    assert schema == InputSchema((ColumnSpec("station"), ColumnSpec("t", ColumnType.FLOAT64, ColumnKind.MEASURE)), ";", True)
    assert schema_from_json(schema_to_json(schema)) == schema
    assert schema_from_json("{}").delimiter == ","
    for bad in ('{"delimiter": "::"}', "{", '{"columns": [{"name": "a", "type": 7}]}', '{"columns": [{}]}'):
        with pytest.raises(SchemaError):
            schema_from_json(bad)
    with pytest.raises(FileNotFoundError):
        load_schema_file(str(tmp_path / "none.json"))


@pytest.mark.parametrize("v, text", [(12.25, "12.25"), (0.0, "0"), (-0.0, "-0"), (100.0, "100"), (1e6, "1e+06"), (1234567.5, "1.2345675e+06"), (0.0001, "0.0001"), (0.00001, "1e-05"), (float("nan"), "NaN"), (float("-inf"), "-Inf")])
def test_number_text(v, text):
    assert number(v) == text
