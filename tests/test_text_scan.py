import io

import pytest
from pyspark.sql import Observation

from tallyframe import AggSpec, Engine, InputSchema, SchemaError, SpecError
from tallyframe.cli import main
from tallyframe.model import ColumnSpec, ColumnType
from tallyframe.sources.text_scan import TextScan
from tallyframe.streaming import spool

CITY = InputSchema((ColumnSpec("city"), ColumnSpec("temp", ColumnType.FLOAT64)), ",", True)
S, I, D = ColumnType.STRING, ColumnType.INT64, ColumnType.FLOAT64


def write(tmp_path, data):
    p = tmp_path / "in.txt"
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def rows(spark, path, schema, **more):
    return sorted(tuple(r) for r in TextScan(spark, path, schema, **more).rows().collect())


def of(*types, **more):
    return InputSchema(tuple(ColumnSpec(f"c{i}", t) for i, t in enumerate(types)), **more)


def test_skip_and_fail(spark, tmp_path):
    path = write(tmp_path, "city,temp\nQuito,14.5\nalone\nLima,warm\nCusco,11\n")
    assert rows(spark, path, CITY) == [("Cusco", 11.0), ("Quito", 14.5)]
    bad = sorted((r.line_no, r.reason) for r in TextScan(spark, path, CITY).rejects().collect())
    assert bad == [(2, "expected 2 fields, got 1"), (3, "column temp: not a float64: warm")]
    with pytest.raises(Exception, match="malformed row"):
        rows(spark, path, CITY, on_error="fail")
    with pytest.raises(Exception, match="malformed row"):  # the bad column is not used
        Engine(spark, path, CITY, "fail").query("SELECT count(*)").collect()
    assert Engine(spark, path, CITY).query("SELECT count(*)").collect()[0][0] == 2
    with pytest.raises(SpecError):
        TextScan(spark, path, CITY, "ignore")


def test_lines(spark, tmp_path):
    path = write(tmp_path, b"a\nbb\r\nc\rc\nd\r\r\n\nlast \xff")
    got = [bytes(r[0]) for r in TextScan(spark, path, of(S)).rows().selectExpr("cast(c0 as binary)").collect()]
    assert sorted(got) == sorted([b"a", b"bb", b"c\rc", b"d\r", b"", b"last \xff"])


def test_blank_lines_and_empty_fields(spark, tmp_path):
    path = write(tmp_path, "a,1\n\n,2\nb,\n")
    assert rows(spark, path, of(S, I)) == [("", 2), ("a", 1)]


@pytest.mark.parametrize("text, good", [("5", True), ("+5", True), ("-007", True), (" 42 ", False), ("4.0", False), ("", False), ("9223372036854775808", False), ("0x1f", False), ("5\r", True)])
def test_integers(spark, tmp_path, text, good):
    assert len(rows(spark, write(tmp_path, f"k,{text}\n"), of(S, I))) == good


@pytest.mark.parametrize("text, good", [("2.5", True), (".5", True), ("5.", True), ("1e3", True), ("inf", True), ("-Infinity", True), ("NaN", True), ("1e999", False), ("1.0f", False), ("1.0d", False), (" 2.5", False), ("1_000", False), ("", False), (".", False)])
def test_floats(spark, tmp_path, text, good):
    assert len(rows(spark, write(tmp_path, f"k,{text}\n"), of(S, D))) == good


@pytest.mark.parametrize(
    "line, want",
    [
        ('"a,b",c', ("a,b", "c")),
        ('"say ""hi""",x', ('say "hi"', "x")),
        ('"",x', ("", "x")),
        (",x", ("", "x")),
        ('mid"quote,x', ('mid"quote', "x")),
        ('"bad"x,y', None),
        ('"open,y', None),
        ("a,b,c", None),
        ("a,", ("a", "")),
        ('"' + "q" * 20_000 + '",z', ("q" * 20_000, "z")),
    ],
)
def test_quoted(spark, tmp_path, line, want):
    assert rows(spark, write(tmp_path, line + "\n"), of(S, S, quote_aware=True)) == ([want] if want else [])


def test_quoted_numbers(spark, tmp_path):
    assert rows(spark, write(tmp_path, '"5","1.5"\n" 5",2\n'), of(I, D, quote_aware=True)) == [(5, 1.5)]


@pytest.mark.parametrize("d", [";", "|", "\t", "^", "]", "-", "\\", ".", "x"])
def test_delimiters(spark, tmp_path, d):
    path = write(tmp_path, f"a{d}1\nb{d}2\n")
    for quoted in (False, True):
        assert rows(spark, path, of(S, I, delimiter=d, quote_aware=quoted)) == [("a", 1), ("b", 2)]


def test_header_once_over_many_splits(spark, tmp_path):
    path = write(tmp_path, "id,value\n" + "".join(f"r{i},{i + 0.5}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        schema = InputSchema((ColumnSpec("id"), ColumnSpec("value", D)), ",", True)
        scan = TextScan(spark, path, schema)
        assert scan.rows().rdd.getNumPartitions() > 3
        assert scan.rows().count() == 5000 and scan.rejects().count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_inference(spark, tmp_path):
    path = write(tmp_path, "city,temp\r\nQuito,1\n")
    engine = Engine(spark, path)
    assert [c.name for c in engine.schema.columns] == ["city", "temp"]
    assert [tuple(r) for r in engine.query("SELECT city GROUP BY city").collect()] == [("Quito", 1)]
    empty = write(tmp_path, "")
    assert Engine(spark, empty).schema.columns == ()
    assert TextScan(spark, empty, InputSchema(has_header=True)).rows().count() == 0
    with pytest.raises(SchemaError):
        Engine(spark, path, InputSchema())


def test_header_only(spark, tmp_path):
    assert Engine(spark, write(tmp_path, "city,temp\n"), CITY).run(AggSpec.of([], temp="sum")).collect() == []


def test_observed_counts(spark, tmp_path):
    path, seen = write(tmp_path, "city,temp\na,1\nb\nc,3\n"), Observation("t")
    assert len(Engine(spark, path, CITY).run(AggSpec(("city",)), observation=seen).collect()) == 2
    assert seen.get == {"rows": 2, "skipped": 1}


def test_spool(spark, tmp_path):
    path = spool(io.BytesIO(b"city,temp\na,1\n"), str(tmp_path))
    assert rows(spark, path, CITY) == [("a", 1.0)]


def test_cli(spark, tmp_path, capsys):
    path = write(tmp_path, "Quito;14.5\nLima;19\nQuito;13.1\nbad\n")
    schema = tmp_path / "s.json"
    schema.write_text('{"delimiter": ";", "columns": [{"name": "station", "type": 0}, {"name": "t", "type": 2}]}')
    assert main(["run", "--file", path, "--schema", str(schema), "--group-by", "station", "--measure", "t:min,max"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[:2] == ["station=Lima count=1 min(t)=19 max(t)=19", "station=Quito count=2 min(t)=13.1 max(t)=14.5"]
    assert out[2].startswith("rows=3 skipped=1 ")
    assert main(["query", "--file", path, "--schema", str(schema), "--quiet", "SELECT avg(t)"]) == 0
    assert capsys.readouterr().out.startswith("count=3 avg(t)=15.53")
    assert main(["ingest", "--file", path, "--schema", str(schema)]) == 0
    assert "skipped=1" in capsys.readouterr().out
    assert main(["query", "--file", path, "--schema", str(schema), "SELECT nope"]) == 1
    with pytest.raises(SystemExit) as e:
        main(["nope"])
    assert e.value.code == 2


def test_generate(spark, tmp_path):
    assert main(["generate", "--rows", "2000", "--sensors", "10", "--out", str(tmp_path / "g")]) == 0
    schema = InputSchema((ColumnSpec("station"), ColumnSpec("t", D), ColumnSpec("s")), ";")
    got = Engine(spark, str(tmp_path / "g"), schema).query("SELECT count(*), distinct(s), distinct(station)").collect()[0]
    assert got[0] == 2000 and got[1] == 10 and got[2] == 104
