"""python -m tallyframe ingest | run | query | serve | generate. Exit codes: 2 usage, 1 run-time error."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import Observation, SparkSession

from tallyframe.errors import EngineError
from tallyframe.model import AggSpec, InputSchema, MeasureSpec
from tallyframe.plans.engine import Engine
from tallyframe.plans.grammar import parse
from tallyframe.render import lines
from tallyframe.sources.schema_file import infer_from_header, load_schema_file
from tallyframe.sources.text_scan import POLICIES, TextScan
from tallyframe.storage import fresh_path
from tallyframe.streaming import spool


def session(args) -> SparkSession:
    builder = SparkSession.builder.appName("tallyframe").config("spark.sql.session.timeZone", "UTC")
    workers = args.workers or args.chunks
    if args.master or workers:
        builder = builder.master(args.master or f"local[{workers}]")
    return builder.config("spark.ui.enabled", "false").getOrCreate()


def source(args, spark: SparkSession) -> str:
    if args.file not in ("", "-"):
        return args.file
    local, shared = spool(sys.stdin.buffer), fresh_path(spark, "spool") + ".txt"
    hadoop = spark._jvm.org.apache.hadoop.fs
    hadoop.Path(shared).getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, hadoop.Path(local), hadoop.Path(shared))
    return shared


def ingest(args) -> None:
    schema = load_schema_file(args.schema) if args.schema else InputSchema((), args.delimiter, not args.no_header)
    spark = session(args)
    path = source(args, spark)
    began = time.time()
    schema = infer_from_header(spark, path, schema)
    if not schema.columns:
        print(f"rows=0 skipped=0 elapsed={time.time() - began:.3f}s rows/sec=0")
        return
    seen = Observation("ingest")
    scan = TextScan(spark, path, schema, args.on_error, args.chunks)
    scan.observed(seen).write.format("noop").mode("overwrite").save()
    if not args.quiet:
        for r in scan.rejects().toLocalIterator():
            print(f"skipped line {r.line_no}: {r.reason}", file=sys.stderr)
    report(seen.get, began)


def report(counts: dict, began: float, more: str = "") -> None:
    s = time.time() - began
    print(f"rows={counts['rows']} skipped={counts['skipped']} elapsed={s:.3f}s rows/sec={counts['rows'] / s:.0f}{more}")


def run(args) -> None:
    schema = load_schema_file(args.schema)
    spec = AggSpec(tuple(args.group_by.split(",")) if args.group_by else (), tuple(MeasureSpec.parse(m) for m in args.measure))
    spec.validate(schema)  # before the file is opened
    show(args, schema, spec)


def query(args) -> None:
    spec = parse(args.text)
    schema = load_schema_file(args.schema)
    spec.validate(schema)
    show(args, schema, spec)


def show(args, schema: InputSchema, spec: AggSpec) -> None:
    spark = session(args)
    began, seen = time.time(), Observation("run")
    engine = Engine(spark, source(args, spark), schema, args.on_error, min_partitions=args.chunks)
    for line in lines(engine.run(spec, observation=seen).collect(), spec):
        print(line)
    if not args.quiet:
        report(seen.get, began, f" workers={spark.sparkContext.defaultParallelism}")


def serve(args) -> None:
    """One query a line from standard input, answered against one file until the input ends."""
    schema = load_schema_file(args.schema)
    spark = session(args)
    engine = Engine(spark, args.file, schema, args.on_error)
    for text in sys.stdin:
        if not text.strip():
            continue
        began = time.time()
        try:
            spec = parse(text)
            for line in lines(engine.run(spec).toLocalIterator(), spec):
                print(line)
            print(f"elapsed={time.time() - began:.3f}s", flush=True)
        except EngineError as e:
            print(f"error: {e}", flush=True)


def generate(args) -> None:
    from tallyframe.synth import readings, write_text

    write_text(readings(session(args), args.rows, args.seed, args.stddev, args.sensors), args.out)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tallyframe")
    commands = top.add_subparsers(dest="command", required=True)
    for name, f in (("ingest", ingest), ("run", run), ("query", query), ("serve", serve), ("generate", generate)):
        p = commands.add_parser(name)
        p.set_defaults(f=f)
        p.add_argument("--master")
        p.add_argument("--chunks", type=int)
        p.add_argument("--workers", type=int)
        if name == "generate":
            p.add_argument("--rows", type=int, default=1_000_000)
            p.add_argument("--out", required=True)
            p.add_argument("--seed", type=int, default=42)
            p.add_argument("--stddev", type=float, default=10.0)
            p.add_argument("--sensors", type=int, default=0)
            continue
        p.add_argument("--file", default="-", required=name == "serve")
        p.add_argument("--schema", required=name != "ingest")
        p.add_argument("--on-error", choices=POLICIES, default="skip")
        p.add_argument("--quiet", action="store_true")
        p.add_argument("--batch-size", type=int, help="accepted; Spark sizes its own batches")
        p.add_argument("--buffer-size", type=int, help="accepted; Spark sizes its own buffers")
        if name == "ingest":
            p.add_argument("--delimiter", default=",")
            p.add_argument("--no-header", action="store_true")
        if name == "run":
            p.add_argument("--group-by", default="")
            p.add_argument("--measure", action="append", default=[])
        if name == "query":
            p.add_argument("text")
    args = top.parse_args(argv)
    try:
        args.f(args)
    except Exception as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0
