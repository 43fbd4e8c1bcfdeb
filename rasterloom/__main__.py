"""Command line: run graphs and pipelines, and look at what there is.

    python -m rasterloom graph GRAPH.json --scenes PATH --pixels PATH --out PATH
    python -m rasterloom etl --format csv --path FILE --table NAME --warehouse DIR [--sql SQL] [--dedupe COLUMN]
    python -m rasterloom validate GRAPH.json
    python -m rasterloom processes | formats
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from .plans import catalogue


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("rasterloom")
    commands = parser.add_subparsers(dest="command", required=True)
    graph = commands.add_parser("graph")
    graph.add_argument("file")
    for name in ("--scenes", "--pixels", "--out"):
        graph.add_argument(name, required=True)
    graph.add_argument("--order", default="cloud", choices=["cloud", "time"])
    commands.add_parser("validate").add_argument("file")
    etl = commands.add_parser("etl")
    for name in ("--format", "--path", "--table", "--warehouse"):
        etl.add_argument(name, required=True)
    for name in ("--sql", "--dedupe"):
        etl.add_argument(name)
    etl.add_argument("--delimiter", default=",")
    commands.add_parser("processes")
    commands.add_parser("formats")
    args = parser.parse_args(argv)

    if args.command == "processes":
        print(json.dumps(catalogue.processes()))
    elif args.command == "formats":
        print(json.dumps(catalogue.file_formats()))
    elif args.command == "validate":
        from .plans.executor import validate

        with open(args.file) as f:
            errors = validate(json.load(f))
        print(json.dumps(errors))
        return int(bool(errors))
    else:
        from . import session

        spark = session.build()
        if args.command == "etl":
            from .etl.pipeline import Engine, PipelineSpec

            status = Engine(spark, args.warehouse).run(PipelineSpec(args.format, args.path, args.table, args.sql, args.dedupe, delimiter=args.delimiter))
            print(json.dumps(asdict(status)))
            return int(status.state != "completed")
        from .plans.executor import execute
        from .sinks.result import Result
        from .sources.scenes import loader

        with open(args.file) as f:
            document = json.load(f)
        value = execute(spark, document, loader(spark.read.parquet(args.scenes), spark.read.parquet(args.pixels), args.order))
        result = value if isinstance(value, Result) else Result.of(value)
        print(json.dumps({"written": result.write(args.out), "format": result.format}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
