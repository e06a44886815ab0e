"""Command line: one query over a JSON document or a folder of Parquet tables, rows as NDJSON.

Exit codes: 1 usage or input, 2 a query that can't be compiled, 3 a failure while it runs.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import time

from .errors import QueryError
from .lang.format import format_query


def parse_param(text: str) -> tuple[str, object]:
    """``name=value``: true, false, null, a number, a quoted string, or else the text as it is."""
    name, sep, raw = text.partition("=")
    if not sep or not name.isidentifier():
        raise argparse.ArgumentTypeError(f"a parameter is name=value, not {text!r}")
    if raw in ("true", "false", "null"):
        return name, {"true": True, "false": False, "null": None}[raw]
    if len(raw) >= 2 and raw[0] == raw[-1] == '"':
        return name, raw[1:-1]
    for kind in (int, float):
        try:
            return name, kind(raw)
        except ValueError:
            pass
    return name, raw


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="fernline", description=__doc__.split("\n")[0])
    p.add_argument("input", help="a JSON file, a folder of Parquet tables, or - for standard input")
    p.add_argument("query", help="the query, or @file")
    p.add_argument("-n", "--limit", type=int, help="at most so many rows")
    p.add_argument("-p", "--param", type=parse_param, action="append", default=[], help="name=value for $name")
    p.add_argument("-f", "--format", choices=("ndjson", "json", "csv", "tsv", "table"), default="ndjson")
    p.add_argument("-t", "--typed", action="store_true", help="read JSON into native columns")
    p.add_argument("-s", "--stats", action="store_true", help="also print counts and times to standard error")
    p.add_argument("-S", "--stats-only", action="store_true", help="print the stats and no rows")
    p.add_argument("-e", "--explain", action="store_true", help="show the canonical query and its steps; reads no rows")
    p.add_argument("--format-only", action="store_true", help="show the query in its canonical layout")
    return p.parse_args(argv)


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.appName("fernline")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    try:
        args = arguments(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    text = args.query
    if text.startswith("@"):
        try:
            with open(text[1:], encoding="utf-8") as f:
                text = f.read()
        except OSError as e:
            print(e, file=sys.stderr)
            return 1
    if args.format_only:
        try:
            print(format_query(text))
        except QueryError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    from .engine import Engine
    from .sinks import emit
    from .sources.catalog import Catalog

    staged = None
    try:
        spark, source = session(), args.input
        if source == "-":
            staged = tempfile.NamedTemporaryFile("wb", suffix=".json", delete=False)
            staged.write(sys.stdin.buffer.read())
            staged.close()
            source = staged.name
        try:
            catalog = Catalog.parquet(spark, source) if os.path.isdir(source) else Catalog.json(spark, source, args.typed)
        except QueryError as e:
            print(e.message, file=sys.stderr)
            return 1
        engine, params = Engine(catalog), dict(args.param)
        try:
            if args.explain:
                print(engine.explain(text, params), end="")
                return 0
            lowered = engine.lower(text, params, ordered=True, observe=args.stats or args.stats_only)
        except QueryError as e:
            print(e, file=sys.stderr)
            return 2
        try:
            began, n = time.time(), 0

            def counted():
                nonlocal n
                for v in emit.values(lowered, args.limit):
                    n += 1
                    yield v

            if args.stats_only:
                for _ in counted():
                    pass
            elif args.format == "table":
                print(emit.table(counted()), end="")
            else:
                sys.stdout.writelines(emit.FORMATS[args.format](counted()))
            if args.stats or args.stats_only:
                print(f"rows {n}, scanned {lowered.scanned()}, bytes {lowered.bytes()}, seconds {time.time() - began:.3f}", file=sys.stderr)
        except Exception as e:  # noqa: BLE001
            print(str(e).split("\n")[0], file=sys.stderr)
            return 3
        return 0
    finally:
        if staged is not None:
            os.unlink(staged.name)


if __name__ == "__main__":
    sys.exit(main())
