"""Command line: run everything, build one model, check, or show some rows."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import datetime, timezone

from lamina.operators.checks import assert_checks
from lamina.plans.feed import EXECUTION_DATE
from lamina.plans.pipeline import DEPARTMENTS, MODELS, Warehouse, employee_checks, run_pipeline
from lamina.schemas import RAW_EMPLOYEES
from lamina.session import build_session
from lamina.sources import Source, read_seed, read_source


def main(argv: Sequence[str] | None = None) -> None:
    args = _arguments(argv)
    spark = build_session("lamina")
    warehouse = Warehouse(spark, args.base, args.buckets)
    if args.command == "show":
        warehouse.read(args.model).limit(args.rows).show(args.rows, truncate=False)
        return
    if args.command == "build":
        warehouse.build(args.model, args.run_ts, args.execution_date)
        return
    checks = employee_checks(args.departments)
    if args.command == "check":
        found = warehouse.check(checks)
        found.show(len(checks), truncate=False)
        assert_checks(found)
        return
    if args.format == "csv":
        raw = read_seed(spark, args.raw, RAW_EMPLOYEES)
    else:
        raw = read_source(spark, Source("raw_employees", RAW_EMPLOYEES, args.raw))
    found = run_pipeline(
        spark,
        raw,
        args.base,
        args.run_ts,
        args.execution_date,
        checks=checks,
        publish_after_checks=args.publish_after_checks,
        buckets=args.buckets,
        keep=args.keep,
    )
    found.show(len(checks), truncate=False)


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--base", required=True, help="folder of the stored tables")
    shared.add_argument("--buckets", type=int, help="folders of a new keyed table")
    shared.add_argument("--run-ts", default=datetime.now(timezone.utc).isoformat(" ", "seconds"))
    shared.add_argument("--execution-date", default=EXECUTION_DATE)
    shared.add_argument("--departments", nargs="+", default=DEPARTMENTS)

    parser = argparse.ArgumentParser(prog="lamina")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", parents=[shared], help="load, build every model, check")
    run.add_argument("--raw", required=True, help="folder of the raw employees")
    run.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    run.add_argument("--publish-after-checks", action="store_true")
    run.add_argument("--keep", type=int, help="states of each table to keep")
    build = commands.add_parser("build", parents=[shared], help="build one model")
    build.add_argument("model", choices=[m for m in MODELS if m != "raw_employees"])
    commands.add_parser("check", parents=[shared], help="run the assertions")
    show = commands.add_parser("show", parents=[shared], help="print some rows")
    show.add_argument("model", choices=list(MODELS))
    show.add_argument("--rows", type=int, default=5)
    return parser.parse_args(argv)


if __name__ == "__main__":
    main()
