"""Command line: ``python -m borespark COMMAND ...``; results are printed as JSON lines."""

from __future__ import annotations

import argparse
import dataclasses
import json
from pathlib import Path

from borespark.session import get_session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="borespark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("operators", help="the operator catalog")
    layouts = commands.add_parser("trace-operators", help="trace operators for a layout")
    layouts.add_argument("layout", choices=["post_stack", "prestack_offset"])
    for name, text in (("inspect-segy", "layout of a trace file"), ("scan", "kinds of the files of a folder"), ("log-headers", "header items of log files"), ("validate-recipe", "faults of a recipe"), ("run-recipe", "runs a recipe and prints its report")):
        commands.add_parser(name, help=text).add_argument("path")
    query = commands.add_parser("query", help="a registered query over a folder of tables")
    query.add_argument("name")
    query.add_argument("path")
    for name, text in (("ingest", "imports a well folder, a trace file or an array"), ("ingest-gathers", "imports a prestack trace file")):
        command = commands.add_parser(name, help=text)
        command.add_argument("path")
        command.add_argument("out")
    commands.add_parser("capabilities", help="what can be used here, and why not")
    commands.add_parser("search-crs", help="coordinate systems by words or code").add_argument("text")
    commands.add_parser("estimate-array", help="traces, chunks and bytes of an array").add_argument("path")
    given = parser.parse_args(arguments)

    def show(rows) -> int:
        for row in rows:
            print(json.dumps(row, default=str))
        return 0

    if given.command == "inspect-segy":
        from borespark.sources.segy import inspect

        return show([{k: v for k, v in dataclasses.asdict(inspect(given.path)).items() if k != "textual"}])
    if given.command == "validate-recipe":
        from borespark.plans.recipes import validate
        from borespark.plans.registry import built_in

        faults = validate(json.loads(Path(given.path).read_text()), built_in())
        return show([{"fault": f} for f in faults]) or int(bool(faults))
    if given.command == "capabilities":
        from borespark.plans.registry import built_in, capabilities

        return show(dataclasses.asdict(r) for r in capabilities(built_in()).records.values())
    spark = get_session(name="borespark-cli")
    if given.command == "query":
        from borespark.plans import workload, workload_frames, workload_more, workload_sources, workload_traces  # noqa: F401

        return show(r.asDict(recursive=True) for r in workload.QUERIES[given.name](spark, given.path).toLocalIterator())
    if given.command in ("ingest", "ingest-gathers"):
        from borespark.sources import folder, segy

        if given.command == "ingest":
            return show(r.asDict() for r in folder.ingest(spark, given.path, given.out).collect())
        return show([segy.ingest_gathers(spark, given.path, given.out)])
    if given.command == "search-crs":
        from borespark.functions import crs

        return show(r.asDict() for r in crs.search(crs.catalogue(spark), given.text).collect())
    if given.command == "estimate-array":
        from borespark.sources import zarr

        return show([zarr.estimate(zarr.read_meta(spark, given.path))])
    if given.command == "operators":
        from borespark.plans.registry import built_in

        return show(r.asDict() for r in built_in().catalog(spark).collect())
    if given.command == "trace-operators":
        from borespark.plans.views import trace_operators

        return show(r.asDict() for r in trace_operators(spark, given.layout).collect())
    if given.command == "scan":
        from borespark.sources.folder import scan_folder

        return show(r.asDict() for r in scan_folder(spark, given.path).toLocalIterator())
    if given.command == "log-headers":
        from borespark.sources.logs import read_log_headers

        return show(r.asDict() for r in read_log_headers(spark, given.path).toLocalIterator())
    from borespark.plans.recipes import run

    _, report = run(spark, json.loads(Path(given.path).read_text()))
    print(report.to_markdown())
    return int(bool(report.failures))


if __name__ == "__main__":
    raise SystemExit(main())
