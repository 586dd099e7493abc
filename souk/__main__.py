"""python -m souk COMMAND: one job, one JSON line. Exit 1: an input layer or file is missing, or a check failed."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from souk.plans import alerts, flow, status, warehouse
from souk.plans.jobs import TABLES, Jobs, MissingTables, Settings, new_run_id
from souk.sources.csv_export import MissingFiles
from souk.sources.files import Files
from souk.sources.records import FIELDS

#: The commands with their options. An option is a flag, or takes a day, a number or one of some words.
OPTIONS = {
    "bronze-api": {"entity": ("all", *FIELDS), "full": bool, "lookback-minutes": 10},
    "bronze-marketplace": {"date": dt.date, "from": dt.date, "until": dt.date, "all": bool, "skip-missing": bool},
    "bronze-events": {"continuous": bool, "max-offsets": 100_000, "interval-seconds": 15},
    "silver": {},
    "gold": {},
    "quality": {},
    "warehouse-load": {},
    "warehouse-build": {"full": bool},
    "lineage": {},
    "freshness": {},
    "status": {"layer": ("all", *TABLES), "json": bool},
    "daily": {"date": dt.date},
    "warmup": {},
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="souk", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for command, options in OPTIONS.items():
        own = commands.add_parser(command)
        for name, kind in options.items():
            if kind is bool:
                how = {"action": "store_true"}
            elif kind is dt.date:
                how = {"type": dt.date.fromisoformat}
            elif isinstance(kind, int):
                how = {"type": int, "default": kind}
            else:
                how = {"choices": kind, "default": kind[0]}
            own.add_argument(f"--{name}", dest=name.replace("-", "_"), **how)
    return top


@dataclass(frozen=True)
class Days:
    """The days that an export load is about. every: all files there are; no day at all means yesterday."""

    first: dt.date | None = None
    last: dt.date | None = None
    every: bool = False

    @classmethod
    def of(cls, day: dt.date | None, first: dt.date | None, last: dt.date | None, every: bool) -> Days:
        ways = [name for name, told in (("--all", every), ("--date", day), ("--from/--until", first or last)) if told]
        if len(ways) > 1:
            raise ValueError(f"{' and '.join(ways)} exclude each other")
        begin, end = sorted_ends(day or first, day or last)
        return cls(begin, end, every)


def sorted_ends(first: dt.date | None, last: dt.date | None) -> tuple[dt.date | None, dt.date | None]:
    """Both ends, one standing for the other where only one is told."""
    first, last = first or last, last or first
    if first and first > last:
        raise ValueError(f"the first day, {first}, comes after the last, {last}")
    return first, last


def checked(argv: Sequence[str] | None) -> argparse.Namespace:
    top = parser()
    args = top.parse_args(argv)
    if args.command == "bronze-marketplace":
        try:
            args.days = Days.of(args.date, getattr(args, "from"), args.until, args.all)
        except ValueError as e:
            top.error(str(e))
    return args


def say(summary: object) -> None:
    print(json.dumps(summary, ensure_ascii=False, default=str), flush=True)


def _one(of: str, every: Sequence[str]) -> tuple[str, ...]:
    return tuple(every) if of == "all" else (of,)


def _status(args: argparse.Namespace, jobs: Jobs) -> None:
    report = jobs.status(_one(args.layer, tuple(TABLES)))
    say({"tables": report}) if args.json else print(status.render(report), flush=True)


def _daily(args: argparse.Namespace, jobs: Jobs) -> dict:
    run_id = new_run_id()
    with flow.lease(Files(jobs.spark), f"{jobs.lake.root}/_leases/daily", run_id):
        ended = flow.run(jobs.daily(args.date))
    for x in ended.values():
        say({"step": x.name, "state": x.state, "tries": x.tries, "error": x.error, "summary": x.summary})
    raised = alerts.raise_alerts("daily", run_id, ended.values())
    return {"job": "daily", "run_id": run_id, "steps": len(ended), "failed": sum(x.state != flow.DONE for x in ended.values()), "alerts": raised}


HANDLERS: dict[str, Callable[[argparse.Namespace, Jobs], dict | None]] = {
    "bronze-api": lambda a, j: j.bronze_api(_one(a.entity, tuple(FIELDS)), a.full, a.lookback_minutes),
    "bronze-marketplace": lambda a, j: j.bronze_marketplace(a.days.first, a.days.last, a.days.every, a.skip_missing),
    "bronze-events": lambda a, j: j.bronze_events(a.continuous, a.max_offsets, a.interval_seconds),
    "silver": lambda a, j: j.silver(),
    "gold": lambda a, j: j.gold(),
    "quality": lambda a, j: j.quality(),
    "warehouse-load": lambda a, j: j.warehouse_load(),
    "warehouse-build": lambda a, j: j.warehouse_build(full=a.full),
    "lineage": lambda a, j: {"job": "lineage", "order": warehouse.models().order, "edges": warehouse.models().edges()},
    "freshness": lambda a, j: j.freshness(),
    "status": _status,
    "daily": _daily,
    "warmup": lambda a, j: {"job": "warmup", "spark": j.spark.version},
}


def main(argv: Sequence[str] | None = None) -> int:
    args = checked(argv)
    spark = SparkSession.builder.appName(f"souk-{args.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        summary = HANDLERS[args.command](args, Jobs(spark, Settings()))
        if summary is not None:
            say(summary)
        return int(bool((summary or {}).get("failed")))
    except (MissingTables, MissingFiles, flow.Held) as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
