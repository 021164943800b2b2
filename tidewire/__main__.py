"""python -m tidewire: analyses of capture files from the command line.

    python -m tidewire analyze CAPTURE... --out FOLDER [--only timing,security] [--format csv|json|parquet]
    python -m tidewire list
    python -m tidewire show-config
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .sources import ranges
from .thresholds import Thresholds


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewire", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze", help="read captures, write the tables of the analyses")
    a.add_argument("captures", nargs="+", help="capture files or folders")
    a.add_argument("--out", required=True, help="folder for the tables, one folder each")
    a.add_argument("--only", help="analyses, separated by commas (default: all)")
    a.add_argument("--format", choices=("csv", "json", "parquet"), default="csv")
    a.add_argument("--src", help="packets from or to this address only")
    a.add_argument("--dst", help="packets from or to this address only, besides --src")
    a.add_argument("--port", type=int, help="packets from or to this port only")
    a.add_argument("--latency", type=float, help="seconds that count as a slow handshake and a long round trip")
    a.add_argument("--config", help="JSON file of thresholds by name")
    a.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="one threshold; may be given several times")
    a.add_argument("--show", type=int, default=0, metavar="N", help="print the first N rows of each table, too")
    a.add_argument("--max-bytes", type=int, help="report larger captures as faulty, and leave them out")
    a.add_argument("--block", type=int, default=ranges.BLOCK, help="bytes of a capture that a task reads")
    commands.add_parser("list", help="names of the analyses")
    c = commands.add_parser("show-config", help="thresholds as JSON")
    c.add_argument("--config")
    c.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    return p


def thresholds_of(config: str | None, settings: Sequence[str], latency: float | None = None) -> Thresholds:
    """Defaults, then a JSON file, then single settings, then the latency."""
    values: dict = {}
    if config:
        with open(config) as f:
            values |= json.load(f)
    for s in settings:
        name, _, value = s.partition("=")
        values[name] = json.loads(value)
    if latency is not None:
        values |= {"handshake_total_s": latency, "rtt_warning_s": latency}
    known = {f.name: type(f.default) for f in dataclasses.fields(Thresholds)}
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise ValueError(f"unknown thresholds: {', '.join(unknown)}")
    return Thresholds().override(**{k: known[k](v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for k, v in values.items()})


def narrowed(p: DataFrame, src: str | None, dst: str | None, port: int | None) -> DataFrame:
    """Packets of both directions between the ends that are asked for."""
    for ip in (src, dst):
        if ip is not None:
            p = p.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    return p if port is None else p.where((F.col("src_port") == port) | (F.col("dst_port") == port))


def analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    t = thresholds_of(args.config, args.set, args.latency)
    table = ranges.range_table(spark, args.captures, args.block)
    bad = ranges.capture_problems(table, args.max_bytes).orderBy("file").collect()  # one row a file that has a fault
    for r in bad:
        print(f"{r.file}: {r.problem}", file=sys.stderr)
    p = ranges.read_ranges(spark, args.captures, args.block)
    large = [r.file for r in bad if r.problem == "too large"]
    p = narrowed(p.where(~F.col("file").isin(large)) if large else p, args.src, args.dst, args.port)

    def write(name: str, df: DataFrame) -> None:
        w = df.write.mode("overwrite").format(args.format)
        (w.option("header", True) if args.format == "csv" else w).save(f"{args.out}/{name}")
        print(name)
        if args.show:
            df.show(args.show, truncate=False)

    _, problems = registry.run(p, args.only.split(",") if args.only else None, t, write)
    failed = problems.collect()
    for r in failed:
        print(f"{r.analysis}: {r.error}", file=sys.stderr)
    return 1 if failed else 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(registry.REGISTRY))
        return 0
    if args.command == "show-config":
        print(json.dumps(dataclasses.asdict(thresholds_of(args.config, args.set)), indent=2))
        return 0
    return analyze(spark or SparkSession.builder.appName("tidewire").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
