"""Command line: python -m locusframe.cli COMMAND STORE ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans.store import Store
from .plans.validation import validate


def emit(rows: DataFrame, form: str) -> None:
    """Row by row, never as a whole on the driver."""
    if form == "tsv":
        print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join("." if v is None else str(v) for v in r) if form == "tsv" else json.dumps(r.asDict(), default=str))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="locusframe")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("store")
        for a in arguments:
            p.add_argument(a)
        p.add_argument("--observed-only", action="store_true")
        p.add_argument("--format", choices=("tsv", "json"), default="tsv")
        p.add_argument("--resolve", action="store_true")
        return p

    command("info")
    command("validate")
    command("query-analysis", "analysis").add_argument("--subset")
    command("query-phewas", "identifier")
    command("query-range-phewas", "chromosome", "start", "end")
    look = command("query-lookup")
    look.add_argument("--variants", nargs="+", required=True)
    look.add_argument("--analyses", nargs="+", required=True)
    hits = command("query-top-hits")
    hits.add_argument("--threshold", type=float, default=5e-8)
    hits.add_argument("--limit", type=int)
    command("build-rho")
    subset = command("build-subset", "name")
    subset.add_argument("--list", required=True, help="a text file of canonical keys")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("locusframe").getOrCreate()
    store = Store.open(spark, args.store)
    if args.command == "info":
        print(json.dumps(vars(store.manifest), indent=1))
        return 0
    if args.command == "validate":
        broken = validate(store)
        for rule, rows in broken.items():
            print(rule, *rows, sep="\n  ")
        return int(bool(broken))
    if args.command == "build-rho":
        store.build_rho()
        return 0
    if args.command == "build-subset":
        store.build_subset(args.name, spark.read.text(args.list).withColumnRenamed("value", "alid"))
        return 0
    rows = {
        "query-analysis": lambda: store.analysis(args.analysis, args.observed_only, args.subset),
        "query-phewas": lambda: store.phewas(args.identifier, args.observed_only),
        "query-range-phewas": lambda: store.range_phewas(args.chromosome, int(args.start), int(args.end), args.observed_only),
        "query-lookup": lambda: store.lookup(args.variants, args.analyses, args.observed_only),
        "query-top-hits": lambda: store.top_hits(None, args.threshold, args.limit, args.observed_only),
    }[args.command]()
    emit(store.resolve(rows) if args.resolve else rows, args.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
