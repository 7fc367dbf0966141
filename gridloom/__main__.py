"""python -m gridloom check|receipt|census|monte|diff: the operators over workbook files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gridloom.functions.random import parse_distribution
from gridloom.operators import census, diff, lint, receipt, report, scenario
from gridloom.sources import xlsx


def main(argv: list[str]) -> int:
    top = argparse.ArgumentParser(prog="gridloom")
    sub = top.add_subparsers(dest="verb", required=True)
    for verb in ("check", "receipt", "census"):
        p = sub.add_parser(verb)
        p.add_argument("path")
        p.add_argument("--baseline")
        p.add_argument("--write-baseline")
        p.add_argument("--ci", action="store_true")
        p.add_argument("--json")
    p = sub.add_parser("monte")
    p.add_argument("path")
    p.add_argument("--input", action="append", required=True, help='such as "Sheet!A1=normal(50,5)"')
    p.add_argument("--watch", action="append")
    p.add_argument("-n", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=1)
    p = sub.add_parser("diff")
    p.add_argument("one")
    p.add_argument("two")
    p.add_argument("--watch", required=True)
    p.add_argument("-n", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=1)
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    book = lambda path: xlsx.File(open(path, "rb").read()).workbook()  # noqa: E731, SIM115
    if args.verb in ("check", "receipt", "census"):
        cells = xlsx.read_binary(xlsx.binaries(spark, args.path)).persist()
        if args.verb == "census":
            census.census(census.combos(cells)).show(100, truncate=False)
            return 0
        if args.verb == "receipt":
            row = receipt.summary(receipt.report(cells)).first().asDict()
            print(row)
            if args.json:
                report.write_json(row, args.json)
            return 0
        found = lint.findings(cells)
        if args.baseline:
            found = lint.new_findings(found, spark.read.parquet(args.baseline))
        if args.write_baseline:
            report.baseline(found, args.write_baseline)
        print(report.diagnostics(found))
        return int(args.ci and bool(found.take(1)))
    if args.verb == "monte":
        own = book(args.path)
        inputs = [(scenario.cell_of(own, name), parse_distribution(d)) for name, _, d in (x.partition("=") for x in args.input)]
        watch = [scenario.cell_of(own, w) for w in args.watch] if args.watch else None
        rows = scenario.monte_carlo(spark, own, inputs, args.n, args.seed, watch)
        scenario.statistics(rows, by=["cell"]).show(truncate=False)
        return 0
    one, two = book(args.one), book(args.two)
    print(diff.report(spark, one, two, diff.default_inputs(one, two), scenario.cell_of(one, args.watch), args.n, args.seed))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
