"""Command line: ``python -m corpusloom consolidate|by-dataset|verify|training …`` (or spark-submit)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import stats
from .plans import consolidate as jobs, training, verify
from .session import ship_code
from .sinks import writers
from .sources import inventory


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corpusloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("consolidate", "by-dataset", "verify", "training", "inventory"):
        command = commands.add_parser(name)
        command.add_argument("--root", required=name != "training", help="folder of the input files")
        command.add_argument("--output", required=True, help="folder to write to")
        command.add_argument("--corpus", required=name in ("verify", "training"), help="written corpus")
        command.add_argument("--seed", default="42")
        command.add_argument("--shard-size", type=int, default=0)
        command.add_argument("--formats", nargs="+", default=["jsonl"], choices=writers.OUTPUT_FORMATS)
        command.add_argument("--fuzzy-threshold", type=float, default=1.0)
        command.add_argument("--no-variants", action="store_true")
    return parser


def main(arguments: list[str] | None = None) -> int:
    args = _parser().parse_args(arguments)
    spark = ship_code(SparkSession.builder.appName("corpusloom").getOrCreate())
    if args.command == "consolidate":
        split = jobs.consolidate(
            spark, args.root, args.output, create_variants=not args.no_variants, shard_size=args.shard_size,
            output_formats=tuple(args.formats), seed=args.seed, fuzzy_threshold=args.fuzzy_threshold)
        stats.split_sizes(split).show()
    elif args.command == "by-dataset":
        stats.split_sizes(jobs.consolidate_by_dataset(spark, args.root, args.output, args.seed)).show()
    elif args.command == "inventory":
        files = inventory.list_files(spark, args.root, args.output)
        writers.write_inventory(inventory.estimated_rows(spark, args.root, files), args.output)
        inventory.totals(files).show()
    elif args.command == "training":
        training.prepare_training(spark, args.corpus, args.output)
    else:
        report = verify.verify(spark, args.root, args.corpus, args.output)
        for name in ("summary", "coverage", "quality"):
            report[name].show(200, truncate=False)
        return 0 if verify.is_accepted(report["summary"]) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
