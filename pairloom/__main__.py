"""Commands: prepare, train, grid, aggregate, toy, compare-runs."""

from __future__ import annotations

import argparse
import sys
from dataclasses import MISSING, fields
from typing import get_args, get_origin, get_type_hints

from pyspark.sql import functions as F

from .session import get_spark


def _value(kind):
    """Converter of one option value: positive checks live in the option classes."""
    inner = [a for a in get_args(kind) if a is not type(None)]
    if type(None) in get_args(kind) and inner:
        kind = inner[0]
    if get_origin(kind) is tuple:
        return get_args(kind)[0], "*"
    return (lambda s: s.lower() in ("1", "true", "yes")) if kind is bool else kind, None


def add_options(parser: argparse.ArgumentParser, cls) -> None:
    hints = get_type_hints(cls)
    for f in fields(cls):
        name = "--" + f.name.replace("_", "-")
        if hints[f.name] is bool:
            parser.add_argument(name, action=argparse.BooleanOptionalAction, default=None)
            continue
        kind, nargs = _value(hints[f.name])
        if get_origin(kind) is tuple:  # feature sets: one argument each, blocks joined by +
            kind = lambda s: tuple(s.split("+"))
        parser.add_argument(name, type=kind, nargs=nargs, default=None, required=f.default is MISSING and cls.__name__ != "GridConfig")


def build(cls, args: argparse.Namespace):
    given = {f.name: getattr(args, f.name) for f in fields(cls) if getattr(args, f.name) is not None}
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def main(argv: list[str] | None = None) -> int:
    from .workflow import grid, identity, prepare, toy, train

    parser = argparse.ArgumentParser(prog="pairloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, cls in (("prepare", prepare.PrepareOptions), ("train", train.TrainOptions), ("grid", grid.GridConfig)):
        add_options(commands.add_parser(name), cls)
    commands.choices["grid"].add_argument("--config")
    sub = commands.add_parser("aggregate")
    sub.add_argument("--benchmark-dir", required=True)
    sub.add_argument("--execution-prefix")
    sub = commands.add_parser("toy")
    add_options(sub, toy.ToyOptions)
    sub.add_argument("--out-dir", required=True)
    sub = commands.add_parser("compare-runs")
    sub.add_argument("first")
    sub.add_argument("second")
    args = parser.parse_args(argv)
    try:
        if args.command == "compare-runs":
            found = identity.compare_directories(args.first, args.second)
            for layer, status in found.statuses.items():
                print(f"{layer}: {status}")
            return 0 if found.matches else 1
        spark = get_spark()
        if args.command == "prepare":
            prepare.prepare(spark, build(prepare.PrepareOptions, args))
        elif args.command == "train":
            train.train(spark, build(train.TrainOptions, args))
        elif args.command == "grid":
            options = {f.name: getattr(args, f.name) for f in fields(grid.GridConfig)}
            grid.run_grid(spark, grid.resolve({k: tuple(v) if isinstance(v, list) else v for k, v in options.items()}, args.config))
        elif args.command == "aggregate":
            grid.aggregate(spark, args.benchmark_dir, args.execution_prefix)
        else:
            from .sinks.writers import write_fasta, write_single_csv

            o = build(toy.ToyOptions, args)
            members = toy.proteins(spark, o)
            write_single_csv(toy.pairs(members, o), f"{args.out_dir}/pairs.csv", ["protein_a", "protein_b"])
            write_single_csv(members.select("protein_id", F.col("component_id").cast("string").alias("component_id")), f"{args.out_dir}/components.csv", ["protein_id"])
            write_fasta(members, members, f"{args.out_dir}/proteins.fasta")
    except ValueError as e:
        print(f"pairloom: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
