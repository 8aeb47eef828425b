"""python -m kalibra analyze LOG [--fresh PATH] ..., python -m kalibra validate LOG: exit code 1 where a log is not valid."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import analysis, validation
from .operators.tables import owned, written
from .sources import jsonl


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kalibra")
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("analyze", "policy values with intervals"), ("validate", "rules that the log breaks")):
        own = commands.add_parser(name, help=text)
        own.add_argument("log", help="JSON-lines log (a file, a folder or a pattern)")
        own.add_argument("--judge-field", default="judge_score")
        own.add_argument("--oracle-field", default="oracle_label")
    own = commands.choices["analyze"]
    own.add_argument("--fresh", help="JSON-lines fresh draws; needed by doubly robust estimators")
    own.add_argument("--estimator", choices=sorted(analysis.REGISTRY), help="stacked-dr by default, calibrated-ips without fresh draws")
    own.add_argument("--alpha", type=float, default=0.05)
    own.add_argument("--output", help="new folder for the results")
    own.add_argument("--format", choices=("json", "csv"), default="json")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("kalibra").getOrCreate()
    with owned(spark):
        return _run(asked, spark)


def _run(asked: argparse.Namespace, spark: SparkSession) -> int:
    if asked.command == "validate":
        found = written(validation.validate(validation.raw_log(spark, asked.log, asked.judge_field, asked.oracle_field, "reward"), asked.judge_field, asked.oracle_field), "validation")
        for r in found.collect():  # a row a rule
            print(f"{r.level}: {r.rule} ({r.n} of {r.of})")
        valid = validation.is_valid(found)
        print("valid" if valid else "not valid")
        return 0 if valid else 1
    values = written(analysis.analyze(spark, asked.log, asked.fresh, asked.estimator, asked.judge_field, asked.oracle_field, asked.alpha), "values")
    for r in values.orderBy("policy").collect():  # a row a policy
        print(f"{r.policy}: {r.estimate:.4f} (error {r.se:.4f}, {r.lo:.4f} to {r.hi:.4f})")
    if asked.output:
        jsonl.write_results(values, asked.output, asked.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
