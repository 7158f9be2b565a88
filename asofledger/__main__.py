"""python -m asofledger COMMAND: audit, contract, canonical, features, load or model. A failure prints one line and exits with 1."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .durable import materialize
from .operators import features
from .plans import pipelines, reports
from .sources import artifact


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="asofledger", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in {"audit": "source report", "contract": "source report", "canonical": "source target", "features": "canonical report", "load": "canonical target", "model": "canonical target"}.items():
        command = commands.add_parser(name)
        for word in words.split():
            command.add_argument(word)
        if name == "canonical":
            command.add_argument("--digest")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("asofledger").getOrCreate()
    try:
        if a.command in ("audit", "contract"):
            with artifact.verified_source(spark, a.source) as found:
                rows = materialize(pipelines.read_canonical(spark, a.source, found.digest), "canonical")
                report = (reports.audit_report if a.command == "audit" else reports.contract_report)(rows, f"{a.report}.tables")
            artifact.write_text(spark, a.report, artifact.stable_json(report | {"source": artifact.as_facts(found)}, default=str))
        elif a.command == "canonical":
            pipelines.canonical_pipeline(spark, a.source, a.target, a.digest)
        elif a.command == "features":
            rows = spark.read.parquet(f"{a.canonical}/canonical")
            artifact.write_text(spark, a.report, artifact.stable_json(reports.feature_report(rows), default=str))
        elif a.command == "load":
            pipelines.load_features(spark, a.canonical, a.target)
        else:
            rows = spark.read.parquet(f"{a.canonical}/canonical")
            keep = ["transaction_id", "source_row_number", "is_fraud", "initiator_balance_before", "recipient_balance_before"]
            pipelines.run_modelling(spark, features.features_by_rollup(rows, keep), a.target, order=("source_row_number", "transaction_id"))
    except Exception as error:
        print(f"{type(error).__name__}: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
