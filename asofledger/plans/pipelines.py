"""End-to-end jobs: canonical publishing, feature loading, and modelling."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import discard, exists, materialize
from ..functions.identity import code_identity
from ..functions.patterns import evaluation_partition
from ..operators import features, integrity, metrics, modelling, validation
from ..operators.contract import partition_counts
from ..schema import CANONICAL_SCHEMA
from ..sources import artifact, csv_source


def read_canonical(spark: SparkSession, path: str, artifact_sha256: str) -> DataFrame:
    """Strictly read, validated and typed rows; raises for the first row that breaks a rule, before anything is derived."""
    rows = csv_source.read_strict(spark, path)
    return validation.canonical(rows, artifact_sha256, validation.checked(rows)[0])


def canonical_pipeline(spark: SparkSession, source: str, target: str, digest: str | None = None, contract: artifact.ArtifactContract | None = None) -> dict:
    """Verify the source, type its rows, write them, read them back, hold them against the contract, and publish all of it or nothing."""
    artifact.require_apart(spark, source, target)
    contract = contract or artifact.ArtifactContract(sha256=digest)

    def produce(staging: str) -> dict:
        with artifact.verified_source(spark, source, contract=contract) as found:
            text = csv_source.read_strict(spark, source)
            sums = validation.write_checked(text, found.digest, f"{staging}/canonical", artifact.row_sums)
            written = spark.read.parquet(f"{staging}/canonical")
            validation.require_as_read(written, found.digest, artifact.row_sums, sums)
            integrity.require(written, "canonical")
            tallies = materialize(validation.tallied(written), "tallies")
            counts = validation.counted(tallies, written).first().asDict()
            if not counts["contiguous"] and counts["n_rows"]:
                raise integrity.IntegrityError("row numbers are not contiguous")
            if validation.steps_fall(tallies):
                raise integrity.IntegrityError("a step is below the step before it")
            observed = validation.reconciled(tallies, "n")
            discard(tallies)
            contract.require(**observed)
        return {"source": artifact.as_facts(found), "counts": counts, "observed": observed, "code": code_identity()}

    return artifact.publish(spark, target, produce)


def load_features(spark: SparkSession, canonical: str, target: str) -> dict:
    """Derive, check and publish the feature relations; a repeated load verifies that the same rows would result."""
    rows = spark.read.parquet(f"{canonical}/canonical")
    integrity.require_types(rows, {"transaction_id": "string", "source_row_number": "bigint", "step": "int", "transaction_type": "string", "amount": "decimal", "initiator_id": "string", "recipient_id": "string", "is_fraud": "int"})
    made = features.history_features(rows, ["transaction_id", "source_row_number", "is_fraud", "initiator_balance_before", "recipient_balance_before"])
    made = made.withColumn("evaluation_partition", evaluation_partition(F.col("step")))
    identity = made.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(made.columns))).alias("x"))
    if exists(spark, target):
        held = json.loads(artifact.read_text(spark, f"{target}/manifest.json"))
        n, x = identity.first()
        if (n, x) != (held["rows"], held["hash"]):
            raise integrity.IntegrityError(f"{target} holds other rows than a new load would")
        return held | {"status": "verified_existing"}

    def produce(staging: str) -> dict:
        made.write.partitionBy("evaluation_partition").parquet(f"{staging}/features")
        held = spark.read.parquet(f"{staging}/features").select(*made.columns)
        for relation in ("lineage", "core"):
            integrity.require(held, relation)
        if not integrity.orphans(held, rows, ["transaction_id"]).isEmpty() or not integrity.repeated_keys(held, ["transaction_id"]).isEmpty():
            raise integrity.IntegrityError("features without a transaction, or two for one")
        n, x = held.agg(F.count("*"), F.bit_xor(F.xxhash64(*sorted(made.columns)))).first()
        return {"rows": n, "hash": x, "partitions": {r["evaluation_partition"]: r["n_rows"] for r in partition_counts(rows).collect()}, "columns": sorted(made.columns), "schema": [f.name for f in CANONICAL_SCHEMA.fields]}

    return artifact.publish(spark, target, produce) | {"status": "loaded"}


def run_modelling(spark: SparkSession, feature_rows: DataFrame, target: str, specs: list[modelling.Spec] = modelling.SPECS, order: tuple[str, ...] = ("step", "txn_key"), partitions: dict[str, int] | None = None) -> dict:
    """Refuse data that no model may see (partitions: their approved row counts), fit, select and explain on train and validation, write the selection, and only then score test. Code that changes meanwhile is refused."""
    identity = code_identity()
    data = materialize(modelling.model_data(feature_rows), "model")
    population = modelling.require_model_data(data, partitions)
    part = lambda name: data.where(F.col("evaluation_partition") == name)
    train, validation_rows = part("train"), part("validation")
    made, best = modelling.fit_and_select(train, validation_rows, specs)
    edges = metrics.quartiles(train.select("amount"))
    known = modelling.explain([m for m, _, _ in made], validation_rows, order[-1])
    selection = {"models": [{"name": m.spec.name, "columns": list(m.spec.columns), "validation_ap": ap, "threshold": t} for m, ap, t in made], "selected": made[best][0].spec.name, "amount_quartiles": edges, "seed": modelling.SEED, "code": identity}

    def produce(staging: str) -> dict:
        if code_identity() != identity:
            raise integrity.IntegrityError("the code changed before test rows were scored")
        artifact.write_text(spark, f"{staging}/selection.json", artifact.stable_json(selection))
        test, report = part("test"), {}
        for fitted, _, threshold in made:
            scored = materialize(fitted.score(test), "scored")
            report[fitted.spec.name] = {"at_threshold": modelling.evaluate(scored, threshold).first().asDict(), "at_half": modelling.evaluate(scored, 0.5).first().asDict()}
        chosen, _, threshold = made[best]
        chosen.score(test.withColumn("amount_value", F.col("amount"))).write.parquet(f"{staging}/test_scores")
        held = spark.read.parquet(f"{staging}/test_scores")
        return {
            "selection": selection, "population": population, "explained": known, "test": report, "review_budgets": [r.asDict() for r in metrics.review_budgets(held, list(order)).orderBy("budget_bp").collect()],
            "slices": [r.asDict() for r in metrics.slice_metrics(held, edges, threshold, "amount_value").orderBy("band").collect()], "errors": [r.asDict() for r in metrics.error_examples(held, threshold, list(order), [order[-1]]).orderBy("error_group", "place").collect()],
        }

    return artifact.publish(spark, target, produce)
