"""Composite reports: many small results of one relation as a dictionary for stable JSON. What has a row per step, or per length of an identifier, is written as a table beside the report, which names it; all else is of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, contract, features, integrity, validation
from ..operators.digest import ordered_digest, row_text


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict() for r in df.orderBy(*order).collect()]


def _table(df: DataFrame, folder: str, name: str) -> dict:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return {"table": name}


def audit_report(rows: DataFrame, folder: str) -> dict:
    """Data-quality audit of canonical rows; tables go to folder."""
    labels = audit.label_counts(rows)
    columns = [c for c in rows.columns if c not in ("transaction_id", "artifact_id", "source_row_number") and not c.endswith("_literal")]
    return {
        "rows": _rows(audit.row_counts_duplicates(rows, columns), "n_rows"), "columns": _rows(audit.column_profile(rows, columns), "column_name"), "majority": _rows(audit.majority_values(rows, columns), "column_name"), "near_constant": _rows(audit.near_constant(rows, columns), "column_name"),
        "examples": _rows(audit.first_examples(rows, columns, "source_row_number"), "column_name", "place"), "ranges": _rows(audit.numeric_ranges(rows, ["amount", *audit.BALANCES]), "column_name"), "labels": _rows(labels.where("level <> 'step'").drop("step"), "level", "transaction_type", "is_fraud"), "labels_by_step": _table(labels.where("level = 'step'").select("step", "is_fraud", "n_rows"), folder, "labels_by_step"),
        "negative": _rows(audit.negative_balances(rows), "is_fraud"), "patterns_by_type": _rows(audit.balance_patterns(rows, "transaction_type"), "transaction_type", "party", "pattern"), "patterns_by_label": _rows(audit.balance_patterns(rows, "is_fraud"), "is_fraud", "party", "pattern"),
        "entities": _rows(audit.entity_label_profile(rows), "role"), "in_both_roles": audit.role_overlap(rows).count(), "time": _rows(audit.temporal_profile(rows), "first_step"), "windows": _rows(audit.candidate_windows(rows), "first_step"), "out_of_order": validation.regressions(rows).count(),
    }


def contract_report(rows: DataFrame, folder: str) -> dict:
    """Contract characteristics of canonical rows; tables go to folder."""
    literals = [c for c in rows.columns if c.endswith("_literal")]
    return {
        "populations": _rows(contract.population_totals(rows), "transaction_type"), "numbers": _rows(contract.numeric_characteristics(rows, literals or ["amount"]), "column_name"), "identifier_formats": _rows(contract.identifier_formats(rows), "role", "format"),
        "identifier_lengths": _table(contract.identifier_lengths(rows), folder, "identifier_lengths"), "partitions": _rows(contract.partition_counts(rows), "first_step"), "stability": _rows(contract.stability_windows(rows), "band"), "steps": _table(contract.transfer_step_summary(rows, exact=True), folder, "steps"),
    }


def feature_report(rows: DataFrame) -> dict:
    """What the feature relation of canonical rows holds: counts, nulls, zeros, state sizes and the digest of its rows in source order."""
    made = features.features_by_rollup(rows, ["transaction_id", "source_row_number"])
    numbers = [c for c in made.columns if c.startswith(("initiator_prior", "recipient_prior"))]
    row = made.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in numbers], *[F.count_if(F.col(c) == 0).alias(f"zero_{c}") for c in numbers])
    digest = ordered_digest(made, "source_row_number", row_text(*sorted(made.columns))).first()["sha256"]
    return {"features": row.first().asDict() | {"digest": digest}, "state": features.state_statistics(rows).first().asDict(), "broken": _rows(integrity.violations(made, "core"), "check_name")}
