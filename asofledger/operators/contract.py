"""Contract summaries: steps, populations, numeric and identifier characteristics, evaluation windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decimals import fraction_digits, integer_digits
from ..functions.patterns import evaluation_partition, identifier_format
from ..functions.wide import with_quotient
from ..schema import MODELLED_TYPE


def eligible(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("transaction_type") == MODELLED_TYPE)


def _counts():
    return [F.count("*").alias("eligible"), F.count_if(F.col("is_fraud") == 1).alias("fraud"), F.count_if(F.col("is_fraud") == 0).alias("legitimate")]


def transfer_step_summary(rows: DataFrame, exact: bool = False) -> DataFrame:
    """Per step: eligible rows, frauds, legitimate ones and the fraud rate in percent (with exact, 28 digits as text)."""
    made = eligible(rows).groupBy("step").agg(*_counts())
    if exact:
        return with_quotient(made, "fraud_rate_percent", F.col("fraud") * 100, F.col("eligible"))
    return made.withColumn("fraud_rate_percent", 100.0 * F.col("fraud") / F.col("eligible"))


def population_totals(rows: DataFrame) -> DataFrame:
    """Rollup of rows and frauds by type and in all."""
    return rows.rollup("transaction_type").agg(F.count("*").alias("n_rows"), F.count_if(F.col("is_fraud") == 1).alias("n_fraud"), (100.0 * F.count_if(F.col("is_fraud") == 1) / F.count("*")).alias("fraud_rate_percent")).select(F.coalesce("transaction_type", F.lit("ALL")).alias("transaction_type"), "n_rows", "n_fraud", "fraud_rate_percent")


def numeric_characteristics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: least, largest, and the most integer and fraction digits of its text."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v"), F.col(c).cast("string").alias("t")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column_name").agg(F.min("v").alias("least"), F.max("v").alias("largest"), F.max(integer_digits(F.col("t"))).cast("long").alias("integer_digits"), F.max(fraction_digits(F.col("t"))).cast("long").alias("fraction_digits"))


def _roles(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array(F.struct(F.lit("initiator").alias("role"), F.col("initiator_id").alias("id")), F.struct(F.lit("recipient").alias("role"), F.col("recipient_id").alias("id")))).alias("x")).select("x.role", "x.id")


def identifier_formats(rows: DataFrame) -> DataFrame:
    return _roles(rows).groupBy("role", identifier_format(F.col("id")).alias("format")).agg(F.count("*").alias("n_rows"))


def identifier_lengths(rows: DataFrame) -> DataFrame:
    return _roles(rows).groupBy("role", F.length("id").cast("long").alias("length")).agg(F.count("*").alias("n_rows"))


def partition_counts(rows: DataFrame) -> DataFrame:
    return eligible(rows).groupBy(evaluation_partition(F.col("step")).alias("evaluation_partition")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("is_fraud") == 1).alias("n_fraud"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


def stability_windows(rows: DataFrame, width: int = 24) -> DataFrame:
    """Bands of width steps: eligible rows, frauds, mean amount and distinct initiators."""
    return eligible(rows).groupBy(F.floor(F.col("step") / width).cast("int").alias("band")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("is_fraud") == 1).alias("n_fraud"), (F.sum("amount").cast("double") / F.count("*")).alias("mean_amount"), F.count_distinct("initiator_id").alias("initiators"))


def write_step_summary(rows: DataFrame, path: str) -> None:
    """transfer_step_summary with exact rates as one CSV in step order (a row per step); the folder must not exist."""
    columns = ["step", "eligible", "fraud", "legitimate", "fraud_rate_percent"]
    transfer_step_summary(rows, exact=True).select(*columns).orderBy("step").coalesce(1).write.csv(path, header=True, mode="errorifexists")
