"""Strict-prior-step history of one role over a stream of events: what each event's entity did before its step.

The stream is the ledger's: an epoch's events are summed per entity and step before they meet the state, which commits a step only when a later one comes, and prior sums are joined back to the events. So an entity with a third of all events sends the state a row per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import MODELLED_TYPE
from . import ledger

RESULT = ["event_id", "step", "entity", "prior_count", "prior_total", "prior_max"]


def events_as_transactions(events: DataFrame) -> DataFrame:
    """The event table as rows of (event_id, step, entity, amount): a step is an hour since 1970, rows without a positive amount are left out."""
    step = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("int")
    return events.where(F.col("value") > 0).select("event_id", step.alias("step"), F.col("user_id").cast("string").alias("entity"), F.col("value").cast("double").alias("amount"))


def run_available(spark: SparkSession, folder: str, schema, work: str, report: dict | None = None) -> DataFrame:
    """Stream all event files that a folder has now, and read the rows that all runs over this work folder have made. What the run read and what the state holds then goes to report."""
    events = events_as_transactions(spark.readStream.schema(schema).parquet(folder))
    stream = events.select("event_id", "step", F.lit(MODELLED_TYPE).alias("transaction_type"), "amount", F.col("entity").alias("initiator_id"), F.col("entity").alias("recipient_id"))
    progress = ledger.run_available(stream, work, ["event_id"])
    if report is not None:
        held = ledger.statistics(spark, work)
        report.update(progress | {"entities": held["initiators"], "last_step": held["last_step"]})
    made = spark.read.parquet(f"{work}/staged")
    return made.select("event_id", "step", F.col("initiator_id").alias("entity"), F.col("initiator_prior_outgoing_count").alias("prior_count"), F.col("initiator_prior_outgoing_amount_total").alias("prior_total"), F.col("initiator_prior_outgoing_amount_max").alias("prior_max"))


def batch_features(rows: DataFrame) -> DataFrame:
    """The same columns in one batch: sums per entity and step, cumulated over the steps before."""
    steps = rows.groupBy("entity", "step").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.max("amount").alias("most"))
    before = Window.partitionBy("entity").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    prior = steps.select("entity", "step", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("prior_count"), F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("prior_total"), F.max("most").over(before).alias("prior_max"))
    return rows.join(prior, ["entity", "step"]).select(*RESULT)
