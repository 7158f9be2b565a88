"""Columns, types and fixed values of the transaction model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data contract.
SOURCE_COLUMNS = ["step", "transactionType", "amount", "initiator", "oldBalInitiator", "newBalInitiator", "recipient", "oldBalRecipient", "newBalRecipient", "isFraud"]
TRANSACTION_TYPES = ["DEBIT", "DEPOSIT", "PAYMENT", "TRANSFER", "WITHDRAWAL"]
MONEY_COLUMNS = ["amount", "oldBalInitiator", "newBalInitiator", "oldBalRecipient", "newBalRecipient"]
PARTITIONS = [("train", 0, 95), ("validation", 96, 119), ("test", 120, 143)]
NAMESPACE_HEX = "e42d9db101525973b3b06df189dc50e4"
REVIEW_BUDGETS = [50, 100, 200, 500, 1000]

MODELLED_TYPE = "TRANSFER"
STEP_MOST = 2**31 - 1
MONEY = T.DecimalType(18, 2)


def _field(name: str, kind: T.DataType, role: str) -> T.StructField:
    return T.StructField(name, kind, True, {"role": role})


# Names and order of the typed relation's columns. A column's role says whether a model may see it: not its identity, time, label or what is known only after the event.
CANONICAL_SCHEMA = T.StructType(
    [
        _field("transaction_id", T.StringType(), "identity"),
        _field("artifact_id", T.StringType(), "identity"),
        _field("source_row_number", T.LongType(), "identity"),
        _field("step", T.IntegerType(), "time"),
        _field("transaction_type", T.StringType(), "value"),
        _field("amount", MONEY, "value"),
        _field("initiator_id", T.StringType(), "party"),
        _field("initiator_balance_before", MONEY, "value"),
        _field("initiator_balance_after", MONEY, "after_event"),
        _field("recipient_id", T.StringType(), "party"),
        _field("recipient_balance_before", MONEY, "value"),
        _field("recipient_balance_after", MONEY, "after_event"),
        _field("is_fraud", T.IntegerType(), "label"),
    ]
)

# What history may read, and the names and order of the features.
EVENT_COLUMNS = ["step", "transaction_type", "amount", "initiator_id", "recipient_id"]
CORE_FEATURES = [
    "amount",
    "initiator_prior_outgoing_count",
    "initiator_prior_outgoing_transfer_count",
    "initiator_prior_outgoing_amount_total",
    "initiator_prior_outgoing_amount_mean",
    "initiator_prior_outgoing_amount_max",
    "recipient_prior_incoming_count",
    "initiator_prior_distinct_recipient_count",
    "recipient_prior_distinct_initiator_count",
]
ENHANCED_FEATURES = [*CORE_FEATURES, "initiator_balance_before", "recipient_balance_before"]
NULLABLE_FEATURES = ["initiator_prior_outgoing_amount_mean", "initiator_prior_outgoing_amount_max"]

