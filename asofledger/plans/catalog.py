"""Named queries over the given tables, and equal SQL for DuckDB where SQL can express them.

The SQL is written independently of the Spark plans (window frames where Spark has rollups, and so on). Money and means are compared as doubles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..durable import discard, exists, filesystem, materialize, rename, shared_dir, with_row_number
from ..functions import decimals
from ..functions.identity import transaction_id, uuid5
from ..functions.patterns import evaluation_partition, inferred_kind
from ..functions.wide import exact_sums
from ..operators import audit, contract, features, integrity, metrics, modelling, validation
from ..operators.digest import ordered_digest, row_text
from ..operators.quantiles import quantiles
from ..schema import CANONICAL_SCHEMA, CORE_FEATURES, EVENT_COLUMNS, MODELLED_TYPE, MONEY_COLUMNS, SOURCE_COLUMNS
from ..sources import artifact, csv_source
from ..sources.adapter import KEY_PARTS, SQL_TXN, TOTAL_ORDER, joined, numbered, numbered_rows, table, transactions, txn_key, typed
from ..streaming import history, ledger
from . import pipelines, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Names the artifact that the queries' rows would come from.
ARTIFACT = "0" * 64
THRESHOLD = 0.5
PROFILED = ["step", "transaction_type", "amount", "initiator_id", "recipient_id", "is_fraud"]
NUMERIC = ["amount", *audit.BALANCES]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {SQL_TXN} {sql}"
        return f

    return add


def scored(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """TRANSFER rows with score and label."""
    return contract.eligible(transactions(spark, sf_dir)).select("score", F.col("is_fraud").alias("label"), *TOTAL_ORDER, *more)


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


_FEATURE_DOUBLES = ["amount", "initiator_prior_outgoing_amount_total", "initiator_prior_outgoing_amount_max"]
_SQL_SCORED = "s AS (SELECT score, is_fraud AS label, step, txn_key, amount FROM txn WHERE transaction_type = 'TRANSFER')"
_SQL_CURVE = _SQL_SCORED + """, g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY score),
    c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cum_n, sum(p) OVER (ORDER BY score DESC) AS cum_p FROM g)"""


def _sql_history() -> str:
    """TRANSFER rows with their features as h: sums by entity and step, cumulated over the steps before by ROWS frames."""
    before = lambda entity: f"WINDOW w AS (PARTITION BY {entity} ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f""", e AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY initiator_id, recipient_id ORDER BY step, txn_key) = 1 THEN 1 ELSE 0 END AS fresh FROM txn),
    si AS (SELECT initiator_id, step, count(*) AS n, count(*) FILTER (transaction_type = 'TRANSFER') AS t, sum(amount) AS a, max(amount) AS m, sum(fresh) AS d FROM e GROUP BY initiator_id, step),
    sr AS (SELECT recipient_id, step, count(*) AS n, sum(fresh) AS d FROM e GROUP BY recipient_id, step),
    pi AS (SELECT initiator_id, step, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS initiator_prior_outgoing_count, CAST(coalesce(sum(t) OVER w, 0) AS BIGINT) AS initiator_prior_outgoing_transfer_count,
        CAST(coalesce(sum(a) OVER w, 0) AS DOUBLE) AS initiator_prior_outgoing_amount_total, CAST(max(m) OVER w AS DOUBLE) AS initiator_prior_outgoing_amount_max, CAST(coalesce(sum(d) OVER w, 0) AS BIGINT) AS initiator_prior_distinct_recipient_count FROM si {before('initiator_id')}),
    pr AS (SELECT recipient_id, step, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS recipient_prior_incoming_count, CAST(coalesce(sum(d) OVER w, 0) AS BIGINT) AS recipient_prior_distinct_initiator_count FROM sr {before('recipient_id')}),
    f AS (SELECT * FROM e JOIN pi USING (initiator_id, step) JOIN pr USING (recipient_id, step) WHERE transaction_type = 'TRANSFER'),
    h AS (SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount), CASE WHEN initiator_prior_outgoing_count > 0 THEN initiator_prior_outgoing_amount_total / initiator_prior_outgoing_count END AS initiator_prior_outgoing_amount_mean FROM f)"""


def _sql_features(columns: str) -> str:
    return f"{_sql_history()} SELECT {columns} FROM h"


_CORE_SQL = _sql_features(", ".join(["txn_key", "step", *CORE_FEATURES]))


@query("pit_core_features", _CORE_SQL)
def pit_core_features(spark, sf_dir):
    made = features.history_features(transactions(spark, sf_dir), ["txn_key"])
    return _doubles(made, *_FEATURE_DOUBLES).select("txn_key", "step", *CORE_FEATURES)


@query("pit_features_range_variant", _CORE_SQL)
def pit_features_range(spark, sf_dir):
    made = features.features_by_range(transactions(spark, sf_dir), ["txn_key"])
    return _doubles(made, *_FEATURE_DOUBLES).select("txn_key", "step", *CORE_FEATURES)


@query("pit_enhanced_features", _sql_features(", ".join(["txn_key", "step", *CORE_FEATURES, "CAST(initiator_balance_before AS DOUBLE) AS initiator_balance_before", "CAST(recipient_balance_before AS DOUBLE) AS recipient_balance_before", "is_fraud"])))
def pit_enhanced_features(spark, sf_dir):
    made = features.history_features(transactions(spark, sf_dir, True), ["txn_key", "initiator_balance_before", "recipient_balance_before", "is_fraud"])
    return _doubles(made, *_FEATURE_DOUBLES, "initiator_balance_before", "recipient_balance_before").select("txn_key", "step", *CORE_FEATURES, "initiator_balance_before", "recipient_balance_before", "is_fraud")


@query("theta_join_oracle", _sql_features("txn_key, step, initiator_prior_outgoing_count, initiator_prior_outgoing_transfer_count, initiator_prior_outgoing_amount_total, initiator_prior_outgoing_amount_max, initiator_prior_distinct_recipient_count, recipient_prior_incoming_count, recipient_prior_distinct_initiator_count"))
def theta_join(spark, sf_dir):
    made = features.features_by_theta_join(transactions(spark, sf_dir), ["txn_key"])
    return _doubles(made, *_FEATURE_DOUBLES[1:]).select("txn_key", "step", *[c for c in CORE_FEATURES if c not in ("amount", "initiator_prior_outgoing_amount_mean")])


def _sql_quotient(total: str, count: str, scale: int, source: str) -> str:
    """CTEs up to z: source's rows with quotient, total (a whole number of 10 ** -scale units) over count to 28 digits, half to even, as text."""
    ten = "100000000000000::HUGEINT"
    return f""", q0 AS (SELECT *, CAST({total} AS HUGEINT) AS u, CAST(nullif({count}, 0) AS HUGEINT) AS n FROM {source}), q1 AS (SELECT *, u // n AS i, (u % n) * {ten} AS x1 FROM q0), q2 AS (SELECT *, (x1 % n) * {ten} AS x2 FROM q1), q3 AS (SELECT *, (x2 % n) * {ten} AS x3 FROM q2),
    q4 AS (SELECT *, lpad(CAST(x1 // n AS VARCHAR), 14, '0') || lpad(CAST(x2 // n AS VARCHAR), 14, '0') || lpad(CAST(x3 // n AS VARCHAR), 14, '0') AS f, x3 % n = 0 AS whole FROM q3), q5 AS (SELECT *, CASE WHEN whole THEN rtrim(f, '0') ELSE f END AS g FROM q4),
    q6 AS (SELECT *, ltrim(CAST(i AS VARCHAR) || g, '0') AS d FROM q5), q7 AS (SELECT *, substr(d, 29) AS rest, greatest(length(d) - 28, 0) AS cut FROM q6),
    q8 AS (SELECT *, CASE WHEN cut > 0 THEN CAST(CAST(substr(d, 1, 28) AS HUGEINT) + CASE WHEN rest[1] > '5' OR (rest[1] = '5' AND (NOT whole OR regexp_matches(rest[2:], '[1-9]') OR CAST(substr(d, 28, 1) AS INTEGER) % 2 = 1)) THEN 1 ELSE 0 END AS VARCHAR) ELSE d END AS k FROM q7),
    q9 AS (SELECT *, length(k) - ({scale} + length(g) - cut) AS p FROM q8),
    z AS (SELECT *, CASE WHEN n IS NULL THEN NULL WHEN d = '' THEN '{"0." + "0" * scale if scale else "0"}' WHEN p >= length(k) THEN k WHEN p > 0 THEN substr(k, 1, p) || '.' || substr(k, p + 1) ELSE '0.' || repeat('0', -p) || k END AS quotient FROM q9)"""


@query("exact_mean_28_digits", _sql_history() + _sql_quotient("round(initiator_prior_outgoing_amount_total * 100)", "initiator_prior_outgoing_count", 2, "h") + " SELECT txn_key, quotient AS mean_28_digits FROM z")
def exact_mean(spark, sf_dir):
    made = features.history_features(transactions(spark, sf_dir), ["txn_key"], exact=True)
    return made.select("txn_key", F.col("initiator_prior_outgoing_amount_mean").alias("mean_28_digits"))


def _streamed(spark, sf_dir) -> str:
    """The transactions as four arrivals of files, each streamed as it comes, in one work folder, which is returned."""
    work = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = transactions(spark, sf_dir).select("txn_key", *EVENT_COLUMNS)
    band = F.least(F.floor(F.col("step") / 36), F.lit(3)).cast("int")
    rows.withColumn("band", band).write.partitionBy("band").parquet(f"{work}/arrivals")
    filesystem(spark, work)[0].mkdirs(filesystem(spark, f"{work}/in")[1])
    for k in range(4):
        if exists(spark, f"{work}/arrivals/band={k}"):
            rename(spark, f"{work}/arrivals/band={k}", f"{work}/in/{k}")
        else:
            rows.limit(0).write.parquet(f"{work}/in/{k}")
        ledger.run_available(spark.readStream.schema(rows.schema).parquet(f"{work}/in/*"), work, ["txn_key"])
    return work


@query("pit_stream_features", _CORE_SQL)
def pit_stream_features(spark, sf_dir):
    """The nine features of both roles over a stream of four arrivals, staged by epoch and published at the end."""
    work = _streamed(spark, sf_dir)
    return _doubles(ledger.publish(spark, work, f"{work}/published/features"), *_FEATURE_DOUBLES).select("txn_key", "step", *CORE_FEATURES)


@query("stream_state_statistics", "SELECT count(DISTINCT initiator_id) AS initiators, count(DISTINCT recipient_id) AS recipients, count(DISTINCT (initiator_id, recipient_id)) AS pairs, CAST(max(step) AS BIGINT) AS last_step FROM txn")
def stream_state_statistics(spark, sf_dir):
    """What the stream's state holds after its last epoch."""
    found = ledger.statistics(spark, _streamed(spark, sf_dir))
    return spark.createDataFrame([tuple(found[c] for c in ("initiators", "recipients", "pairs", "last_step"))], "initiators long, recipients long, pairs long, last_step long")


_SQL_DIGEST = " ".join(f", l{i + 1} AS (SELECT k >> 10 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l{i} GROUP BY k >> 10)" for i in range(4))


@query("ordered_digest", ", o AS (SELECT *, 1 + row_number() OVER (ORDER BY step, txn_key) AS source_row_number, CAST(amount * 100 AS BIGINT) AS cents FROM txn), l0 AS (SELECT source_row_number AS k, sha256(concat_ws(chr(31), " + ", ".join(f"'=' || {c}" for c in ("source_row_number", "txn_key", "step", "transaction_type", "cents", "initiator_id", "recipient_id")) + f")) AS h FROM o){_SQL_DIGEST} SELECT h AS sha256 FROM l4")
def ordered_rows_digest(spark, sf_dir):
    """The digest of the transactions in source order."""
    rows = transactions(spark, sf_dir).select(*TOTAL_ORDER, "transaction_type", (F.col("amount") * 100).cast("long").alias("cents"), "initiator_id", "recipient_id")
    return ordered_digest(numbered(rows), "source_row_number", row_text("source_row_number", "txn_key", "step", "transaction_type", "cents", "initiator_id", "recipient_id"))


@query("exact_sums_beyond_38_digits", """, w AS (SELECT transaction_type, CAST(CAST(amount * 100 AS BIGINT) || lpad(initiator_id, 12, '0') || lpad(recipient_id, 12, '0') AS HUGEINT) AS whole, CAST(amount * 100 AS HUGEINT) * 1000003 + 1 AS part FROM txn),
    s AS (SELECT transaction_type, sum(part) AS p, sum(whole) AS w FROM w GROUP BY transaction_type) SELECT transaction_type, CAST(w + p // 100000000000000000000::HUGEINT AS VARCHAR) || '.' || lpad(CAST(p % 100000000000000000000::HUGEINT AS VARCHAR), 20, '0') AS total FROM s""")
def exact_sums_beyond_38_digits(spark, sf_dir):
    """Sums of amounts of some thirty integer and twenty fraction digits, by type."""
    rows = transactions(spark, sf_dir)
    cents = (F.col("amount") * 100).cast("long")
    part = F.lpad((cents.cast("decimal(20,0)") * 1000003 + 1).cast("decimal(38,0)").cast("string"), 20, "0")
    text = F.concat(cents.cast("string"), F.lpad("initiator_id", 12, "0"), F.lpad("recipient_id", 12, "0"), F.lit("."), part)
    return exact_sums(rows.select("transaction_type", text.alias("t")), ["transaction_type"], "t", "total")


@query("feature_null_zero_counts", _sql_features("""count(*) AS n_rows, count(*) - count(initiator_prior_outgoing_amount_mean) AS null_mean, count(*) - count(initiator_prior_outgoing_amount_max) AS null_max,
    count(*) FILTER (initiator_prior_outgoing_count = 0) AS zero_outgoing, count(*) FILTER (recipient_prior_incoming_count = 0) AS zero_incoming, count(*) FILTER (initiator_prior_outgoing_transfer_count = 0) AS zero_transfers"""))
def feature_null_zero_counts(spark, sf_dir):
    made = features.history_features(transactions(spark, sf_dir), ["txn_key"])
    zero = lambda c: F.count_if(F.col(c) == 0)
    null = lambda c: F.count_if(F.col(c).isNull())
    return made.agg(F.count("*").alias("n_rows"), null("initiator_prior_outgoing_amount_mean").alias("null_mean"), null("initiator_prior_outgoing_amount_max").alias("null_max"), zero("initiator_prior_outgoing_count").alias("zero_outgoing"), zero("recipient_prior_incoming_count").alias("zero_incoming"), zero("initiator_prior_outgoing_transfer_count").alias("zero_transfers"))


@query("feature_state_statistics", "SELECT count(DISTINCT initiator_id) AS initiators, count(DISTINCT recipient_id) AS recipients, count(DISTINCT (initiator_id, recipient_id)) AS pairs FROM txn")
def feature_state_statistics(spark, sf_dir):
    return features.state_statistics(transactions(spark, sf_dir))


@query("prior_counterparties", "SELECT initiator_id, recipient_id, min(step) AS first_step, count(*) AS n_rows FROM txn GROUP BY ALL")
def prior_counterparties(spark, sf_dir):
    return transactions(spark, sf_dir).groupBy("initiator_id", "recipient_id").agg(F.min("step").alias("first_step"), F.count("*").alias("n_rows"))


@query("behavioural_events", f"SELECT {', '.join(EVENT_COLUMNS)} FROM (SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM txn)")
def behavioural_events(spark, sf_dir):
    return _doubles(features.behavioural(transactions(spark, sf_dir), []), "amount")


@query("committed_union_pending", "SELECT initiator_id, recipient_id FROM txn WHERE step < 96 UNION SELECT initiator_id, recipient_id FROM txn WHERE step >= 96")
def committed_union_pending(spark, sf_dir):
    pairs = transactions(spark, sf_dir).select("step", "initiator_id", "recipient_id")
    return pairs.where("step < 96").drop("step").union(pairs.where("step >= 96").drop("step")).distinct()


@query("novel_pairs_anti_join", "SELECT DISTINCT initiator_id, recipient_id FROM txn t WHERE step >= 96 AND NOT EXISTS (SELECT 1 FROM txn o WHERE o.step < 96 AND o.initiator_id = t.initiator_id AND o.recipient_id = t.recipient_id)")
def novel_pairs(spark, sf_dir):
    pairs = transactions(spark, sf_dir).select("step", "initiator_id", "recipient_id")
    return pairs.where("step >= 96").drop("step").join(pairs.where("step < 96").drop("step"), ["initiator_id", "recipient_id"], "left_anti").distinct()


@query("transfer_step_summary", "SELECT step, count(*) AS eligible, count(*) FILTER (is_fraud = 1) AS fraud, count(*) FILTER (is_fraud = 0) AS legitimate, 100.0::DOUBLE * count(*) FILTER (is_fraud = 1) / count(*) AS fraud_rate_percent FROM txn WHERE transaction_type = 'TRANSFER' GROUP BY step")
def transfer_step_summary(spark, sf_dir):
    return contract.transfer_step_summary(transactions(spark, sf_dir))


@query("fraud_rate_28_digits", ", b AS (SELECT step, count(*) AS eligible, count(*) FILTER (is_fraud = 1) AS fraud, count(*) FILTER (is_fraud = 0) AS legitimate FROM txn WHERE transaction_type = 'TRANSFER' GROUP BY step)" + _sql_quotient("100 * fraud", "eligible", 0, "b") + " SELECT step, eligible, fraud, legitimate, quotient AS fraud_rate_percent FROM z")
def fraud_rate_exact(spark, sf_dir):
    return contract.transfer_step_summary(transactions(spark, sf_dir), exact=True)


@query("population_totals", "SELECT coalesce(transaction_type, 'ALL') AS transaction_type, count(*) AS n_rows, count(*) FILTER (is_fraud = 1) AS n_fraud, 100.0::DOUBLE * count(*) FILTER (is_fraud = 1) / count(*) AS fraud_rate_percent FROM txn GROUP BY ROLLUP (transaction_type)")
def population_totals(spark, sf_dir):
    return contract.population_totals(transactions(spark, sf_dir))


@query("numeric_characteristics", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS largest, max(greatest(length(ltrim(regexp_extract(CAST({c} AS VARCHAR), '^-?([0-9]+)', 1), '0')), 1)) AS integer_digits,
    max(length(regexp_extract(CAST({c} AS VARCHAR), '\\.([0-9]+)$', 1))) AS fraction_digits FROM txn""" for c in NUMERIC))
def numeric_characteristics(spark, sf_dir):
    return contract.numeric_characteristics(transactions(spark, sf_dir, True), NUMERIC)


_SQL_ROLES = ", r AS (SELECT 'initiator' AS role, initiator_id AS id, step, is_fraud FROM txn UNION ALL SELECT 'recipient', recipient_id, step, is_fraud FROM txn)"


@query("identifier_formats", """, p AS (SELECT CAST(amount * 100 AS BIGINT) % 7 AS k, initiator_id, recipient_id FROM txn), r AS (SELECT 'initiator' AS role, k FROM p UNION ALL SELECT 'recipient', (k + 3) % 7 FROM p)
    SELECT role, CASE k WHEN 1 THEN 'NN-7' WHEN 2 THEN 'NN-7-4' WHEN 3 THEN 'LNN-7' WHEN 4 THEN 'digits-digits' WHEN 5 THEN 'other' WHEN 6 THEN 'other' ELSE 'numeric' END AS format, count(*) AS n_rows FROM r GROUP BY ALL""")
def identifier_formats(spark, sf_dir):
    """Identifiers dressed in every format by their transaction's cents."""
    rows = transactions(spark, sf_dir).withColumn("pick", F.expr("cast(amount * 100 as bigint) % 7"))

    def dressed(c: str, k: Column) -> Column:
        seven = F.lpad(F.col(c), 7, "0")
        shapes = [F.col(c), F.concat(F.lit("41-"), seven), F.concat(F.lit("41-"), seven, F.lit("-2024")), F.concat(F.lit("C41-"), seven), F.concat(F.col(c), F.lit("-1")), F.concat(F.lit("x"), F.col(c)), F.concat(F.col(c), F.lit("\n"))]
        return F.element_at(F.array(*shapes), (k + 1).cast("int"))

    return contract.identifier_formats(rows.withColumns({"initiator_id": dressed("initiator_id", F.col("pick")), "recipient_id": dressed("recipient_id", (F.col("pick") + 3) % 7)}))


@query("identifier_lengths", _SQL_ROLES + " SELECT role, length(id) AS length, count(*) AS n_rows FROM r GROUP BY ALL")
def identifier_lengths(spark, sf_dir):
    return contract.identifier_lengths(transactions(spark, sf_dir))


@query("partition_counts", "SELECT CASE WHEN step <= 95 THEN 'train' WHEN step <= 119 THEN 'validation' ELSE 'test' END AS evaluation_partition, count(*) AS n_rows, count(*) FILTER (is_fraud = 1) AS n_fraud, min(step) AS first_step, max(step) AS last_step FROM txn WHERE transaction_type = 'TRANSFER' GROUP BY 1")
def partition_counts(spark, sf_dir):
    return contract.partition_counts(transactions(spark, sf_dir))


@query("stability_windows", "SELECT CAST(step // 24 AS INTEGER) AS band, count(*) AS n_rows, count(*) FILTER (is_fraud = 1) AS n_fraud, CAST(sum(amount) AS DOUBLE) / count(*) AS mean_amount, count(DISTINCT initiator_id) AS initiators FROM txn WHERE transaction_type = 'TRANSFER' GROUP BY 1")
def stability_windows(spark, sf_dir):
    return contract.stability_windows(transactions(spark, sf_dir))


@query("row_counts_duplicates", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM txn GROUP BY step, transaction_type, initiator_id, recipient_id, is_fraud)")
def row_counts_duplicates(spark, sf_dir):
    return audit.row_counts_duplicates(transactions(spark, sf_dir), ["step", "transaction_type", "initiator_id", "recipient_id", "is_fraud"])


_SQL_LONG = ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM txn" for c in PROFILED) + "), n AS (SELECT column_name, value, count(*) AS n FROM v GROUP BY ALL)"


@query("column_profile", _SQL_LONG + """ SELECT column_name, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN trim(value) = '' THEN n ELSE 0 END) AS BIGINT) AS n_blank, CASE WHEN count(DISTINCT value) <= 10000 THEN count(DISTINCT value) END AS n_distinct,
    CASE WHEN bool_and(regexp_full_match(value, '[+-]?[0-9]+')) THEN 'integer' WHEN bool_and(try_cast(value AS DOUBLE) IS NOT NULL) THEN 'number' ELSE 'string' END AS kind FROM n GROUP BY column_name""")
def column_profile(spark, sf_dir):
    return audit.column_profile(transactions(spark, sf_dir), PROFILED)


@query("majority_values", _SQL_LONG + ", b AS (SELECT column_name, max(n) AS m, sum(n) AS t FROM n GROUP BY column_name) SELECT n.column_name, max(value) AS value, n AS n_rows, CAST(n AS DOUBLE) / t AS share FROM n JOIN b ON n.column_name = b.column_name AND n = m AND 2 * m >= t GROUP BY n.column_name, n, t")
def majority_values(spark, sf_dir):
    return audit.majority_values(transactions(spark, sf_dir), PROFILED)


@query("near_constant_columns", _SQL_LONG + " SELECT column_name, count(*) AS n_distinct, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS share FROM n GROUP BY column_name HAVING count(*) = 1 OR CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) >= 0.8")
def near_constant_columns(spark, sf_dir):
    return audit.near_constant(transactions(spark, sf_dir), PROFILED, 0.8)


@query("first_examples", ", o AS (SELECT *, row_number() OVER (ORDER BY step, txn_key) AS k FROM txn), v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, k FROM o" for c in ("transaction_type", "initiator_id", "step")) + "), f AS (SELECT column_name, value, min(k) + 1 AS first_row FROM v GROUP BY ALL), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY first_row) AS INTEGER) AS place FROM f) SELECT column_name, place, value, first_row FROM p WHERE place <= 3")
def first_examples(spark, sf_dir):
    return audit.first_examples(numbered(transactions(spark, sf_dir)), ["transaction_type", "initiator_id", "step"], "source_row_number")


_SQL_SPOILT = ", ".join(f"CASE CAST(amount * 100 AS BIGINT) % 20 WHEN {k} THEN 'x' WHEN {k + 5} THEN 'NaN' WHEN {k + 10} THEN '-Infinity' WHEN {k + 15} THEN NULL ELSE CAST({c} AS VARCHAR) END AS {c}" for k, c in enumerate(NUMERIC))


@query("numeric_ranges", f", v AS (SELECT {_SQL_SPOILT} FROM txn), " + "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM v" for c in NUMERIC) + """), d AS (SELECT column_name, try_cast(v AS DOUBLE) AS d FROM l)
    SELECT column_name, min(d) FILTER (isfinite(d)) AS least, max(d) FILTER (isfinite(d)) AS largest, count(*) FILTER (d IS NULL) AS n_invalid, count(*) FILTER (NOT isfinite(d)) AS n_not_finite FROM d GROUP BY column_name""")
def numeric_ranges(spark, sf_dir):
    """Ranges of columns of text in which some values are no number, not finite or missing."""
    rows = transactions(spark, sf_dir, True).withColumn("pick", F.expr("cast(amount * 100 as bigint) % 20"))
    pick = F.col("pick")
    spoilt = {c: F.when(pick == k, "x").when(pick == k + 5, "NaN").when(pick == k + 10, "-Infinity").when(pick == k + 15, F.lit(None)).otherwise(F.col(c).cast("string")) for k, c in enumerate(NUMERIC)}
    return audit.numeric_ranges(rows.withColumns(spoilt), NUMERIC)


@query("label_counts_grouping_sets", "SELECT CASE WHEN grouping(step) = 0 THEN 'step' WHEN grouping(transaction_type) = 0 THEN 'type' ELSE 'label' END AS level, transaction_type, step, is_fraud, count(*) AS n_rows FROM txn GROUP BY GROUPING SETS ((is_fraud), (transaction_type, is_fraud), (step, is_fraud))")
def label_counts(spark, sf_dir):
    return audit.label_counts(transactions(spark, sf_dir))


@query("negative_balances", "SELECT is_fraud, " + ", ".join(f"count(*) FILTER ({c} < 0) AS negative_{c}" for c in audit.BALANCES) + f", count(*) FILTER (least({', '.join(audit.BALANCES)}) < 0) AS negative_any, count(*) FILTER (amount <= 0) AS not_positive_amount FROM txn GROUP BY is_fraud")
def negative_balances(spark, sf_dir):
    return audit.negative_balances(transactions(spark, sf_dir, True))


def _unbalanced(rows: DataFrame) -> DataFrame:
    """Rows of which some recipients get a unit more than their payer gives."""
    return rows.withColumn("recipient_balance_after", F.col("recipient_balance_after") + F.when(F.expr("cast(amount * 100 as bigint) % 20") == 3, F.lit(1)).otherwise(F.lit(0)))


def _sql_patterns(by: str) -> str:
    def pattern(party: str) -> str:
        return f"CASE {party}_balance_after - {party}_balance_before WHEN amount THEN 'increase' WHEN -amount THEN 'decrease' WHEN 0 THEN 'unchanged' ELSE 'other' END"

    return f""", u AS (SELECT * REPLACE (recipient_balance_after + CASE WHEN CAST(amount * 100 AS BIGINT) % 20 = 3 THEN 1 ELSE 0 END AS recipient_balance_after) FROM txn),
    p AS (SELECT transaction_type, is_fraud, 'initiator' AS party, {pattern('initiator')} AS pattern FROM u UNION ALL SELECT transaction_type, is_fraud, 'recipient', {pattern('recipient')} FROM u
    UNION ALL SELECT transaction_type, is_fraud, 'pair', CASE WHEN initiator_balance_before + recipient_balance_before = initiator_balance_after + recipient_balance_after THEN 'conserved' ELSE 'not conserved' END FROM u)
    SELECT {by}, party, pattern, count(*) AS n_rows FROM p GROUP BY ALL"""


@query("balance_patterns_by_type", _sql_patterns("transaction_type"))
def balance_patterns_by_type(spark, sf_dir):
    return audit.balance_patterns(_unbalanced(transactions(spark, sf_dir, True)), "transaction_type")


@query("balance_patterns_by_label", _sql_patterns("is_fraud"))
def balance_patterns_by_label(spark, sf_dir):
    return audit.balance_patterns(_unbalanced(transactions(spark, sf_dir, True)), "is_fraud")


_SQL_ENTITY = ", r AS (SELECT 'initiator' AS role, initiator_id AS id, step, is_fraud FROM l UNION ALL SELECT 'recipient', recipient_id, step, is_fraud FROM l)"
_SQL_ENTITY = ", l AS (SELECT * REPLACE (CASE WHEN CAST(amount * 100 AS BIGINT) % 20 = 0 THEN 2 ELSE is_fraud END AS is_fraud) FROM txn)" + _SQL_ENTITY + ", a AS (SELECT role, id AS entity, count(*) AS n_rows, min(step) AS first_step, max(step) AS last_step, min(step) < max(step) AS multi_step, count(*) FILTER (is_fraud = 1) AS n_fraud, count(*) FILTER (is_fraud = 0) AS n_legitimate, count(*) FILTER (is_fraud NOT IN (0, 1)) AS n_unexpected FROM r GROUP BY ALL)"


def _odd_labels(rows: DataFrame) -> DataFrame:
    """Rows of which some have a label other than 0 and 1."""
    return rows.withColumn("is_fraud", F.when(F.expr("cast(amount * 100 as bigint) % 20 = 0"), 2).otherwise(F.col("is_fraud")))


@query("entity_activity", _SQL_ENTITY + " SELECT * FROM a")
def entity_activity(spark, sf_dir):
    return audit.entity_activity(_odd_labels(transactions(spark, sf_dir)))


@query("entity_label_profile", _SQL_ENTITY + " SELECT role, count(*) AS entities, count(*) FILTER (n_rows > 1) AS multi_row, count(*) FILTER (multi_step) AS multi_step, count(*) FILTER (n_fraud = 0) AS legitimate_only, count(*) FILTER (n_legitimate = 0) AS fraud_only, count(*) FILTER (n_fraud > 0 AND n_legitimate > 0) AS mixed, count(*) FILTER (n_unexpected > 0) AS unexpected FROM a GROUP BY role")
def entity_label_profile(spark, sf_dir):
    return audit.entity_label_profile(_odd_labels(transactions(spark, sf_dir)))


@query("role_overlap_intersect", "SELECT initiator_id AS entity FROM txn INTERSECT SELECT recipient_id FROM txn")
def role_overlap(spark, sf_dir):
    return audit.role_overlap(transactions(spark, sf_dir))


@query("unexpected_labels_except", "SELECT DISTINCT transaction_type FROM txn EXCEPT SELECT * FROM (VALUES ('DEBIT'), ('DEPOSIT'), ('TRANSFER')) x")
def unexpected_labels(spark, sf_dir):
    return audit.unexpected_values(transactions(spark, sf_dir), "transaction_type", ["DEBIT", "DEPOSIT", "TRANSFER"])


@query("temporal_profile", "SELECT min(step) AS first_step, max(step) AS last_step, count(DISTINCT step) AS n_steps, count(DISTINCT CASE WHEN is_fraud = 1 THEN step END) AS steps_with_fraud, min(CASE WHEN is_fraud = 1 THEN step END) AS first_fraud_step, max(CASE WHEN is_fraud = 1 THEN step END) AS last_fraud_step FROM txn")
def temporal_profile(spark, sf_dir):
    return audit.temporal_profile(transactions(spark, sf_dir))


@query("candidate_windows_60_20_20", """, d AS (SELECT DISTINCT step FROM txn), k AS (SELECT step, row_number() OVER (ORDER BY step) AS i, count(*) OVER () AS n FROM d),
    w AS (SELECT step, CASE WHEN i <= greatest(1, n * 3 // 5) THEN 'train' WHEN i <= least(greatest(greatest(1, n * 3 // 5) + 1, n * 4 // 5), n - 1) THEN 'validation' ELSE 'test' END AS evaluation_window FROM k WHERE n >= 3)
    SELECT evaluation_window, min(step) AS first_step, max(step) AS last_step, count(DISTINCT step) AS n_steps, count(*) AS n_rows, count(*) FILTER (is_fraud = 1) AS n_fraud FROM txn JOIN w USING (step) GROUP BY evaluation_window""")
def candidate_windows(spark, sf_dir):
    return audit.candidate_windows(transactions(spark, sf_dir))


# An order that is not chronological: by initiator, so that steps fall back.
_BY_ENTITY = ["initiator_id", "txn_key"]


@query("out_of_order_transitions", ", o AS (SELECT step, 1 + row_number() OVER (ORDER BY initiator_id, txn_key, step) AS source_row_number FROM txn), l AS (SELECT *, lag(step) OVER (ORDER BY source_row_number) AS previous_step FROM o) SELECT source_row_number, step, previous_step FROM l WHERE step < previous_step")
def out_of_order(spark, sf_dir):
    rows = with_row_number(transactions(spark, sf_dir).select("initiator_id", "txn_key", "step"), [*_BY_ENTITY, "step"])
    return validation.regressions(rows)


def _canonical(spark, sf_dir) -> DataFrame:
    rows = numbered(transactions(spark, sf_dir, True))
    return rows.select(transaction_id(F.lit(ARTIFACT), F.col("source_row_number")).alias("transaction_id"), uuid5(F.lit(ARTIFACT)).alias("artifact_id"), *[c for c in CANONICAL_SCHEMA.names if c not in ("transaction_id", "artifact_id")])


@query("transaction_identity", ", o AS (SELECT 1 + row_number() OVER (ORDER BY step, txn_key) AS k FROM txn), h AS (SELECT k, sha1(unhex('e42d9db101525973b3b06df189dc50e4') || CAST('" + ARTIFACT + """:' || k AS BLOB)) AS x FROM o)
    SELECT k AS source_row_number, concat(substr(x, 1, 8), '-', substr(x, 9, 4), '-5', substr(x, 14, 3), '-', substr('89ab', 1 + (CAST(('0x' || substr(x, 17, 1)) AS INTEGER) % 4), 1), substr(x, 18, 3), '-', substr(x, 21, 12)) AS transaction_id FROM h""")
def transaction_identity(spark, sf_dir):
    return numbered(transactions(spark, sf_dir).select(*TOTAL_ORDER)).select("source_row_number", transaction_id(F.lit(ARTIFACT), F.col("source_row_number")).alias("transaction_id"))


@query("reconciliation", "SELECT count(*) AS n_rows, count(*) FILTER (is_fraud = 1) AS n_fraud, count(*) FILTER (is_fraud = 0) AS n_legitimate, " + ", ".join(f"count(*) FILTER (transaction_type = '{t}') AS n_{t.lower()}" for t in ("DEBIT", "DEPOSIT", "PAYMENT", "TRANSFER", "WITHDRAWAL")) + ", min(step) AS first_step, max(step) AS last_step, count(DISTINCT step) AS n_steps, true AS contiguous FROM txn")
def reconciliation(spark, sf_dir):
    return validation.reconciliation(numbered(transactions(spark, sf_dir)))


def _dirty(spark, sf_dir) -> DataFrame:
    """Source rows as text in which the transaction's cents pick a fault for some, so that every rule has rows that break it."""
    rows = transactions(spark, sf_dir, True).withColumn("pick", F.expr("cast(amount * 100 as bigint) % 20"))
    pick = F.col("pick")
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        "txn_key", "pick", (pick == 0).alias("malformed"), F.when(pick == 1, "x1").when(pick == 2, "99999999999").otherwise(text("step")).alias("step"), F.when(pick == 3, F.lower("transaction_type")).otherwise(F.col("transaction_type")).alias("transactionType"),
        F.when(pick == 4, "1e3").when(pick == 5, "-0.00").when(pick == 6, F.concat(text("amount"), F.lit("\n"))).otherwise(text("amount")).alias("amount"), F.when(pick == 7, " \u2003").otherwise(F.col("initiator_id")).alias("initiator"),
        F.when(pick == 8, "+1.").otherwise(text("initiator_balance_before")).alias("oldBalInitiator"), F.when(pick == 9, "").otherwise(text("initiator_balance_after")).alias("newBalInitiator"), F.when(pick == 10, "").otherwise(F.col("recipient_id")).alias("recipient"),
        F.when(pick == 11, ".5").otherwise(text("recipient_balance_before")).alias("oldBalRecipient"), F.when(pick == 12, "NaN").otherwise(text("recipient_balance_after")).alias("newBalRecipient"), F.when(pick == 13, "2").otherwise(text("is_fraud")).alias("isFraud"),
    )


@query("row_validation_errors", """, p AS (SELECT txn_key, CAST(amount * 100 AS BIGINT) % 20 AS k FROM txn)
    SELECT txn_key, CASE k WHEN 0 THEN 'row' WHEN 1 THEN 'step' WHEN 2 THEN 'step' WHEN 3 THEN 'transactionType' WHEN 4 THEN 'amount' WHEN 5 THEN 'amount' WHEN 6 THEN 'amount' WHEN 7 THEN 'initiator' WHEN 8 THEN 'oldBalInitiator'
        WHEN 9 THEN 'newBalInitiator' WHEN 10 THEN 'recipient' WHEN 11 THEN 'oldBalRecipient' WHEN 12 THEN 'newBalRecipient' WHEN 13 THEN 'isFraud' END AS error_column,
      CASE k WHEN 0 THEN 'wrong number of fields or bad quoting' WHEN 1 THEN 'not an integer' WHEN 2 THEN 'outside 0..2147483647' WHEN 3 THEN 'unknown type' WHEN 5 THEN 'not positive' WHEN 7 THEN 'blank' WHEN 10 THEN 'blank' WHEN 13 THEN 'not 0 or 1' ELSE 'not a plain decimal' END AS reason
    FROM p WHERE k <= 13""")
def row_validation_errors(spark, sf_dir):
    return validation.with_errors(_dirty(spark, sf_dir)).select("txn_key", F.col("e.column").alias("error_column"), F.col("e.reason").alias("reason"))


@query("source_quality", ", p AS (SELECT CAST(amount * 100 AS BIGINT) % 20 AS k FROM txn) SELECT count(*) AS n_rows, count(*) FILTER (k = 0) AS malformed_rows, count(*) FILTER (k = 1) AS invalid_step_rows FROM p")
def source_quality(spark, sf_dir):
    return audit.source_quality(_dirty(spark, sf_dir))


@query("inferred_kinds", """, p AS (SELECT CAST(amount * 100 AS BIGINT) % 9 AS k FROM txn) SELECT CASE WHEN k IN (0, 1, 2, 3) THEN 'integer' WHEN k IN (4, 5, 6) THEN 'number' ELSE 'string' END AS kind, count(*) AS n_rows FROM p GROUP BY 1""")
def inferred_kinds(spark, sf_dir):
    """Steps spelt in ways that are an integer, a number or neither."""
    step = F.col("step").cast("string")
    shapes = [step, F.concat(F.lit(" +1_0"), step, F.lit("\u2003")), F.concat(F.lit("\u0663"), step), F.concat(F.lit("-0"), step), F.concat(step, F.lit(".")), F.concat(F.lit("."), step, F.lit("e+1_0")), F.lit("-Infinity"), F.concat(F.lit("1__"), step), F.concat(step, F.lit("_"))]
    kind = inferred_kind(F.element_at(F.array(*shapes), (F.expr("cast(amount * 100 as bigint) % 9") + 1).cast("int")))
    return transactions(spark, sf_dir).select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n_rows"))


def _stored(held: DataFrame) -> DataFrame:
    """The canonical rows to store, of numbered_rows()."""
    return typed(held, True, "source_row_number").drop("score").withColumnRenamed("txn_key", "transaction_id")


def _load(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What a load is made of, each written once: the transactions as numbered_rows(), and what _keyed() makes their features of, hashed by transaction_id into the store's buckets. Rows are narrow until they are there: parties are the tables' own whole numbers, keys are KEY_PARTS."""
    held = numbered_rows(spark, sf_dir, True)
    rows = typed(held, False, "o_custkey", *KEY_PARTS).withColumns({"initiator_id": F.col("o_custkey"), "recipient_id": F.col("l_suppkey")})
    made = features.history_features(rows, [c for c in KEY_PARTS if c != "l_suppkey"], held=True).withColumnRenamed("recipient_id", "l_suppkey")
    made = made.select(*KEY_PARTS, "step", *[c for c in CORE_FEATURES if c != "initiator_prior_outgoing_amount_mean"])
    return held, materialize(made.repartition(store.buckets(held), txn_key()), "features")


def _keyed(made: DataFrame) -> DataFrame:
    """The features to store, of _load()'s."""
    return features.with_mean(made.withColumns({"transaction_id": txn_key(), "transaction_type": F.lit(MODELLED_TYPE)}), False).drop(*KEY_PARTS)


@query("catalog_views", """, t AS (SELECT * FROM txn WHERE transaction_type = 'TRANSFER') SELECT count(*) AS n_core, count(*) AS n_enhanced, count(*) AS n_target, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, CAST(sum(initiator_balance_before) AS DOUBLE) AS balances, 'verified_existing' AS reload FROM t""")
def catalog_views(spark, sf_dir):
    """The relations stored as catalog tables, loaded a second time, and read through their views; the database is dropped again."""
    held, made = _load(spark, sf_dir)
    name = f"ledger_{uuid.uuid4().hex[:12]}"
    parts = _stored(held), _keyed(made)
    store.store(spark, name, *parts, dealt=lambda n: _stored(held.repartition(n, txn_key())))
    again = store.store(spark, name, *parts)
    core, enhanced, target = (spark.table(f"{name}.{v}") for v in ("core_predictors", "enhanced_predictors", "transaction_target"))
    sums = enhanced.agg(F.count("*").alias("n_enhanced"), F.sum("initiator_balance_before").cast("double").alias("balances")).join(core.agg(F.count("*").alias("n_core"))).join(target.agg(F.count("*").alias("n_target"), F.sum("is_fraud").cast("long").alias("n_fraud")))
    out = materialize(sums.withColumn("reload", F.lit(again)), "views")
    spark.sql(f"DROP DATABASE {name} CASCADE")
    discard(held)
    discard(made)
    return out


@query("read_back_join", ", t AS (SELECT step, amount, is_fraud FROM txn WHERE transaction_type = 'TRANSFER') SELECT CASE WHEN step <= 95 THEN 'train' WHEN step <= 119 THEN 'validation' ELSE 'test' END AS evaluation_partition, count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, CAST(sum(amount) AS DOUBLE) AS total, 0::BIGINT AS n_different FROM t GROUP BY 1")
def read_back_join(spark, sf_dir):
    """Stored features, lineage and canonical rows joined bucket by bucket, by partition: rows, frauds, amounts, and rows whose amounts or steps differ."""
    held, made = _load(spark, sf_dir)
    name = f"ledger_{uuid.uuid4().hex[:12]}"
    parts = _stored(held), _keyed(made)
    store.store(spark, name, *parts, dealt=lambda n: _stored(held.repartition(n, txn_key())))
    discard(held)
    discard(made)
    different = (F.col("amount") != F.col("canonical_amount")) | (F.col("step") != F.col("canonical_step"))
    sums = store.read_back(spark, name).groupBy("evaluation_partition").agg(F.count("*").alias("n_rows"), F.sum("is_fraud").cast("long").alias("n_fraud"), F.sum("canonical_amount").cast("double").alias("total"), F.count_if(different).alias("n_different"))
    out = materialize(sums, "readback")
    spark.sql(f"DROP DATABASE {name} CASCADE")
    return out


@query("numeric_tokens", "SELECT txn_key, CAST(amount AS DOUBLE) AS value, CASE WHEN amount = 0 THEN '0' ELSE rtrim(rtrim(CAST(amount AS VARCHAR), '0'), '.') END AS token FROM txn")
def numeric_tokens(spark, sf_dir):
    text = F.concat(F.lit("+00"), F.col("amount").cast("string"), F.lit("0"))
    return transactions(spark, sf_dir).select("txn_key", F.col("amount").cast("double").alias("value"), decimals.numeric_token(text).alias("token"))


_ROUND_TRIP = ", ".join(["step", "transaction_type", "initiator_id || CASE CAST(amount * 100 AS BIGINT) % 5 WHEN 0 THEN ', \"x\"' WHEN 1 THEN ' ' ELSE '' END AS initiator_id", "recipient_id", "is_fraud", "CAST(amount AS DOUBLE) AS amount", *[f"CAST({c} AS DOUBLE) AS {c}" for c in audit.BALANCES]])


@query("canonical_csv_round_trip", f", o AS (SELECT *, 1 + row_number() OVER (ORDER BY step, txn_key) AS source_row_number FROM txn) SELECT source_row_number, {_ROUND_TRIP} FROM o")
def canonical_csv_round_trip(spark, sf_dir):
    """Transactions written as source files in order (some identifiers with commas, quotes and spaces), and read back by the strict reader and the typed projection."""
    made = validation.canonical(csv_source.read_strict(spark, _source_files(spark, sf_dir)), ARTIFACT)
    return _doubles(made, "amount", *audit.BALANCES).select("source_row_number", "step", "transaction_type", "initiator_id", "recipient_id", "is_fraud", "amount", *audit.BALANCES)


def _source_files(spark, sf_dir, dressed: Column | None = None, seen: Observation | None = None) -> str:
    """Source files of the transactions in order, sorted once, with dressed (by pick) as initiators, or some with commas, quotes and spaces. seen takes what a contract holds the transactions to, before they are spelt."""
    if dressed is None:
        dressed = F.concat("initiator_id", F.when(F.col("pick") == 0, ', "x"').when(F.col("pick") == 1, " ").otherwise(""))
    path = f"{shared_dir(spark)}/source-{uuid.uuid4().hex}/files"
    watched = lambda rows: rows.observe(seen, *validation.contract_sums(F.lit(1))) if seen else rows
    artifact.write_csv(joined(spark, sf_dir, True), path, TOTAL_ORDER, lambda rows: _spelt(watched(typed(rows, True)), dressed), {"txn_key": txn_key()})
    return path


def _spelt(rows: DataFrame, dressed: Column) -> DataFrame:
    rows = rows.withColumn("pick", F.expr("cast(amount * 100 as bigint) % 5"))
    return rows.withColumns({f"{s}_literal": F.col(c).cast("string") for s, c in zip(MONEY_COLUMNS, ["amount", *audit.BALANCES])} | {"initiator_id": dressed})


@query("multiline_csv_round_trip", """, o AS (SELECT *, 1 + row_number() OVER (ORDER BY step, txn_key) AS source_row_number, CAST(amount * 100 AS BIGINT) % 5 AS k FROM txn)
    SELECT source_row_number, step, initiator_id || CASE k WHEN 0 THEN chr(10) || 'of "x",' WHEN 1 THEN chr(13) || chr(10) || chr(10) ELSE '' END AS initiator_id, recipient_id, CAST(amount AS DOUBLE) AS amount FROM o""")
def multiline_csv_round_trip(spark, sf_dir):
    """Source files of which two rows in five span lines, read back by the strict reader: blocks cut by the parity of their quotes."""
    dressed = F.concat("initiator_id", F.when(F.col("pick") == 0, '\nof "x",').when(F.col("pick") == 1, "\r\n\n").otherwise(""))
    made = validation.canonical(csv_source.read_strict(spark, _source_files(spark, sf_dir, dressed)), ARTIFACT)
    return _doubles(made, "amount").select("source_row_number", "step", "initiator_id", "recipient_id", "amount")


@query("canonical_pipeline", "SELECT transaction_type, evaluation_partition, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS total, CAST(min(source_row_number) AS BIGINT) AS first_row FROM (SELECT *, 1 + row_number() OVER (ORDER BY step, txn_key) AS source_row_number, CASE WHEN step <= 95 THEN 'train' WHEN step <= 119 THEN 'validation' ELSE 'test' END AS evaluation_partition FROM txn) GROUP BY ALL")
def canonical_pipeline(spark, sf_dir):
    """Source files verified, typed, written, read back, held against a contract and published; what was published, by type and partition."""
    seen = Observation()
    source = _source_files(spark, sf_dir, seen=seen)
    expected = validation.as_contract(seen.get)
    target = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}/run"
    pipelines.canonical_pipeline(spark, source, target, contract=artifact.ArtifactContract(**expected))
    held = spark.read.parquet(f"{target}/canonical")
    return held.groupBy("transaction_type", evaluation_partition(F.col("step")).alias("evaluation_partition")).agg(F.count("*").alias("n_rows"), F.sum("amount").cast("double").alias("total"), F.min("source_row_number").alias("first_row"))


@query("source_header", "SELECT CAST(place - 1 AS INTEGER) AS place, column_name FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in SOURCE_COLUMNS) + "]) AS column_name, generate_subscripts([" + ", ".join(f"'{c}'" for c in SOURCE_COLUMNS) + "], 1) AS place)")
def source_header(spark, sf_dir):
    """The header that inspection finds in source files written from the transactions."""
    report = csv_source.inspect_csv(spark, _source_files(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(report.columns)), "place int, column_name string")


@query("permissive_scan", ", p AS (SELECT CAST(amount * 100 AS BIGINT) % 20 AS k, is_fraud FROM txn) SELECT k = 0 AS malformed, count(*) AS n_rows, count(*) FILTER (k <> 0 AND is_fraud = 1) AS n_fraud FROM p GROUP BY 1")
def permissive_scan(spark, sf_dir):
    """Source lines of which some lack their last two fields, scanned permissively: rows by whether their width is wrong."""
    rows = transactions(spark, sf_dir, True).withColumn("pick", F.expr("cast(amount * 100 as bigint) % 20"))
    text = [F.col(c).cast("string") for c in ("step", "transaction_type", "amount", "initiator_id", "initiator_balance_before", "initiator_balance_after", "recipient_id", "recipient_balance_before", "recipient_balance_after", "is_fraud")]
    lines = rows.select(F.when(F.col("pick") == 0, F.concat_ws(",", *text[:-2])).otherwise(F.concat_ws(",", *text)).alias("value"))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.select(F.col("value")).write.option("header", False).text(path)
    scanned = csv_source.scan_permissive(spark, path, tuple(SOURCE_COLUMNS), header=False)
    return scanned.groupBy("malformed").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("malformed") & (F.col("isFraud") == "1")).alias("n_fraud"))


@query("file_sha256", """, s AS (SELECT step, count(*) AS n, count(*) FILTER (is_fraud = 1) AS f FROM txn WHERE transaction_type = 'TRANSFER' GROUP BY step)
    SELECT sha256(string_agg(step || ',' || n || ',' || f, chr(10) ORDER BY step) || chr(10)) AS sha256, CAST(count(*) AS BIGINT) AS n_lines FROM s""")
def file_sha256(spark, sf_dir):
    """SHA-256 of a file's bytes: TRANSFER rows and frauds by step, a line per step."""
    steps = contract.transfer_step_summary(transactions(spark, sf_dir))
    path = f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"
    steps.orderBy("step").select(F.concat_ws(",", "step", "eligible", "fraud").alias("value")).coalesce(1).write.text(path)  # a line per step
    found = artifact.fingerprint(spark, path)
    return spark.read.text(path).agg(F.count("*").alias("n_lines")).select(F.lit(found.digest).alias("sha256"), "n_lines")


@query("step_summary_file", "SELECT step, count(*) AS eligible, count(*) FILTER (is_fraud = 1) AS fraud, count(*) FILTER (is_fraud = 0) AS legitimate FROM txn WHERE transaction_type = 'TRANSFER' GROUP BY step")
def step_summary_file(spark, sf_dir):
    """The step summary as written to a CSV file and read again."""
    path = f"{shared_dir(spark)}/summary-{uuid.uuid4().hex}"
    contract.write_step_summary(transactions(spark, sf_dir), path)
    return spark.read.csv(path, header=True, schema="step int, eligible long, fraud long, legitimate long, fraud_rate_percent string").drop("fraud_rate_percent")


@query("lineage_completeness", ", t AS (SELECT txn_key, CAST(amount * 100 AS BIGINT) % 20 AS k FROM txn WHERE transaction_type = 'TRANSFER') SELECT problem, count(*) AS n_rows FROM (SELECT CASE k WHEN 0 THEN 'no lineage' WHEN 1 THEN 'no child 1' WHEN 2 THEN 'no child 2' END AS problem FROM t WHERE k <= 2 UNION ALL SELECT 'stray child 2' FROM txn WHERE transaction_type = 'DEBIT') GROUP BY problem")
def lineage_completeness(spark, sf_dir):
    """Feature relations from which some rows were taken away and to which some were added: what is missing or stray."""
    # four relations come from these rows: they are joined and written once
    rows = materialize(transactions(spark, sf_dir).select("txn_key", "transaction_type", F.expr("cast(amount * 100 as bigint) % 20").alias("pick")), "keys")
    sent = contract.eligible(rows)
    other = sent.where("pick <> 2").select("txn_key").unionByName(rows.where("transaction_type = 'DEBIT'").select("txn_key"))
    return integrity.incomplete_lineage(sent.where("pick <> 0"), rows, [sent.where("pick <> 1"), other], "txn_key").groupBy("problem").agg(F.sum("n_rows").alias("n_rows"))


@query("tier_matrix", f"{_sql_features(', '.join(['txn_key', *[f'coalesce(CAST({c} AS DOUBLE), -1) AS {c}' for c in CORE_FEATURES]]))}")
def tier_matrix(spark, sf_dir):
    """The core tier's vectors, taken apart again; what they have as NaN is -1 here."""
    from pyspark.ml.functions import vector_to_array

    made = features.history_features(transactions(spark, sf_dir), ["txn_key"])
    cells = modelling.tier_matrix(made, "core", "txn_key").select("txn_key", vector_to_array("vector").alias("v"))
    return cells.select("txn_key", *[F.when(F.isnan(F.col("v")[i]), F.lit(-1.0)).otherwise(F.col("v")[i]).alias(c) for i, c in enumerate(CORE_FEATURES)])


@query("core_predictors", _sql_features(", ".join(["txn_key", *CORE_FEATURES])))
def core_predictors(spark, sf_dir):
    made = features.history_features(transactions(spark, sf_dir), ["txn_key"])
    return integrity.core_predictors(_doubles(made, *_FEATURE_DOUBLES), "txn_key")


@query("enhanced_predictors", _sql_features(", ".join(["txn_key", *CORE_FEATURES, "CAST(initiator_balance_before AS DOUBLE) AS initiator_balance_before", "CAST(recipient_balance_before AS DOUBLE) AS recipient_balance_before"])))
def enhanced_predictors(spark, sf_dir):
    rows = transactions(spark, sf_dir, True)
    made = materialize(features.history_features(rows, ["txn_key", "initiator_balance_before", "recipient_balance_before"]), "features")
    made = _doubles(made, *_FEATURE_DOUBLES, "initiator_balance_before", "recipient_balance_before")
    return integrity.enhanced_predictors(made, made.select("txn_key", "initiator_balance_before", "recipient_balance_before"), "txn_key")


@query("transaction_target", "SELECT txn_key, is_fraud FROM txn WHERE transaction_type = 'TRANSFER'")
def transaction_target(spark, sf_dir):
    return contract.eligible(transactions(spark, sf_dir)).select("txn_key", "is_fraud")


_SQL_BROKEN = """, b AS (SELECT *, CAST(amount * 100 AS BIGINT) % 20 AS k FROM txn), t AS (SELECT * FROM b WHERE transaction_type = 'TRANSFER'), c AS (SELECT k, initiator_prior_outgoing_count AS n, initiator_prior_outgoing_transfer_count + CASE WHEN k = 8 THEN 100000 ELSE 0 END AS t, initiator_prior_distinct_recipient_count AS dr,
      recipient_prior_incoming_count AS rn, recipient_prior_distinct_initiator_count + CASE WHEN k = 9 THEN 100000 ELSE 0 END AS di, CASE WHEN k = 10 THEN 0 ELSE initiator_prior_outgoing_amount_total END AS total, CASE WHEN k = 11 THEN NULL ELSE initiator_prior_outgoing_amount_mean END AS mean, CASE WHEN k = 12 THEN 1 ELSE initiator_prior_outgoing_amount_max END AS most FROM x)
    SELECT 'canonical.row_number' AS check_name, count(*) FILTER (k = 0) AS n_broken FROM b UNION ALL SELECT 'canonical.step', count(*) FILTER (k = 1 OR step < 0) FROM b UNION ALL SELECT 'canonical.type', count(*) FILTER (k = 2) FROM b UNION ALL SELECT 'canonical.amount', count(*) FILTER (k = 3 OR amount <= 0) FROM b
    UNION ALL SELECT 'canonical.initiator', count(*) FILTER (k = 4) FROM b UNION ALL SELECT 'canonical.recipient', count(*) FILTER (k = 5) FROM b UNION ALL SELECT 'canonical.label', count(*) FILTER (k = 6) FROM b UNION ALL SELECT 'lineage.type', count(*) FILTER (k = 6) FROM t UNION ALL SELECT 'lineage.window', count(*) FILTER (k = 7 AND step NOT BETWEEN 96 AND 119) FROM t
    UNION ALL SELECT 'core.transfers', count(*) FILTER (t > n) FROM c UNION ALL SELECT 'core.distinct_recipients', count(*) FILTER (dr > n) FROM c UNION ALL SELECT 'core.distinct_initiators', count(*) FILTER (di > rn) FROM c
    UNION ALL SELECT 'core.cold_total', count(*) FILTER ((n = 0) <> (total = 0)) FROM c UNION ALL SELECT 'core.cold_mean', count(*) FILTER ((n = 0) <> (mean IS NULL)) FROM c UNION ALL SELECT 'core.cold_max', count(*) FILTER ((n = 0) <> (most IS NULL)) FROM c"""


@query("constraint_violations", _sql_history() + ", x AS (SELECT *, CAST(round(amount * 100) AS BIGINT) % 20 AS k FROM h)" + _SQL_BROKEN)
def constraint_violations(spark, sf_dir):
    """Counts of rows that break each constraint, of relations in which the transaction's cents pick a fault for some rows."""
    rows = numbered(transactions(spark, sf_dir).drop("score")).withColumn("pick", F.expr("cast(amount * 100 as bigint) % 20"))
    spoil = lambda k, c, bad: F.when(F.col("pick") == k, F.lit(bad)).otherwise(F.col(c)).alias(c)
    spoilt = rows.select(spoil(0, "source_row_number", 1), spoil(1, "step", -1), spoil(2, "transaction_type", "LOAN"), spoil(3, "amount", 0), spoil(4, "initiator_id", ""), spoil(5, "recipient_id", ""), spoil(6, "is_fraud", 2))
    core = materialize(features.history_features(rows, ["pick"]), "core").withColumn("evaluation_partition", evaluation_partition(F.col("step")))
    lineage = core.select(spoil(6, "transaction_type", "PAYMENT"), "step", spoil(7, "evaluation_partition", "validation"))
    shift = lambda k, c: (F.col(c) + F.when(F.col("pick") == k, F.lit(100_000)).otherwise(F.lit(0))).alias(c)
    core = core.select(
        "initiator_prior_outgoing_count", "recipient_prior_incoming_count", "initiator_prior_distinct_recipient_count", shift(8, "initiator_prior_outgoing_transfer_count"), shift(9, "recipient_prior_distinct_initiator_count"), spoil(10, "initiator_prior_outgoing_amount_total", 0),
        spoil(11, "initiator_prior_outgoing_amount_mean", None), spoil(12, "initiator_prior_outgoing_amount_max", 1),
    )
    return integrity.violations(spoilt, "canonical").unionByName(integrity.violations(lineage, "lineage")).unionByName(integrity.violations(core, "core"))


@query("fk_orphans", "SELECT initiator_id FROM (SELECT DISTINCT initiator_id FROM txn) c WHERE initiator_id NOT IN (SELECT recipient_id FROM txn)")
def fk_orphans(spark, sf_dir):
    rows = transactions(spark, sf_dir)
    return integrity.orphans(rows.select("initiator_id").distinct(), rows.select(F.col("recipient_id").alias("initiator_id")), ["initiator_id"])


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return integrity.repeated_keys(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("read_back_difference", """, a AS (SELECT step, initiator_id, recipient_id FROM txn WHERE transaction_type = 'TRANSFER'), b AS (SELECT CASE WHEN step >= 120 THEN step + 1 ELSE step END AS step, initiator_id, recipient_id FROM a UNION ALL SELECT * FROM a WHERE step = 96)
    SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def read_back_difference(spark, sf_dir):
    """What a table and a changed copy of it (later steps moved, rows of one step twice) do not share."""
    rows = contract.eligible(transactions(spark, sf_dir)).select("step", "initiator_id", "recipient_id")
    changed = rows.withColumn("step", F.when(F.col("step") >= 120, F.col("step") + 1).otherwise(F.col("step"))).unionByName(rows.where("step = 96"))
    return integrity.difference(rows, changed)


_RATIO = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / {b} END"


@query("threshold_metrics", f""", {_SQL_SCORED}, m AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn, round(avg((score - label) * (score - label)), 9) AS brier FROM s)
    SELECT tp, fp, fn, tn, {_RATIO('(tp + fn)', '(tp + fp + fn + tn)')} AS prevalence, {_RATIO('(tp + fp)', '(tp + fp + fn + tn)')} AS alert_rate, {_RATIO('tp', '(tp + fp)')} AS precision, {_RATIO('tp', '(tp + fn)')} AS recall, {_RATIO('(2 * tp)', '(2 * tp + fp + fn)')} AS f1, brier FROM m""")
def threshold_metrics(spark, sf_dir):
    return metrics.threshold_metrics(scored(spark, sf_dir), THRESHOLD).withColumn("brier", F.round("brier", 9))


@query("average_precision", f", {_SQL_CURVE} SELECT round(sum(p * CAST(cum_p AS DOUBLE) / cum_n) / sum(p), 9) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query("roc_auc", f", {_SQL_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)), 9) AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("pr_curve", f", {_SQL_CURVE} SELECT score, CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS p, CAST(cum_n AS BIGINT) AS cum_n, CAST(cum_p AS BIGINT) AS cum_p FROM c")
def pr_curve(spark, sf_dir):
    return metrics.by_score(scored(spark, sf_dir))


@query("pr_curve_best_threshold", f", {_SQL_CURVE}, w AS (SELECT *, round(2.0::DOUBLE * cum_p / (cum_n + (SELECT sum(p) FROM g)), 12) AS f1 FROM c) SELECT score AS threshold, f1, CAST(cum_p AS DOUBLE) / cum_n AS precision, CAST(cum_p AS DOUBLE) / (SELECT sum(p) FROM g) AS recall FROM w ORDER BY f1 DESC, score DESC LIMIT 1")
def pr_curve_best_threshold(spark, sf_dir):
    return metrics.best_threshold(scored(spark, sf_dir))


@query("review_budgets", f""", {_SQL_SCORED}, o AS (SELECT label, row_number() OVER (ORDER BY score DESC, step, txn_key) AS k, count(*) OVER () AS n, sum(label) OVER () AS ones FROM s),
    b AS (SELECT CAST(unnest([50, 100, 200, 500, 1000]) AS INTEGER) AS budget_bp)
    SELECT budget_bp, count(*) AS reviewed, CAST(sum(label) AS BIGINT) AS captured, CAST(sum(label) AS DOUBLE) / count(*) AS precision, CAST(sum(label) AS DOUBLE) / max(ones) AS recall, (CAST(sum(label) AS DOUBLE) / count(*)) / (CAST(max(ones) AS DOUBLE) / max(n)) AS lift
    FROM b JOIN o ON k <= (n * budget_bp + 9999) // 10000 GROUP BY budget_bp""")
def review_budgets(spark, sf_dir):
    return metrics.review_budgets(scored(spark, sf_dir), TOTAL_ORDER)


@query("error_top3", f""", {_SQL_SCORED}, e AS (SELECT *, CASE WHEN score >= 0.5 AND label = 0 THEN 'false_positive' WHEN score < 0.5 AND label = 1 THEN 'false_negative' WHEN score >= 0.5 THEN 'correct_fraud' END AS error_group, CASE WHEN score >= 0.5 THEN score ELSE 1 - score END AS confidence FROM s),
    a AS (SELECT * FROM e WHERE error_group IS NOT NULL UNION ALL SELECT * REPLACE ('high_confidence_wrong' AS error_group, greatest(score, 1 - score) AS confidence) FROM e WHERE error_group LIKE 'false%'),
    r AS (SELECT error_group, CAST(row_number() OVER (PARTITION BY error_group ORDER BY confidence DESC, step, txn_key) AS INTEGER) AS place, score, txn_key FROM a) SELECT * FROM r WHERE place <= 3""")
def error_top3(spark, sf_dir):
    return metrics.error_examples(scored(spark, sf_dir), THRESHOLD, TOTAL_ORDER, ["txn_key"])


@query("amount_quartiles", "SELECT quantile_cont(CAST(amount AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(amount AS DOUBLE), 0.5) AS q2, quantile_cont(CAST(amount AS DOUBLE), 0.75) AS q3 FROM txn WHERE transaction_type = 'TRANSFER' AND step <= 95")
def amount_quartiles(spark, sf_dir):
    train = contract.eligible(transactions(spark, sf_dir)).where("step <= 95").select("amount")
    return spark.createDataFrame([tuple(metrics.quartiles(materialize(train, "amounts")))], "q1 double, q2 double, q3 double")


_MEDIANS = [c for c in CORE_FEATURES if c != "amount"]


@query("feature_medians", f"{_sql_history()}, t AS (SELECT * FROM h WHERE step <= 95) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM t" for c in _MEDIANS))
def feature_medians(spark, sf_dir):
    """The exact median of each history feature over train: what missing values are filled with."""
    made = features.history_features(transactions(spark, sf_dir).where("step <= 95"), ["txn_key"])
    found = quantiles(materialize(made.select(*_MEDIANS), "medians"), _MEDIANS, [0.5])
    return spark.createDataFrame([(c, v[0]) for c, v in found.items()], "column_name string, median double")


@query("amount_quartile_slices", f""", {_SQL_SCORED}, q AS (SELECT quantile_cont(CAST(amount AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM s WHERE step <= 95),
    b AS (SELECT score, label, CAST((CAST(amount AS DOUBLE) >= q[1]) AS INTEGER) + CAST((CAST(amount AS DOUBLE) >= q[2]) AS INTEGER) + CAST((CAST(amount AS DOUBLE) >= q[3]) AS INTEGER) AS band FROM s, q WHERE step >= 120),
    m AS (SELECT band, count(*) AS n_rows, count(*) FILTER (label = 1) AS positives, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5) AS alerts, round(avg((score - label) * (score - label)), 9) AS brier FROM b GROUP BY band)
    SELECT band, n_rows, positives, {_RATIO('tp', 'alerts')} AS precision, {_RATIO('tp', 'positives')} AS recall, {_RATIO('(2 * tp)', '(alerts + positives)')} AS f1, brier FROM m""")
def amount_quartile_slices(spark, sf_dir):
    rows = scored(spark, sf_dir, "amount")
    edges = metrics.quartiles(materialize(rows.where("step <= 95").select("amount"), "amounts"))
    return metrics.slice_metrics(rows.where("step >= 120"), edges, THRESHOLD).withColumn("brier", F.round("brier", 9))


@query("prevalence_baseline", f""", {_SQL_SCORED}, r AS (SELECT avg(CAST(label AS DOUBLE)) AS rate FROM s WHERE step <= 95), t AS (SELECT label FROM s WHERE step >= 120)
    SELECT count(*) AS n_rows, count(*) FILTER (label = 1) AS positives, round(avg((rate - label) * (rate - label)), 9) AS brier, round(max(rate), 9) AS score FROM t, r""")
def prevalence_baseline(spark, sf_dir):
    rows = scored(spark, sf_dir).drop("score")
    made = modelling.prevalence_baseline(rows.where("step <= 95"), rows.where("step >= 120"))
    return made.agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("positives"), F.round(F.avg(F.pow(F.col("score") - F.col("label"), 2)), 9).alias("brier"), F.round(F.max("score"), 9).alias("score"))


@query("model_test_scores")
def model_test_scores(spark, sf_dir):
    """Each test row's score by the logistic model of the enhanced features, fitted on train."""
    made = features.history_features(transactions(spark, sf_dir, True), ["txn_key", "initiator_balance_before", "recipient_balance_before", "is_fraud"])
    data = materialize(modelling.model_data(made), "model")
    fitted = modelling.Fitted(next(s for s in modelling.SPECS if s.name == "enhanced_logistic"), data.where("evaluation_partition = 'train'"))
    return fitted.score(data.where("evaluation_partition = 'test'")).select("txn_key", "label", F.round("score", 6).alias("score"))


_EVENT_SQL = """WITH e AS (SELECT event_id, CAST(floor(epoch(ts) / 3600) AS INTEGER) AS step, CAST(user_id AS VARCHAR) AS entity, value AS amount FROM events WHERE value > 0),
    s AS (SELECT entity, step, count(*) AS n, sum(amount) AS total, max(amount) AS most FROM e GROUP BY entity, step),
    p AS (SELECT entity, step, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_count, round(coalesce(sum(total) OVER w, 0), 6) AS prior_total, max(most) OVER w AS prior_max FROM s WINDOW w AS (PARTITION BY entity ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, step, entity, prior_count, prior_total, prior_max FROM e JOIN p USING (entity, step)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("prior_total", F.round("prior_total", 6))


@query("event_history_batch")
def event_history_batch(spark, sf_dir):
    return _rounded(history.batch_features(history.events_as_transactions(table(spark, sf_dir, "events"))))


@query("event_history_stream")
def event_history_stream(spark, sf_dir):
    """The events as a stream; every file is read once, and the query ends when none is left."""
    events = table(spark, sf_dir, "events")
    own = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{own}/in")
    return _rounded(history.run_available(spark, f"{own}/in", events.schema, f"{own}/work"))


SQL["event_history_batch"] = SQL["event_history_stream"] = _EVENT_SQL
