"""The relations as catalog tables and views, with a tracked version."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import code_identity
from ..functions.patterns import evaluation_partition
from ..operators import integrity
from ..schema import CORE_FEATURES, MODELLED_TYPE

VERSION = 2
#: Canonical rows of a bucket (some 200 MB). All tables of a load have as many buckets by transaction_id, a file each, and are joined without a shuffle.
BUCKET_ROWS = 1 << 21
VIEWS = {
    "core_predictors": f"SELECT transaction_id, {', '.join(CORE_FEATURES)} FROM {{db}}.core_feature",
    "enhanced_predictors": f"SELECT transaction_id, {', '.join(CORE_FEATURES)}, initiator_balance_before, recipient_balance_before FROM {{db}}.core_feature JOIN {{db}}.enhanced_feature USING (transaction_id)",
    "transaction_target": "SELECT transaction_id, is_fraud FROM {db}.canonical_transaction WHERE transaction_type = 'TRANSFER'",
}


def checksum() -> str:
    return hashlib.sha256(repr((VERSION, sorted(VIEWS.items()))).encode()).hexdigest()


def apply_schema(spark: SparkSession, database: str) -> None:
    """Create the database and its version row; an untracked or changed schema is refused."""
    tracked = spark.catalog.databaseExists(database) and spark.catalog.tableExists(f"{database}.schema_migration")
    if spark.catalog.databaseExists(database) and not tracked and spark.catalog.listTables(database):
        raise integrity.IntegrityError(f"{database} has tables but no version")
    if tracked:
        held = [tuple(r) for r in spark.table(f"{database}.schema_migration").collect()]
        if held != [(VERSION, checksum())]:
            raise integrity.IntegrityError(f"{database} has another schema: {held}")
        return
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.createDataFrame([(VERSION, checksum())], "version int, sha256 string").coalesce(1).write.saveAsTable(f"{database}.schema_migration")


def _sums(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free hash of them."""
    n, x = df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(df.columns))), F.lit(0))).first()
    return n, x


def relations(canonical: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    """The stored tables of canonical rows and features (with transaction_id and step). Balances are the features', or the canonical rows' where features have none."""
    dressed = features if "initiator_balance_before" in features.columns else canonical.where(F.col("transaction_type") == MODELLED_TYPE)
    made = features.withColumn("evaluation_partition", evaluation_partition(F.col("step")))
    return {
        "canonical_transaction": canonical, "feature_lineage": made.select("transaction_id", "step", "transaction_type", "evaluation_partition"), "core_feature": made.select("transaction_id", *CORE_FEATURES),
        "enhanced_feature": dressed.select("transaction_id", "initiator_balance_before", "recipient_balance_before"),
    }


def buckets(canonical: DataFrame) -> int:
    """In how many buckets a load of canonical rows is stored."""
    return max(1, -(-canonical.count() // BUCKET_ROWS))


def store(spark: SparkSession, database: str, canonical: DataFrame, features: DataFrame, dealt: Callable[[int], DataFrame] | None = None) -> str:
    """Write canonical rows and features as tables once, check their keys and that each TRANSFER row has all its parts, read them back, and create the views: loaded.

    dealt spares shuffles of wide rows: it gives the canonical rows hashed by transaction_id to a number of partitions, and says that features were written in buckets() files, one for each hash. Balances of stored canonical rows are not shuffled again.

    A repeated load writes nothing: it verifies that the same rows would result from the same code (verified_existing) and raises otherwise.
    """
    apply_schema(spark, database)
    wanted, read = relations(canonical, features), lambda name: spark.table(f"{database}.{name}")
    if spark.catalog.tableExists(f"{database}.completed_load"):
        held = {r["table_name"]: (r["n_rows"], r["hash"], r["code"]) for r in read("completed_load").collect()}  # a row per table
        new = {name: (*_sums(df), code_identity()) for name, df in wanted.items()}
        if held != new:
            raise integrity.IntegrityError(f"{database} holds another load: {sorted(n for n in new if held.get(n) != new[n])}")
        if changed := [name for name, (n, x, _) in held.items() if _sums(read(name)) != (n, x)]:
            raise integrity.IntegrityError(f"stored rows of {changed} are not those that were loaded")
        return "verified_existing"
    expected, n_buckets = {}, buckets(canonical)
    for name, df in wanted.items():
        if name == "canonical_transaction":
            put = dealt(n_buckets).select(*df.columns) if dealt else df.repartition(n_buckets, "transaction_id")
        elif name == "enhanced_feature" and "initiator_balance_before" not in features.columns:
            put = relations(read("canonical_transaction"), features)[name]  # lies in its buckets
        else:
            put = df if dealt else df.repartition(n_buckets, "transaction_id")
        writer = put.write.mode("overwrite").option("compression", "zstd").bucketBy(n_buckets, "transaction_id").sortBy("transaction_id")
        (writer.partitionBy("evaluation_partition") if name == "feature_lineage" else writer).saveAsTable(f"{database}.{name}")
        expected[name] = _sums(df)
        if _sums(read(name).select(*df.columns)) != expected[name]:
            raise integrity.IntegrityError(f"{database}.{name} read back differs from the rows written")
    for child, parent in (("feature_lineage", "canonical_transaction"), ("core_feature", "feature_lineage"), ("enhanced_feature", "core_feature")):
        if not integrity.orphans(read(child), read(parent), ["transaction_id"]).isEmpty() or not integrity.repeated_keys(read(child), ["transaction_id"]).isEmpty():
            raise integrity.IntegrityError(f"{database}.{child} has orphans or repeated keys")
    if not integrity.incomplete_lineage(read("feature_lineage"), read("canonical_transaction"), [read("core_feature"), read("enhanced_feature")], stored=True).isEmpty():
        raise integrity.IntegrityError(f"{database} has TRANSFER rows without all their features")
    for name, text in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {text.format(db=database)}")
    spark.createDataFrame([(name, n, x, code_identity()) for name, (n, x) in expected.items()], "table_name string, n_rows long, hash long, code string").coalesce(1).write.saveAsTable(f"{database}.completed_load")
    return "loaded"


def read_back(spark: SparkSession, database: str) -> DataFrame:
    """Each feature row with its lineage and canonical row, matched bucket by bucket: sides of the same buckets need no exchange."""
    lineage, core, canonical = (spark.table(f"{database}.{n}").hint("merge") for n in ("feature_lineage", "core_feature", "canonical_transaction"))
    there = canonical.select("transaction_id", "source_row_number", "is_fraud", F.col("amount").alias("canonical_amount"), F.col("step").alias("canonical_step"))
    return core.join(lineage, "transaction_id").join(there, "transaction_id")


def export(spark: SparkSession, database: str, url: str, properties: dict[str, str], digits: int = 31) -> dict[str, int]:
    """Append the stored relations to tables of another database, read them there again, and raise unless all rows are the same: rows by table. digits: the most that its decimals have; wider columns are cast to that, which raises for a value that needs more."""
    counts = {}
    for name in ("canonical_transaction", "feature_lineage", "core_feature", "enhanced_feature"):
        rows = spark.table(f"{database}.{name}")
        narrow = [F.col(f.name).cast(T.DecimalType(digits, f.dataType.scale)) if isinstance(f.dataType, T.DecimalType) and f.dataType.precision > digits else F.col(f.name) for f in rows.schema.fields]
        write_jdbc(rows.select(*[c.alias(n) for c, n in zip(narrow, rows.columns)]), url, name, properties)
        held = read_jdbc(spark, url, name, properties).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        if (seen := _sums(held)) != _sums(rows):
            raise integrity.IntegrityError(f"{name} read from {url} differs from the rows written")
        counts[name] = seen[0]
    return counts


def write_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str], batch: int = 1000) -> None:
    """Append df to a table of another database, batch rows at a time."""
    if not 1 <= batch <= 10_000:
        raise ValueError("batch must be 1 to 10000")
    df.write.option("batchsize", batch).jdbc(url, name, mode="append", properties=properties)


def read_jdbc(spark: SparkSession, url: str, name: str, properties: dict[str, str], fetch: int = 1000) -> DataFrame:
    return spark.read.option("fetchsize", fetch).jdbc(url, name, properties=properties)
