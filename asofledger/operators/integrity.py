"""Constraints of the stored relations as queries: each gives the rows that break it, so an empty result means it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CORE_FEATURES, MODELLED_TYPE, PARTITIONS, TRANSACTION_TYPES


class IntegrityError(ValueError):
    """Stored rows that break a constraint."""


def checks() -> dict[str, dict[str, Column]]:
    """Named conditions per relation."""
    c = F.col
    window = reduce(lambda a, b: a | b, [(c("evaluation_partition") == name) & c("step").between(first, last) for name, first, last in PARTITIONS])
    cold = c("initiator_prior_outgoing_count") == 0
    return {
        "canonical": {"row_number": c("source_row_number") >= 2, "step": c("step") >= 0, "type": c("transaction_type").isin(TRANSACTION_TYPES), "amount": c("amount") > 0, "initiator": F.length("initiator_id") > 0, "recipient": F.length("recipient_id") > 0, "label": c("is_fraud").isin(0, 1)},
        "lineage": {"type": c("transaction_type") == MODELLED_TYPE, "window": window},
        "core": {
            "transfers": c("initiator_prior_outgoing_transfer_count") <= c("initiator_prior_outgoing_count"), "distinct_recipients": c("initiator_prior_distinct_recipient_count") <= c("initiator_prior_outgoing_count"),
            "distinct_initiators": c("recipient_prior_distinct_initiator_count") <= c("recipient_prior_incoming_count"), "cold_total": cold == (c("initiator_prior_outgoing_amount_total") == 0), "cold_mean": cold == c("initiator_prior_outgoing_amount_mean").isNull(), "cold_max": cold == c("initiator_prior_outgoing_amount_max").isNull(),
        },
    }


def violations(df: DataFrame, relation: str) -> DataFrame:
    """Per check of a relation: how many rows break it; a condition that is null counts as broken."""
    named = checks()[relation]
    counts = df.agg(*[F.count_if(F.coalesce(~ok, F.lit(True))).alias(name) for name, ok in named.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f"{relation}.{n}").alias("check_name"), F.col(n).alias("n_broken")) for n in named])).alias("x")).select("x.*")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child without a parent."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with multiplicity, and where they are."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def require(df: DataFrame, relation: str) -> None:
    broken = violations(df, relation).where("n_broken > 0").collect()  # a row per check
    if broken:
        raise IntegrityError(", ".join(f"{r['check_name']}: {r['n_broken']} rows" for r in broken))


def require_types(df: DataFrame, expected: dict[str, str]) -> None:
    """Raise unless each named column is there with its type (a prefix such as decimal will do)."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [f"{c}: {found.get(c, 'missing')}, not {t}" for c, t in expected.items() if not found.get(c, "").startswith(t)]
    if wrong:
        raise IntegrityError("; ".join(wrong))


def incomplete_lineage(lineage: DataFrame, canonical: DataFrame, children: list[DataFrame], key: str = "transaction_id", stored: bool = False) -> DataFrame:
    """Keys with a part missing or without a whole: of every TRANSFER row of canonical there must be one row in lineage and in each child, and no other. Columns: key, problem, n_rows (how many rows of the key have it).

    Keys of all relations meet in one grouping, so each relation is shuffled once. Where all are stored in as many buckets by key, each part meets the canonical rows bucket by bucket instead, and nothing is shuffled. A null key meets none.
    """
    relations = [canonical.where(F.col("transaction_type") == MODELLED_TYPE), lineage, *children]
    if stored:
        counted = lambda i: relations[i].groupBy(key).agg(F.count("*").alias(f"__n{i}"))
        return reduce(DataFrame.unionByName, [_problems(counted(0).join(counted(i), key, "full_outer").na.fill(0, ["__n0", f"__n{i}"]), key, {i: name}) for i, name in _parts(children)])
    held = reduce(DataFrame.unionByName, [df.select(key, F.lit(i).alias("__of")) for i, df in enumerate(relations)])
    counts = held.groupBy(key).agg(*[F.count_if(F.col("__of") == i).alias(f"__n{i}") for i in range(len(relations))])
    return _problems(counts, key, dict(_parts(children)))


def _parts(children: list[DataFrame]) -> list[tuple[int, str]]:
    return list(enumerate(["lineage", *[f"child {i}" for i in range(1, len(children) + 1)]], 1))


def _problems(counts: DataFrame, key: str, names: dict[int, str]) -> DataFrame:
    """What is missing or stray by key, of counts of the whole's rows (__n0) and of named parts' (__n1 and on)."""
    n = lambda i: F.col(f"__n{i}")
    alone = lambda i, other: F.when((n(other) == 0) | F.col(key).isNull(), n(i)).otherwise(0)
    problems = [(f"no {name}", alone(0, i)) for i, name in names.items()] + [(f"stray {name}", alone(i, 0)) for i, name in names.items()]
    return counts.select(key, F.inline(F.array(*[F.struct(F.lit(p).alias("problem"), m.alias("n_rows")) for p, m in problems]))).where("n_rows > 0")


def core_predictors(features: DataFrame, key: str) -> DataFrame:
    """Key and predictors only: no label, step or other identity."""
    return features.select(key, *CORE_FEATURES)


def enhanced_predictors(core: DataFrame, enhanced: DataFrame, key: str) -> DataFrame:
    return core_predictors(core, key).join(enhanced.select(key, "initiator_balance_before", "recipient_balance_before"), key)
