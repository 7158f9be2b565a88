"""Row rules of the source contract: the first rule that fails, as a column, and reconciliation of accepted rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decimals import fraction_digits, integer_digits, is_plain_decimal
from ..functions.identity import transaction_id, uuid5
from ..functions.patterns import evaluation_partition, is_blank
from ..schema import CANONICAL_SCHEMA, MODELLED_TYPE, MONEY, MONEY_COLUMNS, PARTITIONS, STEP_MOST, TRANSACTION_TYPES
from .integrity import IntegrityError


class CanonicalValidationError(ValueError):
    """A row that breaks the contract; the message has its number, column and reason."""


_REASONS = [
    ("row", "wrong number of fields or bad quoting"), ("step", "not an integer"), ("step", "outside 0..2147483647"), ("transactionType", "unknown type"), ("isFraud", "not 0 or 1"), ("initiator", "blank"), ("recipient", "blank"),
    *[(c, "not a plain decimal") for c in MONEY_COLUMNS], ("amount", "not positive"),
]


#: Five plain decimals that MONEY holds: almost any row's money, in one pattern.
_USUAL = r"^[+-]?[0-9]{1,16}+(?:\.[0-9]{1,2}+)?+(?:,[+-]?[0-9]{1,16}+(?:\.[0-9]{1,2}+)?+){4}\z"


def broken_rule(unusual: int = 0) -> Column:
    """Number of the first rule of the contract that a row of text columns breaks, from 1, or 0 (unusual, where the money may not fit the type MONEY). A null column breaks the first rule that reads it.

    malformed (boolean) stands for a row of wrong width or quoting and comes first.
    """
    in_range = F.coalesce(F.col("step").try_cast("long").between(0, STEP_MOST), F.lit(False))  # of a text of digits
    rules = [
        F.col("malformed"), ~F.col("step").rlike(r"^[+-]?[0-9]+\z"), ~in_range, ~F.col("transactionType").isin(TRANSACTION_TYPES), ~F.col("isFraud").isin("0", "1"), is_blank(F.col("initiator")), is_blank(F.col("recipient")),
    ]
    money = F.transform(F.array(*MONEY_COLUMNS), lambda x: F.coalesce(~is_plain_decimal(x), F.lit(True)))  # one pattern in the plan, not five
    rest = F.array_position(money, True).cast("int")
    usual = F.coalesce(F.concat(*[x for c in MONEY_COLUMNS for x in (F.lit(","), F.col(c))][1:]).rlike(_USUAL), F.lit(False))
    not_positive = F.coalesce(F.col("amount").rlike(r"^-|^\+?[0.]*\z"), F.lit(True))
    positive = lambda otherwise: F.when(not_positive, F.lit(len(_REASONS))).otherwise(F.lit(otherwise))
    found = F.when(usual, positive(0)).when(rest > 0, rest + len(rules)).otherwise(positive(unusual))
    for number, broken in reversed(list(enumerate(rules, 1))):
        found = F.when(F.coalesce(broken, F.lit(True)), F.lit(number)).otherwise(found)
    return found


def with_errors(rows: DataFrame) -> DataFrame:
    """The rows that break a rule, with column e: struct<column, reason> of the first rule that each one breaks.

    The rule number is the argument of a generator, so it is computed once a row; a filter on it would be pushed down and repeat all patterns.
    """
    code = broken_rule()
    reasons = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(why).alias("reason")) for c, why in _REASONS])
    return rows.select("*", F.explode(F.array_remove(F.array(code), 0)).alias("__code")).withColumn("e", F.element_at(reasons, F.col("__code"))).drop("__code")


def errors(rows: DataFrame) -> DataFrame:
    """source_row_number, column and reason of every row that breaks a rule."""
    return with_errors(rows).select("source_row_number", F.col("e.column").alias("column"), F.col("e.reason").alias("reason"))


def _as_read(step: str, kind: str, initiator: str, recipient: str, label: str, money: list[str]) -> Column:
    """What a row is known by, in text rows and typed ones alike: its number, parties, money as it is spelt, and the values of step and label."""
    given = {"t": F.col(kind), "i": F.col(initiator), "r": F.col(recipient)} | {f"m{i}": F.col(c) for i, c in enumerate(money)}
    numbers = {"n": F.col("source_row_number").cast("long"), "s": F.col(step).try_cast("int"), "f": F.col(label).try_cast("int")}
    return F.struct(*[F.coalesce(c, F.lit(-1)).alias(n) for n, c in numbers.items()], *[F.coalesce(c, F.lit("")).alias(n) for n, c in given.items()])


def _measures(sums: Callable[[Column], list[Column]] | None) -> list[Column]:
    """Aggregates over rows that have __code and __as_read. The first bad row is a number and not a struct, for which all rows would be sorted."""
    bad = F.min(F.when(F.col("__code") > 0, F.col("source_row_number") * (len(_REASONS) + 1) + F.col("__code")))
    return [bad.alias("bad"), F.count_if(F.col("__code") < 0).alias("unusual"), *(sums(F.col("__as_read")) if sums else [])]


def _with_code(rows: DataFrame) -> DataFrame:
    return rows.select("*", broken_rule(-1).alias("__code"), _as_read("step", "transactionType", "initiator", "recipient", "isFraud", MONEY_COLUMNS).alias("__as_read"))


def _money(rows: DataFrame, found: dict) -> T.DecimalType:
    """The type of money by the measures found of rows; raises for the first row that breaks a rule."""
    if found["bad"] is not None:
        number, code = divmod(found["bad"], len(_REASONS) + 1)
        column, reason = _REASONS[code - 1]
        raise CanonicalValidationError(f"CSV row {number}, {column}: {reason}")
    if not found["unusual"]:
        return MONEY
    widest = lambda digits: F.max(F.array_max(F.transform("m", digits)))
    whole, part = rows.select(F.array(*MONEY_COLUMNS).alias("m")).agg(widest(integer_digits), widest(fraction_digits)).first()
    scale = max(MONEY.scale, part or 0)
    precision = max(MONEY.precision, (whole or 1) + scale)
    if precision > 38:
        raise CanonicalValidationError(f"money of {whole} integer and {part} fraction digits needs more than the 38 digits of a decimal")
    return T.DecimalType(precision, scale)


def _sums(found: dict) -> tuple:
    return tuple(v for k, v in found.items() if k not in ("bad", "unusual"))


def checked(rows: DataFrame, sums: Callable[[Column], list[Column]] | None = None) -> tuple[T.DecimalType, tuple]:
    """Raise for the rejected row with the smallest number; else the decimal that holds all money exactly, with two fraction digits at least, so that nothing is ever rounded, and sums of the rows as they were read. One pass, and one more for the digits where MONEY may not do: a row goes to the driver. Raises where 38 digits do not do."""
    found = _with_code(rows).agg(*_measures(sums)).first().asDict()
    return _money(rows, found), _sums(found)


def write_checked(rows: DataFrame, artifact_sha256: str, path: str, sums: Callable[[Column], list[Column]]) -> tuple:
    """Write canonical() rows of text rows and check these in the same pass, as checked() does; sums of the rows as they were read. Where it raises, what was written is of no use; where MONEY does not do, rows are written again."""
    seen = Observation()
    canonical(_with_code(rows).observe(seen, *_measures(sums)), artifact_sha256).write.parquet(path)
    found = seen.get
    money = _money(rows, found)
    if money != MONEY:
        canonical(rows, artifact_sha256, money).write.mode("overwrite").parquet(path)
    return _sums(found)


def require_as_read(written: DataFrame, artifact_sha256: str, sums: Callable[[Column], list[Column]], expected: tuple) -> None:
    """Raise unless typed rows are the text rows whose sums checked() gave: numbers, parties, labels and spelling by the sums, and in each row money that is what its spelling says, and the identifier of its number."""
    money = dict(zip(["amount", "initiator_balance_before", "initiator_balance_after", "recipient_balance_before", "recipient_balance_after"], MONEY_COLUMNS))
    same = [F.col(c).eqNullSafe(F.col(f"{text}_literal").try_cast(written.schema[c].dataType)) for c, text in money.items()]
    same.append(F.col("transaction_id").eqNullSafe(transaction_id(F.lit(artifact_sha256), F.col("source_row_number"))))
    row = _as_read("step", "transaction_type", "initiator_id", "recipient_id", "is_fraud", [f"{c}_literal" for c in MONEY_COLUMNS])
    different, *found = written.agg(F.count_if(~reduce(lambda a, b: a & b, same)), *sums(row)).first()
    if different or tuple(found) != expected:
        raise IntegrityError(f"rows read back differ from the source: {different} in money or identifiers, sums {found}, not {list(expected)}")


def canonical(rows: DataFrame, artifact_sha256: str, money_as: T.DecimalType = MONEY) -> DataFrame:
    """Typed rows of valid text rows, with deterministic ids and the source's spelling of money as *_literal."""
    sha = F.lit(artifact_sha256)
    money = lambda c: F.col(c).try_cast(money_as)  # noqa: E731  (rows were validated; a plain cast could be evaluated on lines that a filter drops)
    made = rows.select(
        transaction_id(sha, F.col("source_row_number")).alias("transaction_id"), uuid5(sha).alias("artifact_id"), F.col("source_row_number").cast("long").alias("source_row_number"), F.col("step").try_cast("int").alias("step"), F.col("transactionType").alias("transaction_type"), money("amount").alias("amount"),
        F.col("initiator").alias("initiator_id"), money("oldBalInitiator").alias("initiator_balance_before"), money("newBalInitiator").alias("initiator_balance_after"),
        F.col("recipient").alias("recipient_id"), money("oldBalRecipient").alias("recipient_balance_before"), money("newBalRecipient").alias("recipient_balance_after"), F.col("isFraud").try_cast("int").alias("is_fraud"),
        *[F.col(c).alias(f"{c}_literal") for c in MONEY_COLUMNS],
    )
    return made.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in CANONICAL_SCHEMA.fields], *[f"{c}_literal" for c in MONEY_COLUMNS])


def reconciliation(rows: DataFrame) -> DataFrame:
    """One row: counts by label and type, step extremes, row-number contiguity."""
    return counted(tallied(rows), rows)


def tallied(rows: DataFrame) -> DataFrame:
    """Number of rows (n), smallest and largest row number (low, high) by step, type and label."""
    return rows.groupBy("step", "transaction_type", "is_fraud").agg(F.count("*").alias("n"), F.min("source_row_number").alias("low"), F.max("source_row_number").alias("high"))


def counted(tallies: DataFrame, rows: DataFrame) -> DataFrame:
    """The reconciliation of rows from their tallies."""
    held = lambda column, value: F.coalesce(F.sum(F.when(F.col(column) == value, F.col("n"))), F.lit(0))
    kinds = [held("transaction_type", t).alias(f"n_{t.lower()}") for t in TRANSACTION_TYPES]
    sums = tallies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), held("is_fraud", 1).alias("n_fraud"), held("is_fraud", 0).alias("n_legitimate"), *kinds,
        F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count_distinct("step").alias("n_steps"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    # distinct numbers as bits of words of 64: rows in order leave their task as a word, not as 64 numbers
    number = F.col("source_row_number").cast("long")
    words = rows.groupBy(F.shiftright(number, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    distinct = words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("distinct"))
    contiguous = (F.col("high") - F.col("low") + 1 == F.col("n_rows")) & (F.col("distinct") == F.col("n_rows"))
    return sums.crossJoin(distinct).withColumn("contiguous", contiguous).drop("low", "high", "distinct")


def steps_fall(tallies: DataFrame) -> bool:
    """Whether a row's step is below that of the row before, of rows with distinct consecutive numbers, by their tallies.

    If not, each step has a run of numbers for itself, and the run after it belongs to a higher step.
    """
    runs = tallies.groupBy("step").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    after = runs.select(F.col("step").alias("next_step"), F.col("low").alias("next_low"))
    met = runs.join(after, F.col("high") + 1 == F.col("next_low"), "left")
    return not met.where((F.col("high") - F.col("low") + 1 != F.col("n")) | (F.col("next_step") < F.col("step"))).isEmpty()


def regressions(rows: DataFrame) -> DataFrame:
    """Rows whose step is below that of the row before, in source order, without a global window.

    Rows are numbered consecutively, so each row's predecessor is found by an equi-join on its number.
    """
    before = rows.select((F.col("source_row_number") + 1).alias("source_row_number"), F.col("step").alias("previous_step"))
    return rows.select("source_row_number", "step").join(before, "source_row_number").where("step < previous_step")


def contract_sums(n: Column) -> list[Column]:
    """What a contract holds rows to, as aggregates over rows (n is 1) or their tallies (n is their number): as_contract() takes their values."""
    held = lambda ok, name: F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias(name)
    part = F.when(F.col("transaction_type") == MODELLED_TYPE, evaluation_partition(F.col("step")))
    return [
        held(F.lit(True), "rows"), held(F.col("is_fraud") == 0, "label 0"), held(F.col("is_fraud") == 1, "label 1"), F.min("step").alias("low"), F.max("step").alias("high"),
        *[held(F.col("transaction_type") == t, t) for t in TRANSACTION_TYPES], *[held(part == name, name) for name, _, _ in PARTITIONS],
    ]


def as_contract(sums: dict) -> dict:
    """Values of contract_sums() as a contract names them: counts by label, type and evaluation partition (of TRANSFER rows), and step extremes."""
    some = lambda names: {k: sums[k] for k in names if sums[k]}
    parts = some(sorted(name for name, _, _ in PARTITIONS))
    return {"row_count": sums["rows"], "legitimate_count": sums["label 0"], "fraud_count": sums["label 1"], "transaction_type_counts": some(TRANSACTION_TYPES), "step_min": sums["low"], "step_max": sums["high"], "partitions": parts}


def reconciled(rows: DataFrame, n: str | None = None) -> dict:
    """What a contract holds rows to, as numbers by name; of tallies, n is the column with their numbers of rows."""
    return as_contract(rows.agg(*contract_sums(F.col(n) if n else F.lit(1))).first().asDict())
