"""Decimals beyond a decimal's 38 digits, as column expressions over limbs of LIMB digits: quotients of PRECISION digits, and sums that never round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decimals import PRECISION, fraction_digits, integer_digits

#: Digits of a limb: a limb, and a remainder below a long times a limb's base, are held exactly.
LIMB = 18
#: Limbs of a dividend's digits, and of the digits that division adds: enough for the first PRECISION ones after the leading zeros of the smallest quotient of a long.
WHOLE, ADDED = 4, 3
TEN = f"cast(1{'0' * LIMB} as decimal(38,0))"


def _exact(c: Column) -> Column:
    return c.try_cast("decimal(38,0)")


def as_text(digits: Column, exponent: Column, negative: Column) -> Column:
    """digits * 10 ** exponent (of at most 0 or more) as decimal numbers are spelt: with an exponent where it is above 0 or the value below a millionth."""
    size = F.length(digits)
    left = exponent + size
    plain = (exponent <= 0) & (left > -6)
    point = F.when(plain, left).otherwise(F.lit(1))
    body = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, digits)
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
    )
    power = left - point
    return F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), body, F.when(power == 0, F.lit("")).otherwise(F.concat(F.lit("E"), F.when(power > 0, F.lit("+")).otherwise(F.lit("")), power.cast("string"))))


def with_quotient(df: DataFrame, name: str, total: Column, count: Column) -> DataFrame:
    """df with name: total / count to PRECISION significant digits, rounded half to even, as text; null where total is null or count is null or not positive.

    total is a plain decimal of at most WHOLE * LIMB digits, as text or decimal. Long division by limbs: a remainder and the next limb give the next limb of the quotient. An exact quotient keeps the total's trailing zeros, as decimal arithmetic has it.
    """
    text = total.cast("string")
    digits = F.ltrim(F.regexp_replace(text, "[^0-9]", ""), F.lit("0"))
    checked = F.when(F.length(digits) > WHOLE * LIMB, F.raise_error(F.concat(F.lit("too many digits to divide: "), text))).otherwise(F.lpad(digits, WHOLE * LIMB, "0"))
    made = df.withColumns({"__d": checked, "__s": fraction_digits(text), "__neg": text.startswith("-"), "__n": F.when(count > 0, _exact(count)), "__r": _exact(F.lit(0))})
    for i in range(WHOLE + ADDED):
        limb = _exact(F.substring("__d", 1 + LIMB * i, LIMB)) if i < WHOLE else _exact(F.lit(0))
        made = made.withColumn("__x", (F.col("__r") * F.expr(TEN)).cast("decimal(38,0)") + limb).withColumns({f"__q{i}": F.expr("cast(__x div __n as string)"), "__r": F.expr("cast(__x % __n as decimal(38,0))")})
    made = made.withColumns({"__d": F.ltrim(F.concat(*[F.lpad(f"__q{i}", LIMB, "0") for i in range(WHOLE + ADDED)]), F.lit("0")), "__more": F.col("__r") > 0})
    # as few of the added digits as an exact quotient needs
    made = made.withColumn("__k", F.when(F.col("__more"), F.col("__d")).otherwise(F.regexp_replace("__d", rf"0{{1,{ADDED * LIMB}}}\z", "")))
    made = made.withColumn("__e", F.length("__d") - F.length("__k") - F.col("__s") - ADDED * LIMB)
    rest = F.substring("__k", F.lit(PRECISION + 1), F.length("__k"))
    half, beyond = F.substring(rest, 1, 1), F.col("__more") | F.regexp_like(F.substring(rest, F.lit(2), F.length(rest)), F.lit("[1-9]"))
    up = (half > "5") | ((half == "5") & (beyond | F.substring("__k", PRECISION, 1).isin("1", "3", "5", "7", "9")))
    made = made.withColumn("__up", (_exact(F.substring("__k", 1, PRECISION)) + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("string"))
    long_ = F.length("__k") > PRECISION
    kept = F.when(F.col("__k") == "", F.lit("0")).when(long_, F.substring("__up", 1, PRECISION)).otherwise(F.col("__k"))
    exponent = F.when(F.col("__k") == "", -F.col("__s")).otherwise(F.col("__e") + F.when(long_, F.length("__k") - PRECISION + F.length("__up") - PRECISION).otherwise(F.lit(0)))
    made = made.withColumns({"__k": kept, "__e": exponent})
    return made.withColumn(name, F.when(F.col("__n").isNotNull() & F.col("__s").isNotNull(), as_text(F.col("__k"), F.col("__e"), F.col("__neg")))).drop("__d", "__s", "__neg", "__n", "__r", "__x", "__more", "__k", "__e", "__up", *[f"__q{i}" for i in range(WHOLE + ADDED)])


def exact_sums(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """keys and name: the exact sum of a column of plain decimals as text, of any width, with as many fraction digits as the longest of a group's; null for a group without values.

    One pass finds how many limbs the widest value needs. The limbs of signed values are summed apart, which Spark does map-side, and carried once a group.
    """
    text = F.col(column).cast("string")
    whole, part = df.agg(F.max(integer_digits(text)), F.max(fraction_digits(text))).first()
    above, behind = -(-max(1, whole or 1) // LIMB), -(-(part or 0) // LIMB)
    n = above + behind
    zeros = F.lit("0" * above * LIMB)
    before = F.substring(F.concat(zeros, F.regexp_extract(text, r"^[+-]?([0-9]*)", 1)), -above * LIMB, above * LIMB)
    digits = F.concat(before, F.rpad(F.regexp_extract(text, r"\.([0-9]+)", 1), behind * LIMB, "0") if behind else F.lit(""))
    sign = F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    given = df.select(*keys, text.alias("__t"), digits.alias("__d"), sign.alias("__g"))
    limbs = [F.sum((F.substring("__d", 1 + LIMB * i, LIMB).try_cast("decimal(18,0)") * F.col("__g")).cast("decimal(28,0)")).alias(f"__s{i}") for i in range(n)]
    made = given.groupBy(*keys).agg(*limbs, F.max(fraction_digits(F.col("__t"))).alias("__f"))
    for sign_name, factor in (("p", 1), ("m", -1)):  # of the sum and of its negative, one has no borrow left
        made = made.withColumn("__c", _exact(F.lit(0)))
        for i in reversed(range(n)):
            made = made.withColumn("__t", _exact(F.col(f"__s{i}") * factor + F.col("__c"))).withColumn(f"__{sign_name}{i}", F.expr(f"pmod(__t, {TEN})")).withColumn("__c", F.expr(f"cast((__t - __{sign_name}{i}) div {TEN} as decimal(38,0))"))
        made = made.withColumn(f"__{sign_name}", F.col("__c"))
    joined = lambda s: F.concat(F.when(F.col(f"__{s}") > 0, F.col(f"__{s}").cast("string")).otherwise(F.lit("")), *[F.lpad(F.col(f"__{s}{i}").cast("string"), LIMB, "0") for i in range(n)])
    negative = F.col("__p") < 0
    made = made.withColumn("__k", F.when(negative, joined("m")).otherwise(joined("p")))
    made = made.withColumn("__k", F.substring("__k", F.lit(1), F.length("__k") - behind * LIMB + F.col("__f")))
    bare = F.ltrim(F.substring(F.col("__k"), F.lit(1), F.length("__k") - F.col("__f")), F.lit("0"))
    value = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), F.when(bare == "", F.lit("0")).otherwise(bare), F.when(F.col("__f") > 0, F.concat(F.lit("."), F.substring(F.col("__k"), F.length("__k") - F.col("__f") + 1, F.col("__f")))).otherwise(F.lit("")))
    return made.select(*keys, value.alias(name))
