"""Plain decimals as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Significant digits of means and rates, rounded half to even.
PRECISION = 28
PLAIN_DECIMAL = r"^[+-]?[0-9]+(?:\.[0-9]+)?\z"


def is_plain_decimal(text: Column) -> Column:
    """Whether a text is digits with an optional sign and fraction, and nothing else."""
    return text.rlike(PLAIN_DECIMAL)


def integer_digits(text: Column) -> Column:
    """Digits before the point, without leading zeros, one at least."""
    return F.greatest(F.length(F.regexp_extract(text, r"^[+-]?0*([0-9]*)", 1)), F.lit(1))


def fraction_digits(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"\.([0-9]+)\z", 1))


def numeric_token(text: Column) -> Column:
    """One spelling for equal plain decimals: no plus sign, leading zeros, trailing fraction zeros or negative zero."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^([+-]?)0+(?=[0-9])", "$1"), r"^\+", "")
    short = F.regexp_replace(F.regexp_replace(bare, r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    return F.regexp_replace(short, r"^-0\z", "0")
