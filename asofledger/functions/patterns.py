"""Text and balance classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace has it, or nothing.
BLANK = r"(?U)^[\s\x1c-\x1f]*\z"

# Identifier formats, the first that matches counts.
IDENTIFIER_FORMATS = [
    ("numeric", r"^[0-9]+\z"),
    ("NN-7", r"^[0-9]{2}-[0-9]{7}\z"),
    ("NN-7-4", r"^[0-9]{2}-[0-9]{7}-[0-9]{4}\z"),
    ("LNN-7", r"^[A-Z][0-9]{2}-[0-9]{7}\z"),
    ("digits-digits", r"^[0-9]+-[0-9]+\z"),
]


def is_blank(text: Column) -> Column:
    printable = (text >= "!") & (text < "\x7f")  # by its first byte; the pattern is for the rest
    return F.when(printable, F.lit(False)).otherwise(text.rlike(BLANK))


def identifier_format(text: Column) -> Column:
    found = F.lit("other")
    for name, pattern in reversed(IDENTIFIER_FORMATS):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def _close(a: Column, b: Column, tolerance: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * 1e-9, tolerance)


def delta_pattern(before: Column, after: Column, amount: Column) -> Column:
    """increase, decrease, unchanged or other: how a balance moved against the amount, within a cent or a billionth."""
    b, a, x = (c.cast("double") for c in (before, after, amount))
    delta, tolerance = a - b, F.greatest(F.lit(0.01), F.abs(x) * 1e-9)
    return F.when(_close(delta, x, tolerance), "increase").when(_close(delta, -x, tolerance), "decrease").when(_close(delta, F.lit(0.0), tolerance), "unchanged").otherwise("other")


def conserved(before: list[Column], after: list[Column], amount: Column) -> Column:
    """Whether both parties' balances add up to the same before and after."""
    b, a = (sum((c.cast("double") for c in cols[1:]), cols[0].cast("double")) for cols in (before, after))
    return _close(b, a, F.greatest(F.lit(0.02), F.abs(amount.cast("double")) * 2e-9))


def evaluation_partition(step: Column) -> Column:
    """train, validation or test; a step outside all windows raises."""
    from ..schema import PARTITIONS

    found = F.raise_error(F.concat(F.lit("step outside the evaluation windows: "), F.coalesce(step.cast("string"), F.lit("null"))))
    for name, first, last in reversed(PARTITIONS):
        found = F.when(step.between(first, last), F.lit(name)).otherwise(found)
    return found


def inferred_kind(text: Column) -> Column:
    """integer, number or string: what Python's int() and float() take: any script's digits, single underscores between digits, white space around."""
    bare = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    n = r"\p{Nd}(?:_?\p{Nd})*+"
    number = rf"(?i)^[+-]?(?:(?:{n}\.?(?:{n})?|\.{n})(?:e[+-]?{n})?|inf|infinity|nan)\z"
    return F.when(bare.rlike(rf"^[+-]?{n}\z"), "integer").when(bare.rlike(number), "number").otherwise("string")
