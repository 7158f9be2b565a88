"""Exact quantiles of columns of any size, without a buffer that grows with the rows.

Each wanted rank has a bracket of two values. A sketch of bounded size (percentile_approx) narrows it: a value is within n / ACCURACY ranks of the one that was asked for, so values asked for at the rank, and a little below and above it, mostly enclose it. One aggregate then counts
the rows below and at each of these, which says for certain on which side of it the rank lies. Brackets shrink by some thousands at a time, all columns and ranks in the same pass,
until one holds FEW rows, or rows of one value only; then its distinct values are counted, FEW rows at most. The first sketch comes from the pass that counts the rows. Nulls and NaN are left out. Between two ranks a quantile is interpolated linearly, as percentile() does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY, FEW = 10_000, 4096


@dataclass
class Rank:
    """The value of a column at a place (from 0) in ascending order: between low and high, before which `below` rows stand, and in which there are `inside`."""

    column: str
    place: int
    low: float
    high: float
    below: int
    inside: int

    @property
    def found(self) -> bool:
        return self.low == self.high


def _within(values: str, rank: Rank) -> F.Column:
    return F.when(F.col(values).between(rank.low, rank.high), F.col(values))


def _around(share: float) -> list[float]:
    """Shares that a sketch is asked for so that its values enclose the one at share."""
    return [max(0.0, min(1.0, share + e / ACCURACY)) for e in (-2, 0, 2)]


def _sketched(rows: DataFrame, open_: list[Rank]) -> list[list[float]]:
    """Three values of each rank's bracket, by a sketch of the rows in it."""
    shares = [_around((r.place - r.below + 0.5) / r.inside) for r in open_]
    asked = rows.agg(*[F.percentile_approx(_within(r.column, r), s, ACCURACY).alias(f"q{i}") for i, (r, s) in enumerate(zip(open_, shares))]).first()
    return [asked[f"q{i}"] for i in range(len(open_))]


def _narrow(rows: DataFrame, open_: list[Rank], points: list[list[float]]) -> None:
    """Tighter brackets by three values for each, and counts that prove them. A value of a bracket is found or left out, so with one of its own a bracket always loses a value."""
    counts = []
    for i, (r, own) in enumerate(zip(open_, points)):
        counts += [x for k, p in enumerate(own) for x in (F.count_if(F.col(r.column) < p).alias(f"b{i}_{k}"), F.count_if(F.col(r.column) == p).alias(f"e{i}_{k}"))]
    seen = rows.agg(*counts).first()
    for i, (r, own) in enumerate(zip(open_, points)):
        for k, p in enumerate(own):
            before, equal = seen[f"b{i}_{k}"], seen[f"e{i}_{k}"]
            if not r.low <= p <= r.high:
                continue
            if before <= r.place < before + equal:
                r.low = r.high = p
                r.below, r.inside = before, equal
            elif r.place < before:
                r.high, r.inside = math.nextafter(p, -math.inf), before - r.below
            else:
                r.low, r.below, r.inside = math.nextafter(p, math.inf), before + equal, r.below + r.inside - before - equal


def order_statistics(df: DataFrame, places: dict[str, dict[int, list[float]]], bounds: dict[str, tuple[int, float, float]]) -> dict[tuple[str, int], float]:
    """The values of columns (doubles) at places from 0, each given with three values about it. bounds: rows, least and largest value of each column."""
    ranks = {(c, p): Rank(c, p, bounds[c][1], bounds[c][2], 0, bounds[c][0]) for c, own in places.items() for p in own}
    wide = lambda: [r for r in ranks.values() if not r.found and r.inside > FEW]
    if open_ := wide():
        _narrow(df, open_, [places[r.column][r.place] for r in open_])
    while open_ := wide():
        _narrow(df, open_, _sketched(df, open_))
    few = [r for r in ranks.values() if not r.found]
    if few:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _within(r.column, r).alias("v")) for i, r in enumerate(few)]))
        counted = df.select(each.alias("x")).where("x.v is not null").groupBy("x.i", "x.v").count().collect()  # FEW rows a rank at most
        for i, r in enumerate(few):
            reached = r.below
            for v, n in sorted((row["v"], row["count"]) for row in counted if row["i"] == i):
                reached += n
                if reached > r.place:
                    r.low = r.high = v
                    break
    return {k: r.low for k, r in ranks.items()}


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of each column at shares of 0 to 1; None for a column without values."""
    cast = lambda c: F.col(f"`{c}`").cast("double")
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    rows = df.select(*[F.when(~F.isnan(cast(c)), cast(c)).alias(n) for c, n in names.items()])
    asked = [x for s in shares for x in _around(s)]
    seen = rows.agg(*[x for n in names.values() for x in (F.count(n).alias(f"{n}n"), F.min(n).alias(f"{n}l"), F.max(n).alias(f"{n}h"), F.percentile_approx(n, asked, ACCURACY).alias(f"{n}q"))]).first()
    bounds = {n: (seen[f"{n}n"], seen[f"{n}l"], seen[f"{n}h"]) for n in names.values() if seen[f"{n}n"]}
    at = {n: [s * (b[0] - 1) for s in shares] for n, b in bounds.items()}
    found = order_statistics(rows, {n: {k: seen[f"{n}q"][3 * i : 3 * i + 3] for i, x in enumerate(own) for k in (math.floor(x), math.ceil(x))} for n, own in at.items()}, bounds)

    def value(n: str, x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        return found[n, low] if low == high else (high - x) * found[n, low] + (x - low) * found[n, high]

    return {c: [value(n, x) for x in at[n]] if n in at else [None] * len(shares) for c, n in names.items()}
