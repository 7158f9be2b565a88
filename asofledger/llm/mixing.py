"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Method. A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected between 0 (all equal) and 1 (as found) until the weights reach a target entropy, or until no source is repeated
more than a limit; each step compares SECTIONS exponents in one aggregate over the table of sources. With a budget the weights give each source its quota of tokens; without one the budget is the least that gives every
source a whole pass, so no row is lost. Rows have a place in their source's permutation, a hash of their id, and the leading bits of the place are a block. A quota is whole passes over the
source and a last pass that goes as far as the quota: block totals say in which block it ends, and the rows of this one block say where. So rows are aggregated map-side to blocks of about BLOCK_ROWS rows, a source that
has a third of all rows is BLOCK_ROWS times smaller by the time it meets in one place, and each row's copies follow from its place and its source's two numbers.

Cases. Null text has no tokens; null source is a source of its own; a source without tokens is passed once. Null ids have a place too. Rows with equal ids share a place and thus their fate. The last row of a quota is taken
whole. An empty table gives an empty one. Extra columns are kept, and added names avoid theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import clean_text, free_name, materialize

BLOCK_ROWS, SECTIONS, ROUNDS, PLACE_BITS = 4096, 32, 11, 60


def place(id_col: str) -> Column:
    """A row's place in the permutation: PLACE_BITS bits of the MD5 of its id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long")


def block_bits(rows: int) -> int:
    """Leading bits of a place that name a block of about BLOCK_ROWS rows."""
    return max(0, min(30, math.ceil(math.log2(max(1, rows) / BLOCK_ROWS))))


def tokens(text_col: str) -> Column:
    return F.regexp_count(clean_text(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponent(sources: DataFrame, target_entropy: float | None, max_epochs: float | None) -> float:
    """The largest exponent in 0..1 that meets the target; 0 if none does. sources: name, n (tokens, positive)."""
    whole, most = sources.agg(F.sum("n").cast("double"), F.max("n").cast("double")).first()
    if not whole:
        return 1.0

    def met(exponents: list[float]) -> list[bool]:
        made = []
        for a in exponents:
            w = F.pow(F.col("n") / F.lit(whole), F.lit(a))
            if target_entropy is not None:
                made.append(F.log(F.sum(w)) - F.sum(w * F.log(w)) / F.sum(w) >= target_entropy)
            else:
                made.append(F.max(F.pow(F.col("n") / F.lit(most), F.lit(a - 1.0))) <= max_epochs)
        return list(sources.agg(*[m.alias(f"m{i}") for i, m in enumerate(made)]).first())

    low, high = 0.0, 1.0
    rising = max_epochs is not None and target_entropy is None  # whether larger exponents meet the target
    if rising:
        if met([0.0])[0]:
            return 0.0
    elif met([1.0])[0]:
        return 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
        flags = met(grid)
        edges = [low, *grid, high]
        k = flags.index(True) if rising and True in flags else len(grid) if rising else flags.index(False) if False in flags else len(grid)
        low, high = edges[k], edges[k + 1]
        if high - low < 1e-15:
            break
    return high if rising else low


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, max_epochs: float | None = 2.0, budget: float | None = None) -> DataFrame:
    """One row per source: source, n_tokens, weight, quota, passes, last_place (a row gets a copy more if its place is at most that)."""
    rows = docs.select(F.col(f"`{source_col}`").alias("source"), place(id_col).alias("place"), tokens(text_col).alias("n"))
    rows = materialize(rows, "places")
    bits = block_bits(rows.count())
    block = F.shiftright("place", PLACE_BITS - bits)
    blocks = materialize(rows.groupBy("source", block.alias("block")).agg(F.sum("n").alias("n")), "blocks")
    sources = materialize(blocks.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    some = sources.where("n > 0")
    a = exponent(some, target_entropy, max_epochs)
    whole, powers, widest = some.agg(F.sum("n").cast("double"), F.sum(F.pow(F.col("n").cast("double"), F.lit(a))), F.max(F.pow(F.col("n").cast("double"), F.lit(1.0 - a)))).first()
    if not whole:
        return sources.select("source", F.col("n").alias("n_tokens"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(1).cast("long").alias("passes"), F.lit(-1).cast("long").alias("last_place"))
    weight = F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(a)) / F.lit(powers)).otherwise(F.lit(0.0))
    spent = budget if budget is not None else widest * powers
    quotas = sources.withColumn("weight", weight).withColumn("quota", F.round(F.col("weight") * F.lit(float(spent))).cast("long"))
    quotas = materialize(quotas.withColumn("passes", F.when(F.col("n") > 0, F.floor(F.col("quota") / F.greatest("n", F.lit(1)))).otherwise(F.lit(1)).cast("long")).withColumn("rest", F.when(F.col("n") > 0, F.col("quota") - F.col("passes") * F.col("n")).otherwise(F.lit(0)).cast("long")), "quotas")
    same = lambda x, y: x["source"].eqNullSafe(y["source"])
    part = quotas.where("rest > 0").select(F.col("source").alias("__s"), "rest")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("block")) - F.col("n")
    ends = blocks.withColumn("before", before).join(part, F.col("source").eqNullSafe(F.col("__s"))).where("before < rest and before + n >= rest").select("source", "block", F.col("rest") - F.col("before"))
    ends = materialize(ends.toDF("__s", "__b", "left"), "ends")
    inside = rows.withColumn("block", block).join(ends, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")))
    reached = F.sum("n").over(Window.partitionBy("source").orderBy("place")) - F.col("n")
    last = inside.groupBy("source", "place", "left").agg(F.sum("n").alias("n")).withColumn("reached", reached).where("reached < left").groupBy("source").agg(F.max("place").alias("last_place"))
    found = quotas.join(last, same(quotas, last), "left").select(quotas["source"], quotas["n"].alias("n_tokens"), "weight", "quota", "passes", F.coalesce("last_place", F.lit(-1)).cast("long").alias("last_place"))
    return materialize(found, "plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", pass_col: str = "mix_pass", block_col: str | None = None, place_col: str | None = None, **targets) -> DataFrame:
    """docs with each row as often as its source's quota says, and pass_col, 1 for a row's first copy. targets: those of plan().

    The mixture's order is that of pass_col, then block_col, then place_col (each of the latter two is added if it is named): blocks run through all sources at once, and a row's place in its block is a random one.
    """
    own, name, passes, last = (free_name(docs, n) for n in ("__place", "__source", "__passes", "__last"))
    made = plan(docs, id_col, text_col, source_col, **targets).select(F.col("source").alias(name), F.col("passes").alias(passes), F.col("last_place").alias(last))
    placed = docs.withColumn(own, place(id_col)).join(made, F.col(f"`{source_col}`").eqNullSafe(F.col(name)))
    copies = (F.col(passes) + (F.col(own) <= F.col(last)).cast("long")).cast("int")
    added = {place_col: F.col(own)} if place_col else {}
    if block_col:
        added[block_col] = F.shiftright(own, PLACE_BITS - block_bits(docs.count()))
    new = {c.lower() for c in (pass_col, *added)}
    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return placed.where(copies > 0).select(*cols, *[v.alias(k) for k, v in added.items()], F.explode(F.sequence(F.lit(1), copies)).alias(pass_col))
