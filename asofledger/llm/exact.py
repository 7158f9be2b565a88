"""Exact deduplication through a minimal perfect hash over the distinct digests of the history.

Method. A text's digest is SHA-256 over its UTF-8 bytes, each run of [space, \\t-\\r] being one space. The history's digests are
grouped (map-side combine, so a text that fills a third of the table is one row per task), dealt into buckets of about
BUCKET_KEYS keys, and each bucket becomes a minimal perfect hash: cascaded bit arrays in which a key that is alone at its
place is set and the others go on to the next level; a key's slot is the rank of its bit. A slot holds the full digest, the locator of
the winner (its id) and the group's size. Digests of new rows, grouped likewise, look up their bucket's hash; the 32 bytes of
the slot are compared, so a digest that is not in the history never passes for one that is. Nonmembers form groups of their
own. The number of buckets follows the number of digests, so a bucket fits in memory at any size, and nothing goes to the driver but two counts.

Cases. Null text counts as empty; all empty texts are equal. The smallest id of equal texts stays; null ids never win over others,
and a group with null ids only keeps a null id. Rows that repeat both id and text are one document: verdicts() gives each of them the same
verdict, keep_first() leaves one of them. Empty tables give empty tables. Extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, clean_text, free_name, materialize, split_by

#: Digests of a bucket, about: 50 bytes each in the hash, some 300 while it is built.
BUCKET_KEYS = 50_000
#: Bits per key of a level; more bits need fewer levels.
GAMMA = 2
SLOT_FIELDS = "digest binary, keep_id long, group_size long, in_history boolean"


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of the normalised text."""
    return F.unhex(F.sha2(F.encode(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), "UTF-8"), 256))


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words[:, 0] + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15) ^ words[:, 1]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct 32-byte digests, given as an array of n rows of four uint64."""

    def __init__(self, keys: np.ndarray):
        self.n, self.levels = len(keys), []
        left, before = keys, 0
        while len(left):
            size = max(64, GAMMA * len(left))
            place = _mix(left, len(self.levels)) % np.uint64(size)
            bits = np.bincount(place.astype(np.int64), minlength=size) == 1
            self.levels.append((bits, np.cumsum(bits) - 1 + before))
            before += int(bits.sum())
            left = left[~bits[place.astype(np.int64)]]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; for one outside the set any slot, or -1."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(self.levels):
            place = (_mix(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[todo[hit]] = ranks[place[hit]]
            todo = todo[~hit]
        return out


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _bucket(key, history: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """The groups of one bucket: the history's slots with the new rows that hit them, then the nonmembers."""
    keys = _words(history["digest"])
    index = PerfectHash(keys)
    slot = index.slots(keys)
    stored = np.zeros_like(keys)
    stored[slot] = keys
    order = np.argsort(slot)
    held = history.iloc[order].reset_index(drop=True)
    sizes, winners = held["n"].to_numpy(dtype=np.int64).copy(), held["least"].astype("Int64")
    asked = _words(new["digest"])
    at = index.slots(asked)
    hit = (at >= 0) & (stored[np.maximum(at, 0)] == asked).all(axis=1) if len(keys) else np.zeros(len(asked), dtype=bool)
    found = new[hit]
    if len(found):
        sizes[at[hit]] += found["n"].to_numpy(dtype=np.int64)
        both = pd.concat([winners.iloc[at[hit]].reset_index(drop=True), found["least"].astype("Int64").reset_index(drop=True)], axis=1).min(axis=1)
        winners.iloc[at[hit]] = both.astype("Int64").array
    rest = new[~hit]
    return pd.concat(
        [
            pd.DataFrame({"digest": held["digest"], "keep_id": winners, "group_size": sizes, "in_history": True}),
            pd.DataFrame({"digest": rest["digest"], "keep_id": rest["least"].astype("Int64"), "group_size": rest["n"].astype("int64"), "in_history": False}),
        ],
        ignore_index=True,
    )


def groups(history: DataFrame, new: DataFrame) -> DataFrame:
    """One row per distinct digest of both tables (columns id long, digest binary): digest, keep_id, group_size, in_history."""
    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"))

    old, fresh = materialize(distinct(history), "digests"), materialize(distinct(new), "digests")
    buckets = max(1, -(-max(old.count(), fresh.count()) // BUCKET_KEYS))
    dealt = [d.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets))) for d in (old, fresh)]
    return dealt[0].groupBy("bucket").cogroup(dealt[1].groupBy("bucket")).applyInPandas(_bucket, SLOT_FIELDS)


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int | None = None) -> DataFrame:
    """One row per row of df: its id, keep_id, group_size, kept, text_sha256, in_history.

    Rows whose id is at most cut are the history, the others are new; without a cut the median id divides them. The result does not
    depend on the cut, but for in_history.
    """
    rows = materialize(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_digest(clean_text(f"`{text_col}`")).alias("digest")), "rows")
    if cut is None:
        middle = rows.agg(F.percentile_approx("id", 0.5)).first()[0]
        cut = middle if middle is not None else 0
    old = F.coalesce(F.col("id") <= F.lit(cut), F.lit(False))
    made = groups(rows.where(old), rows.where(~old))
    return rows.join(made, "digest").select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose text equals that of a row with a smaller id, and without repeats of a row's id and text.

    Only rows whose text occurs more than once (and the few that a bitmap takes for such) are shuffled; all others are passed on where they are read.
    """
    digest, unknown, number = (free_name(df, n) for n in ("__digest", "__unknown", "__number"))
    own = F.col(f"`{id_col}`").cast("long")
    marked = df.withColumns({digest: text_digest(clean_text(f"`{text_col}`")), unknown: own.isNull(), number: F.coalesce(own, F.lit(0))})
    kept = verdicts(df, id_col, text_col).where("kept").select(F.unhex("text_sha256").alias(digest), F.col(f"`{id_col}`").isNull().alias(unknown), F.coalesce(F.col(f"`{id_col}`"), F.lit(0)).alias(number), "group_size")
    winners = materialize(kept.dropDuplicates([digest, unknown, number]), "winners")
    marks = bitmap(winners.where("group_size > 1").select(F.col(digest).alias("key")))
    alone, rest = split_by(marked, digest, marks)
    _, deciding = split_by(winners, digest, marks)
    first = rest.dropDuplicates([digest, unknown, number]).join(deciding.drop("group_size"), [digest, unknown, number], "left_semi")
    cols = [f"`{c}`" for c in df.columns]
    return alone.select(*cols).unionByName(first.select(*cols))
