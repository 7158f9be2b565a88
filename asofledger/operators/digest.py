"""A digest of rows in their order, by a tree of hashes: two rows that change places change it, and so does any row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a node, as a power of two, and levels above the rows: 2**40 rows at most. Levels are as many for any number of rows, so that digests don't depend on how a table grew.
FAN_BITS, LEVELS = 10, 4


def row_text(*columns: str) -> Column:
    """One text of a row's values; a null is told from any value."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])


def _nodes_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (k, h: 32 bytes): one row per node whose children follow each other there (k of the node, whole), and all other rows as they are. A task holds a batch and the children of one node."""
    fan, columns = 1 << FAN_BITS, ["k", "whole", "h"]
    k, h = np.zeros(0, dtype=np.int64), np.zeros((0, 32), dtype=np.uint8)

    def made(numbers, whole: bool, digests: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([whole] * len(digests), pa.bool_()), pa.array(digests, pa.binary())], names=columns)

    for batch in batches:
        k = np.concatenate([k, batch.column(0).to_numpy()])
        h = np.concatenate([h, np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 32)])
        if not len(k):
            continue
        run = np.append(0, np.cumsum(np.diff(k) != 1))  # rows of one run have consecutive numbers
        first = np.arange(max(len(k) - fan + 1, 0))
        starts = first[(k[first] % fan == 0) & (run[first] == run[first + fan - 1])]
        yield made(k[starts] >> FAN_BITS, True, [hashlib.sha256(h[i : i + fan].tobytes().hex().encode()).digest() for i in starts.tolist()])
        rest = np.ones(len(k), dtype=bool)
        for i in starts.tolist():
            rest[i : i + fan] = False
        begun = len(k) - 1 - int(k[-1] % fan)  # where the last row's node starts: it may go on in the next batch
        kept = begun if begun >= 0 and run[begun] == run[-1] and rest[-1] else len(k)
        rest[kept:] = False
        yield made(k[rest], False, [x.tobytes() for x in h[rest]])
        k, h = k[kept:], h[kept:]
    yield made(k, False, [x.tobytes() for x in h])


def ordered_digest(rows: DataFrame, number: str, text: Column) -> DataFrame:
    """One row: sha256, of rows numbered from 0 or more without repeats. A node is the SHA-256 of its children's digests (as text) in order, and no task holds more than 2**FAN_BITS of them at a time; no rows have the digest of the empty text."""
    sha = lambda x: F.unhex(F.sha2(x, 256))  # noqa: E731  (half as wide as its text)
    level = rows.select(F.col(number).cast("long").alias("k"), sha(text).alias("h"))
    for i in range(LEVELS):
        # rows that come in order are nodes before the first shuffle, but for the ends of each task's rows
        level = level.mapInArrow(_nodes_within, "k long, whole boolean, h binary") if i == 0 else level.withColumn("whole", F.lit(False))
        children = F.transform(F.sort_array(F.collect_list(F.when(~F.col("whole"), F.struct("k", "h")))), lambda x: F.lower(F.hex(x["h"])))
        node = F.when(F.col("whole"), F.col("k")).otherwise(F.shiftright("k", FAN_BITS))
        level = level.groupBy(node.alias("k")).agg(F.coalesce(F.max(F.when(F.col("whole"), F.col("h"))), sha(F.array_join(children, ""))).alias("h"))
    one = F.when(F.count("*") > 1, F.raise_error(F.lit(f"more rows than {LEVELS} levels hold"))).otherwise(F.coalesce(F.lower(F.hex(F.max("h"))), F.sha2(F.lit(""), 256)))
    return level.agg(one.alias("sha256"))
