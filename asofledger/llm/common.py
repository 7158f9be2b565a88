"""Shared helpers: table access, durable intermediate tables, Arrow text buffers."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import discard, materialize, shared_dir  # noqa: F401  (the operators take them from here)

#: Text bytes that one Python step holds at a time, besides a single longer text. Spark itself bounds an Arrow batch (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB).
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of the bitmap that says which keys need a decision: BITMAP / 64 rows of one long each, at most, whatever the input.
BITMAP = 1 << 26


def bitmap(keys: DataFrame) -> DataFrame:
    """The keys (one column, key) hashed to BITMAP bits: word and bits, 16 MB at most however many keys there are."""
    at = F.pmod(F.xxhash64("key"), F.lit(BITMAP))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return materialize(keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")), "bitmap")


def split_by(rows: DataFrame, key: str, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key is certainly not in a bitmap, found without a shuffle, and all others. A crowded bitmap gives more of the latter, never fewer."""
    word, bits = (free_name(rows, n) for n in ("__word", "__bits"))
    at = F.pmod(F.xxhash64(key), F.lit(BITMAP))
    found = rows.withColumn(word, F.shiftright(at, 6)).join(F.broadcast(marks.select(F.col("word").alias(word), F.col("bits").alias(bits))), word, "left")
    hit = F.coalesce(F.getbit(bits, at.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return found.where(~hit).drop(word, bits), found.where(hit).drop(word, bits)


def clean_text(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores added until no column of df has that name, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def release() -> None:
    """Give freed memory back to the system: Python workers wait for their next task with all that they hold."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType, pa.DataType]], step: Callable[[pa.Array], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with the columns that step makes of slices of text_col; null texts count as empty.

    Columns of df that bear the name of a new one are replaced.
    """
    new = {n.lower() for n, _, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    inner = free_name(df, "__text")
    given = df.select(*[F.col(f"`{c}`") for c in kept], clean_text(f"`{text_col}`").alias(inner))
    schema = T.StructType([*given.select(*[f"`{c}`" for c in kept]).schema.fields, *[T.StructField(n, t) for n, t, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, inner):
                made = step(part.column(part.schema.get_field_index(inner)))
                arrays = [part.column(i) for i in range(len(kept))] + [a.cast(t) if a.type != t else a for a, (_, _, t) in zip(made, fields)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[n for n, _, _ in fields]])
            made = arrays = None
            release()

    return given.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts have at most `most` bytes together; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0), dtype=np.int64)
    total, start = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    yield batch.slice(start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the n + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]
