"""Delimited sources: header inspection, permissive scan, and the strict scan of the contract.

The strict scan reads lines in parallel and numbers them by file, block and place in the block, so files of any size split and nothing is copied. A line is checked against the grammar of a record with the contract's number of
fields before any field is taken: unbalanced or stray quotes, a wrong width, an empty line, a byte order mark and bytes that are no UTF-8 all make a row malformed. Where some line has an odd number of
quotes, records span lines: a line break ends a record if an even number of quotes of the file precede it. One pass finds the parity of each block's quotes and how many records would start in it after an even and an odd
number of them; the exclusive or over the blocks before says which, and so gives the block's first record number; the next pass cuts the blocks into records in parallel, and the pieces of the few records that cross blocks are put together by the block that they start in.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..durable import filesystem, materialize
from ..schema import SOURCE_COLUMNS

FIELD = r'(?:"(?:[^"]++|"")*+"|[^",\r\n]*+)'


class CsvSchemaError(ValueError):
    """A header that lacks, repeats or misnames columns."""


@dataclass(frozen=True)
class CsvSchemaReport:
    path: str
    columns: tuple[str, ...]
    extra_columns: tuple[str, ...]


def _first_line(spark: SparkSession, path: str) -> str | None:
    got = spark.read.text(path).limit(1).collect()
    return got[0][0] if got else None


def inspect_csv(spark: SparkSession, path: str, required: list[str] = SOURCE_COLUMNS) -> CsvSchemaReport:
    """The header's names, stripped, a byte order mark allowed; raises for an empty file, blank, repeated or missing names."""
    line = _first_line(spark, path)
    if line is None:
        raise CsvSchemaError(f"{path} is empty")
    names = [n.strip() for n in next(csv.reader(io.StringIO(line.removeprefix("﻿"))), [])]
    if not names or any(not n for n in names):
        raise CsvSchemaError(f"{path}: blank column name")
    repeated = sorted({n for n in names if names.count(n) > 1})
    missing = [c for c in required if c not in names]
    if repeated or missing:
        raise CsvSchemaError(f"{path}: " + "; ".join(x for x in (f"repeated columns {repeated}" * bool(repeated), f"missing columns {missing}" * bool(missing)) if x))
    return CsvSchemaReport(path, tuple(names), tuple(n for n in names if n not in required))


def scan_permissive(spark: SparkSession, path: str, columns: tuple[str, ...], header: bool = True) -> DataFrame:
    """The columns as text, plus malformed: whether a row has more or fewer fields."""
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("_corrupt", T.StringType())])
    rows = spark.read.option("columnPruning", False).csv(path, schema=schema, header=header, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, emptyValue="", nullValue="\x00")  # pruned rows would hide their width
    return rows.withColumn("malformed", F.col("_corrupt").isNotNull()).drop("_corrupt")


def read_permissive(spark: SparkSession, path: str, required: list[str] = SOURCE_COLUMNS) -> DataFrame:
    """All columns of a file with a header as text, plus malformed: whether the row's width differs from the header's. Extra columns stay."""
    return scan_permissive(spark, path, inspect_csv(spark, path, required).columns)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("p"))


def _blocks(spark: SparkSession, path: str, header: str = "") -> DataFrame:
    """A row per block of a path's files, by one pass: f and b (file and place), n (lines), first (its first line's id), headed (whether that line is header), odd (lines with an odd number of quotes), before (lines of the blocks before) and
    file_number (1 for the first file)."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    # numbers only: a line as a buffer would have all lines sorted by block
    counted = _lines(spark, path).groupBy("f", "b").agg(F.count("*").alias("n"), F.min("p").alias("first"), F.min(F.when(value == header, F.col("p"))).alias("at"), F.count_if(value.contains('"') & (quotes % 2 == 1)).alias("odd"))
    counted = counted.withColumn("headed", F.coalesce(F.col("at") == F.col("first"), F.lit(False))).drop("at")
    order = Window.orderBy("f", "b")
    return materialize(counted, "blocks").withColumns({"before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "file_number": F.sum((F.col("b") == 0).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))})


def numbered_lines(spark: SparkSession, path: str, blocks: DataFrame | None = None) -> DataFrame:
    """value, line_number (1 is the first), head (whether it is its file's first line) and file_number of each line, in the order of files, blocks and lines.

    Lines are numbered without bringing them together and without a copy: one pass counts the lines of each block, the other adds the counts of the blocks before (a row per block). Both read the same splits.
    """
    known = (blocks if blocks is not None else _blocks(spark, path)).select("f", "b", "first", "before", "file_number")
    place = F.col("p") - F.col("first")
    return _lines(spark, path).join(known, ["f", "b"]).select("value", (F.col("before") + place + 1).cast("long").alias("line_number"), ((F.col("b") == 0) & (place == 0)).alias("head"), "file_number")


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines up to each line feed, as bytes, with the hash of their file and the place of their block; in the order of the block within a task."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("h"), F.col("_metadata.file_block_start").alias("b"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Runs of a batch's rows (value, h, b ..) of one block, with the block."""
    h, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    cuts = [0, *(np.flatnonzero((h[1:] != h[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(h)] if len(h) else []
    for start, end in zip(cuts, cuts[1:]):
        yield (int(h[start]), int(b[start])), batch.slice(start, end - start)


def _quotes(values: pa.Array) -> np.ndarray:
    return np.asarray(pc.count_substring(values, b'"'))


def _block_parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: the lines before which an even and an odd number of the block's quotes stand, and the parity of all of them."""
    found: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        for block, run in _runs(batch):
            counts = found.setdefault(block, [0, 0, 0])
            after = np.cumsum(_quotes(run.column(0))) + counts[2]
            odd = int(np.count_nonzero(np.append(counts[2], after[:-1]) % 2))
            found[block] = [counts[0] + len(after) - odd, counts[1] + odd, int(after[-1]) % 2]
    rows = [(*k, *v) for k, v in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["h", "b", "even", "odd", "parity"])


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines (value, h, b, inside: whether the block starts within quotes): h, b, i (which of the records that start in the block), kind and value. Kind 0 is a whole record, 1 the start of one that goes on beyond the block, 2 what is in the block of one that started before it.
    A task holds a batch of lines, and one record or its part in the block."""
    block, parity, number, held, begun = None, 0, 0, [], 0

    def made(rows: list[tuple], values: pa.Array | None = None, numbers: np.ndarray | None = None) -> pa.RecordBatch:
        n = 0 if values is None else len(values)
        text = pa.array([r[2] for r in rows], pa.binary())
        columns = [pa.array([block[0]] * (n + len(rows)), pa.int64()), pa.array([block[1]] * (n + len(rows)), pa.int64()), pa.array(np.concatenate([numbers if n else np.zeros(0, dtype=np.int64), np.array([r[0] for r in rows], dtype=np.int64)])), pa.array([0] * n + [r[1] for r in rows], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([values, text]) if n else text], names=["h", "b", "i", "kind", "value"])

    for batch in batches:
        for own, run in _runs(batch):
            if own != block:
                if held:
                    yield made([(begun, 2 if begun < 0 else 1, b"\n".join(held))])
                block, parity, number, held, begun = own, int(run.column(3)[0].as_py()), 0, [], -1
            after = (parity + np.cumsum(_quotes(run.column(0)))) % 2
            before = np.append(parity, after[:-1])
            numbers = number + np.cumsum(before == 0) - 1
            alone = (before == 0) & (after == 0)
            rows = []
            for at in np.flatnonzero(~alone).tolist():
                if before[at] == 0:
                    begun = int(numbers[at])
                held.append(run.column(0)[at].as_py())
                if after[at] == 0:
                    rows.append((begun, 2 if begun < 0 else 0, b"\n".join(held)))
                    held, begun = [], -1
            yield made(rows, run.column(0).filter(pa.array(alone)), numbers[alone])
            parity, number = int(after[-1]), int(numbers[-1]) + 1
    if held:
        yield made([(begun, 2 if begun < 0 else 1, b"\n".join(held))])


def numbered_records(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """value, line_number, head and file_number as numbered_lines() has them, of records that may span lines, in files of any size. A file that ends within quotes ends its last record.

    What is broadcast is a row of numbers per block of a file, 100,000 for 12 TB in blocks of 128 MB.
    """
    parities = materialize(_raw_lines(spark, path).mapInArrow(_block_parities, "h long, b long, even long, odd long, parity long"), "parities")
    named = parities.join(blocks.select(F.xxhash64("f").alias("h"), "b", "f", "file_number"), ["h", "b"], "left")  # a block of which no line starts at another separator is in both
    order, earlier = Window.partitionBy("h").orderBy("b"), (Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("parity").over(order.rowsBetween(*earlier)) % 2, F.lit(0))
    placed = named.withColumn("inside", inside).withColumn("starts", F.when(F.col("inside") == 1, F.col("odd")).otherwise(F.col("even"))).withColumn("f", F.max("f").over(Window.partitionBy("h"))).withColumn("file_number", F.max("file_number").over(Window.partitionBy("h")))
    known = materialize(placed.withColumn("before", F.coalesce(F.sum("starts").over(Window.orderBy("f", "b").rowsBetween(*earlier)), F.lit(0))).select("h", "b", "inside", "before", "file_number"), "known")
    lines = _raw_lines(spark, path).join(F.broadcast(known.select("h", "b", "inside")), ["h", "b"]).select("value", "h", "b", "inside")
    cut = materialize(lines.mapInArrow(_cut_records, "h long, b long, i long, kind int, value binary"), "records")
    crossing = cut.where("kind > 0").withColumn("start", F.max(F.when(F.col("kind") == 1, F.col("b"))).over(Window.partitionBy("h").orderBy("b", F.desc("kind"))))
    pieces = crossing.groupBy("h", F.col("start").alias("b")).agg(F.max("i").alias("i"), F.sort_array(F.collect_list(F.struct(F.when(F.col("kind") == 1, F.lit(-1)).otherwise(F.col("b")).alias("o"), "value"))).alias("parts"))
    joined = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["value"], lambda a, x: F.concat(a, F.unhex(F.lit("0A")), x["value"]))
    whole = cut.where("kind = 0").select("h", "b", "i", "value").unionByName(pieces.select("h", "b", "i", joined.alias("value")))
    value = F.regexp_replace(F.col("value").cast("string"), r"\r\z", "")
    return whole.join(F.broadcast(known), ["h", "b"]).select(value.alias("value"), (F.col("before") + F.col("i") + 1).cast("long").alias("line_number"), ((F.col("b") == 0) & (F.col("i") == 0)).alias("head"), "file_number")


def _starts_with_mark(spark: SparkSession, path: str) -> bool:
    """Whether the first file begins with a byte order mark, which line readers leave out."""
    fs, where = filesystem(spark, path)
    files = sorted(((s.getPath().toString(), s.getPath()) for s in fs.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "._"), key=lambda x: x[0])
    stream = fs.open(files[0][1])
    try:
        return [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
    finally:
        stream.close()


def read_lines_strict(spark: SparkSession, lines: DataFrame, columns: list[str] = SOURCE_COLUMNS) -> DataFrame:
    """Text columns, source_row_number and malformed of lines (value, line_number) that hold one record each."""
    record, value = rf"^{FIELD}(?:,{FIELD}){{{len(columns) - 1}}}+\z", F.col("value")
    found = F.regexp_extract_all(F.concat(F.lit(","), value), F.lit(rf",({FIELD})"), F.lit(1))
    quoted = F.when(value.rlike(record), F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)))
    # without quotes the grammar asks only for the number of fields, and no pattern is needed
    plain = F.when(~(value.contains("\r") | value.contains("\n")), F.split(value, ",", -1))
    cut = lines.select(F.col("line_number").alias("source_row_number"), F.is_valid_utf8(value).alias("valid"), F.when(value.contains('"'), quoted).otherwise(plain).alias("x"))
    good = F.coalesce(F.col("valid") & (F.size("x") == len(columns)), F.lit(False))
    made = cut.select("source_row_number", (~good).alias("malformed"), F.when(good, F.col("x")).alias("x"))
    return made.select("source_row_number", "malformed", *[F.col("x")[i].alias(c) for i, c in enumerate(columns)])


def read_strict(spark: SparkSession, path: str, columns: list[str] = SOURCE_COLUMNS) -> DataFrame:
    """Text columns, source_row_number (2 for the row after the header) and malformed; raises if the header of the file, or of any file of a folder, is not exactly columns."""
    line, header = _first_line(spark, path), ",".join(columns)
    if line is None or line != header or _starts_with_mark(spark, path):
        raise CsvSchemaError(f"{path}: row 1: the header must be exactly {header}")
    blocks = _blocks(spark, path, header)
    spans = blocks.agg(F.sum("odd")).first()[0]
    lines = numbered_records(spark, path, blocks) if spans else numbered_lines(spark, path, blocks)
    heads = lines.where("head").select((F.col("value") == header).alias("headed")) if spans else blocks.where("b = 0").select("headed")
    files, wrong = heads.agg(F.count("*"), F.count_if(~F.col("headed"))).first()
    if wrong:
        raise CsvSchemaError(f"{path}: {wrong} of {files} files have another header than {header}")
    rows = lines.where("not head")
    return read_lines_strict(spark, rows.select("value", (F.col("line_number") - F.col("file_number") + 1).alias("line_number")), columns)
