"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

Method. Each row fails a set of filters, and so survives just those subsets of filters that hold none of them: its survival word has bit S set if it survives subset S (32 bits for five filters). The sum of a bit over
all rows is the number of survivors of a subset; these sums are positional popcounts, made by carry-save adders: three words of one weight become a sum word of that weight and a carry word of twice it, for all 32 positions
at once. A task sums the rows of a part in each Arrow batch, once for all and once for each label, and Spark adds up the tasks. All that a chain in any order does follows from the survivors of its prefixes: a filter removes what survives the
prefix before it but not the one with it, and its Shapley sum adds this over all orders.

Cases. Null texts are empty; a null part is the part ''. A repeated text fails E unless its doc_id is the smallest of that text; a null id has no order, so it neither fails E nor makes others fail. Repeated rows count each.
A document is good (toxic) if any of its labels says so; documents without a label are neither. Empty tables give no parts. Extra columns are not read. Texts are one row whatever their length.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialize

FILTERS = "ABCDE"
#: A: words a text must have. B: least percentage of distinct words. C: largest percentage of capitals. D: characters that a text must not hold.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
UPPER = bytes(range(65, 91))
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(texts: pa.Array) -> list[pa.Array]:
    """Filters A to D that each text fails, as bits, and the SHA-256 of its bytes."""
    points = np.asarray(pc.utf8_length(texts))
    fails, digests = np.zeros(len(texts), dtype=np.int32), []
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        words = text.split()  # of bytes: at [space, \t-\r] and nothing else
        n = len(words)
        upper = len(text) - len(text.translate(None, UPPER))
        symbols = len(text.translate(None, SYMBOLS)) < len(text)
        fails[i] = (n < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1 | (100 * upper > UPPER_PERCENT * int(points[i])) << 2 | symbols << 3
        digests.append(hashlib.sha256(text).digest())
    return [pa.array(fails), pa.array(digests, pa.binary())]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part and fails (bit k for filter k of FILTERS) of each row. Texts are neither shuffled nor written; their digests are."""
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    facts = materialize(add_columns(given, "text", [("own", T.IntegerType(), pa.int32()), ("digest", T.BinaryType(), pa.binary())], text_failures, keep=["id", "part"]), "facts")
    # written before the join, so that it is of two shuffles, of which skew handling splits a text that many rows share
    least = materialize(facts.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least"), "least")
    repeated = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int")
    return facts.join(least, "digest", "left").select("id", "part", F.col("own").bitwiseOR(F.call_function("shiftleft", repeated, F.lit(4))).alias("fails"))


def survival_words(filters: int) -> np.ndarray:
    """For each set of failed filters the word of the subsets that a row survives."""
    subsets = range(1 << filters)
    return np.array([sum(1 << s for s in subsets if not s & failed) for failed in subsets], dtype=np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits: carry-save adders on thirds of a weight's words, until few are left to be counted bit by bit."""
    total, weight = np.zeros(32, dtype=np.int64), 0
    while len(words):
        carries = []
        while len(words) > 64:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third :]])
        total += np.unpackbits(np.ascontiguousarray(words, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) << weight
        words, weight = np.concatenate(carries) if carries else words[:0], weight + 1
    return total


def survivors(failing: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """failing (part, fails, good, toxic) -> part, subset, n, good, toxic: rows of the part that survive each subset of filters, all of them and those with each label."""
    table = survival_words(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            codes = parts.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            words = table[batch.column(1).to_numpy(zero_copy_only=False)][order]
            good, toxic = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=bool)[order] for i in (2, 3))
            ends = np.cumsum(np.bincount(codes, minlength=len(parts.dictionary)))
            made = []
            for a, b in zip([0, *ends[:-1]], ends):
                own = words[a:b]
                made.append(np.stack([positional_counts(w)[: 1 << filters] for w in (own, own[good[a:b]], own[toxic[a:b]])], axis=1))
            rows = np.concatenate(made) if made else np.zeros((0, 3), dtype=np.int64)
            names = parts.dictionary.take(pa.array(np.repeat(np.arange(len(made)), 1 << filters)))
            subset = pa.array(np.tile(np.arange(1 << filters, dtype=np.int32), len(made)))
            yield pa.RecordBatch.from_arrays([names, subset, *[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)]], names=["part", "subset", "n", "good", "toxic"])

    given = failing.select("part", F.col("fails").cast("int"), "good", "toxic")
    return given.mapInArrow(run, "part string, subset int, n long, good long, toxic long").groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def order_rows(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, names: str) -> list[tuple]:
    """(filter_order, step, *COUNTS) of every order and step, from the survivors of each subset."""
    k = len(names)
    whole, fact = (1 << k) - 1, [math.factorial(i) for i in range(k)]
    shapley = [sum(fact[s.bit_count()] * fact[k - 1 - s.bit_count()] * int(n[s] - n[s | 1 << x]) for s in range(1 << k) if not s >> x & 1) for x in range(k)]
    made = []
    for order in itertools.permutations(range(k)):
        before, text = 0, "".join(names[x] for x in order)
        for step, x in enumerate(order, 1):
            after = before | 1 << x
            removed = int(n[before] - n[after])
            made.append((text, step, int(n[after]), removed, int(n[0] - n[1 << x]) - removed, int(n[whole ^ 1 << x] - n[whole]), int(good[before] - good[after]), int(toxic[before] - toxic[after]), shapley[x]))
            before = after
    return made


def by_order(surviving: DataFrame, names: str = FILTERS) -> DataFrame:
    """survivors() -> part, filter_order, step and COUNTS: a row per part, order and step, zeros included."""
    fields = ["filter_order string", "step int", *[f"{c} long" for c in COUNTS]]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, good, toxic = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("n", "good", "toxic"))
                columns = list(zip(*order_rows(n, good, toxic, names)))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.string()), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["part", *[f.split()[0] for f in fields]])

    lists = surviving.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("rows"))  # a row per subset of filters
    return lists.mapInArrow(run, ", ".join(["part string", *fields]))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of FILTERS over docs: one row per part, order of the filters and step."""
    marks = materialize(labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "marks")
    failing = failures(docs, id_col, text_col, part_col).join(marks, "id", "left")
    return by_order(survivors(failing.select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])))
