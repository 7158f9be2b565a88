"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method. Words are runs of letters, digits and non-ASCII bytes of the text in lower case (A-Z). Grams are single words, pairs, pairs
with one word left out between them, and word beginnings of PREFIXES bytes (compounds differ at their ends). A gram has three features:
that it occurs, and that it makes up at least each share of DENSITY of the words. They are hashed to 3 * 2**BITS coordinates and learnt
with per-coordinate rates and L1, which leaves few weights: they are broadcast as indexes and values (at most 12 MB by the size of the table).
Each text is scored whole, in one pass and without a shuffle.

Learning. At most SAMPLE labelled rows, by a hash of their ids, in an order fixed by that hash, EPOCHS times; one task holds their
features (about 20 kB a row). Everything else covers all rows.

Cases. Null text counts as empty and scores as the bias says. Labels that are null are left out, as are labels of ids without a document;
without any label all scores are 0. Null ids are scored. Repeated rows get equal scores; very long texts are one row; empty
tables give empty ones. Only the text makes the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, clean_text, free_name, release, text_bytes
from .wordhash import mix, span_hashes, word_spans

BITS, PREFIXES, DENSITY = 19, (4, 5, 6, 7), (1 / 250, 1 / 60)
#: Labelled rows that are learnt from, at most (in expectation: rows are taken by a hash).
SAMPLE = 12_000
#: Sampled rows that a coordinate must occur in to be learnt.
LEAST_ROWS = 3
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.2, 1.0, 4.0, 1.0
THRESHOLD = 0.3
LEVELS = 1 + len(DENSITY)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_INSIDE = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (below 2**BITS) and text number of every gram occurrence, and the number of words of each text."""
    data = _LOWER[data]
    starts, ends, own = word_spans(_INSIDE[data], offsets)
    counts = np.bincount(own, minlength=len(offsets) - 1)
    word = span_hashes(data, starts, ends)
    parts, owners = [word], [own]
    for gap, salt in ((1, 0xA5A5), (2, 0x5A5A)):
        same = own[gap:] == own[:-gap]
        parts.append(mix(word[:-gap][same] * np.uint64(3) + word[gap:][same] + np.uint64(salt)))
        owners.append(own[:-gap][same])
    for size in PREFIXES:
        long = ends - starts >= size
        parts.append(mix(span_hashes(data, starts[long], starts[long] + size) + np.uint64(0xBEEF)))
        owners.append(own[long])
    return (np.concatenate(parts) & np.uint64((1 << BITS) - 1)).astype(np.int64), np.concatenate(owners), counts


def features(hashes: np.ndarray, owners: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features (coordinates) with their text numbers, sorted by text."""
    keys, n = np.unique(owners << BITS | hashes, return_counts=True)
    text, base = keys >> BITS, keys & ((1 << BITS) - 1)
    at, whose = [base * LEVELS], [text]
    for level, share in enumerate(DENSITY, 1):
        dense = n >= share * words[text]
        at.append(base[dense] * LEVELS + level)
        whose.append(text[dense])
    at, whose = np.concatenate(at), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return at[order], whose[order]


def learn(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of all coordinates and the bias, by FTRL-proximal."""
    size = LEVELS << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for at, y in zip(rows, labels):
            at = np.append(at, size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1], float(w[-1])


def sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """SAMPLE labelled rows at most, in expectation: __id, __h (hash of the id) and __y. Held-out ids and null labels are left out."""
    rows = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(F.col(id_col)).alias("__h"), F.col(label_col).cast("double").alias("__y"))
    total = rows.count()
    return rows if total <= SAMPLE else rows.where(F.pmod("__h", F.lit(1 << 30)) < int((1 << 30) * (SAMPLE / total)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates with a weight, their weights, and the bias, learnt from labels (doc_id, toxic). The sampled labels are bounded and broadcast, so no text is shuffled."""
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), clean_text(f"`{text_col}`").alias("__t"))
    rows = texts.join(F.broadcast(sample(labels, id_col)), "__id").select("__h", "__t", "__y")

    def extract(texts: pa.Array) -> list[pa.Array]:
        data, offsets = text_bytes(texts)
        at, whose = features(*grams(data, offsets))
        ends = np.searchsorted(whose, np.arange(len(texts) + 1))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))]

    made = add_columns(rows, "__t", [("at", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], extract, keep=["__h", "__y"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts = [], np.zeros(LEVELS << BITS, dtype=np.int32)
        for x in batches:
            at = np.array(x.column(2).flatten())
            counts += np.bincount(at, minlength=len(counts)).astype(np.int32)
            parts.append((np.array(x.column(0)), np.array(x.column(1)), np.asarray(x.column(2).offsets) - x.column(2).offsets[0].as_py(), at))
        common, h, y, n, rows = counts >= LEAST_ROWS, [], [], [], []
        while parts:  # each batch goes as its common coordinates are kept
            ph, py, ends, at = parts.pop()
            h.append(ph)
            y.append(py)
            n.append(np.diff(ends))
            rows += [own[common[own]] for own in (at[a:b] for a, b in zip(ends[:-1], ends[1:]))]
        if not rows:
            return
        h, y, n = (np.concatenate(v) for v in (h, y, n))
        order = np.lexsort((n, h))
        w, bias = learn([rows[i] for i in order], y[order])
        rows.clear()
        release()
        on = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(w[on], bias))], names=["at", "w"])

    found = made.repartition(1).mapInArrow(train, "at long, w double").toPandas()
    if not len(found):
        return np.zeros(0, dtype=np.int64), np.zeros(0), -35.0
    on = found["at"] >= 0
    return found["at"][on].to_numpy(), found["w"][on].to_numpy(), float(found["w"][~on].iloc[0])


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with out_col, 0 to 1."""
    sent, cache = df.sparkSession.sparkContext.broadcast(model), []

    def step(texts: pa.Array) -> list[pa.Array]:
        if not cache:
            at, w, _ = sent.value
            table = np.zeros(LEVELS << BITS)
            table[at] = w
            cache.extend([table, (table.reshape(-1, LEVELS) != 0).any(axis=1)])
        table, alive = cache
        data, offsets = text_bytes(texts)
        hashes, owners, words = grams(data, offsets)
        live = alive[hashes]
        at, whose = features(hashes[live], owners[live], words)
        total = np.bincount(whose, weights=table[at], minlength=len(texts)) + sent.value[2]
        return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())]

    return add_columns(df, text_col, [(out_col, T.DoubleType(), pa.float64())], step, keep)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with score; a column of that name is replaced."""
    return score(docs, fit(docs, labels, id_col, text_col), text_col, "score", keep)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score THRESHOLD or more."""
    name = free_name(docs, "__score")
    return score(docs, fit(docs, labels, id_col, text_col), text_col, name).where(F.col(name) < THRESHOLD).drop(name)
