"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Method (near_classes, keep_one). A text's words are those of the text in lower case (A-Z), split at [space, \\t-\\r]; each run of SHINGLE words gives an XXH64, and
a fingerprint bit is set where over half of the hashes have it. Equal fingerprints are one node, so copies cost nothing further. Two fingerprints
within RADIUS = 3 bits meet in the middle: each emits all variants within half the radius, that is itself and its
64 single flips. As 3 is odd, the bit that is left over is met by blanking one block of BLOCK bits: for each of the 64 / BLOCK
blocks a fingerprint emits its variants with that block blank (196 keys in all). Any two fingerprints at distance 3 or less share a key: blank the block
of one differing bit, and flip one of the other two on each side. Keys are shuffled, and within a key every collision is verified by counting bits.
A key of more than KEY_MOST rows is not searched where it is: its fingerprints are passed on and emit the keys of blocks of FINE bits, of which none can have more than
(1 + 64 - FINE) * 2 ** FINE = 14,592 rows. The same argument holds for these, so nothing is lost, and no task holds more than that many rows of a key.
A key gives a spanning star for each of its components rather than all pairs.

Cases. Null or empty texts have fingerprint zero and are linked like any other; fewer than SHINGLE words are one shingle. Null ids never become a
component's id unless all its ids are null. Repeated rows get the same row each; empty tables give empty ones; extra columns are left alone. Texts are one row whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bitmap, free_name, materialize, split_by
from .components import components

SHINGLE, SEED, RADIUS, BLOCK = 3, 42, 3, 16
FINE = 8
#: Rows of a key that are compared where they are; larger keys are passed on to finer ones.
KEY_MOST = 2048
#: Rows up to which a group's pairs are compared at once; larger groups are searched from row to row.
MATRIX_ROWS = 256

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FLIPS = [1 << i for i in range(64)]


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    words = text.translate(LOWER).split()
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(begins, ends[width - 1 :].tolist())]


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """SimHash of each text, as int64 with the same bits."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, width), dtype="<u8")
        if len(hashes):
            counts = np.zeros(64, dtype=np.int64)
            for at in range(0, len(hashes), 1 << 14):
                counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with out_col, the fingerprint as a long."""
    return add_columns(df, text_col, [(out_col, T.LongType(), pa.int64())], lambda texts: [pa.array(fingerprints(texts.cast(pa.binary()).to_pylist()))], keep)


def ball_keys(size: int = BLOCK) -> list[tuple[int, int]]:
    """(kept bits, bits to set or flip) of every key that a fingerprint emits; a blanked block holds the block's tag."""
    made = []
    for at in range(0, 64, size):
        block = ((1 << size) - 1) << at
        tag = ((0x9E37 + 0x1235 * (at // size)) & ((1 << size) - 1)) << at
        made += [(~block, tag)] + [(~block, tag ^ f) for f in FLIPS if not f & block]
    return [tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (keep & ((1 << 64) - 1), flip)) for keep, flip in made]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of a to each row of b; rows of uint64 words."""
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return out


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def classes(rows: np.ndarray, radius: int) -> np.ndarray:
    """The first row that each row reaches over links of at most radius bits: exact, in memory in proportion to the rows."""
    n = len(rows)
    if n <= MATRIX_ROWS:
        a, b = np.nonzero(np.triu(distances(rows, rows) <= radius, 1))
        return local_components(n, a, b)
    label, left = np.arange(n), np.arange(n)
    while len(left):
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            part, front = front[:64], front[64:]
            near = (distances(rows[part], rows[left]) <= radius).any(axis=0)
            label[left[near]] = root
            front, left = np.concatenate([front, left[near]]), left[~near]
    return label


def key_edges(keys: np.ndarray, rows: np.ndarray, radius: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (first words) of whole runs of equal keys; keys are sorted. A run of more than most rows gives an edge from each row to itself instead."""
    change = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(change, len(keys)))
    pair = change[sizes == 2]
    near = np.bitwise_count(rows[pair] ^ rows[pair + 1]).sum(axis=1) <= radius
    us, vs = [rows[pair, 0][near]], [rows[pair + 1, 0][near]]
    for at, size in zip(change[sizes > 2], sizes[sizes > 2]):
        own = rows[at : at + size]
        if most is not None and size > most:
            us.append(own[:, 0])
            vs.append(own[:, 0])
            continue
        label = classes(own, radius)
        moved = np.flatnonzero(label != np.arange(len(own)))
        us.append(own[label[moved], 0])
        vs.append(own[moved, 0])
    return np.concatenate(us), np.concatenate(vs)


def collide(radius: int, most: int | None, step: int = 1 << 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (u, v) from rows (key, fp) sorted by key. The last key of a batch waits for the next one, unless it has more than most rows: then its rows are passed on one by one, as edges from each to itself."""

    def made(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def passed(rows: np.ndarray) -> pa.RecordBatch:
        return made(rows[:, 0].copy(), rows[:, 0].copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = rows = over = None
        for batch in batches:
            k = np.asarray(batch.column(0))
            r = np.stack([np.asarray(c) for c in batch.columns[1:]], axis=1).view(np.uint64)
            if over is not None:
                n = int(np.searchsorted(k, over, side="right"))
                if n:
                    yield passed(r[:n])
                k, r = k[n:], r[n:]
                if not len(k):
                    continue
                over = None
            keys, rows = (k, r) if keys is None or not len(keys) else (np.concatenate([keys, k]), np.concatenate([rows, r]))
            if len(keys) >= step:
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield made(*key_edges(keys[:cut], rows[:cut], radius, most))
                    keys, rows = keys[cut:].copy(), rows[cut:].copy()
                if most is not None and len(keys) > most:
                    over = keys[-1]
                    yield passed(rows)
                    keys = rows = None
        if keys is not None and len(keys):
            yield made(*key_edges(keys, rows, radius, most))

    return run


def fingerprint_edges(nodes: DataFrame, fp_col: str = "fp") -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints of nodes exactly as all links within RADIUS do."""

    def met(fps: DataFrame, size: int, most: int | None) -> DataFrame:
        variants = F.array(*[F.col("fp").bitwiseAND(F.lit(keep)).bitwiseXOR(F.lit(flip)) for keep, flip in ball_keys(size)])
        return fps.select(F.explode(variants).alias("key"), "fp").repartition("key").sortWithinPartitions("key").mapInArrow(collide(RADIUS, most), "u long, v long")

    found = materialize(met(nodes.select(F.col(fp_col).alias("fp")), BLOCK, KEY_MOST), "met")
    crowded = found.where("u = v").select(F.col("u").alias("fp")).distinct()
    return found.where("u <> v") if crowded.isEmpty() else found.where("u <> v").unionByName(met(crowded, FINE, None))


def with_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (fp and more) with root, the smallest fingerprint that each one reaches over edges."""
    roots = components(edges)
    return materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root")), "placed")


def placed_nodes(rows: DataFrame) -> DataFrame:
    """rows (id long, fp long) -> one row per distinct fingerprint: fp, least (its smallest id), n (its rows), root (its component's smallest fingerprint)."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    return with_roots(nodes, fingerprint_edges(nodes))


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, fp (long) and component_id, the smallest id that is reachable over links.

    What rows are joined to is written before, so that each join is of two shuffles, of which skew handling splits a hot one.
    """
    rows = materialize(with_fingerprint(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("__text")), "__text", "fp", keep=["id"]), "fingerprints")
    placed = placed_nodes(rows)
    least = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "classes")
    labelled = materialize(placed.join(least, "root").select("fp", "component_id"), "labelled")
    return rows.join(labelled, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def first_of_each(held: DataFrame, fp: str, placed: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """Columns of held (with a fingerprint fp) for one row of each component of placed: that of its smallest id, then of the smallest fingerprint; among rows that share both, one of them.

    A row is known by its id and fingerprint, as ids may be null or repeat in other components. Only rows of components with several rows (and the few that a bitmap takes for such) are shuffled.
    """
    unknown, number = (free_name(held, n) for n in ("__unknown", "__number"))
    own = F.col(f"`{id_col}`").cast("long")
    chosen = placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("unknown"), F.coalesce("least", F.lit(0)).alias("number"), "fp")).alias("c"), F.sum("n").alias("n"))
    chosen = materialize(chosen.select("root", F.col("c.fp").alias(fp), F.col("c.unknown").alias(unknown), F.col("c.number").alias(number), "n"), "chosen")
    several = placed.join(chosen.where("n > 1").select("root"), "root", "left_semi").select(F.col("fp").alias("key"))
    marks = bitmap(several)
    alone, rest = split_by(held.withColumns({unknown: own.isNull(), number: F.coalesce(own, F.lit(0))}), fp, marks)
    _, deciding = split_by(chosen, fp, marks)
    kept = rest.dropDuplicates([fp, unknown, number]).join(deciding.select(fp, unknown, number), [fp, unknown, number], "left_semi")
    cols = [f"`{c}`" for c in columns]
    return alone.select(*cols).unionByName(kept.select(*cols))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component of fingerprints within RADIUS bits."""
    fp = free_name(df, "__fp")
    held = materialize(with_fingerprint(df, text_col, fp), "fingerprints")
    placed = placed_nodes(held.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(fp).alias("fp")))
    return first_of_each(held, fp, placed, df.columns, id_col)
