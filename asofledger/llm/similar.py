"""Near-duplicates at a Jaccard similarity, by ball hashing of long SimHash fingerprints, verified on the shingles themselves.

Method. A text's set of shingles (WIDE_SHINGLE words, in lower case) gives its identifier (equal sets are one node) and a fingerprint of several words of 64 bits. Texts whose sets have a Jaccard similarity of SIMILAR differ in a share ERROR of their bits (the angle of their
shingle vectors), far beyond three of 64. VERIFY words verify, the others make tables: a table takes `bits` of them, and every fingerprint emits all variants within half of radius TABLE_RADIUS = 2 of these bits. The bits of a table grow with the
logarithm of the number of rows, so that strangers in a key stay about as many at any size; the number of tables follows from them, so that a pair of similarity SIMILAR meets in one with probability MEET, whatever the size.
Within a key, pairs that differ in at most VERIFY_BITS of the VERIFY words are candidates. The rows of a key with more than KEY_MOST rows go on, to tables with STEP_BITS more bits, for which their texts are read again and get as many words as these tables need.
Beyond LAST_BITS such a key becomes one group of candidates, unverified, so no pair that met is lost.

Candidates only say where to look. In each of their components all links are decided by the true similarity of the sets, which are sent by the component: a component of up to PART nodes (and PART_HASHES hashes) in one key. In a larger one, up to PIVOTS nodes in turn are compared with all
others; what is linked to the first one, and to a later one whose links meet these, is connected already, so only the other nodes (and pairs of one of these with any node) are left. Those are dealt in blocks, each block of them against each part of the component.
So a text goes only if texts of similarity SIMILAR or more connect it to the one that stays, and links are lost only where a pair met in no table or had more than VERIFY_BITS bits apart: with a probability of 0.06 at SIMILAR, falling fast above.

Cases. Null or empty texts have the empty set and are one node, linked to nothing else; fewer than WIDE_SHINGLE words are one shingle. Null ids come last. Repeated rows are one node. Empty tables give empty ones; extra columns are left alone. Texts are one row whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bitmap, free_name, materialize, release, split_by
from .components import components
from .simhash import SEED, classes, first_of_each, local_components, shingle_hashes
from .wordhash import mix

WIDE_SHINGLE, SIMILAR, MEET, TABLE_RADIUS, STRANGERS = 5, 0.8, 0.95, 2, 200
#: Share of the bits in which fingerprints of sets of similarity SIMILAR differ.
ERROR = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
#: Words of a fingerprint that verify candidates, and how many of their bits may differ: at similarity SIMILAR 19 are expected, with a deviation of 4.
VERIFY, VERIFY_BITS = 2, 29
#: Rows of a key that are compared where they are; bits that the next tables have more; bits beyond which there are no next tables.
KEY_MOST, STEP_BITS, LAST_BITS = 1 << 14, 10, 48
#: Nodes, and hashes of their shingles, of a part of a component; nodes that are compared with all of a large component before the rest is dealt in blocks.
PART, PART_HASHES, PIVOTS = 512, 1 << 19, 3


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text, WIDE_SHINGLE), dtype="<u8"))


def fingerprint_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set, words of 64 bits, each made of another mix of the hashes. The first words are the same however many there are."""
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 13):
        mixed = mix(hashes[at : at + (1 << 13), None] + salts)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def _nodes_and_words(texts: pa.Array, words: int) -> list[pa.Array]:
    """The set's identifier of each text, and its words."""
    out = np.zeros((len(texts), 1 + words), dtype=np.uint64)
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        hashes = shingle_set(text)
        out[i, 0] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
        out[i, 1:] = fingerprint_words(hashes, words)
    return [pa.array(x) for x in out.view(np.int64).T.copy()]


def _with_words(texts: DataFrame, text_col: str, words: int, node: str = "node", prefix: str = "w", keep: list[str] | None = None) -> DataFrame:
    """texts (or its columns keep) with the node and words of each."""
    names = [node, *[f"{prefix}{w}" for w in range(words)]]
    return add_columns(texts, text_col, [(n, T.LongType(), pa.int64()) for n in names], lambda part: _nodes_and_words(part, words), keep)


def table_bits(n: int) -> int:
    """Bits of a table, so that among n fingerprints a key has STRANGERS rows or fewer by chance."""
    return next(b for b in range(12, 64) if n * (b + 1) / 2**b <= STRANGERS)


def table_count(bits: int) -> int:
    """Tables that a pair of similarity SIMILAR needs to meet in one of them with probability MEET."""
    p = sum(math.comb(bits, k) * ERROR**k * (1 - ERROR) ** (bits - k) for k in range(TABLE_RADIUS + 1))
    return max(1, math.ceil(math.log(1 - MEET) / math.log(1 - p)))


def words_for(bits: int) -> int:
    """Words of a fingerprint whose tables have `bits` bits each, none of them in two tables."""
    return VERIFY + math.ceil(table_count(bits) * bits / 64)


def _emit(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, node, the VERIFY words) of every table, from rows (node, words): the table's bits of the other words, and all single flips."""
    order = np.random.default_rng(bits).permutation(64 * (words_for(bits) - VERIFY))
    flips = np.array([0, *[1 << i for i in range(bits)]], dtype=np.int64)
    names = ["key", "node", *[f"w{w}" for w in range(VERIFY)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                held = np.stack([np.asarray(c) for c in batch.slice(at, 2048).columns], axis=1)
                found = np.unpackbits(np.ascontiguousarray(held[:, 1 + VERIFY :]).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                for t in range(table_count(bits)):
                    own = found[:, order[t * bits : (t + 1) * bits]] @ (1 << np.arange(bits, dtype=np.int64))
                    keys = (own[:, None] ^ flips | t << bits).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.repeat(held[:, w], len(flips))) for w in range(1 + VERIFY)]], names=names)

    return run


def _met(most: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate edges (u, v) from rows (key, node, VERIFY words) sorted by key. Rows of a key with more than most rows are handed on as edges from each to itself or, if last, linked to the key's first row. A task holds most rows of a key, and a batch."""

    def made(edges: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(edges) if edges else np.zeros((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], names=["u", "v"])

    def over(nodes: np.ndarray, first: int) -> np.ndarray:
        return np.stack([np.full(len(nodes), first) if last else nodes, nodes], axis=1)

    def within(own: np.ndarray) -> np.ndarray:
        label = classes(np.ascontiguousarray(own[:, 1:]).view(np.uint64), VERIFY_BITS)
        moved = np.flatnonzero(label != np.arange(len(own)))
        return np.stack([own[label[moved], 0], own[moved, 0]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, count, first = None, [], 0, 0
        for batch in batches:
            keys = np.asarray(batch.column(0))
            rows = np.stack([np.asarray(c) for c in batch.columns[1:]], axis=1)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            edges = []
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != key:
                    if count > 1 and held:
                        edges.append(within(np.concatenate(held)))
                    key, held, count, first = keys[a], [], 0, int(rows[a, 0])
                before, count = count, count + b - a
                if count <= most:
                    held.append(rows[a:b])
                else:
                    edges += [over(r[:, 0], first) for r in held] + [over(rows[a:b, 0], first)]
                    held = []
            yield made(edges)
        if count > 1 and held:
            yield made([within(np.concatenate(held))])

    return run


def candidate_edges(nodes: DataFrame, texts: DataFrame, bits: int) -> DataFrame:
    """Candidate edges among nodes (node, w0, w1 ..). texts (node, text) are read again only for those whose keys are crowded."""
    last = bits + STEP_BITS > LAST_BITS
    emitted = nodes.select("node", *[f"w{w}" for w in range(words_for(bits))]).mapInArrow(_emit(bits), "key long, node long, " + ", ".join(f"w{w} long" for w in range(VERIFY)))
    found = materialize(emitted.repartition("key").sortWithinPartitions("key").mapInArrow(_met(KEY_MOST, last), "u long, v long"), "met")
    edges = found.where("u <> v")
    crowded = materialize(found.where("u = v").select(F.col("u").alias("node")).distinct(), "crowded")
    if last or crowded.isEmpty():
        return edges
    return edges.unionByName(candidate_edges(distinct_nodes(_of(texts, crowded), bits + STEP_BITS), texts, bits + STEP_BITS))


def _of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """One of the texts of each of the nodes; only texts that a bitmap takes for theirs are shuffled, and of equal nodes one per task."""
    _, read = split_by(texts, "node", bitmap(nodes.select(F.col("node").alias("key"))))
    return read.groupBy("node").agg(F.min("text").alias("text")).join(nodes.select("node"), "node", "left_semi")


def distinct_nodes(texts: DataFrame, bits: int) -> DataFrame:
    """node and the words that tables of so many bits need, of texts that are a node each."""
    return materialize(_with_words(texts, "text", words_for(bits)).drop("text"), "words")


def similar_pairs(visitors: list[np.ndarray], residents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Visitors and residents (sets) of similarity SIMILAR or more."""
    sizes = np.array([len(s) for s in residents], dtype=np.int64)
    known, flat = np.unique(np.concatenate(residents) if len(residents) else np.zeros(0, dtype=np.uint64), return_inverse=True)
    ends = np.cumsum(sizes)
    a, b = [], []
    for i, own in enumerate(visitors):
        at = np.searchsorted(known, own)
        at = at[at < len(known)] if not len(known) else at[known[np.minimum(at, len(known) - 1)] == own]
        mark = np.zeros(len(known), dtype=bool)
        mark[at] = True
        summed = np.append(0, np.cumsum(mark[flat]))
        common = summed[ends] - summed[ends - sizes]
        near = np.flatnonzero((common > 0) & (common >= SIMILAR * (len(own) + sizes - common) - 1e-9))
        a.append(np.full(len(near), i))
        b.append(near)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def set_classes(sets: list[np.ndarray]) -> np.ndarray:
    """The first set that each one reaches over links: what is reached is not searched again."""
    label, left = np.arange(len(sets)), np.arange(len(sets))
    while len(left):
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            _, near = similar_pairs([sets[front.pop()]], [sets[i] for i in left])
            label[left[near]] = root
            front += left[near].tolist()
            left = np.delete(left, near)
    return label


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from rows (key, visitor, node, hashes) sorted by key: links of a key's visitors to all others of it or, in a key without visitors, of all. A key's edges are at most as many as its rows."""

    def edges(visits: list[bool], nodes: list[int], hashes: list[bytes]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(h, dtype=np.uint64) for h in hashes]
        if any(visits):
            guests = np.flatnonzero(visits)
            a, b = similar_pairs([sets[i] for i in guests], sets)
            label = local_components(len(nodes), guests[a], b)
        else:
            label = set_classes(sets)
        return [(nodes[r], nodes[i]) for i, r in enumerate(label.tolist()) if nodes[r] != nodes[i]]

    def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    key, held = None, []
    for batch in batches:
        found = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != key and held:
                found += edges(*map(list, zip(*held)))
                held = []
            key = row[0]
            held.append(row[1:])
        yield made(found)
    if held:
        yield made(edges(*map(list, zip(*held))))
    release()


def compared(rows: DataFrame) -> DataFrame:
    """Links within the keys of rows (key, visitor, node, hashes)."""
    return rows.select("key", "visitor", "node", "hashes").repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "u long, v long")


def _numbers(count: str | F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), (F.col(count) if isinstance(count, str) else count) - 1))


def large_links(large: DataFrame) -> DataFrame:
    """Links of components of several parts: large has root, node, hashes and parts (how many parts the root has)."""
    placed = large.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    residents = placed.select(F.col("root"), "part", F.lit(False).alias("visitor"), "node", "hashes")
    keyed = lambda rows, *more: rows.withColumn("key", F.xxhash64("root", "part", *more))
    left, found, tried = placed.select("root", "node"), [], None
    for turn in range(PIVOTS):
        open_nodes = left if tried is None else left.join(tried, ["root", "node"], "left_anti")
        pivots = materialize(open_nodes.groupBy("root").agg(F.min("node").alias("node")), "pivots")
        guests = large.join(pivots, ["root", "node"]).withColumn("part", _numbers("parts")).select("root", "part", F.lit(True).alias("visitor"), "node", "hashes")
        others = residents.join(pivots.select("root"), "root", "left_semi")
        links = materialize(compared(keyed(others.unionByName(guests))), "links")
        found.append(links)
        reached = links.select(F.explode(F.array("u", "v")).alias("node")).unionByName(pivots.select("node")).distinct()
        star = materialize(placed.select("root", "node").join(reached, "node", "left_semi"), "star")
        # a star goes only if it meets what the first one has gathered: else its nodes may have links there that its pivot has not
        gone = star if not turn else star.join(star.join(left, ["root", "node"], "left_anti").select("root").distinct(), "root", "left_semi")
        left = materialize(left.join(gone, ["root", "node"], "left_anti").select("root", "node"), "left")
        if left.isEmpty():
            break
        tried = star if tried is None else tried.unionByName(star)
    else:
        blocks = materialize(left.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("long").alias("blocks")), "blocks")
        block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
        guests = large.join(left, ["root", "node"]).join(blocks, "root").withColumn("block", block).withColumn("part", _numbers("parts")).select("root", "part", "block", F.lit(True).alias("visitor"), "node", "hashes")
        others = residents.join(blocks, "root").withColumn("block", _numbers("blocks")).drop("blocks")
        found.append(compared(keyed(others.unionByName(guests.select(*others.columns)), "block")))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def verified_edges(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges that hold by the true similarity of the sets, within the components of the candidate edges. texts: node and text of all rows."""
    roots = materialize(components(candidates).select("node", "root"), "roots")
    step = lambda part: [pa.array([shingle_set(t).tobytes() for t in part.cast(pa.binary()).to_pylist()], pa.binary())]
    sets = materialize(add_columns(_of(texts, roots), "text", [("hashes", T.BinaryType(), pa.binary())], step, keep=["node"]).join(roots, "node"), "sets")
    sizes = sets.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum(F.octet_length("hashes")) / (8 * PART_HASHES))).cast("long").alias("parts"))
    sizes = materialize(sizes, "sizes")
    held = materialize(sets.join(sizes, "root"), "placed")
    edges = compared(held.where("parts <= 1").select(F.col("root").alias("key"), F.lit(False).alias("visitor"), "node", "hashes"))
    large = held.where("parts > 1")
    return edges if large.isEmpty() else edges.unionByName(large_links(large))


def keep_dissimilar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component of texts of similarity SIMILAR or more: that of its smallest id."""
    bits = table_bits(max(1, df.count()))
    words = words_for(bits)
    prefix = "__w"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    node = free_name(df, "__node")
    held = materialize(_with_words(df, text_col, words, node, prefix), "fingerprints")
    own = [F.col(f"{prefix}{w}").alias(f"w{w}") for w in range(words)]
    rows = held.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(node).alias("node"), *own)
    nodes = rows.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min(F.struct(*[f"w{w}" for w in range(words)])).alias("o"))
    nodes = materialize(nodes.select(F.col("node").alias("fp"), "node", "least", "n", "o.*"), "nodes")
    texts = held.select(F.col(node).alias("node"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = components(verified_edges(candidate_edges(nodes, texts, bits), texts))
    placed = materialize(nodes.join(found, "node", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "placed")
    return first_of_each(held, node, placed, df.columns, id_col)
