"""SentencePiece encoding and decoding by a distinct-chunk table.

Method. A vocabulary in which no piece holds a whitespace marker after another character, and none a line feed, can
never merge across such a boundary, so a text falls into chunks (a run of markers with the word behind it, or a line
feed) that are segmented independently. Each task cuts its texts into chunks with one pass over their bytes, keeps a
table of the distinct chunks, segments each distinct chunk once, and puts the ids back by position. The table is kept
between batches of a task and is emptied when it has TABLE_CHUNKS chunks, so memory stays bounded. The word positions never
leave the task: shuffling one row per word to a global table would move several times the input.

Cases. Null text counts as empty; an empty text has only the begin and end ids and decodes to ''. Repeated rows, ties
and extra columns are kept as they are; an empty table gives an empty table. A text is one row whatever its length.
Columns named like an output are replaced. If a vocabulary has pieces across boundaries, each whole text is one chunk.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, release

#: Distinct chunks that a task's table holds before it starts anew.
TABLE_CHUNKS = 200_000
#: Chunks that go to the library in one string.
JOINED = 512
SPACE, FEED, MARK = 0x20, 0x0A, "▁"


@lru_cache(maxsize=4)
def processor(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


@lru_cache(maxsize=4)
def separable(model_file: str) -> bool:
    """Whether no piece crosses a chunk boundary and the model leaves white space as it is."""
    sp = processor(model_file)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return all("\n" not in p and MARK not in p.lstrip(MARK) for p in pieces) and "".join(sp.encode("  a", out_type=str)) == MARK * 3 + "a" and sp.decode(sp.encode(" a ")) == " a "


class ChunkTable:
    """Distinct chunks met so far and their ids, as one flat list with offsets."""

    def __init__(self, model_file: str):
        self.sp, self.split = processor(model_file), separable(model_file)
        self.feed = self.sp.encode("\n")[-1]
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {"\n": 0} if self.split else {}
        self.flat = np.array([self.feed] * self.split, dtype=np.int32)
        self.ends = np.arange(1 + self.split, dtype=np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """segment() for a vocabulary that has pieces across boundaries; each text comes with a space for the library's marker."""
        made = [np.array(self.sp.encode(t[1:], num_threads=1), dtype=np.int32) for t in texts]
        return np.concatenate([np.zeros(0, dtype=np.int32), *made]), np.array([len(x) for x in made], dtype=np.int64)

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks as they are inside a text, and how many each has. Chunks go to the library many at a time, a line
        feed before each: nothing merges across it, and its id, which nothing else has, tells where a chunk's ids begin."""
        if not chunks:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        made = self.sp.encode(["\n" + "\n".join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)], num_threads=1)
        head = len(self.sp.encode("\n")) - 1  # the marker that the library puts first
        ids = np.concatenate([np.array(x[head:], dtype=np.int32) for x in made])
        feeds = np.flatnonzero(ids == self.feed)
        return np.delete(ids, feeds), np.diff(np.append(feeds, len(ids))) - 1

    def lookup(self, chunks: pa.Array) -> np.ndarray:
        """Row of each distinct chunk, after segmenting those not met before."""
        if len(self.rows) > TABLE_CHUNKS:
            self.clear()
        words = chunks.to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            rows[missing] = np.arange(len(self.rows), len(self.rows) + len(new))
            self.rows.update(zip(new, rows[missing].tolist()))
            ids, lengths = self.segment(new) if self.split else self.whole(new)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.flat = np.concatenate([self.flat, ids])
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and their n + 1 offsets."""
        given = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")  # the library takes a marker in a text for a space
        marked = pc.if_else(pc.equal(pc.binary_length(given), 0), given, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), given, pa.scalar("", pa.large_string())))
        offsets = np.frombuffer(marked.buffers()[1], dtype=np.int64)[marked.offset : marked.offset + len(marked) + 1]
        if offsets[-1] == offsets[0]:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        data = np.frombuffer(marked.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = np.zeros(len(data), dtype=bool)
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.split:
            space, feed = data == SPACE, data == FEED
            starts[1:] |= (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        starts = np.flatnonzero(starts)
        cuts = np.append(starts, len(data))
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = chunks.dictionary_encode()
        rows = self.lookup(coded.dictionary)[np.asarray(coded.indices)]
        firsts, lengths = self.ends[rows], np.diff(self.ends)[rows]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(firsts - ends + lengths, lengths)
        before = np.searchsorted(starts, offsets)
        return self.flat[places], np.concatenate([[0], ends])[before]


def encode_batch(texts: pa.Array, model_file: str, state: dict) -> pa.Array:
    """Lists of ids with begin and end ids."""
    if model_file not in state:
        state[model_file] = ChunkTable(model_file)
    table = state[model_file]
    ids, offsets = table.encode(texts)
    n = len(texts)
    out = np.empty(len(ids) + 2 * n, dtype=np.int32)
    own = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(ids)) + 2 * own + 1] = ids
    ends = offsets + 2 * np.arange(n + 1)
    out[ends[:-1]], out[ends[1:] - 1] = table.sp.bos_id(), table.sp.eos_id()
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(out)).cast(pa.list_(pa.int32()))


def encode(df: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with ids_col: array<int>, begin and end ids included."""
    state: dict = {}
    return add_columns(df, text_col, [(ids_col, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], lambda texts: [encode_batch(texts, model_file, state)], keep)


def id_lists(ids: pa.Array) -> list[list[int]]:
    """The lists of an array of lists; null ones are empty."""
    whole = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False)[whole[0] : whole[-1]].tolist()
    lists = [flat[a:b] for a, b in zip((whole[:-1] - whole[0]).tolist(), (whole[1:] - whole[0]).tolist())]
    return [x if there else [] for x, there in zip(lists, ids.is_valid().to_pylist())] if ids.null_count else lists


def decode_batch(ids: pa.Array, model_file: str) -> pa.Array:
    """The texts of lists of ids."""
    lists = id_lists(ids)
    return pa.array(processor(model_file).decode(lists, num_threads=1) if lists else [], pa.string())


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col: the text of ids_col; null ids count as none and give ''. Ids outside the vocabulary raise."""
    kept = [c for c in df.columns if c.lower() != text_col.lower()]
    given = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*given.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, decode_batch(part.column(part.schema.get_field_index(ids_col)), model_file)], names=[*kept, text_col])
            release()

    return given.mapInArrow(run, schema)


def ids_digest(ids: pa.Array) -> pa.Array:
    """Lowercase hex SHA-256 of each list's ids as little-endian unsigned 32-bit integers."""
    flat, offsets = np.asarray(ids.flatten(), dtype="<u4"), np.asarray(ids.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    return pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])], pa.string())


def decoded_digest(ids: pa.Array, model_file: str) -> pa.Array:
    """Lowercase hex SHA-256 of each list's decoded text."""
    return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decode_batch(ids, model_file).to_pylist()], pa.string())


def round_trip(df: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with ids_col, n_tokens and decoded_sha256, by encode_batch() and decode_batch() in one pass: one Python worker a task holds the vocabulary."""
    state: dict = {}

    def step(texts: pa.Array) -> list[pa.Array]:
        ids = encode_batch(texts, model_file, state)
        return [ids, pa.array(np.diff(ids.offsets.to_numpy()), pa.int64()), decoded_digest(ids, model_file)]

    fields = [(ids_col, T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("n_tokens", T.LongType(), pa.int64()), ("decoded_sha256", T.StringType(), pa.string())]
    return add_columns(df, text_col, fields, step, keep)


def round_trip_digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, n_tokens, ids_sha256, decoded_sha256, by encode_batch() and decode_batch() in one pass, so that ids never leave the task."""
    state: dict = {}

    def step(texts: pa.Array) -> list[pa.Array]:
        ids = encode_batch(texts, model_file, state)
        return [pa.array(np.diff(ids.offsets.to_numpy()), pa.int64()), ids_digest(ids), decoded_digest(ids, model_file)]

    fields = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return add_columns(df, text_col, fields, step, keep=[id_col])
