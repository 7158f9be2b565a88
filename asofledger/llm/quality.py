"""Quality rules: repetition and length counts, and divergence of a text's histograms from its language's reference.

Method. One pass over whole texts gives each row its counts, a histogram of character classes and one of common words (fixed lists of
function words of four languages, and the rest); these rows of numbers are written once. References are the histograms of all rows of a language, summed over
the table. A row's Jensen-Shannon distance (base 2, square root of the divergence) to its language's reference is compared with a limit that allows for
sampling noise; a row with fewer words than CHARS_WORDS or WORDS_WORDS is too short for that comparison and passes it. Languages other than the four share one reference, so there are at
most five and they are broadcast.

Cases. Null text has no words; null lang counts among the other languages. Repeated rows get equal rows; very long texts are one row; empty
tables give empty ones; columns of the table that are named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialize, text_bytes
from .wordhash import mix, span_hashes, word_spans

# Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that it was for on are as with be by at this have from or an not but which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus il avec ce ou".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo es como más o".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
CLASSES = ["lower", "upper", "digit", "space", "stop", "mark", "bar", "symbol", "other", "beyond"]

LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Words that a text needs for each comparison; the largest distance that passes is FAR + NOISE / sqrt(n_words), as short texts differ by chance.
CHARS_WORDS, CHARS_FAR, CHARS_NOISE = 20, 0.12, 1.5
WORDS_WORDS, WORDS_FAR, WORDS_NOISE = 100, 0.12, 2.6

_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_SYMBOL = np.array([chr(c) in "#*$%&|<>" for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_WORDLY = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def _class_of(c: int) -> int:
    x = chr(c)
    if c >= 128:
        return 9 if c >= 192 else 10
    for k, found in enumerate((x.islower(), x.isupper(), x.isdigit(), c == 32 or 9 <= c <= 13, x in ".,;:!?", x in "'\"()-", x == "|", x in "#*$%&<>")):
        if found:
            return k
    return 8


_CLASS = np.array([_class_of(c) for c in range(256)], dtype=np.int64)


def _common_table() -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in WORDS]
    data, ends = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([len(w) for w in raw])
    hashes = span_hashes(data, ends - np.array([len(w) for w in raw]), ends)
    order = np.argsort(hashes)
    return hashes[order], order


_COMMON_HASHES, _COMMON_ROWS = _common_table()


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each byte stands in each text."""
    out = np.zeros((len(offsets) - 1, 256), dtype=np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, b, 1 << 20):
            out[i] += np.bincount(data[at : min(b, at + (1 << 20))], minlength=256)
    return out


def measure(texts: pa.Array) -> list[pa.Array]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and both histograms of each text."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    space = _SPACE[data]
    starts, ends, own = word_spans(~space, offsets)
    n_words = np.bincount(own, minlength=n)
    of_byte = byte_counts(data, offsets)
    classes = np.stack([of_byte[:, _CLASS == k].sum(axis=1) for k in range(len(CLASSES))], axis=1)
    word_chars = classes.sum(axis=1) - classes[:, 3]
    symbols = of_byte[:, _SYMBOL].sum(axis=1)

    word = span_hashes(data, starts, ends)
    repeated = np.zeros(n, dtype=np.int64)
    if len(word) >= WINDOW:
        last = len(word) - WINDOW + 1
        whole = np.flatnonzero(own[:last] == own[WINDOW - 1 :])
        key = mix(own[whole].astype(np.uint64) + np.uint64(7))
        for k in range(WINDOW):
            key = mix(key * np.uint64(31) + word[whole + k])
        if len(whole):
            step = np.zeros(len(word) + 1, dtype=np.int64)
            twice = whole[_repeats(key)]
            np.add.at(step, twice, 1)
            np.add.at(step, twice + WINDOW, -1)
            repeated = np.bincount(own[np.cumsum(step[:-1]) > 0], minlength=n)

    lines, line_ends, line_own = word_spans(data != 10, offsets)
    if len(lines):
        wordy = np.logical_or.reduceat(~space, lines)
        lines, line_ends, line_own = lines[wordy], line_ends[wordy], line_own[wordy]
    key = mix(span_hashes(data, lines, line_ends) + mix(line_own.astype(np.uint64) + np.uint64(11)))
    first = np.unique(key, return_index=True)[1]
    dup_lines = np.bincount(line_own, minlength=n) - np.bincount(line_own[first], minlength=n)

    low = _LOWER[data]
    s, e, o = word_spans(_WORDLY[low], offsets)
    h = span_hashes(low, s, e)
    at = np.minimum(np.searchsorted(_COMMON_HASHES, h), len(WORDS) - 1)
    row = np.where(_COMMON_HASHES[at] == h, _COMMON_ROWS[at], len(WORDS))
    common = np.bincount(o * (len(WORDS) + 1) + row, minlength=n * (len(WORDS) + 1)).reshape(n, -1)

    def lists(table: np.ndarray) -> pa.Array:
        table = np.ascontiguousarray(table, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * table.shape[1]), pa.array(table.ravel()))

    return [pa.array(x.astype(np.int64)) for x in (n_words, word_chars, symbols, dup_lines, repeated)] + [lists(classes), lists(common)]


FIELDS = [(name, T.LongType(), pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [(name, T.ArrayType(T.IntegerType()), pa.list_(pa.int32())) for name in ("char_hist", "word_hist")]


def _total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0.0), lambda a, x: a + x.cast("double"))


def shares(hist: Column) -> Column:
    """A histogram made to sum to 1; zeros if it is empty."""
    return F.transform(hist, lambda x: F.coalesce(F.try_divide(x.cast("double"), _total(hist)), F.lit(0.0)))


def distance(own: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram with its total to the shares of a reference; 0 for an empty histogram.

    A bin that the histogram lacks adds its whole reference share, so logarithms are taken of the bins that it has.
    """
    def part(x: Column, r: Column) -> Column:
        p = x / total
        both = p * F.log2(2 * p / (p + r)) + F.when(r > 0, r * F.log2(2 * r / (p + r))).otherwise(F.lit(0.0))
        return F.when(x > 0, both).otherwise(r)

    divergence = F.aggregate(F.zip_with(own, reference, part), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(divergence / 2, F.lit(0.0)))).otherwise(F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of df: its id, the counts, char_distance, word_distance, base_failed and kept."""
    lang = F.when(F.col(f"`{lang_col}`").isin(*COMMON), F.col(f"`{lang_col}`")).otherwise(F.lit("other"))
    given = df.select(F.col(f"`{id_col}`").alias("__id"), lang.alias("__lang"), F.col(f"`{text_col}`").alias("__t"))
    rows = materialize(add_columns(given, "__t", FIELDS, measure, keep=["__id", "__lang"]), "quality")
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]).cast("double") for i in range(n)]).alias(f"all_{name}")
    reference = rows.groupBy("__lang").agg(sums("char_hist", len(CLASSES)), sums("word_hist", len(WORDS) + 1)).select("__lang", *[shares(F.col(f"all_{h}")).alias(f"all_{h}") for h in ("char_hist", "word_hist")])
    totalled = rows.withColumns({"chars": _total(F.col("char_hist")), "words": _total(F.col("word_hist"))})
    scored = totalled.join(F.broadcast(reference), "__lang").withColumns({"char_distance": distance(F.col("char_hist"), F.col("chars"), F.col("all_char_hist")), "word_distance": distance(F.col("word_hist"), F.col("words"), F.col("all_word_hist"))})
    near = lambda name, least, far, noise: (F.col("n_words") < least) | (F.col(name) <= far + noise / F.sqrt("n_words"))
    passed = near("char_distance", CHARS_WORDS, CHARS_FAR, CHARS_NOISE) & near("word_distance", WORDS_WORDS, WORDS_FAR, WORDS_NOISE)
    failed = base_failed()
    return scored.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passed).alias("kept"), "char_distance", "word_distance")
