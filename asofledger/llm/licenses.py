"""License scans: fuzzy search for short notices.

Method. A text becomes its words (lower-case A-Z, digits, letters and non-ASCII characters), joined by single spaces. Each notice of NOTICES may hold up to one edit (insertion, deletion or
substitution of a character) per EDIT_EVERY characters. By the pigeonhole principle, a notice with at most k edits holds one of k + 1 parts of it unchanged, so the parts are
searched exactly, all at once, by one automaton over the whole text; only around their hits, where enough of the notice's trigrams stand, does the regex library (beyond REGEX_EDITS, bit-vector distances alone) match the notice with at most k errors, which verifies
the edits and gives the span. Hits that stand close together are verified as one stretch: one pass of bit vectors says where matches may end and with how many edits, the regex library then sees a window of the notice's length for each, best first. Base places (a phrase's
words standing consecutively) are found by the same automaton.

Cases. Null text counts as empty and has no words. Repeated rows are scanned each; very long texts are one row; empty tables give empty ones; columns named like an output are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

# Phrases whose places count as they are, and notices with the label that each one gives.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "eclipse public license"),
    ("boost", "distributed under the boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("cc", "licensed under a creative commons attribution"),
    ("warranty", "this software is provided as is without warranty of any kind"),
    ("reserved", "all rights reserved"),
]
#: REGEX_EDITS is the most edits that the regex library is asked for: its time grows steeply with them, and more are met by bit vectors alone.
EDIT_EVERY, REGEX_EDITS = 10, 6

_LOWER = bytes(c + 32 if 65 <= c <= 90 else (c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
FOUND = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("similarity", T.DoubleType())]))
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_()), ("similarity", pa.float64())]))


def edits(notice: str) -> int:
    return len(notice) // EDIT_EVERY


def seeds(notice: str) -> list[tuple[int, str]]:
    """edits + 1 parts of the notice with their offsets."""
    n = edits(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found: dict[str, list[tuple[int, int]]] = {}
    for i, (_, notice) in enumerate(NOTICES):
        for at, part in seeds(notice):
            found.setdefault(part, []).append((i, at))
    for phrase in PHRASES:
        found.setdefault(f" {phrase} ", []).append((-1, 0))
    made = ahocorasick.Automaton()
    for part, owners in found.items():
        made.add_word(part, (part, owners))
    made.make_automaton()
    return made


@lru_cache(maxsize=256)
def pattern(i: int, k: int):
    """The notice with at most k edits, the best match first."""
    return regex.compile(rf"(?b)(?:{regex.escape(NOTICES[i][1])}){{e<={k}}}")


@lru_cache(maxsize=64)
def trigrams(i: int) -> tuple[dict[str, int], int]:
    """The notice's runs of three characters, and how many of them a stretch must share: an edit changes three at most."""
    notice = NOTICES[i][1]
    counts: dict[str, int] = {}
    for at in range(len(notice) - 2):
        counts[notice[at : at + 3]] = counts.get(notice[at : at + 3], 0) + 1
    return counts, len(notice) - 2 - 3 * edits(notice)


def plausible(text: str, a: int, b: int, i: int) -> bool:
    """Whether text[a:b] shares as many trigrams with the notice as any match does."""
    counts, least = trigrams(i)
    left = dict(counts)
    for at in range(a, b - 2):
        gram = text[at : at + 3]
        if left.get(gram, 0):
            left[gram] -= 1
            least -= 1
            if least <= 0:
                return True
    return least <= 0


def distances(notice: str, text: str, anywhere: bool) -> list[int]:
    """Fewest edits from the notice to a stretch of text that ends after each of its characters, and begins anywhere or at 0 (Myers' bit vectors)."""
    n = len(notice)
    full, top = (1 << n) - 1, 1 << (n - 1)
    place: dict[str, int] = {}
    for at, c in enumerate(notice):
        place[c] = place.get(c, 0) | 1 << at
    up, down, score, out = full, 0, n, []
    for c in text:
        eq = place.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(across | up)), up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | (not anywhere)) & full, (minus << 1) & full
        vertical = eq | down
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        out.append(score)
    return out


def span(text: str, a: int, end: int, i: int, k: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the notice's match with k edits in text[a:end], as the regex library has it; beyond REGEX_EDITS by distances from the end."""
    if k <= REGEX_EDITS:
        m = pattern(i, k).search(text, a, end)
        return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None
    notice = NOTICES[i][1]
    lengths = [at + 1 for at, d in enumerate(distances(notice[::-1], text[a:end][::-1], False)) if d == k]
    return (end - min(lengths, key=lambda n: abs(n - len(notice))), end, k) if lengths else None


def verified(text: str, a: int, b: int, i: int) -> list[tuple[int, int, int]]:
    """Start, end and edits of the notice's matches in text[a:b]: those with the fewest edits first, the first of equals, none over another; then those of the parts in between.

    One pass finds the fewest edits of a match that ends at each place, and the regex library is asked only for windows of the notice's length and its edits, so time grows with the text: a part is searched again only where a match
    was over one that is taken, and then needs more edits.
    """
    notice, most = NOTICES[i][1], edits(NOTICES[i][1])
    least, longest = len(notice) - most, len(notice) + most
    found, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        if b - a < least or not plausible(text, a, b, i):
            continue
        taken, own = bytearray(b - a), []
        for k, end in sorted((k, at + 1) for at, k in enumerate(distances(notice, text[a:b], True)) if k <= most):
            if 1 in taken[max(0, end - least) : end]:
                continue
            m = span(text, a + max(0, end - longest), a + end, i, k)
            if m and 1 not in taken[m[0] - a : m[1] - a]:
                taken[m[0] - a : m[1] - a] = b"\x01" * (m[1] - m[0])
                own.append(m)
        own.sort()
        found += own
        if own:
            todo += list(zip([a, *[m[1] for m in own]], [*[m[0] for m in own], b]))
    return found


def words(text: str) -> str:
    """The text's words joined by single spaces, one character a byte."""
    return b" ".join(text.encode().translate(_LOWER).split()).decode("latin-1")


def search(joined: str) -> list[tuple[str, int, int, int, bool, float]]:
    """label, first and last word, edits, whether it is a base place, and similarity of all that is found."""
    text = f" {joined} "
    stretches: dict[int, list[list[int]]] = {}
    found = []
    last = (0, -1)

    def word(at: int) -> int:
        """Number of the word that the character at stands in; asked for in rising order it costs one pass."""
        nonlocal last
        if at < last[0]:
            last = (0, -1)
        last = (at, last[1] + text.count(" ", last[0], at))
        return last[1]

    base = []
    for end, (part, owners) in automaton().iter(text):
        begin = end - len(part) + 1
        for i, offset in owners:
            if i < 0:
                base.append((begin + 1, end, part.strip()))
            else:
                slack = edits(NOTICES[i][1])
                a, b = max(0, begin - offset - slack), min(len(text), begin - offset + len(NOTICES[i][1]) + slack)
                own = stretches.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(b, own[-1][1])
                else:
                    own.append([a, b])
    for a, b, phrase in base:
        found.append((PHRASES[phrase], word(a + 1), word(b - 1), 0, True, 1.0))
    matches = []
    for i, own in stretches.items():
        for a, b in own:
            matches += [(start, end, i, k) for start, end, k in verified(text, a, b, i)]
    for a, b, i, k in sorted(matches):
        label, notice = NOTICES[i]
        shown = text[a:b]
        a, b = a + len(shown) - len(shown.lstrip()), b - len(shown) + len(shown.rstrip())
        first = word(a + 1)
        found.append((label, first, first + text.count(" ", a + 1, b), k, False, 1 - k / len(notice)))
    return found


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with n_words and found: array<struct<label, first, last, edits, base, similarity>>, places in words."""

    def step(texts: pa.Array) -> list[pa.Array]:
        joined = [words(t or "") for t in texts.to_pylist()]
        keys = ("label", "first", "last", "edits", "base", "similarity")
        return [pa.array([t.count(" ") + 1 if t else 0 for t in joined], pa.int64()), pa.array([[dict(zip(keys, x)) for x in search(t)] for t in joined], _FOUND)]

    return add_columns(df, text_col, [("n_words", T.LongType(), pa.int64()), ("found", FOUND, _FOUND)], step, keep)


def summary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, n_words, base places and labels, all labels, the best similarity as score, and the fuzzy spans."""
    made = scan(df, text_col, keep=[id_col]).withColumn("base", F.filter("found", lambda x: x["base"])).withColumn("near", F.filter("found", lambda x: ~x["base"]))
    labels = lambda col: F.array_join(F.array_sort(F.array_distinct(F.transform(col, lambda x: x["label"]))), ",")
    return made.select(
        id_col,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["first"])).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["similarity"])), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("near", lambda x: F.concat_ws(":", x["label"], x["first"], x["last"], x["edits"])), ",").alias("spans"),
    )
