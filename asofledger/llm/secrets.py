"""Secret scans by assignment-aware lexing.

Method. Whole texts are lexed into assignments as source and configuration files write them (name = "..", name: '..', name := .., "name" => .., export NAME=.., name: Type = ..,
<name>..</name>, <x key="name" value=".."/>, --name=.., and map["name"] = ..). The right side may be in brackets or a constructor of text, on the next line, in three quotes, continued by a backslash, a YAML block of indented lines,
or an object or mapping that holds it as its value ({"name": {"value": ..}}). Constants are propagated: a name that stands on the right of a later assignment, also inside a concatenation with + or . or an
interpolation ${NAME}, refers to its latest assignment and brings all literals that reach that one. A literal is scored by the sensitivity of the target name's parts (api_key, privateKey, DB-PASSWORD) and by the
length, alphabet and entropy of what the assignment joins; placeholders score nothing. Where the score is LEAST ** 2 or more, all literals that reach the assignment give a span of kind named, unless a base span
covers them. References are kept as references, and what a chain of them joins is summed up as counts of characters, so time and memory follow the text's length however constants are joined.
The base patterns (assign, access, hex) run over the same text, and their spans are always reported.

Cases. Null text counts as empty and has no spans. Spans are in code points, end exclusive. Names and literals of any length count. Repeated rows are scanned each; very long texts are one row; empty tables give
empty ones; columns named like an output are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{16}")

#: A pair: a name, an operator, and the right side's terms up to the end of the statement.
PAIR = re.compile(r"""(?<![\w.-])["']?([A-Za-z_][\w.-]*+)["']?[\x20\t]*\]?[\x20\t]*(?::[\x20\t]*+[A-Za-z_][\w\[\],.|\x20\t]*+(?==[^=]))?(?::=|=>|=(?!=)|:(?![:/]))[\x20\t]*(?=["'`A-Za-z0-9$+/_\-(\[{|>\\\r\n])""", re.A)
# Members that hold the value of the name above them, and constructors that only wrap a text.
VALUE = "(?:value|val|default|data|content|literal|string|text)"
WRAP = r"(?:new[\x20\t]++[A-Za-z_][\w.]*+|(?:str|String|string|bytes|SecretStr|SecureString|Buffer\.from|base64\.b64decode|b64decode))\("
NEXT = r"\\?\r?\n[\x20\t]*+"
#: What may stand between the operator and the first term: a member of an object or mapping, the end of the line, brackets.
MEMBER = rf"""\{{\s*+(?:["']?(?!{VALUE}\b)\w++["']?[\x20\t]*+[:=]>?[\x20\t]*+(?:"[^"\n]*+"|'[^'\n]*+'|[\w.]++)\s*+,\s*+)*+["']?{VALUE}["']?[\x20\t]*+[:=]>?[\x20\t]*+|\r?\n[\x20\t]++{VALUE}[\x20\t]*+:[\x20\t]++"""
LEAD = re.compile(rf"""({MEMBER})?(?:{NEXT}(?=["'`(\[]))?(?:(?:{WRAP}|[(\[])[\x20\t]*+){{0,3}}+(?:{NEXT}(?=["'`]))?""", re.A)
#: A YAML block: its indicator, and lines that are indented.
FOLDED = re.compile(r"[|>][-+0-9]*+[\x20\t]*+\r?\n((?:[\x20\t]++[^\n]*+(?:\n|\Z))++)", re.A)
ELEMENT = re.compile(r"<[A-Za-z][^<>]*+>", re.A)
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w:.-]*+)[\x20\t]*+=[\x20\t]*+(?:"([^"]*+)"|'([^']*+)')""", re.A)
TAG = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\s]{8,}+)</\1>", re.A)
_PREFIX = """(?:[bBrRuUfF]{1,2}(?=["']))?"""
TERM = re.compile(_PREFIX + r"""(?:\"{3}((?:[^"\\]|\\(?s:.)|"(?!""))*+)"{3}|'{3}((?:[^'\\]|\\(?s:.)|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\\r?\n|\\.)*+)"|'((?:[^'\\\n]|\\\r?\n|\\.)*+)'|`([^`\n]*+)`)|([A-Za-z0-9+/_.=$-]+)""", re.A)
BARE = 6
#: What joins two terms: + or . (the next one on the same line, or a line on), a backslash at the end of the line, or nothing but a line end between quoted terms.
JOIN = re.compile(rf"""[\x20\t]*+(?:[+.][\x20\t]*+(?:{NEXT})?(?=["'`A-Za-z_])|\\\r?\n[\x20\t]*+(?:[+.][\x20\t]*+)?(?=["'`])|{NEXT}(?:[+.][\x20\t]*+)?(?=["'`](?![\w.-]++["'][\x20\t]*+[:=])))""", re.A)
INNER = re.compile(r"\$\{?([A-Za-z_]\w*)\}?", re.A)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.A)

# How much a name's part, or two parts in a row, says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.5, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "dsn": 0.5}
SENSITIVE_PAIRS = {"api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0, "auth key": 0.9, "encryption key": 0.9, "signing key": 0.9, "client key": 0.7, "account key": 0.9, "connection string": 0.7}
#: Words of up to five letters stand in long random keys by chance, so they count only where no letter or digit adjoins them.
PLACEHOLDER = re.compile(r"change_?me|example|placeholder|<[^<>\n]*>|^\$|\.\.\.|(?<![A-Z0-9])(?:your[_-]|(?:dummy|x{4,}|todo|none|null|true|false)(?![A-Z0-9]))", re.I | re.A)
LEAST, LITERAL_LEAST = 0.6, 8
#: Counts of joined literals are doubles; beyond 2 ** HALVED they go on as multiples of it, which changes no share.
HALVED = 512
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def name_score(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name)]
    return max([0.0, *(SENSITIVE.get(p, 0.0) for p in parts), *(SENSITIVE_PAIRS.get(f"{a} {b}", 0.0) for a, b in zip(parts, parts[1:]))])


@dataclass
class Assignment:
    """A name with the places of the literals that it joins itself, and the numbers of the earlier assignments that it joins."""

    name: str
    places: list[tuple[int, int]] = field(default_factory=list)
    refs: list[int] = field(default_factory=list)


def assignments(text: str) -> list[Assignment]:
    """All assignments in the order of the text, tags last."""
    known: dict[str, int] = {}
    found: list[Assignment] = []
    at = 0
    while m := PAIR.search(text, at):
        made, at = Assignment(m[1]), m.end()
        lead = LEAD.match(text, at)
        if folded := FOLDED.match(text, at):
            made.places, at = block_lines(text, *folded.span(1)), folded.end()
        else:
            at = lead.end()
        while not folded and (t := TERM.match(text, at)):
            at = t.end()
            group = next((g for g in range(1, BARE) if t.start(g) >= 0), BARE)
            word = t[group]
            if group == BARE and text.startswith("(", at):  # a call, whose result no text shows
                break
            inner = [known[word]] if group == BARE and word in known else [known[x] for x in INNER.findall(word) if x in known]
            made.refs += inner
            if not inner:
                made.places.append(t.span(group))
            j = JOIN.match(text, at)
            if not j:
                break
            at = j.end()
        at = m.end() if lead[1] else max(at, m.end())  # an object's members are assignments of their own
        made.refs = list(dict.fromkeys(made.refs))
        known[made.name] = len(found)
        found.append(made)
    found += [Assignment(m[1], [m.span(2)]) for m in TAG.finditer(text)]
    for element in ELEMENT.finditer(text) if "value" in text else ():
        given = {m[1].lower(): m for m in ATTRIBUTE.finditer(text, *element.span())}
        if value := given.get("value"):
            group = 2 if value.start(2) >= 0 else 3
            found += [Assignment(given[n][2] or given[n][3] or "", [value.span(group)]) for n in ("key", "name", "id") if n in given]
    return found


def block_lines(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Places of what is on the lines of text[a:b] that are indented as far as the first one."""
    out, at, indent = [], a, None
    for line in text[a:b].splitlines(keepends=True):
        bare = line.strip()
        own = len(line) - len(line.lstrip())
        indent = own if indent is None else indent
        if bare and own < indent:
            break
        if bare:
            out.append((at + own, at + own + len(bare)))
        at += len(line)
    return out


@dataclass
class Joined:
    """What literals look like when they are joined: how often each character occurs (times 2 ** scale), and whether a placeholder or a space rules them out."""

    counts: dict[str, float]
    ruled_out: bool
    scale: int = 0

    @staticmethod
    def of(value: str) -> Joined:
        value = value.replace("\\\r\n", "").replace("\\\n", "")
        return Joined({c: float(n) for c, n in Counter(value).items()}, " " in value or bool(PLACEHOLDER.search(value)))

    def add(self, other: Joined) -> None:
        self.ruled_out |= other.ruled_out
        ours, theirs = (math.ldexp(1.0, min(0, d)) if d > -1074 else 0.0 for d in (self.scale - other.scale, other.scale - self.scale))
        self.scale = max(self.scale, other.scale)
        self.counts = {c: self.counts.get(c, 0.0) * ours + other.counts.get(c, 0.0) * theirs for c in self.counts.keys() | other.counts.keys()}
        if sum(self.counts.values()) > math.ldexp(1.0, HALVED):
            self.counts, self.scale = {c: math.ldexp(n, -HALVED) for c, n in self.counts.items()}, self.scale + HALVED

    def score(self) -> float:
        """0 to 1: how far this looks like key material."""
        total = math.fsum(self.counts.values())
        if not self.scale and total < LITERAL_LEAST or self.ruled_out:
            return 0.0
        entropy = -math.fsum(n / total * math.log2(n / total) for n in self.counts.values() if n)
        kinds = sum(any(f(c) for c in self.counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        return min(1.0, entropy / 4) * (0.55 + 0.15 * kinds if kinds > 1 else 0.4)


def named_places(text: str) -> set[tuple[int, int]]:
    """Places of the literals that reach a name whose sensitivity and value score enough."""
    found = assignments(text)
    weights = [name_score(a.name) for a in found]
    needed, hit = [w > 0 for w in weights], [False] * len(found)
    for i in range(len(found) - 1, -1, -1):  # references point backwards
        for r in found[i].refs if needed[i] else ():
            needed[r] = True
    joined: dict[int, Joined] = {}
    for i, made in enumerate(found):
        if needed[i]:
            joined[i] = Joined.of("".join(text[a:b] for a, b in made.places))
            for r in made.refs:
                joined[i].add(joined[r])
            hit[i] = weights[i] * joined[i].score() >= LEAST * LEAST
    for i in range(len(found) - 1, -1, -1):
        for r in found[i].refs if hit[i] else ():
            hit[r] = True
    return {(a, b) for made, on in zip(found, hit) if on for a, b in made.places if b > a}


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if HEX_LONG.search(text):
        base += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    named = named_places(text) if "=" in text or ":" in text or "</" in text else set()
    if named and base:
        base.sort(key=lambda s: s[1])
        starts, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
        named = {(a, b) for a, b in named if not (k := bisect_right(starts, a)) or reach[k - 1] < b}
    return sorted(base + [("named", a, b) for a, b in named], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(df: DataFrame, text_col: str = "text", out_col: str = "found", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with out_col: array<struct<kind, start, end>>."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    step = lambda texts: [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t or "")] for t in texts.to_pylist()], kind)]
    return add_columns(df, text_col, [(out_col, SPANS, kind)], step, keep)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, counts of the base kinds and of named, the base spans' SHA-256, and all spans."""
    made = scan(df, text_col, "found", keep=[id_col])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return made.select(id_col, of("assign"), of("access"), of("hex"), F.sha2(joined(F.filter("found", lambda s: s["kind"] != "named")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), of("named"))
