"""Secret scans: fixed patterns, and assignment-aware lexing.

The lexer looks for names that something is assigned to (bare, dotted, indexed or quoted keys before
=, :=, => or :, and elements <name>text</name>) and from there reads a value: quoted strings
with escapes, triple quotes and backticks; bare values; names; terms joined by + or . or by
standing side by side; lists in brackets; chained targets; list items and block text under a key,
by their indentation. Comments are skipped, and in brackets or after a joining mark so are line ends.

Constants are propagated: a name stands for what was assigned to it last or, failing that, for what is
assigned to it further down, so ``k = "..."; token = k`` scores the literal under ``token``. A
value is a node over the nodes it was made of, never a copy, and what scoring needs of it (length,
classes and counts of characters) is summed once a node, so that a text takes time and memory in
proportion to its length however its names refer to each other. Assignments in a circle stand for
nothing.

A value's score is how sensitive the words of its target's name are, times how much it looks like a
secret: its length, its entropy, and not being a placeholder. Each literal of a value that reaches
the threshold is a span of kind ``lexed``, beside those of the fixed patterns, which always stay.

Defined results: a null text counts as empty and has no spans; a null doc_id and repeated rows
are rows of their own; an empty table gives an empty result; columns other than doc_id and text
are ignored (and, in ``redact``, kept as they are).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm.common import bounded_batches, documents

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: None of these in a lower-cased text: ASSIGN can't match.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter run fails whole, as does any of its tails
HEX = re.compile(r"[0-9a-f]{16,}")  # likewise
ASSIGN_LEAST = 12

OPERATOR = r"(?::=|=>|=(?![=~])|:(?![:/]))"
TARGET = re.compile(rf"""(?<![\w.\-])([A-Za-z_][\w.\-]*+)["'`\])]*+[\x20\t]*+{OPERATOR}|<([A-Za-z_][\w.:\-]*+)(?:[\x20\t][^<>\n]*+)?>([^<>]*+)</\2[\x20\t]*>""")
CHAINED = re.compile(rf"[\x20\t]*+{OPERATOR}")
LINE_STRING = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*+){q}") for q in "\"'"}
PREFIX = re.compile(r"[rRbBfFuU]{1,2}(?=[\"'])")
BARE = re.compile(r"""\$\{[A-Za-z_]\w*\}|[^\s"'`,;(){}\[\]<>+|=:]+(?:[:=/][^\s"'`,;(){}\[\]<>+|]+)*+={0,2}""")
SCHEME = re.compile(r"(?:[Bb]earer|[Bb]asic|Token)\Z")
REFERENCE = re.compile(r"\$?\{?([A-Za-z_][\w.\-]*)\}?\Z")
SPACES = re.compile(r"(?:[\x20\t]|\\\r?\n)*+")
LINES = re.compile(r"(?:\s|\\\r?\n)*+")
COMMENT = re.compile(r"(?:#|//)[^\n]*+")
ITEM = re.compile(r"""\n([\x20\t]*+)-[\x20\t]++(?:"((?:[^"\\\n]|\\.)*+)"|'([^'\n]*+)'|([^\s"'{\[&*!|>][^\n]*+))[\x20\t]*+(?:#[^\n]*+)?(?=\r?\n|\Z)""")
BLOCK = re.compile(r"[\x20\t]*+[|>][+\-\d]{0,2}[\x20\t]*+(?=\n)")
BLOCK_LINE = re.compile(r"\n([\x20\t]*+)([^\n]*+)")
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How sensitive a word of a name is (fixed values).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, 
    "token": 0.9, "apikey": 1.0, "credential": 0.9,  "auth": 0.6, "authorization": 0.7, "bearer": 0.8,
    "private": 0.5, "key": 0.5, "api": 0.4, "access": 0.4, "signing": 0.5, "encryption": 0.5, "salt": 0.5, "cert": 0.4, "session": 0.3, "cookie": 0.4,
}
#: Values that stand in for a secret (fixed values).
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "redacted", "dummy", "none", "null", "true", "false", "todo")
#: What every sensitive name has some of, without what joins its words.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "private", "api", "access", "signing", "encryption", "salt", "cert", "session", "cookie")
JOINTS = str.maketrans("", "", "_.-")
CHAINED_KEY = re.compile(r"\A[A-Za-z_][\w.\-]*+[\x20\t]*+:(?:[\x20\t]|\Z)")
LITERAL_LEAST = 8
THRESHOLD = 0.5
MASK = "[SECRET]"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int
    score: float


def sensitivity(name: str) -> float:
    """0 to 1: the words of a name, by case, underscores, dots and dashes."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    joined = "".join(words)
    return min(1.0, sum(SENSITIVE.get(w, SENSITIVE.get(w.removesuffix("s"), 0.0)) for w in dict.fromkeys(words)) or (1.0 if joined in SENSITIVE else 0.0))


class Traits(NamedTuple):
    """What a value's score depends on."""

    counts: np.ndarray  # characters by code point, those from 255 on in one class
    lower: bool
    upper: bool
    digit: bool
    other: bool
    space: bool
    stand_in: bool
    first: str
    quoted: bool


class Node:
    """A literal (text[start:end]), or a value made of other nodes."""

    __slots__ = ("start", "end", "quoted", "parts", "traits")

    def __init__(self, start: int, end: int, quoted: bool, parts: tuple[Node, ...] = ()):
        self.start, self.end, self.quoted, self.parts, self.traits = start, end, quoted, parts, None


NOTHING = Traits(np.zeros(256), False, False, False, False, False, False, "", False)
#: Characters beyond which a value's counts are scaled down; its score is 1 by far by then.
VAST = 1e12


def of_literal(value: str, quoted: bool) -> Traits:
    low = value.lower()
    codes = np.minimum(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4"), 255)
    return Traits(
        np.bincount(codes, minlength=256).astype(np.float64), any(map(str.islower, value)), any(map(str.isupper, value)), any(map(str.isdigit, value)),
        not value.isalnum(), any(map(str.isspace, value)), any(p in low for p in PLACEHOLDERS), value[:1], quoted,
    )


def joined(a: Traits, b: Traits) -> Traits:
    counts = a.counts + b.counts
    if counts.sum() > VAST:
        counts /= 2
    return Traits(counts, *(x or y for x, y in zip(a[1:], b[1:], strict=True)))


def traits(node: Node, text: str) -> Traits:
    """Summed once for each node, in whatever depth."""
    stack = [node]
    while stack:
        top = stack[-1]
        if top.traits is None:
            if missing := [p for p in top.parts if p.traits is None]:
                stack += missing
                continue
            if top.parts:
                total = top.parts[0].traits
                for p in top.parts[1:]:
                    total = joined(total, p.traits)
                top.traits = total
            else:
                top.traits = of_literal(text[top.start : top.end], top.quoted) if top.end > top.start else NOTHING
        stack.pop()
    return node.traits


def strength(t: Traits) -> float:
    """0 to 1: how much a value looks like a secret."""
    n = t.counts.sum()
    if n < LITERAL_LEAST or t.space or t.stand_in or t.first in "$%{<":
        return 0.0
    kinds = t.lower + t.upper + t.digit + t.other
    if not t.digit and (kinds < 3 or not t.quoted):
        return 0.0
    some = t.counts[t.counts > 0]
    return min(1.0, float((some * np.log2(n / some)).sum()) / 30.0) * (1.0 if kinds > 1 else 0.8)


class Statement(NamedTuple):
    targets: list[str]
    #: For each element of the value (a list has several) its terms: literals, or names in the text.
    elements: list[list[Node]]


class Lexer:
    """Reads a text's assignments, from front to back."""

    def __init__(self, text: str):
        self.text = text
        self.absent: set[str] = set()

    def find(self, mark: str, at: int) -> int:
        """The next place of a closing mark; once there is none, it isn't looked for again."""
        found = -1 if mark in self.absent else self.text.find(mark, at)
        if found < 0:
            self.absent.add(mark)
        return found

    def gap(self, at: int, lines: bool) -> int:
        """Past spaces and comments, and past line ends if a value may go on behind them."""
        text = self.text
        while True:
            at = (LINES if lines else SPACES).match(text, at).end()
            if text.startswith("/*", at) and (end := self.find("*/", at + 2)) >= 0:
                at = end + 2
            elif lines and (m := COMMENT.match(text, at)):
                at = m.end()
            else:
                return at

    def string(self, at: int) -> tuple[Node, int] | None:
        """A quoted literal and where it ends."""
        text = self.text
        if m := PREFIX.match(text, at):
            at = m.end()
        mark = text[at : at + 1]
        if mark in ("\"", "'"):
            if text.startswith(mark * 3, at) and (end := self.find(mark * 3, at + 3)) >= 0:
                return Node(at + 3, end, True), end + 3
            if m := LINE_STRING[mark].match(text, at):
                return Node(m.start(1), m.end(1), True), m.end()
        elif mark == "`" and (end := self.find("`", at + 1)) >= 0:
            return Node(at + 1, end, True), end + 1
        return None

    def value(self, at: int, targets: list[str]) -> tuple[list[list[Node]], int]:
        """The elements of the value at this place, and where it ends."""
        text, elements, depth, more = self.text, [[]], 0, True  # more: a term has to follow
        while True:
            to = self.gap(at, depth > 0 or (more and elements != [[]]))
            c = text[to : to + 1]
            if c and c in "[(" and more:
                depth, at = depth + 1, to + 1
            elif c and c in "])" and depth:
                depth, at, more = depth - 1, to + 1, False
            elif c == "," and depth:
                at, more = to + 1, True
                elements.append([])
            elif (found := self.string(to)) is not None:
                # Strings side by side are one; a bare value before one ends the statement.
                if not more and not (elements[-1] and elements[-1][-1].quoted):
                    return elements, at
                node, at = found
                elements[-1].append(node)
                more = False
            elif not more and (c == "+" or (c == "." and text[to + 1 : to + 2] in ("\"", "'", " ", "$"))):
                at, more = to + 1, True
            elif more and (m := BARE.match(text, to)):
                if text.startswith("(", m.end()):
                    return elements, m.end()  # a call
                chain = CHAINED.match(text, m.end())
                if chain and not depth and elements == [[]] and REFERENCE.match(m[0]):
                    targets.append(m[0])
                    at = chain.end()
                    continue
                if chain and depth:
                    return elements, to  # a key of its own
                at, more = m.end(), False
                if SCHEME.match(m[0]) and (own := BARE.match(text, self.gap(at, False))) and own[0][0].isalnum():
                    m, at = own, own.end()
                elements[-1].append(Node(m.start(), m.end(), False))
            else:
                return elements, at

    def under(self, key: int, at: int) -> tuple[list[list[Node]], int]:
        """List items or block text below a key, by indentation."""
        text, elements = self.text, []
        # Keys come from front to back, so that no character is looked at twice for a line's beginning.
        line = text.rfind("\n", self.read, key) + 1
        if line or self.indent is None:
            self.indent = SPACES.match(text, line).end() - line
        self.read, indent = key, self.indent
        if m := BLOCK.match(text, at):
            at, own = m.end(), []
            while (m := BLOCK_LINE.match(text, at)) and (m.end(1) - m.start(1) > indent or not m[2].strip()):
                at = m.end()
                body = m[2].rstrip()
                if body:
                    own.append(Node(m.start(2), m.start(2) + len(body), True))
            return [own], at
        end = SPACES.match(text, at).end()
        if m := COMMENT.match(text, end):
            end = m.end()
        depth = None
        while m := ITEM.match(text, end + text.startswith("\r", end)):
            size = len(m[1])
            if size < indent or depth not in (None, size) or (m[4] and CHAINED_KEY.search(m[4])):
                break
            k = m.lastindex
            body = m[k].rstrip() if k == 4 else m[k]
            body = body.split(" #")[0].rstrip() if k == 4 else body
            elements.append([Node(m.start(k), m.start(k) + len(body), k != 4)])
            depth, end = size, m.end()
        return elements, end if elements else at

    def statements(self) -> Iterator[Statement]:
        at, self.read, self.indent = 0, 0, None
        while m := TARGET.search(self.text, at):
            if m[2]:
                yield Statement([m[2]], [[Node(m.start(3), m.end(3), True)]])
                at = m.end()
                continue
            targets = [m[1]]
            elements, at = self.value(m.end(), targets)
            if elements == [[]] and len(targets) == 1 and self.text[m.end() - 1] == ":":
                elements, at = self.under(m.start(), m.end())
            elements = [e for e in elements if e]
            if elements:
                yield Statement(targets, elements)


def bound(text: str) -> list[tuple[str, Node]]:
    """Targets with a node for each element of their value, constants propagated."""
    made: list[tuple[Statement, list[list[Node | str]]]] = []
    known: dict[str, Node] = {}

    def node_of(elements: list[list[Node]]) -> Node:
        every = [n for e in elements for n in e]
        return every[0] if len(every) == 1 else Node(0, 0, False, tuple(every))

    def resolved(elements: list[list[Node]], names: dict[str, Node]) -> list[list[Node]]:
        out = []
        for e in elements:
            own = []
            for n in e:
                m = None if n.quoted or n.parts else REFERENCE.match(text[n.start : n.end])
                own.append(names.get(m[1], n) if m else n)
            out.append(own)
        return out

    for s in Lexer(text).statements():
        elements = resolved(s.elements, known)
        known |= dict.fromkeys(s.targets, node_of(elements))
        made.append((s, elements))
    # Constants that are assigned further down, from the last statement up.
    later: dict[str, Node] = {}
    out = []
    for s, elements in reversed(made):
        elements = resolved(elements, later)
        later |= dict.fromkeys(s.targets, node_of(elements))
        out += [(t, e[0] if len(e) == 1 else Node(0, 0, False, tuple(e))) for t in s.targets for e in elements]
    return out


def lexed(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Spans of the literals of values that reach the threshold under the name they are assigned to."""
    low = text.lower().translate(JOINTS)
    if not any(w in low for w in HINTS):
        return []
    scored = []
    for name, node in bound(text):
        weight = sensitivity(name)
        if weight >= threshold and (score := weight * strength(traits(node, text))) >= threshold:
            scored.append((score, node))
    best: dict[tuple[int, int], float] = {}
    seen: set[int] = set()
    for score, node in sorted(scored, key=lambda x: -x[0]):  # each node once, with its best score
        stack = [node]
        while stack:
            top = stack.pop()
            if id(top) in seen:
                continue
            seen.add(id(top))
            stack += top.parts
            if not top.parts and top.end > top.start:
                best.setdefault((top.start, top.end), score)
    return [Span("lexed", a, b, a, round(s, 6)) for (a, b), s in best.items()]


def scan(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text in code points, by start and then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [Span("assign", m.start(), m.end(), m.start(2), 1.0) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [Span("access", m.start(), m.end(), m.start(), 1.0) for m in ACCESS.finditer(text)]
    out += [Span("hex", m.start(), m.end(), m.start(), 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        out += lexed(text, threshold)
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def masked(text: str, threshold: float = THRESHOLD) -> str:
    """The text with every secret's value replaced; names and other text stay."""
    out, at = [], 0
    for a, b in sorted((s.value_start, s.end) for s in scan(text, threshold)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value_start", T.LongType()), T.StructField("score", T.DoubleType())]))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans (kind, start, end, value_start, score) of every whole text."""
    bounded_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("score", pa.float64())])

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[s._asdict() for s in scan(t or "", threshold)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run_task, schema)


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns, with the values of secrets in ``text`` replaced."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def mask(texts):
        return texts.map(lambda t: masked(t, threshold), na_action="ignore")

    return docs.withColumn("text", mask("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 over the fixed patterns' spans, and all spans."""

    def joined(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = find(docs).select("doc_id", F.col("spans").alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "lexed")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"), count("lexed"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
