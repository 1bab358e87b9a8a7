"""Byte-level BPE encoding and decoding by an index of pair occurrences.

A task gathers the distinct pieces of its texts that it has not met yet, lays their bytes out as
one row of symbols, and maps each adjacent pair that the vocabulary can merge to all its
positions. Ranks are then applied in ascending order, each to all its positions at once; the
pairs that a merge makes to its left and right are put on their own ranks' lists. A symbol that
a merge makes can take part only in merges of higher rank, so that each rank comes up once, and
the result is that of merging each piece by itself.

Pieces repeat, so a worker remembers the ids of the stretches of text it has met (white space
and what follows it up to the next white space, which no piece spans), in two generations of bounded size.

Defined results: a null text counts as empty, with no tokens; strings of the vocabulary's added
tokens in a text become those tokens, as in the library; a null doc_id and repeated rows are
rows of their own; an empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import bounded_batches, documents, larger

#: White space, as the vocabulary's pattern has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRETCH = re.compile(f"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++")
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Stretches, or pieces, and characters of them in each of the two generations that a worker remembers.
KNOWN_STRETCHES, KNOWN_CHARS = 200_000, 4_000_000
#: Rows, and bytes of texts, that are encoded together.
ROWS, BYTES = 2048, 1 << 23


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: bytes that print as they
    are stand for themselves, the others take the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Alphabet:
    """Cuts stretches into pieces, with letters and numbers as the vocabulary's library has them.

    The regex module may know a later Unicode. Characters that the two class differently are
    replaced, while the pieces are found, by one that both class like the library does.
    """

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.kinds = [("a", pre_tokenizers.Split(Regex(r"\p{L}"), "removed", invert=True)), ("1", pre_tokenizers.Split(Regex(r"\p{N}"), "removed", invert=True))]
        self.stand_in: dict[str, str] = {}

    def of(self, c: str) -> str:
        if c not in self.stand_in:
            kind = next((k for k, split in self.kinds if split.pre_tokenize_str(c)), "!")
            own = "a" if regex.match(r"\p{L}", c) else "1" if regex.match(r"\p{N}", c) else "!"
            self.stand_in[c] = c if kind == own else kind
        return self.stand_in[c]

    def pieces(self, stretch: str) -> list[str]:
        if stretch.isascii() or max(stretch) < "\u0530":  # older than any difference
            return PIECE.findall(stretch)
        shadow = "".join([c if c < "\u0530" else self.of(c) for c in stretch])
        if shadow == stretch:
            return PIECE.findall(stretch)
        return [stretch[m.start() : m.end()] for m in PIECE.finditer(shadow)]


class Merges:
    """A vocabulary's merges, ready for lookups by arrays of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], spec.get("added_tokens", [])
        symbol = byte_symbols()
        self.bytes_of = {i: bytes(symbol[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in added}
        self.added = {t["content"]: t["id"] for t in added}
        self.first = np.zeros(256, np.int64)
        for c, b in symbol.items():
            self.first[b] = vocab[c]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.base = max(self.bytes_of) + 2
        key = left * self.base + right
        self.same = left == right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.key_of = key[order], order.astype(np.int64), key

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it has none."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)


class PairIndex:
    """Symbols of many pieces in a row, and for each rank the positions of its pair."""

    def __init__(self, merges: Merges, pieces: list[bytes]):
        self.merges = merges
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        self.ends = np.cumsum(size)
        self.symbol = np.append(merges.first[raw], -1)
        self.after = np.arange(1, n + 2)
        self.after[np.append(self.ends - 1, n)] = n  # n: there is no neighbour
        self.before = np.arange(-1, n)
        self.before[np.concatenate([[0], self.ends[:-1]])] = n
        self.before[n] = n
        self.none = n
        self.lists: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        at = np.flatnonzero(self.after[:n] != n)
        self.put(at)

    def put(self, at: np.ndarray) -> None:
        """Enter the pairs that start at these positions under their ranks."""
        if not len(at):
            return
        rank = self.merges.rank(self.symbol[at], self.symbol[self.after[at]])
        known = rank >= 0
        at, rank = at[known], rank[known]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, some in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            if r in self.lists:
                self.lists[r].append(some)
            else:
                self.lists[r] = [some]
                heapq.heappush(self.heap, r)

    def apply(self) -> None:
        """All merges, in ascending order of their ranks."""
        merges, symbol, after, before, none = self.merges, self.symbol, self.after, self.before, self.none
        while self.heap:
            r = heapq.heappop(self.heap)
            lists = self.lists.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            to = after[at]
            # A position stays on the list of a pair that an earlier merge has broken up.
            live = symbol[at] * merges.base + symbol[to] == merges.key_of[r]
            at, to = at[live], to[live]
            if not len(at):
                continue
            if merges.same[r] and len(at) > 1:
                at = self.every_other(at, to)
                to = after[at]
            beyond = after[to]
            symbol[at] = merges.result[r]
            symbol[to] = -1
            after[at] = beyond
            before[beyond] = at
            before[none] = none
            left = before[at]
            self.put(np.unique(np.concatenate([left[left != none], at[beyond != none]])))

    @staticmethod
    def every_other(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Of pairs that share a symbol (as in aaa), the first, third and so on of each chain."""
        new = np.ones(len(at), bool)
        new[1:] = to[:-1] != at[1:]
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - start) % 2 == 0]

    def ids(self) -> list[list[int]]:
        """The ids of each piece."""
        kept = np.flatnonzero(self.symbol[: self.none] >= 0)
        cuts = [0, *np.searchsorted(kept, self.ends).tolist()]
        ids = self.symbol[kept].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Known(dict):
    """What a worker remembers by string. When there is too much, a new generation begins; what is
    asked for again moves there, and the rest goes with the next."""

    def __init__(self):
        self.old, self.chars = {}, 0

    def unknown(self, strings: set[str]) -> set[str]:
        """Those that are in neither generation; the others are in this one from now on."""
        if len(self) > KNOWN_STRETCHES or self.chars > KNOWN_CHARS:
            self.old = dict(self)
            self.clear()
            self.chars = 0
        new = strings - self.keys()
        self.chars += sum(map(len, new))
        back = new & self.old.keys()
        self.update({s: self.old[s] for s in back})
        return new - back


class Codec:
    """Encodes and decodes, with what a worker remembers."""

    def __init__(self, path: str):
        self.merges, self.alphabet = Merges(path), Alphabet()
        added = sorted(self.merges.added, key=len, reverse=True)
        self.split_added = regex.compile("|".join(map(regex.escape, added))) if added else None
        #: By stretch: its ids as numbers joined by commas, how many, and the bytes they stand for.
        self.known, self.pieces = Known(), Known()

    def entry(self, ids: list[int]) -> tuple[str, int, bytes]:
        return ",".join(map(str, ids)), len(ids), b"".join([self.merges.bytes_of[i] for i in ids])

    def stretches(self, text: str) -> list[str]:
        if self.split_added is None or not self.split_added.search(text):
            return STRETCH.findall(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [*STRETCH.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + STRETCH.findall(text[at:])

    def learn(self, new: set[str]) -> None:
        """Encode stretches that are not known yet, all their pieces by one index."""
        of = {s: self.alphabet.pieces(s) for s in new if s not in self.merges.added}
        entries = self.pieces
        pieces = sorted(entries.unknown({p for own in of.values() for p in own}))
        if pieces:
            index = PairIndex(self.merges, [p.encode() for p in pieces])
            index.apply()
            for p, ids in zip(pieces, index.ids(), strict=True):
                entries[p] = self.entry(ids)
        for s, own in of.items():
            if len(own) == 1:
                self.known[s] = entries[own[0]]
            else:
                ids, n, back = zip(*[entries[p] for p in own], strict=True)
                self.known[s] = ",".join(ids), sum(n), b"".join(back)
        for s in new & self.merges.added.keys():
            self.known[s] = self.entry([self.merges.added[s]])

    def encode(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """By text, the entries of its stretches.

        Nothing here has cycles, so the collector needn't look through what is remembered.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            split = [self.stretches(t) for t in texts]
            known = self.known
            if new := known.unknown(set().union(*split)):
                self.learn(new)
            return [list(map(known.__getitem__, own)) for own in split]
        finally:
            if collects:
                gc.freeze()
                gc.enable()

    def encode_ids(self, text: str) -> list[int]:
        return [int(i) for x in self.encode([text])[0] for i in x[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.merges.bytes_of[i] for i in ids]).decode("utf-8", errors="replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process, kept between tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    bounded_batches(docs.sparkSession)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [[int(i) for x in entries for i in x[0].split(",")] for entries in own.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run_task, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""
    bounded_batches(encoded.sparkSession)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run_task, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    bounded_batches(docs.sparkSession)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in larger(batches, ROWS, BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, ids, decoded = [], [], []
            for entries in own.encode(texts):
                numbers, n, back = zip(*entries, strict=True) if entries else ((), (), ())
                counts.append(sum(n))
                ids.append(hashlib.sha256(",".join(numbers).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(back).decode("utf-8", errors="replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run_task, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
