"""Best-fit packing of documents into sequences, after a Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so an instance of any size is a table of how many
pieces have each length: at most ``capacity`` rows, and the only thing that comes to the driver.

The reduction takes the longest open length i and looks for a set of at most three pieces that
dominates every other set that could share a sequence with i: exchanging pieces can turn any
packing into one that has it, with no more sequences (Martello and Toth, 1990). Such sets are
fixed, as often as the counts allow, until none is found for any length. What remains is packed
by best fit, longest first, on groups of sequences that are alike.

The result is a plan of runs: the pieces of one length numbered from .. to lie, ``slots`` to a
sequence, at the same offset. A document's place follows from its length and its number among
the pieces of that length. Numbers come from counters in the tokenizing tasks and from sums over
tasks, so that no length, however common, is gathered anywhere. The plan has at most some
capacity * log(capacity) rows, whatever the corpus, and is broadcast.

Defined results: a null text counts as empty and has the end token alone; a null doc_id and
repeated rows are packed as rows of their own; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm.bpe import byte_symbols
from meridia.llm.common import bounded_batches, documents, reliable

CAPACITY = 4096
END = 1
#: Words, and characters of them, in each of the two generations that a worker remembers.
KNOWN_WORDS, KNOWN_CHARS = 300_000, 6_000_000
#: White space to Python, but not to the library.
SEPARATORS = "\x1c\x1d\x1e\x1f"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Known(dict):
    """Ids by stretch or piece, made when they are first asked for. When there are too many, a new
    generation begins; what is asked for again moves there, and the rest goes with the next."""

    def __init__(self, made):
        self.made, self.old, self.chars = made, {}, 0

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS or self.chars >= KNOWN_CHARS:
            self.old = dict(self)
            self.clear()
            self.chars = 0
        ids = self.old.get(word)
        if ids is None:
            ids = self.made(word)
        self.chars += len(word)
        self[word] = ids
        return ids


class Words:
    """Token ids by a vocabulary that treats each stretch between white space by itself.

    The normalizer composes (NFC), lower-cases and turns white space into spaces, and no token
    spans white space, so a text's ids are its stretches' ids one after the other, and a
    stretch's those of its pieces. The library's model encodes each distinct piece once. Texts
    for which that does not hold to the letter (special tokens, and characters that the library
    and Python may split or lower-case differently) go to the library whole.
    """

    #: How the vocabulary cuts a stretch (a fixed value).
    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.symbols = {byte: symbol for symbol, byte in byte_symbols().items()}
        self.bytes_of = [struct.pack("<I", i) for i in range(1 + max(self.library.get_vocab().values()))]
        self.known = Known(self.stretch)

    def stretch(self, word: str) -> bytes:
        """The ids of a stretch by those of its pieces; a stretch of ASCII letters is one piece."""
        pieces = [word] if word.isascii() and word.isalpha() else self.PIECE.findall(word)
        return self.piece(word) if len(pieces) == 1 else b"".join([self.known[p] for p in pieces])

    def piece(self, piece: str) -> bytes:
        """The ids of a piece, by the library's model on its bytes' stand-ins (those that print stand for themselves)."""
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.symbols)
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(piece)])

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def odd(self, text: str, low: str, words: list[str]) -> bool:
        """Whether Python's white space, lower case or composition may differ from the library's."""
        if "<|" in text and any(s in text for s in self.special):
            return True
        if any(c in text for c in SEPARATORS):
            return True
        if text.isascii():
            return False
        composed = unicodedata.is_normalized
        # What doesn't print may be a character that only one of the two knows.
        return "\u0130" in text or "\u03a3" in text or not ("".join(words).isprintable() and composed("NFC", text) and composed("NFC", low))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        find, out = self.known.__getitem__, []
        for t in texts:
            words = (low := t.lower()).split()
            out.append(self.whole(t) if self.odd(t, low, words) else b"".join(map(find, words)))
        return out


_vocabularies: dict[str, Words] = {}


def vocabulary(path: str) -> Words:
    """One per worker process, kept between tasks."""
    if path not in _vocabularies:
        _vocabularies[path] = Words(path)
    return _vocabularies[path]


def cut(path: str, capacity: int, end: int):
    """Map function: the pieces of each document, numbered within task and length."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = vocabulary(path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.ids(texts), strict=True):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    rows.append((doc, piece, at // 4, length, zlib.crc32(own), part, nth))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run_task


class Lengths:
    """Counts of open pieces by length, with the next open length below or above."""

    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.open = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.open.pop(bisect.bisect_left(self.open, length))

    def at_most(self, length: int, without: tuple[int, ...] = ()) -> int:
        """The longest open length up to ``length`` once ``without`` is taken away, or 0."""
        i = bisect.bisect_right(self.open, length) - 1
        while i >= 0 and self.count[self.open[i]] <= without.count(self.open[i]):
            i -= 1
        return self.open[i] if i >= 0 else 0

    def shortest(self, n: int, without: tuple[int, ...]) -> list[int]:
        """The n shortest open pieces once ``without`` is taken away; fewer if there are fewer."""
        out: list[int] = []
        for length in self.open:
            out += [length] * min(n - len(out), self.count[length] - without.count(length))
            if len(out) >= n:
                break
        return out


def dominating(open_: Lengths, i: int, room: int) -> tuple[int, ...] | None:
    """What to put beside a piece of length i with ``room`` left, if that is provably best."""
    mate = open_.at_most(room, (i,))
    if not mate or mate == room:
        return (mate,) if mate else ()  # nothing fits, or one fills the room: it replaces any set
    two = open_.shortest(2, (i,))
    if len(two) < 2 or sum(two) > room:
        return (mate,)  # only single pieces fit, and the longest of them replaces any other
    three = open_.shortest(3, (i,))
    if len(three) == 3 and sum(three) <= room:
        return None
    best = best_pair(open_, i, room)
    if best[0] + best[1] <= mate:
        return (mate,)  # no two pieces together are longer than the one
    if mate == best[0] and widest_second(open_, i, room) <= best[1]:
        return best  # holds the longest single piece; of every pair, each finds its place
    return None


def best_pair(open_: Lengths, i: int, room: int) -> tuple[int, int]:
    """The two open pieces (longer first) of the largest sum that fits beside i."""
    best = (0, 0)
    for a in reversed(open_.open):
        if 2 * a <= sum(best) or open_.count[a] <= (i,).count(a):
            if 2 * a <= sum(best):
                break
            continue
        if a <= room and (b := open_.at_most(min(a, room - a), (i, a))) and a + b > sum(best):
            best = (a, b)
    return best


def widest_second(open_: Lengths, i: int, room: int) -> int:
    """The longest that the shorter of two pieces that fit beside i can be."""
    least = 0
    for a in open_.open:
        if 2 * a > room:
            break
        if open_.count[a] <= (i,).count(a):
            continue
        over = open_.at_most(room - a, (i, a))
        if over >= a:
            least = a
    return least


def reduce_and_pack(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """Groups of like sequences (how many, {length: pieces}), and how many the reduction fixed."""
    open_, groups, fixed = Lengths(counts), [], 0
    progress = True
    while progress:
        progress = False
        for i in reversed(list(open_.open)):
            while open_.count.get(i):
                beside = dominating(open_, i, capacity - i)
                if beside is None:
                    break
                use = {x: (i, *beside).count(x) for x in {i, *beside}}
                # The set is best as long as all of its lengths are open: the rest only shrinks.
                n = min(open_.count[x] // k for x, k in use.items())
                for x, k in use.items():
                    open_.take(x, n * k)
                groups.append((n, use))
                fixed += n
                progress = True
    groups += best_fit(open_, capacity)
    return groups, fixed


def best_fit(open_: Lengths, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit, longest first, for all pieces of a length at once."""
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []

    def put(n: int, holds: dict[int, int], room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((n, holds))

    for length in reversed(open_.open):
        left = open_.count[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            if at < len(rooms):
                n, holds = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                n, holds = left, {}
            each = room // length
            full = min(n, left // each)
            if full:
                put(full, holds | {length: each}, room - length * each)
            left -= full * each
            if full < n and left:  # one sequence takes the rest, others stay as they were
                put(1, holds | {length: left}, room - length * left)
                full, left = full + 1, 0
            if full < n and holds:
                put(n - full, holds, room)
    return [group for groups in by_room.values() for group in groups]




def plan(groups: list[tuple[int, dict[int, int]]]) -> dict[int, list[np.ndarray]]:
    """By length: first number, first sequence, pieces to a sequence, offset of each run."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for n, holds in groups:
        offset = 0
        for length in sorted(holds, reverse=True):
            each = holds[length]
            first = given.get(length, 0)
            runs.setdefault(length, []).append((first, sequence, each, offset))
            given[length] = first + n * each
            offset += length * each
        sequence += n
    return {length: [np.array(c, np.int64) for c in zip(*rows, strict=True)] for length, rows in runs.items()}


def place(table):
    """Map function: sequence and offset of each piece, by its length and number."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            nth = batch.column("nth").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros_like(nth), np.zeros_like(nth)
            for n in np.unique(length):
                first, base, each, at = runs[int(n)]
                mine = np.flatnonzero(length == n)
                run = np.searchsorted(first, nth[mine], "right") - 1
                within = nth[mine] - first[run]
                sequence[mine] = base[run] + within // each[run]
                offset[mine] = at[run] + n * (within % each[run])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run_task


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of a document: where it starts there, its ids' checksum, its place.

    Only documents longer than ``capacity`` are cut. ``path`` is the vocabulary's file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = reliable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut(path, capacity, end), PIECES))
    by_task = reliable(pieces.groupBy("part", "length").count())
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    groups, _ = reduce_and_pack(counts, capacity)
    table = spark.sparkContext.broadcast(plan(groups))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("base"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "nth").mapInArrow(place(table), PLACED)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
