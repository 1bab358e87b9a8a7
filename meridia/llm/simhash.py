"""Near-duplicate groups by SimHash fingerprints and anchor-point covering.

Fingerprints within ``threshold`` bits must meet. The 64 bits are cut into ``pieces`` ranges;
by the pigeonhole principle two such fingerprints differ by at most threshold // pieces bits in
one of them. Over the bits of a range a covering code gives the anchors: the words of a Hamming
code on as many bits as fit, with the other bits free, so that each value lies within the
covering radius 1 of exactly one anchor, its home. A fingerprint goes to its home and to every
other anchor that is the home of some value within the range's share of the threshold, that is
to the anchors within covering radius plus threshold of it. At each anchor the fingerprints at
home there are compared with all that came, over all 64 bits.

Equal fingerprints are collapsed first. Anchors with many at home are cut into blocks, each pair
of blocks being one task's work, and every batch of comparisons returns a spanning forest of the
links it found, never the pairs: a group of near copies yields rows in proportion to its size.
A group of K distinct fingerprints at one anchor still costs comparisons in the order of K * K,
spread over the blocks.

Defined results: a null or empty text has no words and the fingerprint zero, linked like any
other; a null doc_id is never the smallest of a group that has another id, and a group of only
such rows has the component null; rows that repeat a doc_id are rows of their own; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import bounded_batches, documents, larger, reliable, sized
from meridia.llm.graph import components, labels

SEED = 42
#: Hashes whose bits are counted at once.
VOTES = 1 << 16
#: Comparisons made at once.
PAIRS = 1 << 21
#: Rows of cells that are looked at together.
CELL_ROWS = 1 << 16


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of a text in UTF-8, over XXH64 of its shingles of ``width`` words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, n, VOTES):
        to = min(n, at + VOTES)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every whole text."""
    bounded_batches(docs.sparkSession)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or b"", width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run_task, "doc_id long, fp long")


class Cover:
    """The covering code of one range of bits: Hamming words on its low bits, the rest free."""

    def __init__(self, first: int, bits: int, share: int):
        self.first, self.bits, self.share = np.uint64(first), bits, share
        order = max(r for r in range(1, 7) if 2**r - 1 <= min(bits, 15))
        self.low = 2**order - 1
        value = np.arange(2**self.low)
        syndrome = np.zeros_like(value)
        for i in range(self.low):
            syndrome ^= np.where(value >> i & 1, i + 1, 0)
        self.word = (value ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)).astype(np.uint64)
        masks = [0]
        for _ in range(share):
            masks = sorted({m ^ (1 << i) for m in masks for i in range(bits)} | set(masks))
        self.masks = np.array(masks, np.uint64)

    def home(self, values: np.ndarray) -> np.ndarray:
        """The anchor in whose ball of radius 1 each value of the range lies."""
        low = np.uint64(2**self.low - 1)
        return (values & ~low) | self.word[(values & low).astype(np.int64)]

    def values(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> self.first) & np.uint64(2**self.bits - 1)

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, anchor, whether it is the home), each anchor once for a fingerprint."""
        value = self.values(fps)
        to = np.sort(np.stack([self.home(value ^ m) for m in self.masks], axis=1), axis=1)
        new = np.ones(to.shape, bool)
        new[:, 1:] = to[:, 1:] != to[:, :-1]
        row, col = np.nonzero(new)
        anchor = to[row, col]
        return row, anchor, anchor == self.home(value)[row]


def covers(threshold: int, pieces: int) -> list[Cover]:
    bounds = [64 * i // pieces for i in range(pieces + 1)]
    return [Cover(a, b - a, threshold // pieces) for a, b in zip(bounds, bounds[1:], strict=False)]


def replicate(threshold: int, pieces: int, homes_only: bool):
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = covers(threshold, pieces)
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, code in enumerate(codes):
                if homes_only:
                    row, anchor = np.arange(len(fps)), code.home(code.values(fps))
                    home = np.ones(len(fps), bool)
                else:
                    row, anchor, home = code.anchors(fps)
                key = (anchor | np.uint64(k << 56)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(fps[row].view(np.int64))], names=["anchor", "home", "fp"])

    return run_task


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to links of the same components, one fewer than the nodes of each."""
    node, root = labels(a, b)
    other = node != root
    return node[other], root[other]


def compare(threshold: int, codes: list[Cover]):
    """Map function over rows sorted by cell, those at home first: links within the threshold,
    thinned out batch by batch to spanning forests.

    Two fingerprints that are close in several ranges of bits meet in each; only the first such
    range counts.
    """

    def near(x: np.ndarray, y: np.ndarray, piece: int) -> np.ndarray:
        differ = x ^ y
        out = (np.bitwise_count(differ) <= threshold) & (differ != 0)
        for code in codes[:piece]:
            out &= np.bitwise_count(code.values(differ)) > code.share
        return out

    def links(home: np.ndarray, fps: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        step = max(1, PAIRS // max(1, len(home)))
        for at in range(0, len(fps), step):
            some = fps[at : at + step]
            i, j = np.nonzero(near(home[:, None], some[None, :], piece))
            if len(i):
                a, b = forest(home[i], some[j])
                left.append(a), right.append(b)
        return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])

    def small_cells(home: np.ndarray, fps: np.ndarray, bounds: np.ndarray, pieces: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All cells of a batch at once: each one at home against all of its cell."""
        cell = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = np.flatnonzero(home)
        for piece in np.unique(pieces):
            mine = at[pieces[cell[at]] == piece]
            size = np.diff(bounds)[cell[mine]]
            cuts = np.searchsorted(np.cumsum(size), np.arange(PAIRS, size.sum() + PAIRS, PAIRS))
            for some in np.split(mine, np.unique(cuts + 1)):
                n = np.diff(bounds)[cell[some]]
                if n.sum():
                    i = np.repeat(some, n)
                    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[cell[some]], n)
                    close = near(fps[i], fps[j], int(piece))
                    if close.any():
                        yield forest(fps[i[close]], fps[j[close]])

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at_home = None, np.zeros(0, np.uint64)  # the cell that a batch's end may have cut
        for batch in larger(batches, CELL_ROWS):
            cell = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "left", "right")], axis=1)
            home = batch.column("home").to_numpy(zero_copy_only=False).astype(bool)
            fps = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False)).view(np.uint64)
            bounds = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1, [len(fps)]])
            found = []
            if last is not None and (cell[0] == last).all():
                first = slice(0, bounds[1])
                mine = np.concatenate([at_home, fps[first][home[first]]])
                found.append(links(mine, fps[first], int(cell[0, 0] >> 56)))
            if len(bounds) > 2 or last is None or (cell[0] != last).any():
                found += small_cells(home, fps, bounds, cell[bounds[:-1], 0] >> 56)
            for a, b in found:
                if len(a):
                    yield out(a, b)
            tail = slice(bounds[-2], bounds[-1])
            kept = fps[tail][home[tail]]
            at_home = np.concatenate([at_home, kept]) if last is not None and (cell[-1] == last).all() else kept
            last = cell[-1].copy()

    return run_task


def links(distinct: DataFrame, threshold: int, pieces: int, block: int) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within the threshold."""
    spark = distinct.sparkSession
    at_home = distinct.mapInArrow(replicate(threshold, pieces, True), "anchor long, home boolean, fp long")
    hot = at_home.groupBy("anchor").count().filter(F.col("count") > block)
    hot = reliable(hot.select("anchor", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    sent = distinct.mapInArrow(replicate(threshold, pieces, False), "anchor long, home boolean, fp long")
    many = hot.count()
    if many:
        sent = sent.join(F.broadcast(hot) if many <= 50_000 else hot, "anchor", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        one = F.lit(0).cast("int")
        rows = sent.filter("blocks is null").select("anchor", one.alias("left"), one.alias("right"), "home", "fp")
        split = sent.filter("blocks is not null")
        from_home = split.filter("home").select("anchor", own.alias("left"), F.explode(every).alias("right"), "home", "fp")
        others = split.select("anchor", F.explode(every).alias("left"), own.alias("right"), F.lit(False).alias("home"), "fp")
        sent = rows.unionByName(from_home).unionByName(others)
    else:
        sent = sent.select("anchor", F.lit(0).alias("left"), F.lit(0).alias("right"), "home", "fp")
    cells = sent.repartition("anchor", "left", "right").sortWithinPartitions("anchor", "left", "right", F.desc("home"))
    return cells.mapInArrow(compare(threshold, covers(threshold, pieces)), "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, threshold: int = 4, pieces: int = 3, block: int = 4096) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id.

    ``pieces`` trades copies of a fingerprint for comparisons: 3 sends each to about 44 anchors
    of 2**17 or more a range, 2 to about 330 of 2**28; with far over 10**8 distinct
    fingerprints 2 is the better choice. ``block`` bounds the fingerprints at home in one cell.
    """
    own = reliable(fingerprints(docs, width))
    distinct = reliable(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    edges = links(distinct.select("fp"), threshold, pieces, block)
    found = reliable(components(edges))
    # A row for each component, broadcast or behind a checkpoint: a join of its own can be split where one is large.
    least = reliable(found.join(distinct, found["node"] == distinct["fp"]).groupBy("root").agg(F.min("doc_id").alias("component_id")))
    linked = found.join(sized(least), "root").select(F.col("node").alias("fp"), "component_id")
    named = reliable(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id")))
    return own.join(sized(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), width=4)
