"""Exact deduplication by a log-structured merge index.

Each map task fills memtables of bounded size. A full memtable is flushed as sorted runs of
digests, cut by shard, each with a Bloom filter. One task per shard then adds the runs to a
levelled index: where two runs of a level meet, they are compacted, the filter of the one
telling which digests of the other have to be looked up at all. Of equal digests the smallest
identifier stays (of the row to keep: most code points first), and their rows are counted.

Digests found in two rows or more are hits. Their entries in the index give keep_id and
group_size. The texts of hits are read once more, and their bytes verify the entry: only if all
texts of a digest are the same bytes it stands. Digests that clash are split by their bytes.

Hot groups: copies collapse in the memtable and again in each compaction, and the verification
is combined before its shuffle, so that a third of all rows in one group is a few entries by the
time anything meets in one task.

Defined results: a null text counts as empty, and all empty texts are one group; a null doc_id
orders after every other (the largest 64-bit id is reserved for it); rows that repeat a doc_id
and a text are members each, and share ``kept``; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import bounded_batches, documents, parts, reliable, row_names, sized, without

SPACES = b" \t\n\x0b\x0c\r"
NO_ID = np.iinfo(np.int64).max
ENTRY = np.dtype([("key", "V32"), ("lead", ">u8"), ("chars", "<i8"), ("id", "<i8"), ("count", "<i8")])
FLUSH = "doc_id long, k1 long, k2 long, sha binary, chars long, shard int, run string, entries binary, filter binary"
PROBES = 4
#: Rows of hits in a batch, and tasks that make a filter over them.
HIT_ROWS, FILTER_TASKS = 65_536, 8


class Filter:
    """A Bloom filter over digests, whose own words serve as its hash functions."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> np.ndarray:
        words = np.ascontiguousarray(keys).view(">u8").reshape(-1, 4).astype(np.uint64)
        spread = words[:, :1] * np.uint64(0x9E3779B97F4A7C15) + words[:, 1:2]
        step = (words[:, 2:3] ^ words[:, 3:4]) | np.uint64(1)
        probe = spread + step * np.arange(1, PROBES + 1, dtype=np.uint64)
        probe ^= probe >> np.uint64(29)
        return (probe % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, size: int | None = None) -> Filter:
        size = size or max(64, 10 * len(keys) // 8 * 8)
        bits = np.zeros(size // 8, np.uint8)
        if len(keys):
            at = cls.places(keys, size).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return cls(bits)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        at = self.places(keys, len(self.bits) * 8)
        return ((self.bits[at >> 3] >> (at & 7)) & 1).all(axis=1)


def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the row named in b is to be kept rather than the one in a."""
    return (b["chars"] > a["chars"]) | ((b["chars"] == a["chars"]) & (b["id"] < a["id"]))


def compact(old: np.ndarray, held: Filter, new: np.ndarray) -> np.ndarray:
    """Two sorted runs as one. Only entries that pass the filter of ``old`` are looked up in it."""
    maybe = np.flatnonzero(held.may_hold(new["key"]))
    fresh = np.ones(len(new), bool)
    if len(maybe) and len(old):
        lead = old["lead"].astype(np.uint64)
        wanted = new["lead"][maybe].astype(np.uint64)
        first, last = np.searchsorted(lead, wanted, "left"), np.searchsorted(lead, wanted, "right")
        old = old.copy()
        for k, a, b in zip(maybe, first, last, strict=True):
            for i in range(a, b):  # more than one only where the leading words collide
                if old["key"][i].tobytes() == new["key"][k].tobytes():
                    count = old["count"][i] + new["count"][k]
                    if better(old[i], new[k]):
                        old[i] = new[k]
                    old["count"][i] = count
                    fresh[k] = False
    both = np.concatenate([old, new[fresh]])
    return both[np.argsort(both["lead"].astype(np.uint64), kind="stable")]


class Levels:
    """A levelled index over the runs of one shard."""

    def __init__(self):
        self.runs: dict[int, tuple[np.ndarray, Filter]] = {}

    def add(self, run: np.ndarray, held: Filter) -> None:
        level = max(1, len(run)).bit_length()
        while level in self.runs:
            old, older = self.runs.pop(level)
            run = compact(old, older, run)
            held, level = Filter.of(run["key"]), max(level + 1, len(run).bit_length())
        self.runs[level] = run, held

    def whole(self) -> np.ndarray:
        out = np.zeros(0, ENTRY)
        for level in sorted(self.runs):
            run, held = self.runs[level]
            out = compact(run, held, out)
        return out


def memtables(shards: int, limit: int, digest_bytes: int):
    """Map function: a row for each document and, at each flush, a row for each shard of the run."""

    def flush(table: dict, run: str) -> Iterator[pa.RecordBatch]:
        entries = np.zeros(len(table), ENTRY)
        entries["key"] = np.frombuffer(b"".join(table), "V32")
        entries["lead"] = np.frombuffer(b"".join(table), ">u8")[::4]
        for i, (chars, doc, count) in enumerate(table.values()):
            entries["chars"][i], entries["id"][i], entries["count"][i] = chars, doc, count
        entries = entries[np.argsort(entries["lead"].astype(np.uint64), kind="stable")]
        shard = (entries["lead"].astype(np.uint64) >> np.uint64(8)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        entries, shard = entries[order], shard[order]
        ends = np.flatnonzero(np.diff(shard, append=np.uint64(shards)))
        pieces = np.split(entries, ends[:-1] + 1)
        n = len(pieces)
        none = pa.nulls
        yield pa.RecordBatch.from_arrays(
            [
                none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.int64()),
                pa.array(shard[ends].astype(np.int32)), pa.array([run] * n),
                pa.array([x.tobytes() for x in pieces], pa.binary()),
                pa.array([Filter.of(x["key"]).bits.tobytes() for x in pieces], pa.binary()),
            ],
            names=["doc_id", "k1", "k2", "sha", "chars", "shard", "run", "entries", "filter"],
        )

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, flushed, table = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            ids, chars = batch.column("doc_id").to_pylist(), batch.column("chars").to_pylist()
            shas = [hashlib.sha256((t or b"").translate(None, SPACES)).digest() for t in batch.column("text").to_pylist()]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), batch.column("k1"), batch.column("k2"), pa.array(shas, pa.binary()), pa.array(chars, pa.int64()),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                ],
                names=["doc_id", "k1", "k2", "sha", "chars", "shard", "run", "entries", "filter"],
            )
            for doc, length, sha in zip(ids, chars, shas, strict=True):
                key, doc = sha[:digest_bytes].ljust(32, b"\0"), NO_ID if doc is None else doc
                if (seen := table.get(key)) is None:
                    table[key] = length, doc, 1
                elif length > seen[0] or (length == seen[0] and doc < seen[1]):
                    table[key] = length, doc, seen[2] + 1
                else:
                    table[key] = seen[0], seen[1], seen[2] + 1
            if len(table) >= limit:
                yield from flush(table, f"{part:09}-{flushed:06}")
                flushed, table = flushed + 1, {}
        if table:
            yield from flush(table, f"{part:09}-{flushed:06}")

    return run_task


def compaction(digest_bytes: int):
    """Runs, sorted by shard and run, to the index's hits: key, shard, keep_id and group_size."""

    def hits(shard: int, levels: Levels) -> Iterator[pa.RecordBatch]:
        found = levels.whole()
        found = found[found["count"] > 1]
        for at in range(0, len(found), HIT_ROWS):
            some = found[at : at + HIT_ROWS]
            ids = some["id"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k.tobytes()[:digest_bytes] for k in some["key"]], pa.binary()), pa.array(np.full(len(some), shard, np.int32)),
                    pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(some["count"], pa.int64()),
                ],
                names=["key", "shard", "keep_id", "group_size"],
            )

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, levels = None, Levels()
        for batch in batches:
            for shard, entries, held in zip(batch.column("shard").to_pylist(), batch.column("entries").to_pylist(), batch.column("filter").to_pylist(), strict=True):
                if shard != at and at is not None:
                    yield from hits(at, levels)
                    levels = Levels()
                at = shard
                levels.add(np.frombuffer(entries, ENTRY), Filter(np.frombuffer(held, np.uint8)))
        if at is not None:
            yield from hits(at, levels)

    return run_task


def filters_of(bits: int):
    """Map function: a filter of so many bits over the keys of each task, as one row."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys = np.frombuffer(b"".join(k.ljust(32, b"\0") for k in batch.column("key").to_pylist()), "V32")
            out |= Filter.of(keys, bits).bits
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    return run_task


def hit_texts(shared, digest_bytes: int):
    """Map function: key and normalised bytes of the documents that the filter over hits lets through."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(np.frombuffer(shared.value, np.uint8))
        for batch in batches:
            bodies = [(t or b"").translate(None, SPACES) for t in batch.column("text").to_pylist()]
            keys = np.frombuffer(b"".join(hashlib.sha256(t).digest()[:digest_bytes].ljust(32, b"\0") for t in bodies), "V32")
            rows = np.flatnonzero(held.may_hold(keys))
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(rows)) for c in ("doc_id", "k1", "k2", "chars")), pa.array([keys[i].tobytes()[:digest_bytes] for i in rows], pa.binary()), pa.array([bodies[i] for i in rows], pa.binary())],
                    names=["doc_id", "k1", "k2", "chars", "key", "body"],
                )

    return run_task


def exact_rows(docs: DataFrame, memtable_rows: int = 65_536, filter_bytes: int = 64 << 20, digest_bytes: int = 32) -> DataFrame:
    """A row for each document: doc_id, k1, k2, chars, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; of equal texts,
    the row with the most code points in its original text stays, then the smallest doc_id.
    ``memtable_rows`` bounds a task's memtable, ``filter_bytes`` the filter over hits that tells
    which texts have to be verified: ten bits a hit up to there (some 5 * 10**7 hits), fewer
    beyond, when more texts are read again than need be and none is lost. ``digest_bytes``
    under 32 is for tests.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shards = max(64, 4 * parts(spark))
    texts = docs.select(*row_names(), F.col("text").cast("binary").alias("text"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    flushed = reliable(texts.mapInArrow(memtables(shards, memtable_rows, digest_bytes), FLUSH))
    rows = flushed.filter("shard is null").select("doc_id", "k1", "k2", "chars", "sha", F.substring("sha", 1, digest_bytes).alias("key"))
    runs = flushed.filter("shard is not null").select("shard", "run", "entries", "filter")
    index = reliable(
        runs.repartition("shard").sortWithinPartitions("shard", "run")
        .mapInArrow(compaction(digest_bytes), "key binary, shard int, keep_id long, group_size long")
    )
    bits = max(512, min(filter_bytes * 8, 10 * index.count()) // 8 * 8)
    filled = np.zeros(bits // 8, np.uint8)
    # Some tasks' filters come one after the other; each is as large as the whole.
    for r in index.select("key").coalesce(FILTER_TASKS).mapInArrow(filters_of(bits), "bits binary").toLocalIterator():
        filled |= np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(filled.tobytes())
    hits = texts.mapInArrow(hit_texts(shared, digest_bytes), "doc_id long, k1 long, k2 long, chars long, key binary, body binary")
    verified = reliable(hits.groupBy("key").agg((F.min("body") == F.max("body")).alias("same")))
    # Rows stay where they are if the hits are few; else a join that can be split deals them out.
    stands = sized(reliable(index.join(verified.filter("same"), "key").select("key", "keep_id", "group_size")))
    clashing = verified.filter("not same").select("key")
    out = rows.join(stands, "key", "left")
    if not clashing.isEmpty():
        # Equal digests of unequal texts: these documents get their class by their bytes.
        keep = F.min_by("doc_id", F.struct(-F.col("chars"), F.coalesce("doc_id", F.lit(int(NO_ID))))).alias("keep_id")
        own = hits.join(clashing, "key", "left_semi")
        classes = own.groupBy("key", "body").agg(keep, F.count(F.lit(1)).alias("group_size"))
        by_bytes = own.join(classes, ["key", "body"]).select("key", "doc_id", "k1", "k2", own["chars"], F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
        out = out.join(clashing, "key", "left_anti").unionByName(by_bytes)
    return out.select(
        "doc_id", "k1", "k2", "chars",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, **parameters: int) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256; see ``exact_rows``."""
    return exact_rows(docs, **parameters).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of equal texts the row that ``exact_rows`` keeps, all columns, null and repeated ids included; of
    several with its id, the longest original text, then the smallest hash of it."""
    rows = reliable(exact_rows(docs).filter("group_size > 1"))
    first = F.struct(~F.col("kept"), -F.col("chars"), "k1", "k2").alias("order")
    best = reliable(rows.groupBy("text_sha256").agg(F.min_by(F.struct("doc_id", "k1", "k2"), first).alias("best")))
    named = rows.groupBy("text_sha256", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("rows")).join(sized(best), "text_sha256")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))
    return without(docs, named.withColumn("stays", stays).filter("not stays or rows > 1"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS n
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(n) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""
