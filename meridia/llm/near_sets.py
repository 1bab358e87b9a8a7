"""Near duplicates by sets of shingles: SimHash finds them, the shingles confirm them, and a
prefix filter finds what SimHash leaves.

Two texts are near duplicates if their sets of ``width``-word shingles have a Jaccard similarity
of ``similarity`` or more, and groups are the components of all such links; none is left out.

1. Every text is read once, into a sketch: its set's key, size, SimHash fingerprint (each
   distinct shingle votes once), rarest members and a parity bitmap.
2. Fingerprints within THRESHOLD bits meet by anchor-point covering (``simhash.links``). The
   pairs are confirmed by their shingles; near copies are one component from then on.
3. What SimHash does not find is found exactly. Sets A and B as similar as asked share at least
   similarity * |A| members, so that in one order of all shingles the first
   |A| - ceil(similarity * |A|) + 1 of A meet those of B: each shared one is a cell. For TURNS turns the
   sets of a cell are held against one of them; then a set against that of each other component whose
   bitmap is nearest to its own; then all pairs of a cell that still are in different components.
   A pair goes on only if size, place and bitmap leave it a chance, each a bound that no similar
   pair fails, and again its shingles decide.

Sketches are joined as rows by the DataFrame engine, so that no cell, group or hub is ever held by a
task: cells that many sets share are dealt out by salt, minima are combined before their shuffle,
and skewed joins are split by adaptive execution. A group of near copies yields rows in proportion
to its size. Sets that share a rare shingle and are not similar cost a comparison a pair, and a row
only if all three bounds let them through.

Defined results: a null or empty text has the set of the empty shingle, so all such texts are one
group; a null doc_id orders after every other; rows that repeat a doc_id with other texts are rows of
their own, and of rows that repeat a doc_id and a text one stays; an empty table gives an empty
result. Sets, and texts of one doc_id, are told apart by hashes (64 and 128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import bounded_batches, larger, reliable, row_names, sized, without
from meridia.llm.graph import components
from meridia.llm.simhash import SEED, links

#: Bits by which fingerprints of sets may differ to be looked at first, and ranges of bits.
THRESHOLD, PIECES, BLOCK = 4, 3, 4096
#: Longs of a parity bitmap in a cell, and classes of a set's own at most.
BITS, MOST_CLASSES = 8, 1 << 16
#: Turns in which a cell's sets are held against one of them.
TURNS = 1
#: The turns that follow: with the nearest set of each other component, and with all sets of them.
NEAREST, ALL = 0, -1
#: Texts whose shingles are counted for an order by frequency, and frequent ones that go to the driver.
ORDER_ROWS = 5_000
ORDER_SHINGLES = 100_000
#: A set in so many is looked at to tell which cells are large, and members from which one is.
ASKED, LARGE = 64, 16_384
#: Rows of cells that are looked at together, and members up to which each is held against each.
CELL_ROWS, WHOLE_CELL = 1 << 16, 2048
#: Members of a cell compared at once.
COMPARED = 1 << 19
#: Sets that a task remembers, to send each once.
SEEN = 1 << 18
#: For rounding: what a bound on members is lowered by.
SLACK = 1e-6


def shingles(text: bytes, width: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the members of ``shingles``, in order."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def set_key(hashes: np.ndarray) -> int:
    """64 bits, as a signed long, that stand for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def vote(hashes: np.ndarray) -> int:
    """The SimHash of a set, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CELL_ROWS):
        ones += np.unpackbits(hashes[at : at + CELL_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of some classes of hashes, whether the set has an odd number of them.

    Two sets' bitmaps differ in as many bits as the sets differ in members, at most. There are as
    many classes as members, in powers of two, so that bitmaps of sets that differ a lot do so too.
    """
    classes = 64 * BITS
    while classes < min(len(hashes), MOST_CLASSES):
        classes *= 2
    odd = np.bincount((hashes % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def folded(bitmap: np.ndarray, longs: int) -> np.ndarray:
    """A bitmap over fewer classes."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, longs), axis=0)


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes that several texts of a bounded sample have, the most frequent last.

    They serve to order the members of a set, and any order gives the same links.
    """

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_hashes(t or b"", width) for t in batch.column("text").to_pylist()]
            h, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    rows = max(1, texts.count())
    some = texts.filter(F.pmod(F.xxhash64(F.lit("order"), "text"), F.lit(1 << 30)) < (1 << 30) * min(rows, ORDER_ROWS) // rows)
    counts = some.mapInArrow(run_task, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).collect()
    return np.array([r.h for r in reversed(found)], np.int64).view(np.uint64)


SKETCH = "doc_id long, k1 long, k2 long, set_key long, n int, fp long, prefix array<long>, bits array<long>, wide binary"


def sketch(width: int, similarity: float, common):
    """Map function: rows (doc_id, k1, k2, text) with a sketch of the text in its place."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(common.value)
        ranked = common.value[order]

        def rarest(own: np.ndarray) -> np.ndarray:
            rank = np.zeros(len(own), np.int64)
            if len(ranked):
                at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)
                rank = np.where(ranked[at] == own, order[at] + 1, 0)
            take = len(own) - int(np.ceil(similarity * len(own) - SLACK)) + 1
            return own[np.lexsort([own, rank])[:take]].view(np.int64)

        for batch in batches:
            sets = [shingle_hashes(t or b"", width) for t in batch.column("text").to_pylist()]
            wide = [parity(s) for s in sets]
            made = [
                pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([vote(s) for s in sets], pa.int64()),
                pa.array([rarest(s) for s in sets], pa.list_(pa.int64())), pa.array([folded(w, BITS) for w in wide], pa.list_(pa.int64())),
                pa.array([w.tobytes() for w in wide], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), *made], names=["doc_id", "k1", "k2", "set_key", "n", "fp", "prefix", "bits", "wide"])

    return run_task


def may_be_similar(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m members whose first common one is at these places can be similar."""
    return np.minimum(n - at, m - to) >= similarity / (1 + similarity) * (n + m) - SLACK


def apart(x: str, y: str) -> Column:
    """Bits in which the bitmaps of rows x and y of a cell differ."""
    return sum((F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(BITS)), F.lit(0))


def chance(x: str, y: str, similarity: float) -> Column:
    """The same of rows x and y of a cell, and by their bitmaps, unless they are in one component."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    common = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
    share = similarity / (1 + similarity)
    return (F.col(f"{x}.root") != F.col(f"{y}.root")) & (common >= share * both - SLACK) & (apart(x, y) <= (1 - 2 * share) * both + SLACK)


ROW, BITMAP = ("h", "key", "n", "at", "salt"), tuple(f"b{i}" for i in range(BITS))


def shared_cells(similarity: float, bitmaps: bool):
    """Map function over rows sorted by cell and key: those that share it with a set that can be
    similar, by size and place and, where they come along, by bitmaps.

    Of a cell that is large, or a salted part of one (salt > 0), all rows pass.
    """
    share = similarity / (1 + similarity)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*ROW, *(BITMAP if bitmaps else ())]
        held: list[np.ndarray] | None = None  # the cell that a batch's end may have cut
        passing = None  # a cell of which rows passed already

        def pairable(cell: list[np.ndarray]) -> list[np.ndarray]:
            n, at = cell[2].astype(np.int64), cell[3].astype(np.int64)
            step, met = max(1, COMPARED // len(n)), []
            for a in range(0, len(n), step):
                can = may_be_similar(n[a : a + step, None], at[a : a + step, None], n[None, a + 1 :], at[None, a + 1 :], similarity)
                x, y = np.nonzero(np.triu(can))  # each with those behind it
                met.append((x + a, y + a + 1))
            i, j = (np.concatenate(x) for x in zip(*met, strict=True))
            if bitmaps:
                apart = np.zeros(len(i), np.int64)
                for b in cell[5:]:
                    apart += np.bitwise_count(b.view(np.uint64)[i] ^ b.view(np.uint64)[j])
                near = apart <= (1 - 2 * share) * (n[i] + n[j]) + SLACK
                i, j = i[near], j[near]
            some = np.zeros(len(n), bool)
            some[i] = some[j] = True
            return [x[some] for x in cell]

        def out(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)

        for batch in larger(batches, CELL_ROWS):
            own = [np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in names]
            own = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            bounds = np.concatenate([[0], np.flatnonzero(own[0][1:] != own[0][:-1]) + 1, [len(own[0])]])
            size = np.diff(bounds)
            salted = own[4][bounds[:-1]] > 0
            found, last = [], len(size) - 1
            ends = np.isin(np.arange(len(size)), (0, last))
            for c in np.flatnonzero((size > 1) | salted | ends).tolist():
                cell = [x[bounds[c] : bounds[c + 1]] for x in own]
                if salted[c] or size[c] > WHOLE_CELL or cell[0][0] == passing:
                    found.append(cell)
                    passing = cell[0][0]
                elif c < last and size[c] > 1:
                    found.append(pairable(cell))
            tail = [x[bounds[-2] :] for x in own]
            held = None if tail[0][0] == passing else tail
            yield from out(found)
        if held is not None and len(held[0]) > 1:
            yield from out([pairable(held)])

    return run_task


def cells_of(sets: DataFrame, similarity: float) -> DataFrame:
    """(h, key, n, at, b0 ..): the sets that can be similar to another in the cell of shingle h."""
    members = sets.select(F.col("set_key").alias("key"), "n", F.posexplode("prefix").alias("at", "h"))
    asked = members.filter(F.pmod(F.xxhash64(F.lit("asked"), "key"), F.lit(ASKED)) == 0)
    large = asked.groupBy("h").count().filter(F.col("count") * ASKED >= LARGE)
    large = reliable(large.select("h", F.ceil(F.col("count") * ASKED / LARGE).cast("int").alias("parts")))
    salt = F.lit(0)
    if some := large.count():
        members = members.join(F.broadcast(large) if some <= 50_000 else large, "h", "left")
        salt = F.when(F.col("parts").isNotNull(), 1 + F.pmod(F.xxhash64("key"), "parts").cast("int")).otherwise(0)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("h", "salt").sortWithinPartitions("h", "salt", "key")

    schema = "h long, key long, n int, at int, salt int"
    shared = dealt(members.withColumn("salt", salt).select(*ROW)).mapInArrow(shared_cells(similarity, False), schema)
    bitmaps = sets.select(F.col("set_key").alias("key"), *(F.col("bits")[i].alias(b) for i, b in enumerate(BITMAP)))
    rows = dealt(shared.join(bitmaps, "key").select(*ROW, *BITMAP))
    return reliable(rows.mapInArrow(shared_cells(similarity, True), schema + "".join(f", {b} long" for b in BITMAP)).drop("salt"))


def near_bitmaps(similarity: float):
    """Map function: of pairs with sizes and own bitmaps, those that can be similar by them."""
    share = similarity / (1 + similarity)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                longs = min(len(p), len(q))
                apart = int(np.bitwise_count(folded(p, longs) ^ folded(q, longs)).sum())
                keep.append(apart <= (1 - 2 * share) * (n + m) + SLACK)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run_task


def sets_of(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, members) for each wanted set (set_key, and k1 and k2 of a text that has it); members are its sorted hashes."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, sets = [], []
            for key, t in zip(batch.column("set_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key not in seen:
                    keys.append(key), sets.append(shingle_hashes(t or b"", width).tobytes())
                    if len(seen) < SEEN:
                        seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "members"])

    some = texts.select("k1", "k2", "text").join(sized(reliable(wanted)), ["k1", "k2"]).select("set_key", "text")
    return some.mapInArrow(run_task, "key long, members binary").dropDuplicates(["key"])


def similar(similarity: float):
    """Map function: of pairs with both sets, those that are as similar as asked."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= similarity * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run_task


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): sets of one fingerprint with the first of them, and the first ones of fingerprints
    that anchor-point covering links."""
    first = reliable(sets.groupBy("fp").agg(F.min("set_key").alias("first")))
    same = sets.join(first, "fp").filter("set_key <> first").select(F.col("first").alias("a"), F.col("set_key").alias("b"))
    edges = links(first.select("fp"), THRESHOLD, PIECES, BLOCK).distinct()
    left = edges.join(first.select(F.col("fp").alias("a"), F.col("first").alias("p")), "a")
    both = left.join(first.select(F.col("fp").alias("b"), F.col("first").alias("q")), "b")
    return same.unionByName(both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))


def similar_sets(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Sketched rows (doc_id, k1, k2, set_key), and (node, root) for each set_key that is linked to another."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(*row_names(), F.col("text").cast("binary").alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(texts.select("text"), width))
    rows = reliable(texts.select("doc_id", "k1", "k2", "text").mapInArrow(sketch(width, similarity, common), SKETCH))
    sets = reliable(rows.groupBy("set_key").agg(F.min(F.struct("k1", "k2")).alias("of"), *(F.first(c).alias(c) for c in ("n", "fp", "prefix", "bits", "wide"))))
    cells = cells_of(sets, similarity)

    def beside(pairs: DataFrame, table: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
        """Pairs with columns of both their sets; ``table`` is moved only where pairs need it, if they are few."""
        ends = pairs.select("b").distinct()
        a = table.select(F.col("key").alias("a"), *(F.col(c).alias(names[0]) for c, names in columns.items()))
        b = table.select(F.col("key").alias("b"), *(F.col(c).alias(names[1]) for c, names in columns.items()))
        return sized(pairs).join(a, "a").join(b.join(sized(reliable(ends)), "b", "left_semi"), "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        by_bits = beside(reliable(pairs), sets.withColumnRenamed("set_key", "key"), {"n": ("n", "m"), "wide": ("x", "y")})
        pairs = reliable(by_bits.select("a", "b", "n", "m", "x", "y").mapInArrow(near_bitmaps(similarity), "a long, b long"))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
        held = reliable(sets_of(texts, sets.join(sized(reliable(ends)), "set_key").select("set_key", "of.*"), width))
        return beside(pairs, held, {"members": ("x", "y")}).select("a", "b", "x", "y").mapInArrow(similar(similarity), "a long, b long")

    roots = reliable(components(confirmed(fingerprint_pairs(sets))))
    for turn in (*range(1, TURNS + 1), NEAREST, ALL):
        now = cells.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
        if turn > 0:
            hub = F.min_by(F.struct(*now.columns), F.xxhash64(F.lit(turn), "key")).alias("hub")
            # Behind a checkpoint, as is what is joined below: a join of its own can be split where a cell is large.
            hubs = reliable(now.groupBy("h").agg(hub, F.min("root").alias("p"), F.max("root").alias("q")).filter("p <> q").select("hub.*"))
            met = now.alias("x").join(hubs.alias("y"), (F.col("x.h") == F.col("y.h")) & chance("x", "y", similarity))
        else:
            # The component with most sets of a cell need not be held against itself.
            counts = now.groupBy("h", "root").count()
            most = counts.groupBy("h").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
            now = reliable(now.join(reliable(most.drop("roots")), "h"))
            once = (F.col("y.root") == F.col("y.most")) | (F.col("x.key") < F.col("y.key"))
            met = now.filter("root <> most").alias("x").join(now.alias("y"), (F.col("x.h") == F.col("y.h")) & once & chance("x", "y", similarity))
        pair = F.struct(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
        if turn == NEAREST:
            # Most sets that a component of many is similar to are linked to it here, by a pair each.
            pair = met.select(pair.alias("pair"), F.col("x.key").alias("key"), F.col("y.root").alias("to"), apart("x", "y").alias("apart"))
            pairs = pair.groupBy("key", "to").agg(F.min_by("pair", F.struct("apart", "pair")).alias("pair")).select("pair.*").distinct()
        else:
            pairs = met.select(pair.alias("pair")).select("pair.*").distinct()
        # What was found before is a star for each component.
        roots = reliable(components(confirmed(pairs).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))
    return rows.select("doc_id", "k1", "k2", "set_key"), roots


def similar_classes(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """Rows (doc_id, k1, k2, root): k1 and k2 stand for the row's text, root for its group."""
    rows, roots = similar_sets(docs, similarity, width)
    return rows.join(roots, F.col("set_key") == F.col("node"), "left").select("doc_id", "k1", "k2", F.coalesce("root", "set_key").alias("root"))


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """A row for each document with an id: doc_id, component_id (the smallest id of its group).

    Rows without an id are left out, after they have linked others.
    """
    own = reliable(similar_classes(docs, similarity, width))
    least = reliable(own.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return own.filter("doc_id IS NOT NULL").join(sized(least), "root").select("doc_id", "component_id").distinct()


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """Of each group the row with the smallest doc_id, all columns. A null orders after every id;
    of rows with one id and unlike texts, the one with the smallest hash of its text stays."""
    own = reliable(similar_classes(docs, similarity, width))
    row = ("doc_id", "k1", "k2")
    first = F.min_by(F.struct(*row), F.struct(F.col("doc_id").isNull(), *row)).alias("first")
    kept = reliable(own.groupBy("root").agg(first, F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"))
    named = own.join(sized(kept), "root").groupBy("root", *row, "first").agg(F.count(F.lit(1)).alias("rows"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    return without(docs, named.withColumn("stays", stays).filter("not stays or rows > 1"))
