import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meridia.llm import common, exact_dedup, graph, near_sets, simhash


def brute_groups(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub("[\x20\x09-\x0d]", "", r.text or "")].append((-len(r.text or ""), (r.doc_id is None, r.doc_id or 0), r.doc_id))
    out = []
    for body, rows in groups.items():
        keep = min(rows, key=lambda x: x[:2])[2]
        out += [(r[2], keep, len(rows), r[2] == keep, hashlib.sha256(body.encode()).hexdigest()) for r in rows]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [{}, {"memtable_rows": 3, "filter_bytes": 64, "digest_bytes": 1}])
def test_exact_groups(odd, documents, no_documents, small):
    """Also with tiny memtables and with digests that collide, when bytes have to tell texts apart."""
    for docs in (odd, documents):
        assert sorted(map(tuple, exact_dedup.exact_groups(docs, **small).collect()), key=str) == brute_groups(docs)
    assert exact_dedup.exact_groups(no_documents, **small).count() == 0


def test_exact_dedup_agrees_with_sql(agree):
    agree(exact_dedup.op10_exact_dedup, exact_dedup.ORACLE)


def test_filter_has_no_false_negatives():
    keys = np.array([hashlib.sha256(bytes([i, j])).digest() for i in range(20) for j in range(20)], "V32")
    assert exact_dedup.Filter.of(keys).may_hold(keys).all()
    assert exact_dedup.Filter.of(keys[:200]).may_hold(keys[200:]).mean() < 0.1


edges = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=30)


@pytest.mark.parametrize("few", [1_000_000, 0])
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges)
def test_components(spark, monkeypatch, few, pairs):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    parent = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = graph.components(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in parent)


def brute_fingerprint(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", "  \n", "a", "A b\tC", "a b c d", "É b c d e \xa0 f", "x " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(), 4) == brute_fingerprint(text, 4)


@pytest.mark.parametrize(("threshold", "pieces"), [(4, 3), (4, 2), (3, 4), (8, 4), (0, 1)])
def test_anchors_bring_all_close_fingerprints_together(threshold, pieces):
    rng = np.random.default_rng(threshold)
    x = rng.integers(0, 2**64, 60, np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, threshold, replace=False)) for _ in x]
    y = x ^ np.array(flips, np.uint64)
    met = np.zeros(len(x), bool)
    for code in simhash.covers(threshold, pieces):
        if code.bits > 32 and threshold // pieces > 2:
            continue
        homes = code.home(code.values(x))
        row, anchor, at_home = code.anchors(y)
        for r, a in zip(row, anchor, strict=True):
            met[r] |= homes[r] == a
        assert at_home.sum() == len(y)
        near = np.bitwise_count(code.values(x) ^ homes)
        assert near.max() <= 1  # the code's covering radius
    assert met.all()


def components_of(fps, ids, threshold):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ x) <= threshold):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 64)
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], d)
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("block", [4096, 8])
def test_links_of_crowded_fingerprints(spark, block):
    """A group of near copies, in one cell and cut into blocks."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, np.uint64)
    close = [base[0] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for _ in range(80)]
    fps = np.unique(np.concatenate([base, np.array(close, np.uint64)]))
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = graph.components(simhash.links(frame, 4, 3, block))
    root = {r.node: r.root for r in found.collect()}
    signed = fps.view(np.int64).tolist()
    want = components_of(fps, signed, 4)
    assert [root.get(s, s) for s in signed] == want


def test_near_groups(documents, texts, odd, no_documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(documents, width=4).collect()}
    ids = sorted(texts)
    fps = np.array([brute_fingerprint(texts[i], 4) for i in ids], np.uint64)
    assert [got[i][0] for i in ids] == [f"{int(f):016x}" for f in fps]
    assert [got[i][1] for i in ids] == components_of(fps, ids, 4)
    strange = simhash.near_groups(odd).collect()
    assert len(strange) == odd.count()
    assert {r.doc_id for r in strange if r.component_id == 1} == {1, 2, 3}
    assert simhash.near_groups(no_documents).count() == 0


def test_similar_groups(spark, odd, no_documents):
    words = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    docs = [(1, words), (2, [*words[:-1], "end"]), (3, words[:90] + other[:110]), (4, other), (5, ["start", *other[1:]]), (6, words)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    assert dict(map(tuple, near_sets.similar_groups(frame).collect())) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 1}
    got = dict(map(tuple, near_sets.similar_groups(odd).collect()))
    assert got[3] == 1 and got[9] == 8 and got[5] == 4 and None not in got
    assert near_sets.similar_groups(no_documents).count() == 0


def brute_similar(rows, similarity=0.8, width=5):
    """doc_id to the smallest id of its group, by all pairs that share a shingle."""
    sets = {i: near_sets.shingles((t or "").encode(), width) for i, t in rows}
    having, root = defaultdict(list), {i: i for i in sets}
    for i in sorted(sets):
        for h in sets[i]:
            having[h].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for ids in having.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}:
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def near_copies(seed, families=12, size=14, length=120):
    """Texts that lose or change some words of another of their family: similarities on both sides of 0.8."""
    rng, out = np.random.default_rng(seed), []
    for f in range(families):
        family = [[f"f{f}w{i}" for i in range(length)]]
        for _ in range(size):
            w = list(family[rng.integers(len(family))])
            for at in rng.choice(len(w), rng.integers(1, 5), replace=False):
                w[at] = f"x{rng.integers(1 << 30)}"
            family.append(w)
        out += family
    order = rng.permutation(len(out))
    return [(int(i), " ".join(out[i])) for i in order]


def test_similar_groups_have_all_links(spark):
    """Partners that are not the closest ones, and bridges between groups, link as well."""
    for rows in (near_copies(1), [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert dict(map(tuple, near_sets.similar_groups(frame).collect())) == brute_similar(rows)


def test_similar_groups_of_large_cells(spark, monkeypatch):
    """The same groups when cells are salted, pass batch by batch, and nothing is broadcast."""
    for name, value in (("WHOLE_CELL", 3), ("CELL_ROWS", 8), ("LARGE", 4), ("ASKED", 1), ("SEEN", 2), ("COMPARED", 4)):
        monkeypatch.setattr(near_sets, name, value)
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    rows = near_copies(2, families=3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(map(tuple, near_sets.similar_groups(frame).collect())) == brute_similar(rows)
    left = {r.doc_id for r in near_sets.one_of_each(frame.unionByName(frame)).collect()}
    assert left == set(brute_similar(rows).values())


def test_bounds_let_similar_sets_through():
    """Sizes, places and bitmaps never part sets that are as similar as asked."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, keep = int(rng.integers(1, 3000)), rng.uniform(0.85, 1)
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < keep], rng.integers(0, 1 << 63, int(n * (1 - keep)), np.uint64)]))
        common_members = len(np.intersect1d(a, b))
        if not len(b) or common_members < 0.8 * (len(a) + len(b) - common_members):
            continue
        p, q = near_sets.parity(a), near_sets.parity(b)
        longs = min(len(p), len(q))
        apart = np.bitwise_count(near_sets.folded(p, longs).view(np.uint64) ^ near_sets.folded(q, longs).view(np.uint64)).sum()
        assert apart <= len(a) + len(b) - 2 * common_members <= (1 - 2 * 0.8 / 1.8) * (len(a) + len(b)) + near_sets.SLACK


def test_similar_groups_of_repeated_lines(spark):
    """The shingles are a set: how often a line repeats doesn't part two texts."""
    line = "this very line of nine words repeats and repeats "
    rows = []
    for k in range(6):
        body = " ".join(f"b{k}w{i}" for i in range(200))
        rows += [(10 * k + j, f"{body} {line * n}") for j, n in enumerate((2, 10, 20, 40))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(map(tuple, near_sets.similar_groups(frame).collect())) == {i: i - i % 10 for i, _ in rows}


def test_similar_groups_behind_one_fingerprint(spark):
    """Unlike texts that one line gives the same fingerprint don't hide each other's near copies."""
    line = "this very line of nine words repeats and repeats " * 100
    body = [" ".join(f"b{k}w{i}" for i in range(60)) for k in (0, 1)]
    rows = [(1, f"{body[0]} {line}"), (2, f"{body[1]} {line}"), (3, f"{body[1]} end {line}")]
    assert len({simhash.fingerprint(t.encode(), 5) for _, t in rows}) == 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(map(tuple, near_sets.similar_groups(frame).collect())) == {1: 1, 2: 2, 3: 2}


def test_pairs_of_a_group_grow_as_the_group(spark, monkeypatch):
    """Near copies about as similar as asked: those of a component are not all held against a set that one of them links."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        words = [f"w{j}" for j in range(400)]
        for j in rng.choice(400, rng.integers(3, 8), replace=False):
            words[j] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    compared, reliable = [], near_sets.reliable

    def counted(df):
        out = reliable(df)
        if out.columns == ["a", "b"]:
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_sets, "reliable", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(map(tuple, near_sets.similar_groups(frame).collect())) == brute_similar(rows)
    assert sum(compared) < 75 * len(rows)
