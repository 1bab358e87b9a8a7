import re

from test_dedup import brute_similar

import corpus_pipeline as pipeline
from meridia.llm import quality, secrets

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            kept[name] = (before, docs)
    texts = {n: ({r.doc_id: r.text for r in a.collect()}, {r.doc_id: r.text for r in b.collect()}) for n, (a, b) in kept.items()}
    # Quality: whoever the classifier scores at half or more.
    a, b = texts["quality classifier"]
    scores = quality.score(kept["quality classifier"][0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert b.keys() == {r.doc_id for r in scores.collect() if r.quality >= 0.5} and all(a[i] == t for i, t in b.items())
    # Equal texts: of each the longest original stays, then the smallest id.
    a, b = texts["exact dedup"]
    groups = {}
    for i, t in a.items():
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t), []).append((-len(t), i))
    assert b.keys() == {min(g)[1] for g in groups.values()}
    # Near duplicates: of each group, by all links that there are, the smallest id.
    a, b = texts["SimHash near-dedup"]
    assert b.keys() == set(brute_similar(list(a.items())).values())
    # Secrets: nobody leaves, values are masked and all else stays.
    a, b = texts["secret scans"]
    assert b == {i: secrets.masked(t) for i, t in a.items()}
    assert not any(s.kind != "lexed" for t in b.values() for s in secrets.scan(t))
    assert all(r.n_chars == len(r.text) for r in kept["secret scans"][1].collect())
    # Packing: every document whole, sequences without gaps and within their length.
    pieces = docs.collect()
    own, places = {}, {}
    for r in pieces:
        own.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert own.keys() == b.keys()
    for parts in own.values():
        assert [p[1] for p in sorted(parts)] == [sum(q[2] for q in sorted(parts)[:k]) for k in range(len(parts))]
    for parts in places.values():
        assert [p[0] for p in sorted(parts)] == [sum(q[1] for q in sorted(parts)[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) <= 4096


def test_odd_documents(spark, odd, no_documents):
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd, FOLDER)
        rows = out.count()
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == list(pipeline.COLUMNS) and rows <= odd.count()
            assert stage(spark, no_documents, FOLDER).count() == 0


def test_run(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns


def test_rows_of_missing_and_repeated_ids_stay(spark):
    """Both deduplicating stages leave one row of each text, whatever its id."""
    texts = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (4, texts[4]), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    want = sorted([(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (4, texts[4]), (5, texts[5])], key=str)
    for name in ("exact dedup", "SimHash near-dedup"):
        out = stages[name](spark, docs, FOLDER)
        assert out.columns == list(pipeline.COLUMNS)
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want
