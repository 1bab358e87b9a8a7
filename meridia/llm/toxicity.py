"""Toxicity by a classifier chain.

The categories are predicted in order, each by a linear model over how often certain words and
beginnings of words occur, which also sees the probabilities of the categories before it. In
training those are out-of-fold predictions, so that a later model meets earlier probabilities as
honest as those it will get when scoring.

Labels give one bit, ``toxic``; the chain's other categories are found in the labelled rows
themselves. ``kind1`` to ``kind3`` part the toxic rows by which of the chosen terms they have
(spherical k-means, started from the rows furthest apart, the largest kind first). ``severe`` are the
third of the toxic rows that a model of toxicity alone, not fitted on them, is surest of. No list of
words is given. What the models look at are the words and beginnings that the labelled rows tell
apart, in any language, chosen by how far their share of documents differs between toxic and other rows.
No bar is set, as it would depend on the number of labelled rows; the models' penalty shrinks
terms that differ by chance.

Shares are counted over a sample of labelled rows of bounded size, on executors; the driver gets
that sample's counts, rows by chosen terms, and nothing else of the corpus. Every whole document
is scored.

Defined results: a null or empty text has no words and gets the chain's score for none; without
labelled rows of both classes every probability is 0; null labels are left out, a label
that is repeated counts once, and of documents that repeat an id one is learnt from; a null doc_id is scored like any other; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import bounded_batches, documents, reliable
from meridia.llm.linear import logistic, out_of_fold, predict

WORD = re.compile(r"[^\W\d_]+")
KINDS = 3
CATEGORIES = (*(f"kind{k + 1}" for k in range(KINDS)), "toxic", "severe")
#: Of toxic rows, the share that is severe; steps of k-means at most.
SEVERE, STEPS = 1 / 3, 50
#: Labelled rows that the chain is fitted on, about, however many there are.
TRAIN_ROWS = 10_000
TRAIN_TASKS = 32
#: Terms the models look at: those whose shares are the most standard errors apart, however far that is.
CHOSEN = 300
#: Lengths of the beginnings of words.
BEGINNINGS = (3, 4, 5, 6, 7)
L2 = 2.0


def words(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


def terms(own: Iterable[str]) -> set[str]:
    """Words, and their beginnings (with a star), of a document's words."""
    return {*own, *(f"{w[:k]}*" for w in own for k in BEGINNINGS if len(w) > k)}


class Vocabulary:
    """The chosen terms, and how often they occur in a text, as log2(1 + n) with its length."""

    def __init__(self, chosen: list[str]):
        self.place = {t: i for i, t in enumerate(chosen)}
        self.starts = {k: {t[:-1]: i for t, i in self.place.items() if t[-1] == "*" and len(t) == k + 1} for k in BEGINNINGS}
        self.whole = {t: i for t, i in self.place.items() if t[-1] != "*"}

    def counts(self, own: Mapping[str, int]) -> np.ndarray:
        """How often each chosen term occurs."""
        out = np.zeros(len(self.place), np.uint32)
        for w in own.keys() & self.whole.keys():
            out[self.whole[w]] += own[w]
        for k, starts in self.starts.items():
            if starts:
                for w, n in own.items():
                    if len(w) > k and (i := starts.get(w[:k])) is not None:
                        out[i] += n
        return out


def features(counts: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.hstack([np.log2(1.0 + counts), np.log2(1.0 + length)[:, None] / 4])


def kinds(own: np.ndarray) -> np.ndarray:
    """A kind (0 is the largest) for each toxic row, by the terms it has; rows of unit length."""
    n = len(own)
    if not n:
        return np.zeros(0, np.int64)
    unit = own / np.maximum(1e-9, np.linalg.norm(own, axis=1, keepdims=True))
    first = [int(np.argmax(own.sum(axis=1)))]
    while len(first) < min(KINDS, n):
        first.append(int(np.argmin((unit @ unit[first].T).max(axis=1))))
    centers, kind = unit[first], np.full(n, -1)
    for _ in range(STEPS):
        new = np.argmax(unit @ centers.T, axis=1)
        if (new == kind).all():
            break
        kind = new
        sums = np.array([unit[kind == k].sum(axis=0) for k in range(len(centers))])
        centers = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
    size = np.bincount(kind, minlength=len(centers))
    return np.argsort(np.argsort(-size, kind="stable"), kind="stable")[kind]


def categories(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Rows by CATEGORIES, from the bit that labels give; x are the features, the length last."""
    out = np.zeros((len(x), len(CATEGORIES)))
    at = np.flatnonzero(toxic)
    more = x[at].mean(axis=0) > x[toxic == 0].mean(axis=0)
    more[-1] = False
    out[at, kinds((x[at][:, more] > 0).astype(np.float64))] = 1
    out[:, KINDS] = toxic
    sure = out_of_fold(x, toxic, l2=L2)[at]
    out[at[np.argsort(-sure, kind="stable")[: round(SEVERE * len(at))]], KINDS + 1] = 1
    return out


class Chain:
    """Weights by category, over the features and the earlier categories' probabilities."""

    def __init__(self, vocabulary: list[str], weights: list[np.ndarray]):
        self.vocabulary, self.weights = vocabulary, weights
        self.counter = Vocabulary(vocabulary)

    def features(self, texts: list[str | None]) -> np.ndarray:
        own = [words(t) for t in texts]
        counts = np.array([self.counter.counts(w) for w in own], np.uint32).reshape(len(own), len(self.vocabulary))
        return features(counts, np.array([w.total() for w in own], np.float64))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Rows by categories, each fed to the next."""
        out = np.zeros((len(x), len(CATEGORIES)))
        for k, w in enumerate(self.weights):
            out[:, k] = predict(np.hstack([x, out[:, :k]]), w)
        return out

    @classmethod
    def fitted(cls, vocabulary: list[str], x: np.ndarray, y: np.ndarray) -> Chain:
        weights, earlier = [], np.zeros((len(x), 0))
        for k in range(y.shape[1]):
            seen = np.hstack([x, earlier])
            weights.append(logistic(seen, y[:, k], L2))
            earlier = np.hstack([earlier, out_of_fold(seen, y[:, k], l2=L2)[:, None]])
        return cls(vocabulary, weights)


def read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: the words of labelled texts and how often they occur."""
    for batch in batches:
        own = [words(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([list(w) for w in own], pa.list_(pa.string())), pa.array([list(w.values()) for w in own], pa.list_(pa.int32()))], names=["toxic", "words", "counts"])


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: in how many of the task's toxic and other documents each term occurs."""
    found: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for toxic, own in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
            found[bool(toxic)].update(terms(own))
    both = list(found[0].keys() | found[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([found[k][t] for t in both], pa.int64()) for k in (1, 0))], names=["term", "a", "b"])


def matrix(chosen: list[str]):
    """Map function: counts of the chosen terms and the length."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Vocabulary(chosen)
        for batch in batches:
            own = [dict(zip(w, n, strict=True)) for w, n in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            counts, lengths = [counter.counts(w).astype("<u4").tobytes() for w in own], [sum(w.values()) for w in own]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(counts, pa.binary()), pa.array(lengths, pa.int64())], names=["toxic", "x", "n"])

    return run_task


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, chosen: int = CHOSEN) -> Chain:
    """The chain, fitted on about ``train_rows`` labelled rows taken by a hash of doc_id."""
    bounded_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").distinct()
    n = usable.count()
    if n > train_rows:
        usable = usable.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < (1 << 30) * train_rows // n)
    # The sample has a bounded number of rows, so it is broadcast and the documents stay where they are.
    # One row for each id and label, however many documents or labels repeat it.
    sample = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(usable), F.col("id") == F.col("doc_id"))
    sample = sample.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    rows = reliable(sample.repartition(TRAIN_TASKS).mapInArrow(read_words, "toxic int, words array<string>, counts array<int>"))
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (total.get(0) and total.get(1)):
        return Chain([], [])
    counts = rows.mapInArrow(shares, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share_a, share_b = (F.col("a") + 0.5) / (total[1] + 1.0), (F.col("b") + 0.5) / (total[0] + 1.0)
    spread = F.sqrt(share_a * (1 - share_a) / total[1] + share_b * (1 - share_b) / total[0])
    apart = counts.withColumn("apart", F.abs(share_a - share_b) / spread)
    best = apart.orderBy(F.desc("apart"), "term").limit(chosen)
    vocabulary = sorted(r.term for r in best.collect())
    found = rows.mapInArrow(matrix(vocabulary), "toxic int, x binary, n long").collect()
    found.sort(key=lambda r: (r.toxic, r.n, r.x))  # the same order, whichever task they came from
    counts = np.frombuffer(b"".join(r.x for r in found), "<u4").reshape(len(found), len(vocabulary))
    x = features(counts, np.array([r.n for r in found], np.float64))
    return Chain.fitted(vocabulary, x, categories(x, np.array([r.toxic for r in found], np.float64)))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and a probability for each category, of every whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((chain.vocabulary, chain.weights))

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*shared.value)
        for batch in batches:
            p = own.probabilities(own.features(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(CATEGORIES)))], names=["doc_id", *CATEGORIES])

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run_task, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = score(docs, chain)
    return p.select("doc_id", *(F.col(c).alias(f"p_{c}") for c in CATEGORIES), (F.col("toxic") >= 0.5).alias("toxic"))
