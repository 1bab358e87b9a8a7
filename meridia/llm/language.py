"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of characters that are not letters becomes one space, and each
n-gram of 1 to 3 characters counts in one of 2**15 buckets. The matrix of log-probabilities
(languages by buckets) is broadcast, and batches of texts are scored at once: the rows of the
matrix for all n-grams of the batch, summed by text, and the log of each language's share of the
rows that were learnt from.

The model is fitted on a bounded sample of the labelled rows it may learn from; it sees text and
language only. Prediction covers every whole text.

Defined results: a text that is null or has no letter gets ``und`` with score 0, as does every
text if there is nothing to learn from; equal likelihoods go to the first language in order; a
language of which no text has a letter is none to learn; a null doc_id is held out never (it has no remainder) and repeated rows are rows of their own; an
empty table gives an empty result; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import bounded_batches, documents, reliable

BITS = 15
BUCKETS = 1 << BITS
ORDERS = 3
#: Characters whose n-grams are looked at together.
SPAN = 1 << 18
#: Rows that the model is fitted on, about, however many are labelled.
TRAIN_ROWS = 20_000
TRAIN_TASKS = 32
BLOCK = 1024
SMOOTH = 0.5

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point, whether it is a letter; made once in a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def codes(text: str | None) -> np.ndarray:
    """Lower-cased letters with one space for what is between; empty without letters."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = letters()[raw]
    if not letter.any():
        return raw[:0]
    out = np.where(letter, raw, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[32], out[keep], [32]]).astype(np.uint64)


def buckets(own: np.ndarray, start: int, end: int) -> np.ndarray:
    """Buckets of all n-grams that start at start .. end - 1, orders one after the other."""
    out, h = [], np.zeros(end - start, np.uint64)
    for n in range(ORDERS):
        piece = own[start + n : end + n]
        h = (h[: len(piece)] * np.uint64(0x100000001B3)) ^ (piece + np.uint64(n + 1))
        out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out)


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: n-gram counts by language, in blocks of buckets, and how many texts there were."""
    counts: dict[str, np.ndarray] = {}
    texts: Counter[str] = Counter()
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            own = codes(text)
            texts[lang] += 1
            mine = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for at in range(0, len(own), SPAN):
                mine += np.bincount(buckets(own, at, min(at + SPAN, len(own))), minlength=BUCKETS)
    for lang, mine in counts.items():
        rows = [np.array([texts[lang]]), *mine.reshape(-1, BLOCK)]  # block -1: the number of texts
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(rows)), pa.array(np.arange(-1, len(rows) - 1, dtype=np.int32)), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())],
            names=["lang", "block", "counts"],
        )


def add_up(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, "<i8") for b in table.column("counts").to_pylist())
    return table.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))


class Languages(NamedTuple):
    """Languages in order, their log-probabilities by bucket, and those of the languages themselves."""

    names: list[str]
    table: np.ndarray
    prior: np.ndarray


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Languages:
    """The model.

    ``labelled`` has doc_id, text and lang. Of more than ``train_rows`` rows a sample of about so
    many is taken by a hash of doc_id; at most TRAIN_TASKS tasks count, so that sums of counts,
    and never texts, are brought together.
    """
    bounded_batches(labelled.sparkSession)
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    n = usable.count()
    if n > train_rows:
        usable = usable.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < (1 << 30) * train_rows // n)
    counted = usable.repartition(TRAIN_TASKS).mapInArrow(tally, "lang string, block int, counts binary")
    rows = reliable(counted.groupBy("lang", "block").applyInArrow(add_up, "lang string, block int, counts binary")).collect()
    counts: dict[str, np.ndarray] = {}
    texts = {}
    for r in rows:
        own = np.frombuffer(r.counts, "<i8")
        if r.block < 0:
            texts[r.lang] = int(own[0])
        else:
            counts.setdefault(r.lang, np.zeros(BUCKETS))[r.block * BLOCK : (r.block + 1) * BLOCK] = own
    names = sorted(x for x, own in counts.items() if own.any())
    table = np.array([counts[x] for x in names]).reshape(-1, BUCKETS)
    table = (table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    prior = np.array([texts[x] for x in names], np.float64)
    return Languages(names, np.log(table), np.log(prior / max(1.0, prior.sum())))


class Scorer:
    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray | float = 0.0):
        self.langs, self.rows, self.prior = langs, np.ascontiguousarray(table.T), prior

    def likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods by text and language, and which texts have a letter."""
        out = np.zeros((len(texts), len(self.langs)))
        some = np.zeros(len(texts), bool)
        held, of, n = [], [], 0

        def flush() -> None:
            nonlocal held, of, n
            if held:
                starts = np.cumsum([0, *map(len, held[:-1])])
                sums = np.add.reduceat(self.rows[np.concatenate(held)], starts, axis=0)
                np.add.at(out, of, sums)
            held, of, n = [], [], 0

        for i, text in enumerate(texts):
            own = codes(text)
            some[i] = len(own) > 0
            for at in range(0, len(own), SPAN):
                held.append(buckets(own, at, min(at + SPAN, len(own))))
                of.append(i)
                n += len(held[-1])
                if n >= SPAN:
                    flush()
        flush()
        return out, some

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        like, some = self.likelihoods(texts)
        like += self.prior
        best = like.argmax(axis=1)
        share = 1.0 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, share, 0.0)


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            pred, score = scorer.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run_task, "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = fit(docs.filter(remainder != 2).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
