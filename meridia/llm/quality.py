"""Quality classification by co-training on two views of a document.

The text view looks at the content: how words repeat, their case and length, what other marks
there are, how lines are laid out. The metadata view looks at what is known about the page without
reading it, and at nothing else: source, language and stated length. Each view has a logistic model, fitted
first on labelled rows. In each round both models score every document; the documents that one view
is confident about become pseudo-labelled rows for the other, which is fitted again on its
labelled rows and those (by the gradient and Hessian of their loss at the weights they were found
with). Pseudo-labels of a class weigh as much in all as its labelled rows. After every fit each view's
log-odds are calibrated, Platt's way, on scores of labelled rows by models that were fitted without
them, so that confidence means the same in every round; the calibrated sum of both views, fitted
on the same scores, is what documents are scored by in the end.

Features are a few dozen numbers a document, computed once where its row is read and kept by a
checkpoint. A round is one pass over them: tasks return sums (gradient and Hessian by view and
class), which are added up in a fixed number of slots before they come to the driver. Only a
bounded sample of labelled rows is ever collected.

Defined results: a null text counts as empty; a null source, language or length is a value of
its own; without labelled rows of both classes every score is 1 and every document is kept;
null labels are left out, a label that is repeated counts once, and of documents that repeat an id one is learnt from; a null doc_id is scored like any other;
an empty table gives an empty result; columns other than doc_id, text, lang, source and n_chars
are ignored by ``score`` and kept by ``accept``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import bounded_batches, documents, reliable
from meridia.llm.linear import Quadratic, log_odds, logistic, out_of_fold, platt, predict, sigmoid, with_bias

#: Labelled rows that the models are fitted on, about, however many there are.
TRAIN_ROWS = 20_000
ROUNDS = 3
CONFIDENT = 0.95
L2 = 1.0
SLOTS = 32
HOSTS, LANGS = 24, 8
MARKS = "!?.,;:|#*$%&<>_-=/\\\"'()[]{}"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def content(text: str) -> list[float]:
    """The text view of a document."""
    n = max(1, len(text))
    words = text.split()
    k = max(1, len(words))
    low = [w.lower() for w in words]
    pairs = len(set(zip(low, low[1:], strict=False))) / max(1, k - 1)
    same = sum(a == b for a, b in zip(low, low[1:], strict=False)) / k
    letters = sum(map(str.isalpha, words)) / k
    upper = sum(map(str.isupper, words)) / k
    title = sum(map(str.istitle, words)) / k
    marks = [text.count(c) for c in MARKS]
    total = sum(marks)
    size = len("".join(words)) / k
    stops = text.count(". ") + text.count(".\n")
    per_word = [
        marks[0] / k, marks[6] / k, sum(marks[7:13]) / k, (marks[2] + marks[3]) / k, total / k,
        len(set(low)) / k, pairs, same, letters, upper, title, stops / k,
    ]
    per_char = [total / n, sum(map(text.count, "0123456789")) / n]
    per_char += [sum(not (c.isalnum() or c.isspace()) for c in set(text)) / 32]
    return [*per_word, *per_char, min(size, 40) / 10, np.log1p(k), *np.sqrt(np.clip(per_word, 0, None))]


def layout(text: str) -> list[float]:
    """How a text's lines are laid out."""
    lines = text.split("\n")
    sizes = [len(x) for x in lines]
    filled = [x for x in lines if x.strip()]
    n = max(1, len(filled))
    mean = sum(sizes) / len(sizes)
    spread = (sum((s - mean) ** 2 for s in sizes) / len(sizes)) ** 0.5
    return [
        np.log1p(len(lines)), np.log1p(mean), np.log1p(max(sizes)), np.log1p(min(sizes)), spread / (mean + 1),
        1 - len(filled) / len(lines), 1 - len(set(filled)) / n, len(lines) / max(1.0, np.log1p(len(text))),
    ]


def page(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """The metadata view of a document."""
    host, tongue = np.zeros(HOSTS + 1), np.zeros(LANGS + 1)
    host[HOSTS if source is None else zlib.crc32(source.encode()) % HOSTS] = 1
    tongue[LANGS if lang is None else zlib.crc32(lang.encode()) % LANGS] = 1
    length = np.log1p(max(0, n_chars or 0))
    return [length, length**2 / 10, float(n_chars is None), *host, *tongue]


def both(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[list[float], list[float]]:
    return [*content(text or ""), *layout(text or "")], page(lang, source, n_chars)


def read_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: the features of both views, as 32-bit numbers, after what else the rows have."""
    for batch in batches:
        rows = [both(*r) for r in zip(*(batch.column(c).to_pylist() for c in COLUMNS[1:]), strict=True)]
        packed = [pa.array([np.array(r[v], "<f4").tobytes() for r in rows], pa.binary()) for v in (0, 1)]
        kept = [c for c in batch.schema.names if c not in COLUMNS[1:]]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *packed], names=[*kept, "view0", "view1"])


def unpack(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1).astype(np.float64)


class Model(NamedTuple):
    """By view: shift and scale of its features, weights, calibration; then the combination."""

    shift: list[np.ndarray]
    scale: list[np.ndarray]
    weights: list[np.ndarray]
    calibration: list[tuple[float, float]]
    combination: np.ndarray

    def standard(self, view: int, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.shift[view]) / self.scale[view], -6, 6)

    def view(self, view: int, x: np.ndarray) -> np.ndarray:
        """A view's calibrated probabilities of standardised features."""
        a, b = self.calibration[view]
        return sigmoid(a * log_odds(predict(x, self.weights[view])) + b)

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        """Probability and both views' own, of raw features; columns."""
        if not len(self.weights):
            return np.ones((len(x[0]), 3))
        p = [self.view(v, self.standard(v, x[v])) for v in (0, 1)]
        return np.stack([predict(np.stack([log_odds(q) for q in p], axis=1), self.combination), *p], axis=1)


NONE = Model([], [], [], [], np.zeros(0))


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Count, gradient and Hessian of the logistic loss at w, in a row."""
    a = with_bias(x)
    p = predict(x, w)
    return np.concatenate([[len(x)], a.T @ (p - y), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])


def pseudo_labels(shared, slots: int):
    """Map function: what each view learns from the other's confident documents, by class."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model: Model = shared.value
        sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [model.standard(v, unpack(batch.column(f"view{v}"))) for v in (0, 1)]
            p = [model.view(v, x[v]) for v in (0, 1)]
            got = []
            for learner in (0, 1):
                teacher = p[1 - learner]
                for y, sure in ((0.0, teacher <= 1 - CONFIDENT), (1.0, teacher >= CONFIDENT)):
                    got.append(newton_sums(x[learner][sure], np.full(sure.sum(), y), model.weights[learner]))
            sums = got if sums is None else [a + b for a, b in zip(sums, got, strict=True)]
        if sums is not None:
            slot = TaskContext.get().partitionId() % slots
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([np.concatenate(sums).astype("<f8").tobytes()], pa.binary())], names=["slot", "sums"])

    return run_task


def add_up(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, "<f8") for b in table.column("sums").to_pylist())
    return table.slice(0, 1).set_column(1, "sums", pa.array([total.tobytes()], pa.binary()))


def learned(model: Model, x: list[np.ndarray], y: np.ndarray, more: list[Quadratic | None]) -> Model:
    """The model fitted on labelled rows and pseudo-labels; calibrations and combination by
    scores of rows that the scoring models were not fitted on."""
    weights = [logistic(x[v], y, L2, more=more[v]) for v in (0, 1)]
    odds = [log_odds(out_of_fold(x[v], y, l2=L2, more=more[v])) for v in (0, 1)]
    calibration = [platt(o, y) for o in odds]
    even = [a * o + b for (a, b), o in zip(calibration, odds, strict=True)]
    return model._replace(weights=weights, calibration=calibration, combination=logistic(np.stack(even, axis=1), y, l2=1e-2))


def weighed(sums: np.ndarray, model: Model, y: np.ndarray) -> list[Quadratic | None]:
    """By view, the loss of its pseudo-labelled rows; each class weighs as its labelled rows at most."""
    out, at = [], 0
    for v in (0, 1):
        d, total = len(model.weights[v]), 0.0
        for label in (0.0, 1.0):
            own = sums[at : at + 1 + d + d * d]
            at += len(own)
            if own[0]:
                total = total + own[1:] * min(1.0, (y == label).sum() / own[0])
        out.append(None if isinstance(total, float) else Quadratic(model.weights[v], total[:d], total[d:].reshape(d, d)))
    return out


def co_train(features: DataFrame, labels: DataFrame, rounds: int = ROUNDS, train_rows: int = TRAIN_ROWS) -> Model:
    """The model, from about ``train_rows`` labelled rows and all documents' features."""
    spark = features.sparkSession
    usable = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").distinct()
    n = usable.count()
    if n > train_rows:
        usable = usable.filter(F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 30)) < (1 << 30) * train_rows // n)
    # One row for each id and label, however many documents or labels repeat it.
    labelled = features.join(F.broadcast(usable), F.col("id") == F.col("doc_id")).groupBy("id", "y").agg(F.min(F.struct("view0", "view1")).alias("views"))
    rows = labelled.select("id", "y", "views.*").collect()
    rows.sort(key=lambda r: (r.id, r.y, r.view0, r.view1))
    y = np.array([r.y for r in rows])
    if len(np.unique(y)) < 2:
        return NONE
    raw = [np.frombuffer(b"".join(r[f"view{v}"] for r in rows), "<f4").reshape(len(rows), -1).astype(np.float64) for v in (0, 1)]
    model = Model([x.mean(axis=0) for x in raw], [x.std(axis=0) + 1e-3 for x in raw], [], [], np.zeros(0))
    x = [model.standard(v, raw[v]) for v in (0, 1)]
    model = learned(model, x, y, [None, None])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        found = features.mapInArrow(pseudo_labels(shared, SLOTS), "slot int, sums binary").groupBy("slot").applyInArrow(add_up, "slot int, sums binary").collect()
        if not found:
            break
        sums = sum(np.frombuffer(r.sums, "<f8") for r in sorted(found, key=lambda r: r.slot))
        model = learned(model, x, y, weighed(sums, model, y))
    return model


def features_of(docs: DataFrame, rows: bool = False) -> DataFrame:
    """doc_id and the features of both views of every whole document, behind a checkpoint; with
    ``rows`` the rows as they are in a column of that name."""
    bounded_batches(docs.sparkSession)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"),
        *([F.struct(*docs.columns).alias("row")] if rows else []),
    )
    schema = own.drop(*COLUMNS[1:]).withColumns({f"view{v}": F.lit(None).cast("binary") for v in (0, 1)}).schema
    return reliable(own.mapInArrow(read_features, schema))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row for each document: doc_id, quality, the views' own probabilities, kept."""
    features = features_of(docs)
    scored = judged(features, co_train(features, labels))
    return scored.withColumn("kept", F.col("quality") >= threshold)


def judged(features: DataFrame, model: Model) -> DataFrame:
    """The columns of ``features`` but for the views, and quality, p_text, p_page."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    kept = features.drop("view0", "view1")

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = shared.value.score([unpack(batch.column(f"view{v}")) for v in (0, 1)])
                own = [c for c in batch.schema.names if c not in ("view0", "view1")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(p[:, k]) for k in range(3))], names=[*own, "quality", "p_text", "p_page"])

    schema = kept.withColumns({c: F.lit(0.0) for c in ("quality", "p_text", "p_page")}).schema
    return features.mapInArrow(run_task, schema)


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose quality reaches the threshold.

    Rows are kept beside their features, so that each text is read once and none is shuffled, and
    rows without an id or with the same id are each judged by themselves.
    """
    features = features_of(docs, rows=True)
    return judged(features, co_train(features, labels)).filter(F.col("quality") >= threshold).select("row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
