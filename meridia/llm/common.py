"""What the text operators share: bounded Arrow batches, reliable checkpoints, input columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.sources import shared

#: Rows in an Arrow batch. Texts can be very long, so Spark's default of 10,000 is too many.
BATCH_ROWS = 256
#: Rows of a few numbers each up to which a table is broadcast (some 50 MB), by its count.
FEW_ROWS = 1_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Python workers' memory bounded: batches of a few hundred rows, not ten thousand."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (see ``shared.folder``), set for checkpoints."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared.folder(spark))
    return context._jsc.sc().getCheckpointDir().get()


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the operators size their own key spaces by it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_names(text: str = "text") -> list[Column]:
    """doc_id, k1 and k2: with 128 bits that stand for its text, a row's name."""
    return [F.col("doc_id").cast("long").alias("doc_id"), *(F.xxhash64(F.lit(i), F.col(text).cast("binary")).alias(f"k{i}") for i in (1, 2))]


def sized(df: DataFrame) -> DataFrame:
    """The checkpointed rows, to be broadcast if there are FEW_ROWS at most."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` but for the rows that ``judged`` (doc_id, k1, k2, stays) names;
    of those with one name that stays, one stays. Rows that are not named stay where they are,
    as long as FEW_ROWS are named at most."""
    judged = reliable(judged.select("doc_id", "k1", "k2", "stays"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_names()).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("d.k1") == F.col("j.k1")) & (F.col("d.k2") == F.col("j.k2"))
    out = rows.join(sized(judged).alias("j"), same, "left_anti").select("row.*")
    staying = judged.filter("stays")
    if not staying.isEmpty():
        alike = rows.join(sized(staying).alias("j"), same, "left_semi")
        out = out.unionByName(alike.groupBy("doc_id", "k1", "k2").agg(F.first("row").alias("row")).select("row.*"))
    return out


def larger(batches: Iterator[pa.RecordBatch], rows: int, most_bytes: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many rows or bytes, but for the last; none is empty."""
    held, n, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= most_bytes:
            yield pa.concat_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)
