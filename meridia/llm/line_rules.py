"""Quality rules by cross-document line frequency, in DataFrame functions throughout.

Lines are normalised (trimmed, inner white space as one space, lower case) and hashed with their
host; a line counts once for each document of the host that has it. Lines that more than
``max_docs`` documents of one host share are removed from the texts, and a document is depleted
and rejected if the text that is left lacks more than ``max_lost`` of its words. Base statistics
are those of whole texts, computed inside each row on arrays of words and lines, so that no word
is ever shuffled.

Lines are counted and found by their hashes alone. A text is read once for them and once for its
statistics and the removal; a host and 128 bits that stand for its text name it in between, so
rows need no numbers. Counts are combined before their shuffle. A bitmap tells which documents
may have a line to remove (all that do, and one in ten of the others); only their texts are moved,
in a plain join that adaptive execution can split, so that many copies are no one task's work.

Defined results: a null text has no words, fails the base rules and stays null; a null source is
a host of its own; every row is a document, so repeated rows count as many; lines without a word
are never removed, and a text that loses all its lines is empty; an empty table gives an empty
result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import documents, reliable, sized

WHITE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS = 100
MAX_LOST = 0.5
#: What stands for a host and a text, and bits of one row of the bitmap over them (Spark's own size).
NAME = ("k1", "k2")
BITMAP_BITS = 32_768
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def words_of(text: Column) -> Column:
    """Words of a text that is trimmed already."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, GAP))


def statistics(rows: DataFrame) -> DataFrame:
    """The rows (with a text), and the base statistics of each."""
    t = rows.withColumn("whole", F.coalesce("text", F.lit("")))
    t = t.withColumn("line", F.filter(F.split("whole", "\n"), lambda x: trimmed(x) != ""))
    t = t.withColumn("word", words_of(trimmed(F.col("whole"))))
    t = t.select(
        *rows.columns, "word",
        F.size("word").cast("long").alias("n_words"),
        F.length(F.array_join("word", "")).cast("long").alias("word_chars"),
        (F.size(F.split("whole", SYMBOL)) - 1).cast("long").alias("n_symbols"),
        (F.size("line") - F.size(F.array_distinct("line"))).cast("long").alias("n_dup_lines"),
    )
    # Hashes of three-word windows. Sorted with their places, equal ones stand side by side.
    third = F.transform(
        F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.col("word")[i], F.col("word")[i + 1], F.col("word")[i + 2]).alias("h"), i.alias("i")),
    )
    t = t.withColumn("window", third)
    t = t.withColumn("repeats", F.size(F.array_distinct("window.h")) < F.size("window"))
    t = t.withColumn("window", F.when(F.col("repeats"), F.sort_array("window")).otherwise(F.slice("window", 1, 0)))
    window = F.col("window")

    def twice(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(window, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(window, i + 1)["h"] == x["h"], F.lit(False))

    t = t.withColumn("place", F.transform(F.filter("window", twice), lambda x: x["i"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform("place", lambda i: F.array(i, i + 1, i + 2)))))
    return t.select(*rows.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def named(docs: DataFrame) -> DataFrame:
    """doc_id, host, text, and k1 and k2: with 128 bits, the name of a host and a text."""
    rows = docs.select("doc_id", F.col("source").alias("host"), "text")
    return rows.select("*", *(F.xxhash64(F.lit(i), "host", F.coalesce("text", F.lit(""))).alias(k) for i, k in enumerate(NAME)))


def frequent_lines(rows: DataFrame, max_docs: int) -> DataFrame:
    """(k1, k2, gone): places in a text, from 0, of lines that more than ``max_docs`` documents of its host share."""
    line = F.split(F.coalesce("text", F.lit("")), "\n")
    hashes = F.transform(line, lambda x: F.when(trimmed(x) != "", F.xxhash64("host", F.lower(F.regexp_replace(trimmed(x), GAP, " ")))))
    lines = reliable(rows.select(*NAME, hashes.alias("h")))
    once = lines.select(F.explode(F.array_distinct(F.array_compact("h"))).alias("h"))
    frequent = sized(reliable(once.groupBy("h").count().filter(F.col("count") > max_docs).select("h")))
    places = lines.select(*NAME, F.posexplode("h").alias("i", "h")).join(frequent, "h")
    return reliable(places.groupBy(*NAME).agg(F.collect_set("i").alias("gone")))


def marked(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows, and ``maybe``: false only where a row's name is not in ``gone``."""
    # Ten bits a name.
    cell = F.pmod("k1", F.lit(1 + 10 * gone.count() // BITMAP_BITS)).alias("cell")
    bit = F.pmod("k2", F.lit(BITMAP_BITS))
    bitmap = gone.select(cell, bit.alias("bit")).groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod((byte / F.pow(F.lit(2), bit % 8)).cast("int"), F.lit(2)) == 1
    out = rows.select("*", cell).join(F.broadcast(reliable(bitmap)), "cell", "left")
    return out.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias("maybe"))


def stripped(docs: DataFrame, max_docs: int, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The rows that ``prepare`` makes of the documents, and gone and left: the places of lines that more than
    ``max_docs`` documents of a host share (null: none), and the text without them."""
    rows = named(docs)
    gone = frequent_lines(rows, max_docs)
    own, none = prepare(marked(rows, gone)), F.lit(None).cast("array<int>")
    moved = own.filter("maybe").join(gone, list(NAME), "left")
    own = moved.unionByName(own.filter("not maybe").withColumn("gone", none))
    own = own.withColumn("line", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("line") - 1), "gone")
    left = F.array_join(F.transform(stay, lambda i: F.get("line", i)), "\n")
    return own.withColumn("left", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)).drop("line", "maybe", *NAME)


def judged(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document: doc_id, the base statistics, base_failed, kept, lost_words, and left, its text without frequent lines."""
    t = stripped(docs, max_docs, statistics)
    lost = F.when(F.col("gone").isNull(), 0).otherwise(F.col("n_words") - F.size(words_of(trimmed(F.col("left")))))
    t = t.withColumn("lost_words", lost.cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    t = t.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words"))
    return t.withColumn("kept", kept).select(*COLUMNS, "left")


def line_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST, min_words: int = MIN_WORDS) -> DataFrame:
    """The same without the texts."""
    return judged(docs, max_docs, max_lost, min_words).select(*COLUMNS)


def clean_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id and text without the lines that more than ``max_docs`` documents of a host share."""
    return stripped(docs, max_docs).select("doc_id", F.col("left").alias("text"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(documents(spark, sf_dir))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT doc_id, host, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
g AS (
  SELECT doc_id, i, w AS a, lead(w) OVER p AS b, lead(w, 2) OVER p AS c
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
),
r AS (
  SELECT doc_id, i FROM g WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1
),
k AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id
),
l AS (
  SELECT doc_id, host, lower(regexp_replace(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, host, unnest(ls) AS line FROM s)
),
f AS (SELECT host, line FROM l GROUP BY host, line HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
x AS (
  SELECT l.doc_id, sum(len(regexp_split_to_array(l.line, ' '))) AS n
  FROM l JOIN f ON l.line = f.line AND l.host IS NOT DISTINCT FROM f.host GROUP BY l.doc_id
),
z AS (
  SELECT s.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(k.n, 0) AS n_repeat_words, coalesce(x.n, 0) AS lost_words
  FROM s LEFT JOIN k ON k.doc_id = s.doc_id LEFT JOIN x ON x.doc_id = s.doc_id
),
y AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM z)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND lost_words <= {MAX_LOST} * n_words AS kept, CAST(lost_words AS BIGINT) AS lost_words
FROM y
"""
