"""Document fingerprints: bottom-k sketches of word shingles, in column expressions only.

A sketch is the ``SIZE`` smallest different hashes of a text's shingles (``WIDTH`` words
each), in order. The bottom of the union of two sketches is the sketch of the two texts
together, so sketches of parts merge; how many of its values both sides hold estimates
resemblance, and the largest of them the number of different shingles.

Null texts are empty. An empty text, or one of white space only, has the empty sketch. A
text with fewer words than a shingle is one shingle. Texts are taken whole at any length;
a text is one row's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import keep, scratch

WIDTH = 5
SIZE = 128
#: Hexadecimal digits kept of a shingle's md5: 48 bits.
DIGITS = 12
SPAN = float(16**DIGITS)
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most rows of the list of cells that is broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Ids of one window when documents are put in order; so many different ids at most meet in a task's group.
CELL = 4096
#: The cell of null ids, before those of all numbers.
FIRST_CELL = -(1 << 60)


# --- sketches as columns -----------------------------------------------------


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value computed once: inside a lambda a plain expression would run for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sketch(text: Column, width: int = WIDTH, size: int = SIZE) -> Column:
    """The ``size`` smallest different shingle hashes of a text, ascending."""

    def hashes(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - F.lit(width - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, width), " ")), 1, DIGITS))

    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    empty = F.array().cast("array<string>")
    return _let(words, lambda w: F.when(F.size(w) == 0, empty).otherwise(bottom(hashes(w), size)))


def bottom(values: Column, size: int = SIZE) -> Column:
    """The smallest different values of an array, ascending."""
    return F.slice(F.sort_array(F.array_distinct(values)), 1, size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of different shingles; exact below ``size``."""
    largest = F.conv(F.element_at(a, size), 16, 10).cast("double") + 1
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) * SPAN / largest)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty ones, 0 for one.

    Exact while the two sets together have at most ``size`` shingles.
    """

    def share(both: Column) -> Column:
        union, common = both["union"], both["common"]
        shared = F.size(F.filter(common, lambda x: x <= F.element_at(union, -1)))
        return F.when(F.size(union) == 0, 1.0).otherwise(shared / F.size(union))

    return _let(F.struct(merge(a, b, size).alias("union"), F.array_intersect(a, b).alias("common")), share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b holds: resemblance times union over a; 1 for an empty a."""
    union = distinct_shingles(merge(a, b, size), size)
    share = resemblance(a, b, size) * union / distinct_shingles(a, size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(share, F.lit(1.0)))


def to_text(a: Column) -> Column:
    """A sketch as one string: its values, each of ``DIGITS`` hexadecimal digits, in order."""
    return F.array_join(a, "")


def from_text(text: Column) -> Column:
    """The sketch a string stands for."""
    return F.regexp_extract_all(text, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def merge_by(sketches: DataFrame, keys: list[str], column: str, size: int = SIZE) -> DataFrame:
    """One sketch per group: the smallest ``size`` different values of all its rows' sketches.

    Values are made distinct first, spread by value, and each task keeps only ``size`` per
    group before the groups meet, so a hot group costs no more than any other. Groups whose
    rows are all empty get the empty sketch; null keys are one group.
    """
    values = sketches.select(*keys, F.explode_outer(column).alias("__v")).distinct()
    order = Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_last())
    least = values.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= size)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias(column))


# --- documents in order ------------------------------------------------------


def _cells(rows: DataFrame) -> DataFrame:
    """(first, cell): the smallest id of every cell, and the cell before it; before the first comes the last.

    Cells are put in order by ranges; what crosses from one range to the next is one row a range.
    """
    first = rows.groupBy("__cell").agg(F.min("doc_id").alias("first"))
    ranged = first.repartitionByRange("__cell").withColumn("__p", F.spark_partition_id())
    before = F.lag("__cell").over(Window.partitionBy("__p").orderBy("__cell"))
    ranged = ranged.withColumn("__before", before)
    # One row per range: as many as shuffle partitions, whatever the number of rows.
    order = Window.orderBy("__p")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = F.coalesce(F.lag("__last").over(order), F.last("__last").over(everything))
    ends = ranged.groupBy("__p").agg(F.max("__cell").alias("__last")).select("__p", carry.alias("__carry"))
    return ranged.join(ends, "__p").select("first", F.coalesce("__before", "__carry").alias("cell"))


def with_next(docs: DataFrame, **per_document: Column) -> DataFrame:
    """``doc_id``, ``text``, ``per_document`` and the same of the next document as ``next_...``.

    The next document is that of the next larger id, and after the last comes the first; a
    document alone is its own next. Null ids come before all others; rows of one id follow
    each other in order of their texts. Null texts are empty.

    Documents move once, to the window of their ``CELL`` ids. The first of each window is
    also sent to the window before it: one in ``CELL`` where ids are dense, each at most.
    ``per_document`` (expressions over doc_id and text) is computed after the move.
    """
    cell = F.coalesce(F.floor(F.col("doc_id") / CELL).cast("long"), F.lit(FIRST_CELL))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("__cell", cell)
    first = keep(_cells(rows), scratch(docs.sparkSession, "cells"))
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    guests = rows.drop("__cell").join(first, F.col("doc_id").eqNullSafe(F.col("first")))
    guests = guests.select("doc_id", "text", F.col("cell").alias("__cell"), F.lit(True).alias("__guest"))
    placed = rows.withColumn("__guest", F.lit(False)).unionByName(guests).repartition("__cell")
    placed = placed.withColumns(per_document)
    order = Window.partitionBy("__cell").orderBy("__guest", F.col("doc_id").asc_nulls_first(), "text")
    names = ["text", *per_document]
    following = {f"next_{n}": F.lead(n).over(order) for n in names}
    return placed.withColumns(following).where("NOT __guest").select("doc_id", *names, *following)


def edit(text: Column, other: Column) -> Column:
    """The last half (rounded down) of a text's code points replaced by the first as many, or all, of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that to the next document.

    Returns doc_id, n_chars (code points of the text), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. One row per row of ``docs``, repeated ids and
    rows included; an empty table gives none. Other columns are not looked at.
    """
    rows = with_next(docs, sketch=sketch(F.col("text"), width, size))
    edited = rows.withColumn("edited", edit(F.col("text"), F.col("next_text")))
    edited = edited.withColumn("edited_sketch", sketch(F.col("edited"), width, size))
    return edited.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        to_text(F.col("sketch")).alias("fingerprint"),
        to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), size).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), size).alias("near_next"),
    )
