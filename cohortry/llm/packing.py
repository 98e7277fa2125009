"""Packing token sequences: first-fit decreasing in randomised groups.

Documents become pieces of at most ``SIZE`` tokens; full pieces fill a sequence each. The
rest goes, by a hash of the document, into groups of about ``GROUP`` pieces. In each group
the pieces, longest first, go into the first sequence with room; a tournament tree over
the room left finds it in logarithmic time. Only lengths travel; tokens stay in the stored
piece table until sequences are assembled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import keep, scratch
from cohortry.llm.tokens import Encoder

SIZE = 2048
#: Pieces of a group, on average: enough for little padding, few enough for one task's memory.
GROUP = 20_000


def first_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) per piece: longest first (ties in the given order), each into the first bin with room.

    The tree's leaves hold the room of the bins in order, every inner node the larger of its
    two children, so the first bin with room is found by going left wherever that side has
    enough.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [size] * (2 * leaves)
    for i in np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable").tolist():
        need = int(lengths[i])
        if need > size:
            raise ValueError(f"a piece of {need} tokens does not fit into {size}")
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, size - room[at]
        room[at] -= need
        at //= 2
        while at:
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
            at //= 2
    return bins, offsets


def cut_pieces(docs: DataFrame, encoder: Encoder, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian 32-bit) per piece of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = [], []
            for row, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                raw, n = ids.astype("<u4").tobytes(), len(ids)
                for start in range(0, n, size):
                    part = raw[4 * start : 4 * (start + size)]
                    own.append(row)
                    out.append((start, len(part) // 4, zlib.crc32(part), n, part))
            columns = [batch.column("doc_id").take(pa.array(own, pa.int64()))]
            columns += [pa.array([x[k] for x in out], pa.int64()) for k in range(4)] + [pa.array([x[4] for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(pieces: DataFrame, size: int = SIZE, group: int = GROUP, seed: int = 7) -> DataFrame:
    """Pieces (with length and uid) plus sequence_id and offset, packed group by group."""
    groups = -(-pieces.count() // group) or 1
    which = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), size)
        return rows.drop(columns="__group").assign(sequence_id=(int(key[0]) << 32) | bins, offset=offsets)

    grouped = pieces.withColumn("__group", which).groupBy("__group")
    return grouped.applyInPandas(pack, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, encoder: Encoder, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(placed pieces, stored pieces with their ids); ``assemble`` joins the two into padded sequences.

    Null texts are empty documents, whose only token is the end id. Repeated rows are packed
    each. Rows with a null doc_id are packed like any other. An empty table gives no pieces.
    """
    at = scratch(docs.sparkSession, "packing")
    stored = keep(cut_pieces(docs, encoder, size).withColumn("uid", F.monotonically_increasing_id()), f"{at}/pieces")
    return place(stored.drop("ids"), size), stored


def padded_length(length: Column, size: int = SIZE) -> Column:
    """Length of a stored sequence: ``size``, but a length that is a power of two stays as it is."""
    return F.when(F.bit_count(length) == 1, length).otherwise(F.lit(size)).cast("long")


def assemble(placed: DataFrame, stored: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens, doc_ids, ids (array, padded) of every sequence."""
    rows = placed.select("uid", "doc_id", "sequence_id", "offset", "length").join(stored.select("uid", "ids"), "uid")
    whole = rows.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"),
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    whole = whole.select("sequence_id", "n_tokens", F.col("parts.doc_id").alias("doc_ids"), joined.alias("raw"), padded_length(F.col("n_tokens"), size).alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, to in zip(batch.column("raw").to_pylist(), batch.column("to").to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype="<u4")
                out.append(np.pad(ids, (0, to - len(ids)), constant_values=pad))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([x.astype(np.int64) for x in out], pa.list_(pa.int64()))],
                names=["sequence_id", "n_tokens", "doc_ids", "ids"],
            )

    kind = placed.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"sequence_id long, n_tokens long, doc_ids array<{kind}>, ids array<long>")
