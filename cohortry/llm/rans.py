"""Token ids in a compressed binary format: static range asymmetric numeral systems.

One table of symbol frequencies, counted over all ids, serves every block. A block holds
the ids of whole documents, coded by ``LANES`` interleaved coders (id i belongs to lane i
modulo the lanes), and is independent of all others. Checkpoints (states and place in the
code every ``EVERY`` steps) cut a block into segments, each with a checksum of its ids, that
are decoded by tasks of their own. Files hold the blocks of documents in ascending doc_id order.

File:   ``FILE_MAGIC``, crc32 of the table (u32), blocks.
Block:  ``BLOCK_MAGIC``, sizes, checksums of the segments, document table, checkpoints, final
        states, code words.
All numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import forget, keep, scratch
from cohortry.llm.tokens import Encoder

#: Frequencies add up to 2 ** PRECISION.
PRECISION = 20
#: Interleaved coders of a block, and steps between two checkpoints.
LANES = 1024
EVERY = 256
#: Ids after which a block is closed, and bytes after which a file is closed.
BLOCK_IDS = 1 << 19
FILE_BYTES = 16 << 20

#: Segments a reading task decodes on average.
SEGMENTS_A_TASK = 8

FILE_MAGIC = b"RANSIDS2"
BLOCK_MAGIC = b"BLK2"
#: Ids, documents, lanes, steps of a segment, checkpoints, code words, crc32 of the ids.
SIZES = struct.Struct("<QQIIIQI")
LOW = np.uint64(1 << 31)


class Table:
    """Frequencies of symbols 0 .. n-1, scaled to 2 ** PRECISION; every symbol that occurs has at least 1."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.int64)
        total, size = int(counts.sum()), 1 << PRECISION
        if len(counts) and np.count_nonzero(counts) > size:
            raise ValueError("more symbols than the table has room for")
        self.freq = np.zeros(len(counts), dtype=np.int64)
        if total:
            used = counts > 0
            exact = counts[used] / total * size
            freq = np.maximum(np.floor(exact).astype(np.int64), 1)
            # What rounding left over goes to, or comes from, the most frequent symbols.
            order = np.argsort(-freq, kind="stable")
            spare = size - int(freq.sum())
            while spare:
                take = order[: abs(spare)] if spare > 0 else order[freq[order] > 1][: abs(spare)]
                freq[take] += 1 if spare > 0 else -1
                spare = size - int(freq.sum())
            self.freq[used] = freq
        self._derive()

    def _derive(self) -> None:
        self.first = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        self.freq = self.freq.astype(np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    def __getstate__(self):
        return {"freq": self.freq.astype(np.int64)}

    def __setstate__(self, state):
        self.freq = state["freq"]
        self._derive()


def encode_ids(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, int]]]:
    """(final states, code words, checkpoints). A checkpoint: states and place before step ``every * k``, k = 1, 2, ..."""
    n = len(ids)
    lanes = min(lanes, n)
    steps = -(-n // lanes) if n else 0
    state = np.full(lanes, LOW, dtype=np.uint64)
    freq, first = table.freq[ids], table.first[ids]
    limit = freq << np.uint64(63 - PRECISION)
    out, marks, written = [], [], 0
    low32, up = np.uint64(0xFFFFFFFF), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        full = x >= limit[a:b]
        if full.any():
            words = (x[full] & low32).astype(np.uint32)
            out.append(words)
            written += len(words)
            x = np.where(full, x >> up, x)
        q = x // f
        state[: b - a] = (q << np.uint64(PRECISION)) + (x - q * f) + first[a:b]
        if step % every == 0 and step:
            marks.append((state.copy(), written))
    code = np.concatenate(out[::-1]) if out else np.empty(0, dtype=np.uint32)
    return state, code, [(s, written - w) for s, w in reversed(marks)]


def decode_ids(n: int, lanes: int, state: np.ndarray, code: np.ndarray, table: Table, start: int = 0, stop: int | None = None, place: int = 0) -> np.ndarray:
    """Ids of steps ``start`` .. ``stop`` (all by default), given the states and place in the code before ``start``."""
    steps = -(-n // lanes) if n else 0
    stop = steps if stop is None else min(stop, steps)
    state = state.astype(np.uint64, copy=True)
    out = np.empty(max(0, min(n, stop * lanes) - start * lanes), dtype=np.uint32)
    mask, shift, up = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32)
    symbol, freq, first = table.symbol, table.freq, table.first
    for step in range(start, stop):
        width = min(n, (step + 1) * lanes) - step * lanes
        x = state[:width]
        slot = x & mask
        found = symbol[slot]
        x = freq[found] * (x >> shift) + slot - first[found]
        short = np.flatnonzero(x < LOW)
        if len(short):
            x[short] = (x[short] << up) | code[place : place + len(short)]
            place += len(short)
        state[:width] = x
        out[(step - start) * lanes : (step - start) * lanes + width] = found
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One block of whole documents."""
    state, code, marks = encode_ids(ids, table, lanes, every)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    size = max(1, every * len(state))
    parts = [
        BLOCK_MAGIC,
        SIZES.pack(len(ids), len(doc_ids), len(state), every, len(marks), len(code), _crc(ids)),
        np.array([_crc(ids[k * size : (k + 1) * size]) for k in range(len(marks) + 1)], dtype="<u4").tobytes(),
        known.tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array(lengths, dtype="<u8").tobytes(),
        *[struct.pack("<Q", place) + s.astype("<u8").tobytes() for s, place in marks],
        state.astype("<u8").tobytes(),
        code.astype("<u4").tobytes(),
    ]
    return b"".join(parts)


class Block:
    """A block at ``at`` of an open file; only the sizes and the document table are read at once."""

    def __init__(self, file, at: int):
        self._file, self._at = file, at
        if self._read("S4", 1)[0] != BLOCK_MAGIC:
            raise ValueError("not a block")
        sizes = self._read("u1", SIZES.size).tobytes()
        self.n, docs, self.lanes, self.every, self.marks, self.words, self.crc = SIZES.unpack(sizes)
        self.checksums = self._read("<u4", self.marks + 1)
        known, numbers = self._read("u1", docs), self._read("<i8", docs)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, numbers, strict=True)]
        self.lengths = self._read("<u8", docs).astype(np.int64)
        self._points = self._at
        self._code = self._points + self.marks * (8 + 8 * self.lanes) + 8 * self.lanes
        self.end = self._code + 4 * self.words
        #: Ids of a full segment.
        self.size = max(1, self.every * self.lanes)

    def _read(self, kind: str, count: int, at: int | None = None) -> np.ndarray:
        where = self._at if at is None else at
        width = np.dtype(kind).itemsize * count
        self._file.seek(where)
        found = np.frombuffer(self._file.read(width), dtype=kind, count=count)
        if at is None:
            self._at = where + width
        return found

    def _checkpoint(self, k: int) -> tuple[int, np.ndarray]:
        """Place in the code and states at the start of segment ``k``."""
        if k == 0:
            return 0, self._read("<u8", self.lanes, self._code - 8 * self.lanes)
        at = self._points + (k - 1) * (8 + 8 * self.lanes)
        return int(self._read("<u8", 1, at)[0]), self._read("<u8", self.lanes, at + 8)

    def segment(self, k: int, table: Table, more: int = 0) -> np.ndarray:
        """Ids of segment ``k``, checked, and ``more`` ids after it (at most one segment's), decoded from its checkpoint."""
        place, state = self._checkpoint(k)
        last = self._checkpoint(k + 2)[0] if k + 2 <= self.marks else self.words
        code = self._read("<u4", last - place, self._code + 4 * place)
        stop = (k + 1) * self.every + -(-more // max(1, self.lanes))
        found = decode_ids(self.n, self.lanes, state, code, table, k * self.every, stop)
        if _crc(found[: self.size]) != self.checksums[k]:
            raise ValueError("segment checksum differs")
        return found

    def ids(self, table: Table) -> np.ndarray:
        """All ids, segment by segment, checked."""
        found = np.concatenate([self.segment(k, table) for k in range(self.marks + 1)])
        if _crc(found) != self.crc:
            raise ValueError("block checksum differs")
        return found

    def short(self, k: int, table: Table) -> list[tuple[int, int, int | None, bytes]]:
        """(row, start in the block, doc_id, ids) of the documents no longer than a segment that start in segment ``k``."""
        starts = np.cumsum(self.lengths) - self.lengths
        mine = np.flatnonzero((np.minimum(starts // self.size, self.marks) == k) & (self.lengths <= self.size))
        if not len(mine):
            return []
        first, ends = k * self.size, starts[mine] + self.lengths[mine]
        raw = self.segment(k, table, max(0, int(ends.max()) - first - self.size)).astype("<u4").tobytes()
        return [(int(i), int(starts[i]), self.doc_ids[i], raw[4 * (int(starts[i]) - first) : 4 * (int(e) - first)]) for i, e in zip(mine, ends, strict=True)]

    def long(self, k: int, table: Table) -> list[tuple[int, int, int | None, bytes]]:
        """The same for what segment ``k`` holds of documents longer than a segment."""
        starts = np.cumsum(self.lengths) - self.lengths
        first, last = k * self.size, min((k + 1) * self.size, self.n)
        mine = np.flatnonzero((starts < last) & (starts + self.lengths > first) & (self.lengths > self.size))
        if not len(mine):
            return []
        raw = self.segment(k, table).astype("<u4").tobytes()
        cuts = [(max(int(starts[i]), first), min(int(starts[i] + self.lengths[i]), last)) for i in mine]
        return [(int(i), int(starts[i]), self.doc_ids[i], raw[4 * (a - first) : 4 * (b - first)]) for i, (a, b) in zip(mine, cuts, strict=True)]


def token_table(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """part, row, doc_id, n_tokens, ids of every document; parts and rows in them follow ascending doc_id (nulls first)."""
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            found = encoder.encode(batch.column("text").to_pylist())
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int64()),
                    pa.array(range(row, row + n), pa.int64()),
                    batch.column("doc_id"),
                    pa.array([len(x) for x in found], pa.int64()),
                    # Vocabularies of up to 65,536 entries, so two bytes hold an id.
                    pa.array([_narrow(x) for x in found], pa.binary()),
                ],
                names=["part", "row", "doc_id", "n_tokens", "ids"],
            )
            row += n

    return ordered.mapInArrow(run, "part long, row long, doc_id long, n_tokens long, ids binary")


def _narrow(ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("the stored form holds ids below 65,536")
    return ids.astype("<u2").tobytes()


def symbol_counts(tokens: DataFrame) -> DataFrame:
    """(symbol, n) over all ids; each task sends at most one row per symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            joined = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype="<u2")
            total += np.bincount(joined, minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["symbol", "n"])

    return tokens.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def fit_table(tokens: DataFrame) -> Table:
    """The shared table. What reaches the driver is bounded by the vocabulary (at most 65,536 rows)."""
    found = symbol_counts(tokens).toPandas()
    counts = np.zeros(int(found["symbol"].max()) + 1 if len(found) else 0, dtype=np.int64)
    counts[found["symbol"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return Table(counts)


def _publish(folder: str, name: str, data: bytes) -> None:
    """Write under a name of its own, then move into place, so that a repeated task replaces whole files."""
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    passing = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(passing) as out:
        out.write(data)
    store.move(passing, f"{path}/{name}")


def write_files(tokens: DataFrame, table: Table, folder: str) -> DataFrame:
    """Encode a stored token table into files; returns (file, part, row, n_docs, n_tokens, blocks), one row per file.

    A file's name starts with the part and row of its first document, so names sort as
    documents do. A run of documents of one part that follow one another goes to one file
    until that is full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[bytes] = []
        docs: list[tuple[int | None, int]] = []
        ids: list[bytes] = []
        at = {"head": None, "next": None, "docs": 0, "tokens": 0, "open": 0}
        shapes: list[dict] = []
        done: list[tuple] = []

        def close_block() -> None:
            if docs:
                joined = np.frombuffer(b"".join(ids), dtype="<u2").astype(np.uint32)
                place = len(FILE_MAGIC) + 4 + sum(map(len, blocks))
                size = EVERY * min(LANES, len(joined))
                longer = any(n > size for _, n in docs)
                shapes.append({"at": place, "ids": len(joined), "segments": max(1, -(-len(joined) // max(1, size))), "longer": int(longer)})
                blocks.append(write_block([d for d, _ in docs], [n for _, n in docs], joined, table, LANES, EVERY))
                docs.clear()
                ids.clear()
                at["open"] = 0

        def close_file() -> None:
            close_block()
            if blocks:
                part, row = at["head"]
                name = f"{part:08d}-{row:012d}.rans"
                _publish(folder, name, FILE_MAGIC + struct.pack("<I", table.crc) + b"".join(blocks))
                done.append((name, part, row, at["docs"], at["tokens"], list(shapes)))
                blocks.clear()
                shapes.clear()
            at.update(head=None, docs=0, tokens=0)

        for batch in batches:
            for part, row, doc, n, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at["head"] is not None and (part, row) != at["next"] or sum(map(len, blocks)) >= FILE_BYTES:
                    close_file()
                if at["head"] is None:
                    at["head"] = (part, row)
                docs.append((doc, n))
                ids.append(raw)
                at.update(next=(part, row + 1), docs=at["docs"] + 1, tokens=at["tokens"] + n, open=at["open"] + n)
                if at["open"] >= BLOCK_IDS:
                    close_block()
        close_file()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in done], pa.string()),
                *[pa.array([x[k] for x in done], pa.int64()) for k in range(1, 5)],
                pa.array([x[5] for x in done], pa.list_(pa.struct([(c, pa.int64()) for c in ("at", "ids", "segments", "longer")]))),
            ],
            names=["file", "part", "row", "n_docs", "n_tokens", "blocks"],
        )

    return tokens.select("part", "row", "doc_id", "n_tokens", "ids").mapInArrow(
        run, "file string, part long, row long, n_docs long, n_tokens long, blocks array<struct<at: long, ids: long, segments: long, longer: long>>"
    )


def file_starts(index: DataFrame) -> DataFrame:
    """``index`` plus start: ids in all files before. Totals per part are added up first, so no task sees more than the parts."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before = parts.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return index.withColumn("__inside", inside).join(before, "part").withColumn("start", F.col("__inside") + F.col("__before")).drop("__inside", "__before")


def store_ids(docs: DataFrame, encoder: Encoder, folder: str) -> DataFrame:
    """Write all documents' ids to ``folder`` and return the stored index of its files (with start).

    Also stores the frequency table. Null texts are empty, repeated rows are stored each,
    null doc_ids come first. An empty table gives an empty folder and index.
    """
    spark = docs.sparkSession
    at = scratch(spark, "tokens")
    tokens = keep(token_table(docs, encoder), f"{at}/tokens")
    table = fit_table(tokens)
    freq = spark.createDataFrame(
        [(int(s), int(f)) for s, f in enumerate(table.freq) if f], T.StructType([T.StructField("symbol", T.LongType()), T.StructField("freq", T.LongType())])
    )
    keep(freq.coalesce(1), f"{folder}/_table")
    written = keep(write_files(tokens, table, f"{folder}/files"), f"{folder}/_written")
    index = keep(file_starts(written), f"{folder}/_index")
    forget(spark, at, f"{folder}/_written")
    return index


def load_table(spark: SparkSession, folder: str) -> Table:
    found = spark.read.parquet(f"{folder}/_table").toPandas()
    freq = np.zeros(int(found["symbol"].max()) + 1 if len(found) else 0, dtype=np.int64)
    freq[found["symbol"].to_numpy(dtype=np.int64)] = found["freq"].to_numpy(dtype=np.int64)
    return Table(freq)


def segments(index: DataFrame) -> DataFrame:
    """(file, at, start, longer, k): one row per segment of every block; start counts the ids before the block, longer
    says whether a document of the block is longer than a segment."""
    before = F.aggregate(F.slice("blocks", 1, F.col("pos")), F.lit(0).cast("bigint"), lambda t, b: t + b["ids"])
    each = index.select("file", "start", "blocks", F.posexplode("blocks").alias("pos", "b"))
    last = F.col("b.segments") - 1
    return each.select(
        "file", F.col("b.at").alias("at"), (F.col("start") + before).alias("start"), (F.col("b.longer") == 1).alias("longer"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"),
    )


def load_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids (little-endian 32-bit).

    The unit of work is a segment, decoded from its checkpoint and checked; tasks read only
    the bytes they need from the shared folder. A document that runs into the next segment is
    finished where it starts. One longer than a segment (262,144 ids) is decoded by as many
    tasks as it has segments and put together by its place.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    rows = segments(spark.read.parquet(f"{folder}/_index"))
    total, wide = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("longer"), 1))).first()
    if total == 0:
        return spark.createDataFrame([], schema)
    table = load_table(spark, folder)

    def reader(pick: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, path = pafs.FileSystem.from_uri(f"{folder}/files")
            for batch in batches:
                for file, at, start, k in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    with store.open_input_file(f"{path}/{file}") as data:
                        head = data.read(len(FILE_MAGIC) + 4)
                        if head[: len(FILE_MAGIC)] != FILE_MAGIC or struct.unpack_from("<I", head, len(FILE_MAGIC))[0] != table.crc:
                            raise ValueError("the file was written with another table")
                        block = Block(data, at)
                        found = pick(block, k, table)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * len(found), pa.string()),
                            pa.array([at] * len(found), pa.int64()),
                            pa.array([k] * len(found), pa.int64()),
                            pa.array([i for i, _, _, _ in found], pa.int64()),
                            pa.array([d for _, _, d, _ in found], pa.int64()),
                            pa.array([start + s for _, s, _, _ in found], pa.int64()),
                            pa.array([int(block.lengths[i]) for i, _, _, _ in found], pa.int64()),
                            pa.array([zlib.crc32(raw) for _, _, _, raw in found], pa.int64()),
                            pa.array([raw for _, _, _, raw in found], pa.binary()),
                        ],
                        names=["file", "at", "k", "row", "doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

        return run

    def read(chosen: DataFrame, count: int, pick: Callable) -> DataFrame:
        spread = chosen.select("file", "at", "start", "k").repartition(-(-count // SEGMENTS_A_TASK))
        return spread.mapInArrow(reader(pick), f"file string, at long, k long, row long, {schema}")

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    whole = read(rows, total, Block.short).select(*names)
    if not wide:
        return whole
    pieces = read(rows.where("longer"), wide, Block.long)
    joined = pieces.groupBy("file", "at", "row", "doc_id", "start", "n_tokens").agg(
        F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts")
    )
    ids = F.aggregate("parts", F.lit(b""), lambda t, p: F.concat(t, p["ids"]))
    return whole.unionByName(joined.withColumn("ids", ids).withColumn("ids_crc32", F.crc32("ids")).select(*names))
