"""Ranked lexical search: best-first document intervals bounded by range-maximum tables.

The index is cut into shards of documents in order of ids. A shard is one row: its terms, and
for every term the documents that hold it with their counts. For a query, a sparse table
over the impacts of its terms' postings answers the largest impact of any term in any
interval of documents at once. The sum of a query's answers bounds every score in the
interval. The interval with the highest bound is taken first and split at the document with
the largest single impact in it, which is scored; each remaining interval is bounded anew.
Intervals that cannot reach the results found so far are dropped, so the results are exact.
Intervals of few postings are scored as they are: that costs less than to split them.

Scores are whole numbers. A task goes through several shards and keeps its best results, so
that later shards start with a high bar.

Null texts have no terms; they and documents without terms are not counted and never found.
A null id comes before all others. Repeated rows are documents of their own. Items without
terms, and all items when nothing is indexed, have no results. Repeated items are answered
each. Texts are taken whole at any length; a shard is closed after ``SHARD_WORDS`` words.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import keep, map_batches, raw_bytes, scratch

#: Documents and words of a shard, at most (a longer text is a shard of its own).
SHARD = 8_192
SHARD_WORDS = 8_000_000
#: Items answered in one job, and the most terms they hold together (one item may hold more).
BLOCK_ITEMS = 2_000
BLOCK_TERMS = 200_000
#: Intervals split at a time, and the postings up to which an interval is scored without splitting.
SPLIT_AT_ONCE = 64
SMALL = 256
NO_ID = -(1 << 63)

#: Everything but letters, digits and bytes above 127 is blank; capitals A-Z become small.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)

INDEX = "n_docs long, n_terms long, terms binary, counts binary, doc_ids binary, lengths binary, docs binary, tfs binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


# --- index ---------------------------------------------------------------


class _Shard:
    """Documents collected so far, and their postings as one row."""

    def __init__(self) -> None:
        self.slots: dict[bytes, int] = defaultdict()
        self.slots.default_factory = self.slots.__len__
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.parts: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.words = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = terms_of(text)
        if not words:
            return
        counts = Counter(words)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(words))
        self.parts.append(np.fromiter(map(self.slots.__getitem__, counts), dtype=np.int32, count=len(counts)))
        self.tfs.append(np.fromiter(counts.values(), dtype=np.int32, count=len(counts)))
        self.words += len(words)

    def full(self) -> bool:
        return len(self.ids) >= SHARD or self.words >= SHARD_WORDS

    def row(self) -> pa.RecordBatch:
        """Documents by id, terms in byte order, postings by (term, document)."""
        ids = np.array(self.ids, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        docs = np.repeat(place, [len(p) for p in self.parts])
        names = sorted(self.slots)
        rank = np.empty(len(names), dtype=np.int32)
        rank[[self.slots[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        terms = rank[np.concatenate(self.parts)]
        by = np.lexsort((docs, terms))
        values = [
            len(ids), self.words, b" ".join(names), np.bincount(terms, minlength=len(names)).astype("<i4").tobytes(),
            ids[order].astype("<i8").tobytes(), np.array(self.lengths, dtype="<i4")[order].tobytes(),
            docs[by].astype("<i4").tobytes(), np.concatenate(self.tfs)[by].astype("<i4").tobytes(),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values],
            names=[c.split()[0] for c in INDEX.split(", ")],
        )


def build_index(docs: DataFrame, folder: str) -> DataFrame:
    """Index every document's whole text (``doc_id``, ``text``); returns the stored table of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                shard.add(i, text)
                if shard.full():
                    yield shard.row()
                    shard = _Shard()
        if shard.ids:
            yield shard.row()

    return keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), folder)


# --- range maxima ---------------------------------------------------------------


class RangeMaximum:
    """Sparse table: places of maxima of all power-of-two stretches of ``values``; any range is two of them."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= longest:
            low = self.levels[-1]
            a, b = low[: len(values) - 2 * width + 1], low[width : len(values) - width + 1]
            # The first of equal maxima.
            self.levels.append(np.where(values[b] > values[a], b, a))
            width *= 2

    def places(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the maximum of every [start, end); -1 for empty ranges."""
        out = np.full(start.shape, -1, dtype=np.int64)
        size = end - start
        level = np.where(size > 0, np.frexp(np.maximum(size, 1))[1] - 1, -1)
        for k in np.unique(level[level >= 0]):
            at = level == k
            a, b = self.levels[k][start[at]], self.levels[k][end[at] - (1 << int(k))]
            out[at] = np.where(self.values[b] > self.values[a], b, a)
        return out


class Searcher:
    """The postings of some terms in one shard, and the best results of queries over them."""

    def __init__(self, row: dict, weights: dict[bytes, int], n: int, total: int):
        self.ids = np.frombuffer(row["doc_ids"], dtype="<i8")
        names = row["terms"].split(b" ")
        ends = np.cumsum(np.frombuffer(row["counts"], dtype="<i4").astype(np.int64))
        docs, tfs = np.frombuffer(row["docs"], dtype="<i4"), np.frombuffer(row["tfs"], dtype="<i4")
        held = [(t, int(ends[k - 1]) if k else 0, int(ends[k])) for k, t in enumerate(names) if t in weights]
        self.slot = {t: k for k, (t, _, _) in enumerate(held)}
        self.start = np.cumsum([0, *[b - a for _, a, b in held]])
        pick = np.concatenate([np.arange(a, b) for _, a, b in held]) if held else np.empty(0, dtype=np.int64)
        self.docs = docs[pick].astype(np.int64)
        # Python-sized products overflow nothing here: 75 * length * documents stays below 2**63.
        norm = 25 + 75 * np.frombuffer(row["lengths"], dtype="<i4").astype(np.int64) * n // max(total, 1)
        tf = tfs[pick].astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm[self.docs])
        self.size = len(self.ids)
        slots = np.repeat(np.arange(len(held), dtype=np.int64), np.diff(self.start))
        #: Ascending over all lists, so that one search finds a document's place in many of them.
        self.key = slots * (self.size + 1) + self.docs
        longest = int(np.diff(self.start).max(initial=1))
        self.maxima = RangeMaximum(self.impact, longest) if len(pick) else None

    def search(self, query: dict[bytes, int], k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``best`` (score, id), updated with the shard's documents; ``query`` has a term's weight times its repeats.

        Higher scores come first, then smaller ids.
        """
        mine = [(self.slot[t], w) for t, w in query.items() if w and t in self.slot]
        if not mine:
            return best
        slots = np.array([s for s, _ in mine], dtype=np.int64)
        weight = np.array([w for _, w in mine], dtype=np.int64)
        heap: list[tuple[int, int]] = [(score, -i) for score, i in best]  # smallest first: the result to beat
        heapq.heapify(heap)

        def offer(scores: np.ndarray, docs: np.ndarray) -> None:
            if len(heap) == k:
                open_ = scores >= heap[0][0]
                scores, docs = scores[open_], docs[open_]
            if len(scores) > k:
                first = np.lexsort((self.ids[docs], -scores))[:k]
                scores, docs = scores[first], docs[first]
            for s, i in zip(scores.tolist(), self.ids[docs].tolist(), strict=True):
                if s > 0 and len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                elif s > 0 and (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))

        def score(docs: np.ndarray) -> np.ndarray:
            at = np.searchsorted(self.key, slots[None, :] * (self.size + 1) + docs[:, None])
            at[at == len(self.key)] = 0
            found = self.key[at] == slots[None, :] * (self.size + 1) + docs[:, None]
            return np.where(found, self.impact[at] * weight[None, :], 0).sum(axis=1)

        def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low = np.searchsorted(self.key, slots[None, :] * (self.size + 1) + first[:, None])
            return low, np.searchsorted(self.key, slots[None, :] * (self.size + 1) + last[:, None])

        def open_intervals(first: np.ndarray, last: np.ndarray) -> None:
            """Bound intervals of documents; score the small ones, keep the others that can still matter."""
            some = first < last
            first, last = first[some], last[some]
            if not len(first):
                return
            low, high = ranges(first, last)
            held = (high - low).sum(axis=1)
            places = self.maxima.places(low, high)
            most = np.where(places >= 0, self.impact[places] * weight[None, :], 0)
            bound = most.sum(axis=1)
            at = places[np.arange(len(first)), most.argmax(axis=1)]
            for j in np.flatnonzero(held).tolist():
                if not beats(int(bound[j]), int(first[j])):
                    continue
                if held[j] <= SMALL:
                    pick = np.concatenate([np.arange(a, b) for a, b in zip(low[j].tolist(), high[j].tolist(), strict=True)])
                    by = np.repeat(weight, high[j] - low[j])
                    docs = self.docs[pick] - first[j]
                    sums = np.zeros(int(last[j] - first[j]), dtype=np.int64)
                    np.add.at(sums, docs, self.impact[pick] * by)
                    hit = np.flatnonzero(sums)
                    offer(sums[hit], hit + first[j])
                else:
                    heapq.heappush(waiting, (-int(bound[j]), int(first[j]), int(last[j]), int(self.docs[at[j]])))

        def beats(bound: int, first: int) -> bool:
            """Whether a document from ``first`` on, with a score up to ``bound``, could be a result."""
            return bound > 0 and (len(heap) < k or (bound, -int(self.ids[first])) > heap[0])

        waiting: list[tuple[int, int, int, int]] = []
        open_intervals(np.array([0]), np.array([self.size]))
        while waiting:
            taken = []
            while waiting and len(taken) < SPLIT_AT_ONCE:
                bound, first, last, at = heapq.heappop(waiting)
                if not beats(-bound, first):
                    # Ids ascend with places, so of equal bounds the first waiting one is the likeliest.
                    if len(heap) == k and -bound < heap[0][0]:
                        waiting.clear()
                    continue
                taken.append((first, last, at))
            if not taken:
                break
            first, last, at = (np.array(c, dtype=np.int64) for c in zip(*taken, strict=True))
            offer(score(at), at)
            open_intervals(np.concatenate([first, at + 1]), np.concatenate([at, last]))
        return [(s, -i) for s, i in heap]


# --- queries ---------------------------------------------------------------


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, int, Counter]]]:
    """The stated queries in blocks of bounded size: (number, item_id, term counts)."""
    block, terms = [], 0
    for number, row in enumerate(items.select("item_id", "text").toLocalIterator()):
        counts = Counter(terms_of((row["text"] or "").encode()))
        if block and (len(block) == BLOCK_ITEMS or terms + len(counts) > BLOCK_TERMS):
            yield block
            block, terms = [], 0
        block.append((number, row["item_id"], counts))
        terms += len(counts)
    if block:
        yield block


def _weights(index: DataFrame, terms: set[bytes], n: int) -> dict[bytes, int]:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of the terms that documents hold, df over all shards."""

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, counts = [], []
        for row in batch.to_pylist():
            df = np.frombuffer(row["counts"], dtype="<i4").tolist()
            found = [(t, c) for t, c in zip(row["terms"].split(b" "), df, strict=True) if t in terms]
            names += [t for t, _ in found]
            counts += [c for _, c in found]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int64())], names=["term", "df"])

    found = map_batches(index.select("terms", "counts"), "term binary, df long", held).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    # At most as many rows as terms in the block.
    return {bytes(r["term"]): r["w"] for r in found.select("term", weight.alias("w")).toLocalIterator()}


def top_documents(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, ties to smaller ids.

    ``index`` is a table of :func:`build_index`; ``items`` has item_id and text. Shards of one
    task are searched one after the other with the task's own results as the bar.
    """
    schema = "item bigint, item_id bigint, doc_id bigint, score bigint"
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, total = int(totals[0] or 0), int(totals[1] or 0)
    out = index.sparkSession.createDataFrame([], schema)
    for block in _item_blocks(items) if n else ():
        weights = _weights(index, {t for _, _, counts in block for t in counts}, n)
        queries = [(i, item, {t: weights[t] * c for t, c in counts.items() if t in weights}) for i, item, counts in block]

        def run(batches: Iterator[pa.RecordBatch], queries=queries, weights=weights) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[int, int]]] = [[] for _ in queries]
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Searcher(row, weights, n, total)
                    for j, (_, _, query) in enumerate(queries):
                        best[j] = shard.search(query, k, best[j])
            rows = [(i, item, d, s) for (i, item, _), found in zip(queries, best, strict=True) for s, d in found]
            if rows:
                kinds = [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item", "item_id", "doc_id", "score"]
                )

        out = out.unionByName(index.select("doc_ids", "lengths", "terms", "counts", "docs", "tfs").mapInArrow(run, schema))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """:func:`top_documents` over a fresh index of ``docs``."""
    return top_documents(build_index(docs, scratch(docs.sparkSession, "index")), items, k)
