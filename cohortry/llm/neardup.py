"""Near duplicates by bottom-k sketches.

1. One hash function over the word shingles of a text; the ``k`` smallest values are its
   sketch. Texts with equal shingle sets are one class, represented by its smallest id.
2. Inverted lists of the ``indexed`` smallest values. Each representative enters only the
   lists of its rarest values, as many as two sets of the wanted similarity cannot all
   differ in (a prefix in any common order meets). So a passage many documents share opens
   no lists for documents with text of their own.
3. Short lists give pairs, kept if their sizes allow the similarity and the union of their
   sketches estimates enough of it. Long lists give only links to their smallest member.
   Connected together these form groups that no true link leaves.
4. Each group is split by set size (each bucket a factor of the similarity wide, so links
   stay in a bucket or go to the next) and, if large, by hash. Pairs of blocks are compared
   on full shingle sets, exactly, and give a spanning forest of their links.
5. Connected components of these links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import forget, keep, map_batches, raw_bytes, scratch
from cohortry.llm.graph import components
from cohortry.operators.relational import join_heavy

#: Values of a sketch, and how many of them are indexed.
K = 48
INDEXED = 24
#: Standard deviations by which sketch overlap and estimates may fall below their expectation.
DEVIATIONS = 5
#: Longest inverted list that is unfolded into pairs.
LONGEST_LIST = 64
#: Documents and shingles of a block of the exact comparison.
BLOCK_DOCUMENTS = 512
BLOCK_SHINGLES = 1 << 19

MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words than ``width`` are one shingle, none is empty.

    A-Z are lower-cased; words are what ASCII white space separates.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        total = (total ^ hashes[i : i + n]) * MIX
        total ^= total >> np.uint64(29)
    return np.unique(total)


def _signed(values: np.ndarray) -> np.ndarray:
    """Order-preserving move to signed 64-bit."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, n_shingles, print (of the whole set) and the k smallest values."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, width) for x in raw_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([_signed(s[:k]) for s in sets], pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "print", "sketch"],
        )

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        "doc_id long, n_shingles long, print binary, sketch array<long>",
        run,
    )


def prefix_length(indexed: int, percent: int) -> int:
    """Rarest values two sketches may look at and still meet in one, for sets with more than ``indexed`` shingles."""
    t = percent / 100
    least = math.floor(indexed * t - DEVIATIONS * math.sqrt(indexed * t * (1 - t)))
    return min(indexed, indexed - max(least, 1) + 1)


def _candidates(reps: DataFrame, percent: int, at: str) -> DataFrame:
    """Edges (a, b) between representatives such that every true link stays inside a connected group."""
    listed = reps.select("id", "n", F.explode(F.slice("sketch", 1, INDEXED)).alias("v"))
    shared = listed.groupBy("v").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("first")).where("df > 1")
    # Stored, so that both sides of the join are plain shuffles and a hot value can be split.
    rows = listed.join(keep(shared, f"{at}/shared"), "v")
    per_id = Window.partitionBy("id", "n")
    rows = rows.select(
        "id",
        "n",
        "v",
        "df",
        "first",
        F.count(F.lit(1)).over(per_id).alias("met"),
        F.row_number().over(per_id.orderBy("df", "v")).alias("place"),
    )
    used = F.least("n", F.lit(INDEXED))
    short = F.floor(F.col("n") * (100 - percent) / 100) + 1
    prefix = F.when(F.col("n") <= INDEXED // 2, short).otherwise(F.lit(prefix_length(INDEXED, percent)))
    rows = rows.where(used - F.col("met") + F.col("place") <= prefix)
    rows = keep(rows.select("id", "n", "v", "df", "first"), f"{at}/lists")

    few = rows.where(F.col("df") <= LONGEST_LIST)
    left = few.select("v", F.col("id").alias("a"), F.col("n").alias("na"))
    right = few.select("v", F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    pairs = left.join(right, "v").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    of_a = reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    of_b = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    # The k smallest values of the union are a sketch of the union; those in both estimate the similarity.
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("union")))
    t = percent / 100
    least = t - DEVIATIONS * math.sqrt(t * (1 - t) / K)
    close = (
        pairs.join(of_a, "a")
        .join(of_b, "b")
        .select("a", "b", "sa", "sb", union.alias("union"))
        .where(both >= F.size("union") * least)
        .select("a", "b")
    )
    many = rows.where((F.col("df") > LONGEST_LIST) & (F.col("id") != F.col("first")))
    stars = many.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    return close.union(stars)


def _placed(groups: DataFrame, percent: int, total: int) -> DataFrame:
    """(id, task, side) of every block pair a member takes part in; side 0 and 1 are compared, 2 is one block.

    ``groups``: id, root, n, at most ``total`` rows.
    """
    width = -math.log(percent / 100)
    groups = groups.withColumn("bucket", F.floor(F.log(F.col("n").cast("double")) / width + 1e-9))

    def parts(n, shingles):
        return F.ceil(F.greatest(n / BLOCK_DOCUMENTS, shingles / BLOCK_SHINGLES)).cast("int")

    by_bucket = groups.groupBy("root", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    own = F.struct("bucket", parts(F.col("rows"), F.col("shingles")))
    whole = by_bucket.groupBy("root").agg(
        parts(F.sum("rows"), F.sum("shingles")).alias("all_parts"),
        # Sizes of sets span few buckets, whatever the group.
        F.map_from_entries(F.collect_list(own)).alias("parts"),
        F.sum("rows").alias("rows"),
    )
    rows = join_heavy(groups, whole, "root", "rows", "id", total)
    small = rows.where("all_parts <= 1").select(
        "id", F.struct("root", *[F.lit(0).cast("long").alias(x) for x in ("b", "i", "c", "j")]).alias("task"),
        F.lit(2).alias("side"),
    )
    large = (
        rows.where("all_parts > 1")
        .withColumns({"p": F.col("parts")[F.col("bucket")], "p_next": F.try_element_at("parts", F.col("bucket") + 1),
                      "p_last": F.try_element_at("parts", F.col("bucket") - 1)})
        .withColumn("i", F.pmod(F.xxhash64("id"), F.col("p")).cast("long"))
    )

    def task(b, i, c, j):
        return F.struct("root", b.alias("b"), i.alias("i"), c.alias("c"), j.alias("j"))

    here, i = F.col("bucket"), F.col("i")
    upto = lambda n: F.sequence(F.lit(0), n - 1).cast("array<bigint>")
    same = F.transform(
        upto(F.col("p")),
        lambda j: F.struct(
            task(here, F.least(i, j), here, F.greatest(i, j)).alias("task"),
            F.when(i == j, 2).when(i < j, 0).otherwise(1).alias("side"),
        ),
    )
    up = F.transform(upto(F.col("p_next")), lambda j: F.struct(task(here, i, here + 1, j).alias("task"), F.lit(0).alias("side")))
    down = F.transform(upto(F.col("p_last")), lambda j: F.struct(task(here - 1, j, here, i).alias("task"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<task:struct<root:bigint,b:bigint,i:bigint,c:bigint,j:bigint>,side:int>>")
    each = F.explode(F.concat(same, F.coalesce(up, none), F.coalesce(down, none))).alias("x")
    return small.union(large.select("id", each).select("id", "x.task", "x.side"))


def _links(ids: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the exact links of one block, or between the two sides of a block pair."""
    m = len(ids)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        common = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2)
        common[1, 0] = common[0, 1]
    else:
        values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), sizes)
        several = count > 1
        column = np.cumsum(several) - 1
        chosen = several[inverse]
        owner, column = owner[chosen], column[inverse[chosen]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((m, m), dtype=np.float32)
        total, step = int(several.sum()), 4096
        for low in range(0, total, step):
            a, b = np.searchsorted(column, [low, low + step])
            part = np.zeros((m, min(step, total - low)), dtype=np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            common += part @ part.T
        common = common.astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    side = np.array(sides)
    linked &= (side[:, None] == 2) | (side[:, None] != side[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(m)
    found = []
    for start in np.argsort(np.array(ids), kind="stable"):
        if root[start] != start or not linked[start].any():
            continue
        seen = np.zeros(m, dtype=bool)
        seen[start] = True
        front = np.array([start])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[front] = True
        members = np.flatnonzero(seen)
        root[members] = start
        root[start] = start
        found += [(ids[x], ids[start]) for x in members if ids[x] != ids[start]]
        linked[members, :] = False
        linked[:, members] = False
    return found


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of every task; ``rows``: task, id, side, values, one task's rows together in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, sets, out = None, [], [], [], []
        for batch in batches:
            tasks = batch.column("task").to_pylist()
            for task, i, side, values in zip(
                tasks, batch.column("id").to_pylist(), batch.column("side").to_pylist(), batch.column("set").to_pylist(),
                strict=True,
            ):
                if task != key:
                    out += _links(ids, sides, sets, percent)
                    key, ids, sides, sets = task, [], [], []
                ids.append(i)
                sides.append(side)
                sets.append(np.frombuffer(values, dtype=np.uint64))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"]
                )
                out = []
        if out := _links(ids, sides, sets, percent):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, width).tobytes() for x in raw_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "set"])

    return map_batches(docs, "id long, set binary", run)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|`` for their sets of
    ``width``-word shingles; component_id is the smallest doc_id reachable over links, and the
    row whose doc_id it is stays (kept).

    Null, empty and blank texts have no shingles, are linked with nothing and stay. Rows that
    repeat a doc_id are one document with several texts, each of which may link it. Rows with a null doc_id take no
    part: component_id is null, and they stay. Empty tables give no rows.
    """
    spark = docs.sparkSession
    at = scratch(spark, "neardup")
    base = keep(sketches(docs, width), f"{at}/sketches")
    taking = base.where("doc_id is not null and n_shingles > 0")
    classes = taking.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = keep(classes.where("copies > 1").drop("copies"), f"{at}/classes")
    members = taking.join(classes, "print", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    members = keep(members.select("doc_id", "n_shingles", "rep", "print", F.when(F.col("doc_id") == F.col("rep"), F.col("sketch")).alias("sketch")), f"{at}/members")
    reps = members.where("doc_id = rep").select(F.col("doc_id").alias("id"), "print", F.col("n_shingles").alias("n"), "sketch")
    reps = keep(reps.dropDuplicates(["id", "print"]).drop("print"), f"{at}/reps")
    groups = components(_candidates(reps, percent, at), "candidates")
    placed = _placed(groups.select(F.col("node").alias("id"), "root").join(reps.select("id", "n"), "id"), percent, reps.count())
    placed = keep(placed, f"{at}/placed")
    wanted = placed.select(F.col("id").alias("__id")).distinct()
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sets = _full_sets(named.join(wanted, F.col("id") == F.col("__id"), "left_semi"), width)
    rows = placed.join(sets, "id").repartition("task").sortWithinPartitions("task")
    links = keep(_compare(rows, percent).distinct(), f"{at}/links")
    # A repeated doc_id may be a member of several classes, which it then links.
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b")
    roots = components(links.union(members.join(several, "doc_id").select("rep", "a")), "duplicates")
    roots = roots.select(F.col("node").alias("rep"), "root")
    forget(spark, f"{at}/lists", f"{at}/placed")
    out = members.select("doc_id", "n_shingles", "rep").join(roots, "rep", "left")
    root = F.coalesce("root", "rep")
    found = out.select("doc_id", "n_shingles", root.alias("component_id"), (root == F.col("doc_id")).alias("kept"))
    alone = base.where("doc_id is null or n_shingles = 0")
    return found.union(alone.select("doc_id", "n_shingles", "doc_id", F.lit(True)))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that repeat or nearly repeat one with a smaller doc_id, all columns kept.

    Of rows with the same doc_id all stay or go together.
    """
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
