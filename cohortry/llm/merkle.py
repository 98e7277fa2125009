"""Merkle manifest of a dataset, and proofs of all its rows by octopus multiproofs.

A row's leaf is the hash of its fields. The leaves of a source, in order of ids, are hashed
by threes up to the source's root; the sources' roots, in order of names, likewise up to the
root of all.

Rows are sorted once, by (source, id), into runs of at most ``RUN`` leaves. A run hashes what
it can on its own and publishes only the nodes at its two ends whose parents it cannot
build; neighbouring runs' ends are joined, ``JOINED`` parts of the sort at a time, until
every tree is whole. For proofs, a run lists the nodes that all its leaves together still
need (the octopus' missing coordinates), gets them in one join, derives everything between
and writes out each leaf's proof on the spot. So between runs travel a few nodes per run and
level, whatever a source's share of the rows is.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import keep, scratch

FAN = 3
#: Leaves of a run, at most.
RUN = 10_000
#: Parts of the sort whose open ends one task joins; each has a few nodes a level.
JOINED = 64
#: Most rows of a list about runs that is broadcast.
BROADCAST_ROWS = 1_000_000

NODE = "tree string, total long, level int, idx long, digest binary, part long, open boolean, fresh boolean, top boolean"
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# --- leaves ---------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_table(docs: DataFrame) -> DataFrame:
    """tree, name, doc_id, leaf, altered: each row's leaf, and the leaf after tampering where that changes it.

    Trees are sources; null is the empty name, others follow a ``=``, which keeps their order.
    Tampering takes the line breaks out of the texts of ids with an even checksum; a null id
    has none.
    """

    def leaf(text: Column) -> Column:
        parts = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
        return F.unhex(F.sha2(F.concat(*map(_field, parts)), 256))

    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    altered = F.when(even & F.contains(F.col("text"), F.lit("\n")), leaf(F.translate("text", "\n", "")))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.lit(None).cast("string").alias("name"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(F.col("text")).alias("leaf"),
        altered.alias("altered"),
    )


def _pack(leaves: DataFrame, run: int) -> DataFrame:
    """Runs of leaves in order of (tree, name, doc_id, leaf): one row each, with the trees in it and their counts."""
    parts = max(1, -(-leaves.count() // run))
    order = ["tree", F.col("name").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "uid"]
    ranged = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().cast("long").alias("part"), "tree", "name", "doc_id", "leaf", "altered")
    fields = "part long, run long, trees array<string>, counts array<long>, names array<string>, doc_ids array<long>, leaves binary, altered array<binary>"

    def pack(rows: pa.Table, number: int) -> pa.RecordBatch:
        trees = rows.column("tree").to_pylist()
        starts = [i for i, t in enumerate(trees) if i == 0 or t != trees[i - 1]]
        counts = [b - a for a, b in zip(starts, [*starts[1:], len(trees)], strict=True)]
        part = rows.column("part")[0].as_py()
        row = [part, (part << 24) + number, [trees[i] for i in starts], counts]
        row += [rows.column(c).to_pylist() for c in ("name", "doc_id")]
        row += [b"".join(rows.column("leaf").to_pylist()), rows.column("altered").to_pylist()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]
        kinds += [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
        names = [f.split()[0] for f in fields.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, run - n)
                batch = batch.slice(take.num_rows)
                held.append(take)
                n += take.num_rows
                if n == run:
                    yield pack(pa.Table.from_batches(held), number)
                    held, n, number = [], 0, number + 1
        if n:
            yield pack(pa.Table.from_batches(held), number)

    return ranged.mapInArrow(packed, fields)


def _spans(runs: DataFrame) -> DataFrame:
    """run, tree, first, count, total: which leaves of which trees a run holds.

    A tree's window has one row per run that it is in, not one per leaf.
    """
    each = runs.select("run", F.explode(F.arrays_zip("trees", "counts")).alias("s"))
    each = each.select("run", F.col("s.trees").alias("tree"), F.col("s.counts").alias("count"))
    before = F.sum("count").over(Window.partitionBy("tree").orderBy("run")) - F.col("count")
    return each.select("run", "tree", before.alias("first"), "count", F.sum("count").over(Window.partitionBy("tree")).alias("total"))


def _with(runs: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Runs with one short list each; packed runs stay where they are while the lists are few."""
    return runs.join(F.broadcast(lists) if lists.count() <= BROADCAST_ROWS else lists, "run", how)


# --- trees ---------------------------------------------------------------


def climb(known: dict[int, dict[int, str]], total: int) -> dict[int, dict[int, str]]:
    """All nodes (level, index) that follow from known ones in a tree of ``total`` leaves; ``known`` grows."""
    level, size = 0, total
    while size > 1:
        here = known.get(level, {})
        above = known.setdefault(level + 1, {})
        for up in {i // FAN for i in here}:
            children = range(FAN * up, min(FAN * up + FAN, size))
            if up not in above and all(c in here for c in children):
                above[up] = digest("".join([here[c] for c in children]))
        level, size = level + 1, -(-size // FAN)
    return known


def missing(known: np.ndarray, total: int) -> list[tuple[int, int]]:
    """Coordinates of the fewest nodes that, with leaves ``known``, give the root: siblings nobody below can derive."""
    out, level, size = [], 0, total
    known = np.unique(known)
    while size > 1:
        parents = np.unique(known // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        lacking = np.setdiff1d(children[children < size], known, assume_unique=True)
        out += [(level, int(i)) for i in lacking]
        known, level, size = parents, level + 1, -(-size // FAN)
    return out


def _height(total: int) -> int:
    level = 0
    while total > 1:
        level, total = level + 1, -(-total // FAN)
    return level


def _node_rows(tree: str, total: int, part: int, known: dict, old: set, every: bool) -> list[tuple]:
    """Rows of the nodes of a part: those whose parent is unknown are open, those not in ``old`` are fresh."""
    top, rows = _height(total), []
    for level, nodes in known.items():
        for i, value in nodes.items():
            is_open = level < top and i // FAN not in known.get(level + 1, {})
            fresh = (level, i) not in old
            if is_open or level == top or every or (fresh and old):
                rows.append((tree, total, level, i, bytes.fromhex(value), part, is_open, fresh, level == top))
    return rows


def _grow(runs: DataFrame, every: bool, at: str) -> DataFrame:
    """The stored nodes that runs need of each other: ends of runs, what joins them, and roots; ``every``: all nodes."""
    spark = runs.sparkSession

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves, at, out = row["leaves"].hex(), 0, []
                for s in row["spans"]:
                    nodes = {s["first"] + k: leaves[64 * (at + k) : 64 * (at + k + 1)] for k in range(s["count"])}
                    at += s["count"]
                    out += _node_rows(s["tree"], s["total"], row["part"], climb({0: nodes}, s["total"]), set(), every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], names=NODE_NAMES
                )

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (tree, total), mine in rows.groupby(["tree", "total"]):
            known: dict[int, dict[int, str]] = {}
            for level, i, value in zip(mine["level"], mine["idx"], mine["digest"], strict=True):
                known.setdefault(int(level), {})[int(i)] = bytes(value).hex()
            old = {(level, i) for level, nodes in known.items() for i in nodes}
            out += _node_rows(tree, int(total), int(rows["part"].iloc[0]), climb(known, int(total)), old, every)
        return pd.DataFrame(out, columns=NODE_NAMES)

    found = [keep(runs.mapInArrow(own, NODE), f"{at}/nodes0")]
    parts = runs.agg(F.max("part")).first()[0]
    while True:
        ends = found[-1].where("open").withColumn("part", F.floor(F.col("part") / JOINED).cast("long"))
        found.append(keep(ends.groupBy("part").applyInPandas(join, NODE), f"{at}/nodes{len(found)}"))
        parts = (parts or 0) // JOINED
        if not parts:
            break
    nodes = found[0]
    for later in found[1:]:
        nodes = nodes.unionByName(later.where("fresh"))
    return nodes.select("tree", "level", "idx", "digest", "top")


_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]


def _forest(leaves: DataFrame, every: bool, at: str, run: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, spans, nodes) of the trees over a leaf table, all stored."""
    leaves = keep(leaves.withColumn("uid", F.monotonically_increasing_id()), f"{at}/leaves")
    runs = keep(_pack(leaves, run), f"{at}/runs")
    spans = keep(_spans(runs), f"{at}/spans")
    lists = spans.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("tree", "first", "count", "total"))).alias("spans"))
    nodes = _grow(_with(runs.select("part", "run", "leaves"), lists), every, at)
    return runs, spans, nodes


# --- proofs ---------------------------------------------------------------


def _paths(known: dict[int, dict[int, str]], total: int, above: dict[int, str], wanted: list[int]) -> dict[int, str]:
    """Siblings from each wanted leaf up to the root of its tree, and on with ``above`` (the root's own)."""
    parents = []
    at = wanted
    for _ in range(_height(total)):
        parents.append(at)
        at = sorted({i // FAN for i in at})
    for level in reversed(range(len(parents))):
        here = known[level]
        below = {}
        for i in parents[level]:
            start = i // FAN * FAN
            others = [here[c] for c in range(start, start + FAN) if c != i and c in here]
            below[i] = "".join(others) + above[i // FAN]
        above = below
    return above


def fold(value: str, index: int, known: dict[int, dict[int, str]], total: int) -> str:
    """The root that follows from another value of leaf ``index``, with the known siblings."""
    for level in range(_height(total)):
        here, start = known[level], index // FAN * FAN
        value = digest("".join([value if c == index else here[c] for c in range(start, start + FAN) if c == index or c in here]))
        index //= FAN
    return value


def _prove_run(row: dict, root: str) -> Iterator[pa.RecordBatch]:
    """Every leaf's proof of one run, from its own leaves and the nodes fetched for it."""
    leaves, at = row["leaves"].hex(), 0
    fetched: dict[tuple, dict[int, dict[int, str]]] = {}
    for node in row["fetched"] or []:
        fetched.setdefault((node["upper"], node["tree"]), {}).setdefault(node["level"], {})[node["idx"]] = node["digest"].hex()
    trees = []
    for s in row["spans"]:
        known = fetched.get((False, s["tree"]), {})
        base = known.setdefault(0, {})
        base.update({s["first"] + k: leaves[64 * (at + k) : 64 * (at + k + 1)] for k in range(s["count"])})
        climb(known, s["total"])
        trees.append((s, at, known, known[_height(s["total"])][0]))
        at += s["count"]
    upper = fetched.get((True, ""), {})
    upper.setdefault(0, {}).update({s["place"]: subroot for s, _, _, subroot in trees})
    sources = trees[0][0]["sources"]
    climb(upper, sources)
    derived = upper[_height(sources)][0]
    beyond = _paths(upper, sources, {0: ""}, sorted(s["place"] for s, *_ in trees))
    for s, at, known, subroot in trees:
        for start in range(0, s["count"], 1000):
            picked = range(start, min(start + 1000, s["count"]))
            proofs = _paths(known, s["total"], {0: beyond[s["place"]]}, [s["first"] + k for k in picked])
            out = []
            for k in picked:
                own, altered = leaves[64 * (at + k) : 64 * (at + k + 1)], row["altered"][at + k]
                folded = derived
                if altered is not None:
                    folded = fold(fold(altered.hex(), s["first"] + k, known, s["total"]), s["place"], upper, sources)
                out.append((row["doc_ids"][at + k], own, subroot, root, digest(proofs[s["first"] + k]), folded, folded == root))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            names = [c.split()[0] for c in PROOF.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def prove(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Every row's leaf, its source's root, the root of all, its proof's hash, and what tampering does to it.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Rows of one
    source and id are put in order of their leaves (equal rows are interchangeable). Null
    ids come first, null sources are one source. An empty table gives no rows. Texts are
    hashed whole, by built-in functions; other columns than the five hashed are not looked at.
    """
    spark = docs.sparkSession
    at = scratch(spark, "merkle")
    runs, spans, nodes = _forest(leaf_table(docs), False, f"{at}/sources", run)
    null = F.lit(None)
    subroots = nodes.where("top").select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), null.cast("long").alias("doc_id"), F.col("digest").alias("leaf"), null.cast("binary").alias("altered")
    )
    top_runs, top_spans, top_nodes = _forest(subroots, True, f"{at}/all", run)
    root = top_nodes.where("top").first()
    if root is None:
        return spark.createDataFrame([], PROOF)
    # Where each source's root lies among all, and how many there are.
    named = top_runs.join(top_spans.select("run", "first", "total"), "run")
    named = named.select(F.posexplode("names").alias("k", "tree"), (F.col("first") + F.col("k")).alias("place"), F.col("total").alias("sources"))
    placed = keep(spans.join(named.select("tree", "place", "sources"), "tree"), f"{at}/placed")
    coordinate = "run long, upper boolean, tree string, level int, idx long"

    def lacking(rows: pd.DataFrame) -> pd.DataFrame:
        run, out = int(rows["run"].iloc[0]), []
        for tree, first, count, total in zip(rows["tree"], rows["first"], rows["count"], rows["total"], strict=True):
            out += [(run, False, tree, level, i) for level, i in missing(np.arange(first, first + count), int(total))]
        out += [(run, True, "", level, i) for level, i in missing(rows["place"].to_numpy(), int(rows["sources"].iloc[0]))]
        return pd.DataFrame(out, columns=["run", "upper", "tree", "level", "idx"])

    wanted = keep(placed.groupBy("run").applyInPandas(lacking, coordinate), f"{at}/wanted")
    shared = nodes.select(F.lit(False).alias("upper"), "tree", "level", "idx", "digest")
    shared = shared.unionByName(top_nodes.select(F.lit(True).alias("upper"), "tree", "level", "idx", "digest"))
    key = ["upper", "tree", "level", "idx"]
    few = wanted.count() <= BROADCAST_ROWS
    got = shared.join(F.broadcast(wanted) if few else wanted, key)
    got = got.groupBy("run").agg(F.collect_list(F.struct(*key, "digest")).alias("fetched"))
    lists = placed.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("tree", "first", "count", "total", "place", "sources"))).alias("spans")
    )
    lists = keep(lists.join(got, "run", "left"), f"{at}/lists")
    known_root = bytes(root["digest"]).hex()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _prove_run(row, known_root)

    return _with(runs.select("run", "doc_ids", "leaves", "altered"), lists).mapInArrow(expand, PROOF)
