"""Ranked search, Merkle manifest and fingerprints against brute force, and on odd tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import fingerprints, merkle, search
from cohortry.llm.common import prepare, scratch, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, run long, tree string, `__cell` long"


@pytest.fixture(scope="module")
def docs(spark):
    return table(prepare(spark), SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated ids and rows, clashing columns."""
    prepare(spark)
    long_text = " ".join(f"word{i % 977} and {i}" for i in range(60_000))
    text = "One two three four\nfive six seven eight nine ten"
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, " \n\t ", "en", None), (4, long_text, "en", "s"), (5, long_text, "en", "s"),
            (6, text, "en", "s"), (6, text, "en", "s"), (7, text, None, "s"), (None, text, "en", "s"), (8, "x\ny", "", ""), (1 << 50, "é" * 50_000, "en", "s")]
    return spark.createDataFrame([(i, t, a, b, None if t is None else len(t), True, 5, "t", 0) for i, t, a, b in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


# --- search ---------------------------------------------------------------


def slow_search(rows, items, k=10):
    parsed = [(i, Counter(search.terms_of((t or "").encode()))) for i, t in rows]
    parsed = [(i, c) for i, c in parsed if c]
    n, total = len(parsed), sum(sum(c.values()) for _, c in parsed)
    df = Counter(t for _, c in parsed for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in parsed:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, r in Counter(search.terms_of((text or "").encode())).items() if t in c)
            found += [(-s, -math.inf if i is None else i)] if s > 0 else []
        out += [(item, r + 1, None if i == -math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def test_terms():
    text = "Ab_cD-é9 \x00x İ Ω"
    want = [t.translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    assert [t.decode() for t in search.terms_of(text.encode())] == want


def test_range_maximum():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 9, 500)
    table = search.RangeMaximum(values, 500)
    start = rng.integers(0, 500, 400)
    end = np.minimum(start + rng.integers(0, 300, 400), 500)
    for a, b, at in zip(start, end, table.places(start, end), strict=True):
        assert at == -1 if a == b else (a <= at < b and values[at] == values[a:b].max())


@pytest.mark.parametrize("small", [0, 3, 256])
def test_shards_give_the_best(monkeypatch, small):
    """Best-first search over several shards, with many ties, finds what scoring every document finds."""
    monkeypatch.setattr(search, "SMALL", small)
    monkeypatch.setattr(search, "SPLIT_AT_ONCE", 5)
    rng = np.random.default_rng(small)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(0, 40)) % 60)) for i in range(900)]
    rows += [(2000 + i, rows[7][1]) for i in range(200)] + [(None, rows[7][1])]
    items = [(j, " ".join(f"w{x}" for x in rng.integers(0, 60, 1 + j % 12))) for j in range(40)] + [(40, ""), (41, rows[7][1])]
    parsed = [Counter(search.terms_of(t.encode())) for _, t in rows]
    n, total = sum(map(bool, parsed)), sum(sum(c.values()) for c in parsed)
    df = Counter(t for c in parsed for t in c)
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    shards = []
    for part in range(4):
        shard = search._Shard()
        for i, t in rows[part::4][:: -1 if part == 2 else 1]:
            shard.add(i, t.encode())
        shards.append(search.Searcher(shard.row().to_pylist()[0], weights, n, total))
    got = []
    for item, text in items:
        query = {t: weights[t] * c for t, c in Counter(search.terms_of(text.encode())).items() if t in weights}
        best = []
        for shard in shards:
            best = shard.search(query, 10, best)
        ranked = sorted((-s, i) for s, i in best)
        got += [(item, r + 1, None if i == search.NO_ID else i, -s) for r, (s, i) in enumerate(ranked)]
    assert got == slow_search(rows, items)


def test_search_documents(spark, docs, monkeypatch):
    items = table(spark, SF, "benchmark")
    monkeypatch.setattr(search, "BLOCK_ITEMS", 7)
    got = search.search_documents(docs.repartition(5), items).select("item_id", "rank", "doc_id", "score").orderBy("item_id", "rank")
    want = slow_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert [tuple(r) for r in got.collect()] == sorted(want)


def test_search_odd_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "five SIX"), (1, "five six"), (2, None), (None, "x é"), (3, "nothing")], "item_id long, text string")
    got = [tuple(r) for r in search.search_documents(odd, items).select("item_id", "rank", "doc_id").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1, None), (1, 2, 6), (1, 3, 6), (1, 4, 7)] * 2 + [(None, 1, 8)]))
    assert search.search_documents(none, items).count() == 0 and search.search_documents(odd, items.limit(0)).count() == 0


# --- manifest ---------------------------------------------------------------


def test_missing_nodes_suffice_and_are_needed():
    rng = np.random.default_rng(4)
    for total in (1, 2, 3, 4, 10, 27, 28, 100):
        leaves = {i: merkle.digest(str(i)) for i in range(total)}
        whole = merkle.climb({0: dict(leaves)}, total)
        top = merkle._height(total)
        assert len(whole[top]) == 1
        for _ in range(6):
            own = np.unique(rng.integers(0, total, rng.integers(1, total + 1)))
            lacking = merkle.missing(own, total)

            def derived(coordinates, own=own, whole=whole, total=total):
                known = {0: {int(i): whole[0][int(i)] for i in own}}
                for level, i in coordinates:
                    known.setdefault(level, {})[i] = whole[level][i]
                return merkle.climb(known, total).get(merkle._height(total))

            assert derived(lacking) == whole[top]
            assert not any(derived(lacking[:j] + lacking[j + 1 :]) for j in range(len(lacking)))


def slow_proofs(rows):
    """Proofs by whole trees in memory: rows of (doc_id, source, leaf, altered)."""
    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def siblings(tree, i):
        for nodes in tree[:-1]:
            start = i // 3 * 3
            yield nodes[start:i], nodes[i + 1 : start + 3]
            i //= 3

    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([r[2] for r in sorted((r for r in rows if r[1] == s), key=key)]) for s in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for s, tree in zip(names, trees, strict=True):
        for i, r in enumerate(sorted((r for r in rows if r[1] == s), key=key)):
            path = [*siblings(tree, i), *siblings(top, names.index(s))]
            value = r[3]
            for a, b in path:
                value = h([*a, value, *b])
            out.append((r[0], r[2], tree[-1][0], top[-1][0], h([x for a, b in path for x in [*a, *b]]), value, value == top[-1][0]))
    return sorted(out, key=str)


def plain_rows(rows):
    import zlib

    def leaf(r, text):
        fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields).encode()).hexdigest()

    for r in rows:
        even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        yield r["doc_id"], r["source"], leaf(r, r["text"]), leaf(r, r["text"].replace("\n", "") if even and r["text"] else r["text"])


@pytest.mark.parametrize("run", [1, 7, 50, 10_000])
def test_proofs(docs, run):
    rows = list(plain_rows(docs.collect()))
    if run < 7:
        docs, rows = docs.where("doc_id % 9 = 1"), [r for r in rows if r[0] % 9 == 1]
    assert sorted((tuple(r) for r in merkle.prove(docs, run=run).collect()), key=str) == slow_proofs(rows)


def test_proofs_of_odd_tables(odd, none):
    got = sorted((tuple(r) for r in merkle.prove(odd, run=2).collect()), key=str)
    assert got == slow_proofs(list(plain_rows(odd.collect())))
    assert merkle.prove(none).count() == 0
    one = odd.where("doc_id = 8")
    assert [tuple(r) for r in merkle.prove(one).collect()] == slow_proofs(list(plain_rows(one.collect())))


# --- fingerprints ---------------------------------------------------------------


def slow_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    return {hashlib.md5(g.encode()).hexdigest()[:12] for g in grams}


def slow_sketch(text, size=128):
    return sorted(slow_set(text))[:size]


def test_fingerprints(docs, odd, none):
    for frame in (docs, odd):
        rows = sorted(frame.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
        texts = [r["text"] or "" for r in rows]
        want = []
        for r, t, after in zip(rows, texts, [*texts[1:], texts[0]], strict=True):
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            want.append((r["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(slow_sketch(t)), "".join(slow_sketch(edited))))
        got = [tuple(r)[:5] for r in fingerprints.fingerprint_documents(frame).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_next_where_ids_are_far_apart(spark):
    ids = [0, 1, 4095, 4096, 10**6, -5, 1 << 60, -(1 << 62), None]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(rows).collect()}
    order = [None, *sorted(i for i in ids if i is not None)]
    assert got == {a: f"t{b}" for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    alone = fingerprints.with_next(rows.where("doc_id = 1")).collect()
    assert [(r["text"], r["next_text"]) for r in alone] == [("t1", "t1")]


def test_estimates(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(6000)]
    pairs = [("", ""), ("", "a b c d e f"), ("A b", "a B"), (" ".join(words[:300]), " ".join(words[200:500]))]
    pairs += [(" ".join(words[: int(n)]), " ".join(words[int(m) :])) for n, m in zip(rng.integers(3000, 6000, 8), rng.integers(0, 3000, 8), strict=True)]
    a, b = (fingerprints.sketch(F.col(c)) for c in "ab")
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", a.alias("x"), b.alias("y"))
    x, y = F.col("x"), F.col("y")
    back = fingerprints.from_text(fingerprints.to_text(x)) == x
    measured = rows.select(
        "a", "b", "x", fingerprints.resemblance(x, y).alias("near"), fingerprints.containment(x, y).alias("within"),
        fingerprints.distinct_shingles(x).alias("n"), fingerprints.merge(x, y).alias("both"), back.alias("back"),
    )
    for r in measured.collect():
        s, t = slow_set(r["a"]), slow_set(r["b"])
        assert r["x"] == sorted(s)[:128] and r["both"] == sorted(s | t)[:128] and r["back"]
        assert abs(r["near"] - (len(s & t) / len(s | t) if s | t else 1)) < (0.16 if len(s | t) > 128 else 1e-9)
        assert abs(r["n"] - len(s)) <= 0.3 * len(s) * (len(s) >= 128)
        assert abs(r["within"] - (len(s & t) / len(s) if s else 1)) < 0.3


def test_sketches_of_groups(docs):
    """Sketches of parts merge to the sketch of all: per source, and with null and empty groups."""
    rows = docs.select(F.when(F.col("source") != "src1", F.col("source")).alias("g"), fingerprints.sketch(F.col("text")).alias("s"), "text")
    got = {r["g"]: r["s"] for r in fingerprints.merge_by(rows, ["g"], "s").collect()}
    sets = {}
    for r in rows.collect():
        sets.setdefault(r["g"], set()).update(slow_set(r["text"]))
    assert got == {g: sorted(s)[:128] for g, s in sets.items()}
    empty = rows.select(F.lit(None).cast("string").alias("g"), F.array().cast("array<string>").alias("s"))
    assert [tuple(r) for r in fingerprints.merge_by(empty, ["g"], "s").collect()] == [(None, [])]


def test_indexes_are_stored(spark, docs):
    at = scratch(spark, "index")
    index = search.build_index(docs, at)
    assert spark.read.parquet(at).agg(F.sum("n_docs")).first()[0] == index.agg(F.sum("n_docs")).first()[0] == docs.where("text rlike '[0-9A-Za-z]'").count()
