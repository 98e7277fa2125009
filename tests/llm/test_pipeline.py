"""The whole pipeline over a small folder, each stage against plain Python or SQL on what the stage before kept."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cohortry.llm import pii, toxicity
from cohortry.llm.common import keep, prepare, scratch, table
from cohortry.llm.queries import ORACLES, vocabulary

SAME = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Input and output of every stage, each stored."""
    prepare(spark)
    at = scratch(spark, "pipeline-test")
    found = [keep(table(spark, sf, "documents"), f"{at}/documents")]
    for name, stage in corpus_pipeline.STAGES:
        found.append(keep(stage(spark, found[-1], sf), f"{at}/{name}"))
    return at, found


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def _rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_toxicity_stage_keeps_what_scores_below_the_bar(spark, sf, steps):
    _, (docs, out, *_) = steps
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, table(spark, sf, "labels")).collect()}
    assert len(scores) == docs.count()
    assert _ids(out) == sorted(i for i, s in scores.items() if s < 0.7)
    before = _rows(docs)
    assert all(row == before[i] for i, row in _rows(out).items())


def test_quality_stage_follows_the_rules_in_sql(spark, steps):
    at, (_, docs, out, *_) = steps
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at.removeprefix('file://').removeprefix('file:')}/toxicity/*.parquet'")
    verdicts = db.execute(f"SELECT doc_id, kept FROM ({ORACLES['op1_quality_rules']}) v").fetchall()
    assert len(verdicts) == docs.count()
    assert _ids(out) == sorted(i for i, kept in verdicts if kept)


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_near_duplicate_stage_keeps_the_smallest_of_each_group(steps):
    _, (_, _, docs, out, *_) = steps
    sets = {i: _shingles(r["text"]) for i, r in _rows(docs).items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted(i for i in sets if find(i) == i)
    assert len(want) < len(sets), "the folder holds copies"
    assert _ids(out) == want


def test_pii_stage_replaces_spans_and_nothing_else(steps):
    _, (*_, docs, out, _) = steps
    texts, got = _rows(docs), _rows(out)
    assert texts.keys() == got.keys()
    changed = 0
    for r in pii.report(docs).collect():
        before, after = texts[r["doc_id"]], got[r["doc_id"]]
        text, at, parts = before["text"] or "", 0, []
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        for start, back, kind in sorted((int(a), -int(b), k) for k, a, b in spans):
            if start >= at:
                parts.append(text[at:start] + f"[{kind.upper()}]")
            at = max(at, -back)
        clean = "".join(parts) + text[at:]
        assert after["text"] == (None if before["text"] is None else clean)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", clean)
        changed += bool(spans)
    assert changed, "the folder holds personal data"


def test_packing_stage_places_every_token_once(steps):
    _, (*_, docs, packed) = steps
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {i: plain.encode(r["text"] or "", add_special_tokens=False).ids + [1] for i, r in _rows(docs).items()}
    pieces, room = {}, {}
    for r in packed.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    for held in room.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_is_the_stages_one_after_the_other(spark, sf, steps):
    _, (*_, packed) = steps
    got = corpus_pipeline.run(spark, sf)
    assert sorted(tuple(r[c] for c in SAME) for r in got.collect()) == sorted(tuple(r[c] for c in SAME) for r in packed.collect())
