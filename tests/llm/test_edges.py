"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from cohortry.llm import ann, licenses, neardup, packing, pieces, pii, quality, rans, toxicity, warc
from cohortry.llm.common import prepare, scratch
from cohortry.llm.queries import QUERIES, vocabulary
from cohortry.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, score double, `__lang` string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, a, b, None if t is None else len(t), None, "x", 0.5, "y") for i, t, a, b in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    long_text = " ".join(f"word{i % 977} and {i}" for i in range(60_000))
    text = "One two three four five six seven eight nine ten eleven twelve. Mail a.b@c.example now."
    rows = [
        (1, None, "en", "s"), (2, "", None, None), (3, " \n\t ", "en", None), (4, long_text, "en", "s"), (5, long_text, "en", "s"),
        (6, text, "en", "s"), (6, text, "en", "s"), (7, text, None, "s"), (None, text, "en", "s"), (8, "x", "", ""), (9, "a" * 50_000, "en", "s"),
    ]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, None, 1), (None, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(odd, none):
    found = {r["doc_id"]: r for r in quality.judge(odd).collect()}
    assert found[1]["n_words"] == found[2]["n_words"] == 0 and found[1]["base_failed"] and not found[1]["kept"]
    assert found[6]["n_words"] == 15 and found[6]["kept"] and found[9]["word_chars"] == 50_000
    assert quality.judge(odd).count() == 11 and quality.judge(none).count() == 0
    kept = quality.keep_good(odd)
    assert kept.schema == odd.schema and kept.where("doc_id = 6").count() == 2
    assert quality.keep_good(none).count() == 0


def test_near_duplicates(odd, none):
    found = [tuple(r) for r in neardup.near_duplicates(odd).collect()]
    by_id = {r[0]: r for r in found}
    assert len(found) == 11 and by_id[7][2:] == (6, False) and by_id[5][2:] == (4, False)
    assert by_id[1][1:] == (0, 1, True) and by_id[None][2:] == (None, True)
    assert sum(r[0] == 6 and r[3] for r in found) == 2
    assert neardup.near_duplicates(none).count() == 0
    assert sorted(str(r[0]) for r in neardup.keep_first(odd).collect()) == sorted(map(str, [1, 2, 3, 4, 6, 6, None, 8, 9]))


def test_pii(odd, none):
    assert pii.report(odd).count() == 11 and pii.report(none).count() == 0
    found = {r["doc_id"]: r for r in pii.report(odd).collect()}
    assert found[1]["spans"] == "" and found[6]["spans"] == "email:69:82"
    clean = {r["doc_id"]: r for r in pii.redact(odd).collect()}
    assert clean[1]["text"] is None and clean[6]["text"].endswith("Mail [EMAIL] now.") and clean[6]["n_chars"] == len(clean[6]["text"])
    assert pii.redact(odd).columns == odd.columns


def test_packing(odd, none):
    encoder = Encoder(vocabulary("byte_bpe_50k.json"), end=1)
    placed, stored = packing.pack_documents(odd, encoder)
    rows = placed.collect()
    assert {r["doc_id"] for r in rows if r["doc_tokens"] == 1} == {1, 2}
    assert sum(r["doc_id"] == 6 for r in rows) == 2
    assert packing.pack_documents(none, encoder)[0].count() == 0
    sequences = packing.assemble(placed, stored).collect()
    for s in sequences:
        assert len(s["ids"]) == 2048 or len(s["ids"]) == s["n_tokens"] and s["n_tokens"] & (s["n_tokens"] - 1) == 0
    assert sum(s["n_tokens"] for s in sequences) == sum(r["length"] for r in rows)


def test_token_files(spark, odd, none):
    encoder = Encoder(vocabulary("word_bpe_49k.json"), end=2)
    at = scratch(spark, "test")
    rans.store_ids(odd, encoder, at)
    rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in rans.load_ids(spark, at).collect())
    assert [r[2] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    assert [r[0] for r in rows] == [sum(x[1] for x in rows[:k]) for k in range(11)]
    at = scratch(spark, "test")
    rans.store_ids(none, encoder, at)
    assert rans.load_ids(spark, at).count() == 0


def test_pieces(odd, none):
    model = pieces.PieceModel(vocabulary("piece_bpe_32k.model"))
    coded = pieces.encode_documents(odd, model)
    found = {r["doc_id"]: r for r in coded.collect()}
    assert found[1]["n_pieces"] == found[2]["n_pieces"] == 0 and all(r["same"] for r in found.values())
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(coded, model).collect()}
    assert all(back[k] == (v or "") for k, v in texts.items())
    assert pieces.encode_documents(none, model).count() == 0


def test_toxicity(odd, none, labels):
    found = {r["doc_id"]: r for r in toxicity.score(odd, labels).collect()}
    assert len(found) == 10 and found[1]["score"] == found[2]["score"] and found[None]["held_out"] is False
    assert toxicity.score(none, labels).count() == 0 and toxicity.score(odd, labels.limit(0)).count() == 11
    assert toxicity.keep_harmless(odd, labels).columns == odd.columns


def test_licenses(odd, none):
    assert licenses.find_licenses(odd).where("n_units > 0").count() == 0 and licenses.find_licenses(odd).count() == 11
    assert licenses.find_licenses(none).count() == 0


def test_nearest(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]),
            (7, [0.5, 0.5]), (None, [1.0, 1.0]), (40, [float("inf"), 0.0]), (8, [1.0, 0.0, 0.0]), (20, [1.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0.1) for i, v in rows], "vec_id long, embedding array<float>, score double")
    use = ann.usable(table)
    found = ann.nearest(ann.every_twentieth(use), use, k=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(20, 1, 1, 1.0), (20, 2, 6, 0.5), (20, 3, 7, 0.5)]
    assert ann.nearest(use.limit(0), use.limit(0)).count() == 0


def test_archives(spark):
    rows = [(3, "http://a\r\nX: y", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (None, "u", "same"), (7, "u", "é" * 100_000), (1, None, "same")]
    table = spark.createDataFrame([(a, b, c, "z") for a, b, c in rows], "page_id long, url string, html string, digest string")
    at = scratch(spark, "test")
    warc.write_archives(table, at)
    found = [tuple(r) for r in warc.read_archives(spark, at).select("page_id", "record_type", "payload_bytes", "refers_to").collect()]
    want = [(1, "response", 4, None), (1, "revisit", 4, 1), (3, "revisit", 4, 1), (None, "revisit", 4, 1), (2, "response", 0, None), (5, "revisit", 0, 2), (7, "response", 200_000, None)]
    assert sorted(map(str, found)) == sorted(map(str, want))
    at = scratch(spark, "test")
    warc.write_archives(table.limit(0), at)
    assert warc.read_archives(spark, at).count() == 0


def test_stages_keep_columns(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_queries_are_registered():
    assert [q.split("_")[0] for q in QUERIES] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]
