"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from kinograph.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use inside
EXTRA = "row long, score double, ids string, shard int, key long, tokens string, `_p` int, g long, n int, fp long, p int, `_y` int"
#: read other tables; test_negatives.py and test_codes.py have their cases
VECTORS = ("op12_negatives", "op13_codes")
LONG = " ".join(f"word{k % 977} of" for k in range(60_000))


def write(spark, folder, docs, extra=True, pages=(), labels=(), benchmark=()):
    n = len(docs)
    df = spark.createDataFrame([(*d, *([k, 0.5, "x", 3, 9, "t", 1, 2, 3, 4, 5, 6] if extra else [])) for k, d in enumerate(docs)], DOCS + (", " + EXTRA if extra else ""))
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return n


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, LONG, "en", "s", len(LONG)), (5, "the same text of some words here", "en", "s", 1),
    (6, "the same text of some words here", "fr", None, 1), (7, "THE same TEXT of some words here", None, "s", 1), (8, "日本語 テキスト 😀 é", "ja", "s", 1), (9, "1234 !!! ???", "en", "s", 1), (10, "x", "en", "s", 1), (11, LONG, "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    pages = [(1, None, None), (2, "http://a/ b", ""), (3, "http://a", "z" * 100), (4, "http://b\n", "z" * 100), (5, "http://c", "z" * 99), (6, "http://c", "z" * 99), (7, "http://d", LONG), (8, "http://d", LONG), (8, "http://d", LONG), (None, "u", "v")]
    labels = [(2, 0, 0), (5, 1, 0), (6, None, None), (None, 1, 1), (9, 0, 0), (4, 1, 0), (4, 1, 0)]
    benchmark = [(1, "the same text of some words here"), (2, None), (3, ""), (None, "x y z"), (4, "never in any of these texts that there are in this small table at all really")]
    write(spark, folder, ODD, pages=pages, labels=labels, benchmark=benchmark)
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    write(spark, folder, [], extra=False)
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op4_decontaminate", "op6_warc", *VECTORS}))
def test_one_row_for_each_odd_document(spark, odd, name):
    got = QUERIES[name](spark, odd).collect()
    assert sorted(r.doc_id for r in got) == [d[0] for d in ODD]


def test_jaccard(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_jaccard"](spark, odd).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[10] == (1, 10)
    assert {got[k][1] for k in (5, 6, 7)} == {5} and got[11][1] == 4


def test_licences(spark, odd):
    assert all(r.licence is None and r.dice is None and r.units == 0 for r in QUERIES["op2_licences"](spark, odd).collect())


def test_simhash(spark, odd):
    got = {r.doc_id: r for r in QUERIES["op3_simhash"](spark, odd).collect()}
    texts = {d[0]: d[1] or "" for d in ODD}
    for k, text in texts.items():
        following = texts[k - 1 if k > 1 else 11]
        cut = len(text) // 3
        assert got[k].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint == "0" * 16
    assert got[4].fingerprint == got[11].fingerprint


def test_decontamination(spark, odd):
    assert {(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate"](spark, odd).collect()} == {(5, 1), (6, 1), (7, 1)}


def test_shards(spark, odd):
    got = {r.doc_id: r for r in QUERIES["op5_shards"](spark, odd).collect()}
    assert got[1]["size"] == 8 and got[1].text_crc32 == 0
    assert got[8].text_crc32 == zlib.crc32(ODD[7][1].encode())
    assert sorted(r.slot for r in got.values()) == [0] * len(ODD)  # fewer rows than shards


def test_warc(spark, odd):
    got = {r.page_id: r for r in QUERIES["op6_warc"](spark, odd).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {k: ("response", None) for k in (1, 2, 3, 5, 6, 7)} | {4: ("revisit", 3), 8: ("revisit", 7)}
    assert got[1].payload_bytes == 0 and got[8].payload_digest == hashlib.sha256(LONG.encode()).hexdigest()


def test_quality_and_language(spark, odd):
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in QUERIES["op7_quality"](spark, odd).collect())
    got = {r.doc_id: r for r in QUERIES["op10_langid"](spark, odd).collect()}
    assert [k for k in got if got[k].lang_pred == "und"] and {k for k in (1, 2, 3, 9) if got[k].lang_pred == "und"} == {1, 2, 3, 9}
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_model(spark, odd):
    got = {r.doc_id: r for r in QUERIES["op9_lm"](spark, odd).collect()}
    assert got[1].n_tokens == 1 and got[1].score < 0 and got[4].n_tokens == 120_001


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Repeated and missing doc_ids: equal rows, and one doc_id with several texts."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    rows = [(None, "a text of some words without a number", "en", "s", 1), (None, None, None, None, None), (2, "one text of number two", "en", "s", 1), (2, "one text of number two", "en", "s", 1), (2, "another text of number two", "fr", "s", 1), (3, "third", None, "s", 1)]
    write(spark, folder, rows, pages=[(1, "u", "p")], labels=[(2, 1, 0), (3, 0, 0), (3, 0, 0)], benchmark=[(1, "one text of number two")])
    return folder


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op3_simhash", "op4_decontaminate", "op6_warc", *VECTORS}))
def test_each_row_of_a_repeated_or_missing_doc_id_has_its_own(spark, repeated, name):
    assert sorted(str(r.doc_id) for r in QUERIES[name](spark, repeated).collect()) == ["2", "2", "2", "3", "None", "None"]


def test_repeated_doc_ids_of_fingerprints_passages_and_pipeline(spark, repeated):
    got = QUERIES["op3_simhash"](spark, repeated).collect()
    assert sorted(str(r.doc_id) for r in got if r.doc_id is None) == ["None", "None"] and {r.doc_id for r in got} == {None, 2, 3}
    # the distinct texts of 2 after each other, and each as what follows 3
    assert sorted(r.n_chars for r in got if r.doc_id == 2) == [22, 26] and sum(r.doc_id == 3 for r in got) == 2
    assert [(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate"](spark, repeated).collect()] == [(2, 1)]
    assert {r.doc_id for r in corpus_pipeline.run(spark, repeated).collect()} <= {None, 3}


def test_pipeline(spark, odd):
    kept = {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()}
    assert not kept & {1, 2, 3, 5, 6, 7, 9, 11}  # no language, a passage of the benchmark, or a copy
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd).columns == docs.columns, name
