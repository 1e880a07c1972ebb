"""The pipeline's stages against plain versions, on the smallest tables."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kinograph.llm import bpe, decontaminate, langid, quality
from tests.llm.test_jaccard import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_quality(spark, docs):
    machine = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = [r.doc_id for r in docs.collect() if machine.scores(*quality.features(np.frombuffer((r.text or "").encode(), np.uint8), np.array([0, len((r.text or "").encode())])))[0] >= corpus_pipeline.LEAST_QUALITY]
    got = corpus_pipeline.keep_quality(spark, docs, FOLDER)
    assert ids(got) == sorted(want) and got.columns == docs.columns


def test_language(spark, docs):
    named = langid.identify(docs, langid.train(docs.select("text", "lang"))).collect()
    want = [r.doc_id for r in named if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE]
    assert ids(corpus_pipeline.keep_language(spark, docs, FOLDER)) == sorted(want)


def test_near_duplicates(spark, docs):
    groups = brute({r.doc_id: r.text for r in docs.collect()}, 5, 80, 100)
    assert ids(corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_decontamination(spark, docs):
    words = lambda t: (t or "").encode().lower().split()
    items = [w for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if (w := words(r.text))]

    def overlaps(x, y):
        size = min(decontaminate.WINDOW, len(y))
        need = size if len(y) < decontaminate.SPAN else np.ceil(decontaminate.SHARE * size)
        if not set(x) & set(y):
            return False
        for shift in range(1 - len(y), len(x)):
            same = [x[i] == y[i - shift] for i in range(max(0, shift), min(len(x), shift + len(y)))]
            if len(same) >= size and sum(same) >= need and any(sum(same[k : k + size]) >= need for k in range(len(same) - size + 1)):
                return True
        return False

    chosen = docs.orderBy("doc_id").limit(60)
    want = [r.doc_id for r in chosen.collect() if not any(overlaps(words(r.text), y) for y in items)]
    assert ids(corpus_pipeline.drop_benchmark_passages(spark, chosen, FOLDER)) == sorted(want)


def test_tokens(spark, docs):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = corpus_pipeline.token_ids(spark, docs, FOLDER).collect()
    assert len(got) == len(texts) and all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decodes for r in got)
