"""The encoder against the tokenizers library, and the decoder as a round trip."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinograph.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def sample_texts():
    rng = random.Random(4)
    texts = ["", " ", "Hello world's it'll  \n\n x", "<|endoftext|>ab<|endoftext|> <|endoftext", "a" * 3000 + " " * 500, "é" * 300, "😀" * 40, "0123456789" * 40, "x y 　z\x85"]
    texts += ["".join(rng.choice("abcdefghij ABC  \n\t'.,!é日😀0123") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return texts


def test_ids_equal_the_library(library):
    c, d = bpe.encoder(bpe.default_vocabulary()), bpe.decoder(bpe.default_vocabulary())
    for t in sample_texts():
        ids = np.frombuffer(c.encode(t), np.uint32)
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert d.decode(ids.astype(np.int32), np.array([0, len(ids)])) == [t]


def test_query_columns_and_nulls(spark, library, tmp_path):
    texts = [None, *sample_texts()[:30]]
    rows = [(i, t, "ids", "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op8_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df)).count() == 0


def test_another_kind_of_vocabulary_fails():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_documents_equal_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in bpe.op8_bpe(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) > 50
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_one_pass_gives_what_two_give(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate([None, *sample_texts()[:140]])], "k int, text string, coded string")
    two = {r.k: r for r in bpe.decode(bpe.encode(df)).collect()}
    for r in bpe.round_trip(df).collect():
        assert (r.coded.ids, r.coded.decoded) == (two[r.k].ids, two[r.k].decoded)


def test_a_byte_without_a_token_is_told(tmp_path):
    import json

    import pytest

    from kinograph.llm.bpe import Encoder

    spec = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    encoder = Encoder(str(tmp_path / "v.json"))
    assert encoder.encode_piece(b"abba") == [2, 1, 0]
    with pytest.raises(ValueError, match="no token"):
        encoder.encode_piece(b"abc")


def test_a_piece_of_the_generation_before_is_not_encoded_again():
    asked = []
    pieces = bpe.Pieces(lambda piece: asked.append(piece) or piece, 2)
    assert [pieces[x] for x in "abcab"] == [b"a", b"b", b"c", b"a", b"b"]
    assert asked == [b"a", b"b", b"c"] and len(pieces) <= 2
    assert pieces["x" * 65] == b"x" * 65 and "x" * 65 not in pieces  # long ones aren't kept
