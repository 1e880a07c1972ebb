"""Single operators against plain versions, exact round trips or held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from kinograph.llm import decontaminate, langid, licences, lm, quality, shards, simhash, warc
from kinograph.llm.common import Tables, running_total
from kinograph.llm.components import connected_components

FOLDER = "/root/testdata/sf0.01"


def rows_of(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").toPandas()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Tables(spark)).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_running_total(spark):
    df = spark.createDataFrame([(k % 2, k % 5, k) for k in range(40)], "g int, b int, v long")
    got = running_total(df, ["g"], "b", ["v"], F.col("v"), "t").collect()
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.b, r.v)):
            assert r.t == total
            total += r.v


def test_licences_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    theirs = {r[0]: r[1:] for r in con.execute(licences.oracle()).fetchall()}
    ours = {r.doc_id: (r.licence, r.dice, r.units) for r in licences.op2_licences(spark, FOLDER).collect()}
    assert ours == theirs and sum(v[0] is not None for v in ours.values()) > 20


def test_size_bounds_and_cues_lose_nothing():
    known = licences.template_rows(licences.TEMPLATES, 0.9)
    cues = licences.cues(known)
    for name, grams, low, high in known:
        dice = lambda size: 2 * min(size, len(grams)) / (size + len(grams))
        assert dice(low) >= 0.9 - 1e-9 > dice(low - 1) and dice(high) >= 0.9 - 1e-9 > dice(high + 1), name
        # a unit shares `low` bigrams at least; fewer than that are without a cue
        assert sum(not set(g.split()) & set(cues) for g in grams) < low, name


def test_licences_in_paragraphs_and_sentences(spark):
    grant, whole = licences.TEMPLATES["MIT"][2:]
    terms = whole[len(grant):].strip()
    header = licences.TEMPLATES["Apache-2.0"][2].replace(" Unless", "\n\nUnless")
    texts = {
        1: "A page of notes.\n\n" + grant + "\n \n" + terms + "\n\nMore notes follow here.",
        2: "We like it. Licensed under the MIT License. You may call us (soon) about it.",
        3: "Some code.\n\n" + header.upper() + "\n\nThe end.",
        4: "The software comes with a license, and copies of it, but no notice.",
        5: "",
        6: None,
        7: licences.TEMPLATES["GPL-3.0"][1].replace("; ", ";\n").replace("Foundation, ", "Foundation,\n"),
        8: " ".join(whole.split()[: len(whole.split()) // 2]),
    }
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()] + [(None, texts[2]), (2, texts[2])], "doc_id long, text string")
    rows = [(r.doc_id, r.licence, r.units) for r in licences.scan(docs).collect()]
    by = {k: (name, n) for k, name, n in rows if k}
    assert by[1][0] == "MIT" and by[1][1] >= 2 and by[2] == ("MIT", 1) and by[3][0] == "Apache-2.0"
    assert by[4] == by[5] == by[6] == by[8] == (None, 0) and by[7][0] == "GPL-3.0"
    assert len(rows) == len(texts) + 2 and (None, "MIT", 1) in rows
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r[0], r[1], r[3]) for r in con.execute(licences.oracle()).fetchall()), key=str) == sorted(rows, key=str)


def test_simhash_search_is_exact(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base for _ in range(6)]
    signed = [x - (1 << 64) if x >> 63 else x for x in (f & ((1 << 64) - 1) for f in fps)]
    df = spark.createDataFrame([(x,) for x in signed] + [(None,)], "fp long")
    got = {(r.query_fp, r.fp): r.distance for r in simhash.within_radius(df.limit(60), df, 3, 5).collect()}
    u = lambda x: x & ((1 << 64) - 1)
    queries = {r.fp for r in df.limit(60).collect() if r.fp is not None}
    want = {(a, b): (u(a) ^ u(b)).bit_count() for a in queries for b in set(signed) if (u(a) ^ u(b)).bit_count() <= 3}
    assert got == want


def test_simhash_by_hand(spark):
    texts = ["alpha beta gamma", "beta", "x " * 50 + "longerword", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    words = sorted({w for t in texts for w in t.split()})
    hashes = {r.w: r.h & ((1 << 64) - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = {r.k: r.fp & ((1 << 64) - 1) for r in simhash.fingerprints(df, ["k"]).collect()}
    for k, t in enumerate(texts):
        votes = [0] * 64
        for w in t.split():
            for bit in range(64):
                votes[bit] += max(1, 2 * len(w) - 5) * (1 if hashes[w] >> bit & 1 else -1)
        assert got[k] == sum(1 << b for b, v in enumerate(votes) if v > 0)


def test_next_descending(spark):
    ids = [1, 2, 5, 4095, 4096, 4097, 10**7, 10**12, -3, 2**62]
    got = {r.doc_id: r.next_id for r in simhash.next_descending(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    order = sorted(ids, reverse=True)
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_each_overlap_that_counts_has_a_seed():
    for size in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        wrong = size - math.ceil(decontaminate.SHARE * size)
        places = [{at + i for i, x in enumerate(m) if x == "1"} for m in decontaminate.MASKS for at in range(size - len(m) + 1)]
        assert all(any(not p & set(chosen) for p in places) for chosen in itertools.combinations(range(size), wrong)), size


def test_recall_at_every_number_of_substitutions(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    items = [[word() for _ in range(16)] for _ in range(150)]
    docs = []
    for k, item in enumerate(items):
        for wrong in range(6):
            passage = list(item)
            for at in rng.sample(range(16), wrong):
                passage[at] = word()
            docs.append((k * 10 + wrong, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)])))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k * 10 + wrong, k) for k in range(150) for wrong in range(5)}


def test_substituted_passages_are_found(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(rng.choice([6, 14, 25, 60]))] for _ in range(12)]
    docs, want = [], set()
    for d in range(120):
        w = [word() for _ in range(rng.randrange(0, 80))]
        if d % 2:
            k = rng.randrange(len(items))
            passage = list(items[k])
            if len(passage) > 12:
                passage[rng.randrange(len(passage))] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = [p.upper() for p in passage]
            want.add((d, k))
        docs.append((d, " ".join(w), 1))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string, begin int"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_a_group_larger_than_a_shard_is_split_as_little_as_can_be(spark):
    rows = [(k, 1 if k < 400 else 2 if k < 420 else k) for k in range(1200)]
    df = Tables(spark).keep(spark.createDataFrame(rows, "doc_id long, g0 long"))
    got = shards.balanced_shards(df, "g0", 12).toPandas()
    counts = got.groupby("shard").size()
    assert counts.tolist() == [100] * 12
    assert all(sorted(x) == list(range(100)) for _, x in got.groupby("shard").slot)
    assert got[got.g0 == 1].shard.nunique() <= 6 and got[got.g0 == 2].shard.nunique() == 1


@pytest.fixture(scope="module")
def archive():
    dictionary = zstandard.train_dictionary(4096, [f"<html><body>page {k} of the sample {k * k}</body></html>".encode() * 3 for k in range(400)]).as_bytes()
    context = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    raw = [warc.record_bytes(k, f"http://a/{k}", f"<html>{k}</html>".encode() * k, hashlib.sha256(f"<html>{k}</html>".encode() * k).hexdigest(), "response", None) for k in range(5)]
    return dictionary, context, raw


def test_a_page_with_two_payloads(spark, tmp_path):
    rows = [(3, "u", "z" * 100), (3, "u", "y" * 120), (4, "u", "z" * 100), (4, "v", "z" * 100), (2, "u", "y" * 120), (3, "u", "y" * 120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.op6_warc(spark, str(tmp_path)).collect())
    assert got == [(2, 120, "response", 0), (3, 100, "response", 0), (3, 120, "revisit", 2), (3, 120, "revisit", 2), (4, 100, "revisit", 3), (4, 100, "revisit", 3)]


def test_pages_equal_a_plain_version(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect()
    payload = {r.page_id: (r.html or "").encode() for r in pages}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    got = {r.page_id: r for r in warc.op6_warc(spark, FOLDER).collect()}
    assert len(got) == len(pages) == len(payload)
    for i, data in payload.items():
        later = len(data) >= 100 and first[data] != i
        want = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", first[data] if later else None)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want


def test_archives_round_trip(archive):
    dictionary, context, raw = archive
    for d in (dictionary, zstandard.compress(dictionary)):
        data = warc.dictionary_frame(d) + b"".join(map(context.compress, raw))
        assert [r["payload"] for r in warc.records(data)] == [f"<html>{k}</html>".encode() * k for k in range(5)]


@pytest.mark.parametrize("damage", ["no_dictionary", "cut", "length", "junk", "version", "header"])
def test_damaged_archives_fail(archive, damage):
    dictionary, context, raw = archive
    one = raw[3]
    if damage == "length":
        one = one.replace(b"Content-Length: ", b"Content-Length: 1", 1)
    if damage == "version":
        one = one.replace(b"WARC/1.1", b"WARC/9.9")
    if damage == "header":
        one = one.replace(b"WARC-Date: ", b"WARC-Nate: ")
    data = (b"" if damage == "no_dictionary" else warc.dictionary_frame(dictionary)) + context.compress(one)
    data = data[:-5] if damage == "cut" else data + b"junk" if damage == "junk" else data
    with pytest.raises(warc.ArchiveError):
        list(warc.records(data))


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32))
    x = np.zeros((3, 20), np.float32)
    x[0, [1, 5, 7]], x[1, [2]], x[2, 3:15] = [1, 0.5, 2], 3, rng.normal(size=12)
    index, value, off = np.concatenate([np.flatnonzero(r) for r in x]), np.concatenate([r[r != 0] for r in x]), np.cumsum([0, *(np.count_nonzero(r) for r in x)])
    for r, got in zip(x, m.raw_scores(index, value, off)):
        want = 0.3 + r @ m.weights + sum(m.factors[i] @ m.factors[j] * r[i] * r[j] for i, j in itertools.combinations(range(20), 2))
        assert got == pytest.approx(want, rel=1e-4)


def test_quality_on_held_out_documents(spark):
    got = quality.op7_quality(spark, FOLDER).toPandas().merge(rows_of(spark, "labels"), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got.held_out]
    assert len(held) > 30 and (held.predicted == held.quality).mean() >= 0.97


def test_language_on_held_out_documents(spark):
    got = langid.op10_langid(spark, FOLDER).toPandas().merge(rows_of(spark, "documents"), on="doc_id", suffixes=("", "_d"))
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.lang_pred == held.lang).mean() >= 0.97 and got.score.between(0, 1).all()


def test_language_by_words_and_grams_that_tasks_do_not_hold(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    texts = [(lang, " ".join(word(letters) for _ in range(400))) for lang, letters in (("x", "abcdeé"), ("y", "abcfgü"), ("z", "cefhi")) for _ in range(3)]
    # "rare" is once in y, its letters are common in x
    texts += [("x", "raro rarx arex " * 50), ("y", "rare")]
    asked = ["rare", "rarest", "bead fég hij", "zzz", "a", "ühia ciffe", "q1q", "", "12"]
    counts: dict = collections.defaultdict(collections.Counter)
    grams = lambda w, n: [g for g in (f" {w} "[k : k + n] for k in range(len(w) + 3 - n)) if " " not in g[1:-1] and g != " "]
    for lang, text in texts:
        for w in text.split():
            counts[0, lang][w] += 1
            for n in range(1, 5):
                counts[n, lang].update(grams(w, n))
    names = ["x", "y", "z"]

    def logs(n, key):
        space = max(len(counts[n, x]) for x in names) + 1
        return np.array([math.log10((counts[n, x][key] + 0.5) / (counts[n, x].total() + 0.5 * space)) for x in names])

    def known(n, keys):
        return [k for k in keys if any(counts[n, x][k] for x in names)]

    def vector(w):
        if known(0, [w]):
            return logs(0, w)
        return next((np.mean([logs(n, g) for g in found], axis=0) for n in (4, 3, 2, 1) if (found := known(n, grams(w, n)))), np.zeros(3))

    docs = spark.createDataFrame(texts, "lang string, text string")
    questions = spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "k int, text string")
    for words, held in ((3, 5), (1 << 16, 1 << 16)):
        got = {r.k: (r.lang_pred, r.score) for r in langid.identify(questions, langid.train(docs, words, held)).collect()}
        for k, text in enumerate(asked):
            if not any(c.isalpha() for c in text):
                assert got[k] == ("und", 0)
                continue
            total = sum(vector(w) for w in text.replace("1", " ").split())
            share = np.exp(total - total.max())
            assert got[k] == (names[int(total.argmax())], pytest.approx(share.max() / share.sum(), rel=1e-9)), text
        assert got[0][0] == "y"


def test_language_stores_no_spelling_of_learned_texts(spark, monkeypatch):
    rng = random.Random(7)
    texts = [(k, rng.choice("xy"), " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6))) for _ in range(60))) for k in range(40)]
    texts += [(40, "x", None), (41, None, "abc dcba"), (42, "y", "12")]
    docs = spark.createDataFrame(texts, "k int, lang string, text string")
    model = langid.train(docs.where("k < 30 or k >= 40"), 3, 5)
    want = {r.k: (r.lang_pred, r.score) for r in langid.scores(docs, model, ["k"]).collect()}
    stored = []

    class Kept(langid.Tables):
        def keep(self, df, name=None):
            stored.append(super().keep(df, name))
            return stored[-1]

    monkeypatch.setattr(langid, "Tables", Kept)
    out = langid.scores(docs, model, ["k"], learned=F.expr("(k < 30 or k >= 40) and lang is not null and text is not null"))
    got = {r.k: (r.lang_pred, r.score) for r in out.collect()}
    assert {k: (x, pytest.approx(y, rel=1e-9)) for k, (x, y) in want.items()} == got
    heads, met = stored[:2]
    spelt = {r.k for r in heads.where(F.exists("word", lambda w: w.isNotNull())).select("kept.k").collect()}
    assert spelt == {*range(30, 40), 41}
    known = met.where("by is not null")
    assert known.count() > 500 and known.where("key is not null or word is not null").count() == 0
    assert met.where("by is null and (key is null or word is null)").count() == 0 < met.where("by is null").count()


def test_unseen_grams_back_off_however_many_are_known(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdefghijklmnopqrstuv") for _ in range(6)) for _ in range(40_000)}
    assert len({w[k : k + 4] for w in words for k in range(3)}) > 80_000
    docs = spark.createDataFrame([("x", " ".join(sorted(words))), ("y", "wxyz zyxw")], "lang string, text string")
    # no 4-gram of this word was seen; of its 3-grams xyz and zyx were, once each in y alone
    got = langid.identify(spark.createDataFrame([("xyzyx",)], "text string"), langid.train(docs)).first()
    space = len({f" {w} "[k : k + 3] for w in words for k in range(6)}) + 1
    x, y = math.log10(0.5 / (6 * len(words) + 0.5 * space)), math.log10(1.5 / (8 + 0.5 * space))
    assert (got.lang_pred, got.score) == ("y", pytest.approx(1 / (1 + math.exp(x - y)), rel=1e-9))


def test_language_model(spark):
    docs = rows_of(spark, "documents")
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in zip(docs.doc_id, docs.text)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # few words are held by the tasks, so that most go through the shuffled table
    got = lm.score(frame, frame.where(~quality.held_out(F.col("doc_id"), 7, 2)), frequent_most=700).toPandas().set_index("doc_id")
    for i, ws in tokens.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    held = got[[out[i] for i in got.index]]
    assert held.score.sum() > held.base_score.sum() * 0.97


def small_model(rng, k=12, size=4):
    return lm.Parameters(rng.normal(size=(k, size)), rng.normal(size=(k, size)), rng.normal(size=(2, size)), rng.normal(size=k))


def test_class_probabilities_add_up_to_one():
    m = lm.normalised(small_model(np.random.default_rng(2)))
    for one, two in itertools.product(range(12), repeat=2):
        p = 10 ** m.log10(np.arange(12), np.full(12, one), np.full(12, two))
        assert p.sum() == pytest.approx(1, rel=1e-5)


def test_both_positions_are_learned_together():
    # the class before tells nearly the same as the one before that: counted one by one, their evidence would count twice
    rng = np.random.default_rng(4)
    one = rng.integers(0, 3, 60_000)
    two = np.where(rng.random(60_000) < 0.9, one, rng.integers(0, 3, 60_000))
    chance = 1 / (1 + np.exp(-(one + two - 2.0)))
    seq = np.where(rng.random(60_000) < chance, 3, 4)
    unigram = np.bincount(seq, minlength=5) + 1.0
    trainer = lm.Trainer(lm.first_parameters(unigram / unigram.sum(), 8), unigram / unigram.sum(), 1)
    for _ in range(6):
        trainer.take(seq, one, two)
    got = 10 ** lm.normalised(trainer.p).log10(np.full(60_000, 3), one, two)
    assert np.abs(got - chance).mean() < 0.04


def test_scores_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 300")
    tables = Tables(spark)
    learned = lm.learn(docs.where("doc_id % 3 > 0"), tables, classes=400, frequent_most=900)
    got = {r.doc_id: r.score for r in lm.scored(docs, learned, tables).collect()}
    counts = {r.key & (1 << 64) - 1: r.c for r in learned.counts.collect()}
    f, p = learned.frequent, learned.model.p
    for r in docs.where("doc_id < 40").collect():
        raw, off = lm.text_buffers(pa.array([r.text]))
        hashes, _, starts = lm.word_hashes(raw, off)
        before, total = [lm.END, lm.END], 0.0
        for h, g in [*zip(hashes.tolist(), lm.endings(raw, starts).tolist()), (None, None)]:
            at = int(np.searchsorted(f.keys, h)) if h is not None else 0
            own = h is not None and at < len(f.keys) and int(f.keys[at]) == h and f.classes[at]
            cls = lm.END if h is None else int(own or g)
            x = (p.context[before[-1]] * p.weight[0] + p.context[before[-2]] * p.weight[1]) @ p.target.T + p.bias
            total += (x[cls] - np.log(np.exp(x).sum())) / math.log(10)
            if h is not None and not own:
                total += math.log10((counts.get(h, 0) + 1) / learned.split[g])
            before.append(cls)
        assert got[r.doc_id] == pytest.approx(total, rel=1e-5)
