"""The join against all pairs, on texts with many near copies around both thresholds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinograph.llm import jaccard
from kinograph.llm.common import Tables, chunks, shingle_sets, word_hashes


def brute(texts, width, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed):
    rng = random.Random(seed)
    texts, k = {}, 0
    passage = [f"shared{j}" for j in range(25)]
    for family in range(9):
        size = rng.choice([6, 20, 40, 90, 200])
        base = [f"f{family}w{j}" if rng.random() < 0.8 else rng.choice(["the", "of", "a"]) for j in range(size)]
        if family % 3 == 0:
            base[:0] = passage
        for _ in range(rng.choice([1, 12, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                at = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.5:
                    w[at] = f"edit{rng.randrange(30 if family % 2 else 10**6)}"
                elif kind < 0.75 and len(w) > 3:
                    del w[at]
                else:
                    w.insert(at, f"new{rng.randrange(5)}")
            if rng.random() < 0.2:
                w = w[: max(2, int(len(w) * rng.choice([0.95, 0.85, 0.7])))]
            texts[k * 7 % 1009 + 1] = " ".join(w)
            k += 1
    return texts


@pytest.mark.parametrize("seed,width,num", [(1, 3, 90), (2, 5, 80), (3, 3, 80), (4, 2, 60)])
def test_components_equal_all_pairs(spark, seed, width, num):
    texts = families(seed)
    texts[5000], texts[5001], texts[5002] = None, "", "a b"
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, key string").repartition(3)
    tables = Tables(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, width, num, 100, tables).collect()}
    assert got == brute(texts, width, num, 100)
    # the matrix rules queries out, and every link comes out of a group that it opened
    queries, opened = tables.named["queries"], tables.named["opened"]
    assert 0 < opened.count() <= queries.count()
    links = {(r.a, r.b) for name in ("links", "other_links", "more_links") for r in tables.named[name].collect()}
    group = {r.s1: r.g for r in opened.select("s1", "g").collect()}
    reached = {(r.s1, r.h) for r in opened.collect()}
    assert links and all((a, group[b]) in reached and (b, group[a]) in reached for a, b in links)
    assert tables.named["links"].count() > tables.named["more_links"].count()


def test_a_row_is_linked_by_its_own_text(spark):
    words = [f"w{k}" for k in range(60)]
    near, other = " ".join(["v", *words[1:]]), " ".join(f"x{k}" for k in range(60))
    rows = [(5, " ".join(words)), (3, near), (3, other), (3, other), (None, near), (9, other), (9, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 56, 3), (3, 56, 3), (3, 56, 3), (3, 56, 3), (None, 56, None), (9, 56, 3), (9, 0, 9)], key=str)


@pytest.mark.parametrize("num", [60, 80, 90, 95])
def test_linked_sets_share_a_key(num):
    rng = np.random.default_rng(num)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = rng.integers(1, 2**62, n).astype(np.uint64)
        differ = n * (100 - num) // num
        cut = int(rng.integers(0, differ + 1))
        y = np.concatenate([x[cut:], rng.integers(1, 2**62, differ - cut).astype(np.uint64)])
        common, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if not len(y) or 100 * common < num * union:
            continue
        values = np.concatenate([np.sort(x), np.sort(y)])
        keys, at, level, least = jaccard.segment_keys(values, np.array([0, len(x), len(values)]), num, 100)
        same, of_x, of_y = np.intersect1d(keys[: at[1]], keys[at[1] :], return_indices=True)
        assert len(same)
        # in some size class they share as many as each asks for
        assert any(((lv == level[of_x]).sum() >= max(least[: at[1]][of_x][lv == level[of_x]].max(), least[at[1] :][of_y][lv == level[of_x]].max())) for lv in set(level[of_x]))


def test_word_sets():
    raw_off = next(iter(chunks(pa.array(["A b\tC\n", None, "", "x", "a b c a b c"]))))
    hashes, words, _ = word_hashes(raw_off[2], raw_off[3])
    assert np.diff(words).tolist() == [3, 0, 0, 1, 6]
    _, off = shingle_sets(hashes, words, 3)
    assert np.diff(off).tolist() == [1, 0, 0, 1, 3]


def test_threshold_has_bounds(spark):
    with pytest.raises(ValueError):
        jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), 3, 0, 100)


def family_below_threshold(members, others):
    """A text, copies of it with two edits, and others with four, of which one is a copy's: most linked with no copy,
    though the copies together have enough of their words. Three more are linked with a copy of one edit alone."""
    base = [f"w{k}" for k in range(150)]

    def edited(edits):
        w = list(base)
        for slot, word in edits:
            w[5 * slot + 2] = word
        return " ".join(w)

    rng = random.Random(5)
    texts, edits = {1: edited([])}, []
    for k in range(members):
        edits.append([(slot, f"m{k}x{slot}") for slot in rng.sample(range(30), 2)])
        texts[len(texts) + 1] = edited(edits[-1])
    for k in range(others + 3):
        taken = edits[k][0] if k < others else (k % 30, f"one{k}")
        if k >= others:
            texts[len(texts) + 1] = edited([taken])
        free = rng.sample([slot for slot in range(30) if slot != taken[0]], 3)
        texts[len(texts) + 1] = edited([taken, *[(slot, f"o{k}x{slot}") for slot in free]])
    return texts


def test_a_family_is_not_compared_pair_by_pair(spark, monkeypatch):
    texts = family_below_threshold(60, 25)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    compared, verify = [], jaccard.verify

    def counting(pairs, *others):
        compared.append(pairs.count())
        return verify(pairs, *others)

    monkeypatch.setattr(jaccard, "verify", counting)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute(texts, 5, 80, 100)
    assert 67 <= sum(component == 1 for _, component in got.values()) < 80
    # not 25 others with 60 copies each
    assert compared[-1] < 400, compared
