"""Language-model scores: a log-bilinear model over word classes, trained by noise-contrastive estimation.

A word's class is itself if it is one of the most frequent words, else that of its ending and length, which any word has;
the end of a text is a class too. The two classes before a word predict its target vector: their context vectors, each times
the weights of its position, are added up, and the score is the sum's product with the target vector plus the target's bias.

Training goes through every training text. A task starts from the parameters so far and takes mini-batches of its own
tokens, with both positions in one score, against noise classes drawn from the classes' frequencies; a shuffle averages the
tasks' parameters, and the next round, over other texts, starts from there. Batched matrix products over all pairs of
classes give the normaliser of every context, so that log-probabilities are exact. The words of a class of endings are told
apart by their corpus counts, add-one smoothed; rare words' counts come from a shuffled table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import _LOWER, _SPACE, Tables, chunks, list_array, mix, most_frequent, rows_of, signed, text_buffers, word_hashes
from kinograph.llm.quality import held_out
from kinograph.session import ship_package

#: Classes of the model; words whose counts every task holds; vector size.
CLASSES, FREQUENT, SIZE = 2048, 1 << 19, 16
#: Tokens of a mini-batch; noise classes of a batch and how many each of its tokens is set against; rounds over the texts, the
#: least mini-batches of a task (which goes through few tokens several times), and their rate.
BATCH, DRAWN, NOISE, ROUNDS, LEAST_STEPS, RATE = 2048, 64, 8, 3, 150, 0.15
#: Class 0 is the end, 1 to ENDINGS the classes of endings, the others words.
END, ENDINGS = 0, 256
#: A task hands on its word counts when it holds so many.
HELD = 2_000_000


def endings(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class, 1 to ENDINGS, of each word's last two bytes (A-Z lower-cased) and length; starts: the words' first bytes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    size = np.add.reduceat((~_SPACE[raw]).astype(np.int64), starts)
    last = starts + size - 1
    code = _LOWER[raw[last]].astype(np.uint64) * np.uint64(256) + np.where(size > 1, _LOWER[raw[last - (size > 1)]], 0).astype(np.uint64)
    code += np.uint64(1 << 16) * np.minimum(size // 4, 4).astype(np.uint64)
    return (mix(code, 31) % np.uint64(ENDINGS)).astype(np.int64) + 1


def count_words(docs: DataFrame) -> DataFrame:
    """(key, g, c): each word's hash, class of endings and count over all texts; each task adds up its own first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        groups: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def merge():
            k, first, slot = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            keys[:], groups[:], counts[:] = [k], [np.concatenate(groups)[first]], [np.bincount(slot, np.concatenate(counts)).astype(np.int64)]

        def hand_on():
            for k, g, c in zip(keys, groups, counts):
                for at in range(0, len(k), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([signed(k[part]), pa.array(g[part].astype(np.int32)), pa.array(c[part])], ["key", "g", "c"])
            keys.clear()
            groups.clear()
            counts.clear()

        for b in batches:
            for _, _, raw, off in chunks(b.column(0)):
                hashes, _, starts = word_hashes(raw, off)
                k, first, c = np.unique(hashes, return_index=True, return_counts=True)
                keys.append(k)
                groups.append(endings(raw, starts)[first])
                counts.append(c.astype(np.int64))
            if sum(map(len, keys)) > HELD:
                merge()
                if len(keys[0]) > HELD // 2:
                    yield from hand_on()
        if keys:
            merge()
            yield from hand_on()

    return docs.select("text").mapInArrow(partial, "key long, g int, c long").groupBy("key", "g").agg(F.sum("c").alias("c"))


@dataclass
class Frequent:
    """The most frequent words, sorted by hash; classes: each one's class (0: that of its ending)."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    groups: np.ndarray

    def find(self, hashes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is frequent, count, class) of each hash; groups: the words' classes of endings."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), groups
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return hit, np.where(hit, self.counts[at], 0), np.where(hit & (self.classes[at] > 0), self.classes[at], groups)


def frequent_words(counts: DataFrame, most: int, classes: int) -> Frequent:
    top = most_frequent(counts, "c", most).toArrow().sort_by([("c", "descending"), ("key", "ascending")])
    keys, c = top["key"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    rank = np.arange(len(keys))
    cls = np.where(rank < classes - ENDINGS - 1, rank + ENDINGS + 1, 0)
    order = np.argsort(keys)
    return Frequent(keys[order], c[order], cls[order], top["g"].to_numpy()[order])


def class_sequence(classes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with an END after each text, and the classes one and two places before (END before a text's first word)."""
    seq = np.insert(classes, words[1:], END)
    one = np.concatenate([[END], seq[:-1]])[: len(seq)]
    two = np.concatenate([[END], one[:-1]])[: len(seq)]
    two[(words[:-1] + np.arange(len(words) - 1)).astype(np.int64)] = END
    return seq, one, two


@dataclass
class Parameters:
    context: np.ndarray  # (classes, size)
    target: np.ndarray  # (classes, size)
    weight: np.ndarray  # (2, size): for the classes one and two places before
    bias: np.ndarray  # (classes,)

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.weight, self.bias]

    def scores(self, seq: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return ((self.context[one] * self.weight[0] + self.context[two] * self.weight[1]) * self.target[seq]).sum(1) + self.bias[seq]


def first_parameters(unigram: np.ndarray, size: int) -> Parameters:
    rng = np.random.default_rng(1)
    k = len(unigram)
    return Parameters(rng.normal(0, 0.3, (k, size)), rng.normal(0, 0.3, (k, size)), np.ones((2, size)) * [[1.0], [0.5]], np.log(unigram))


def _add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    ids = at[order]
    cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    into[ids[cuts]] += np.add.reduceat(rows[order], cuts, axis=0)


class Trainer:
    """Mini-batches of noise-contrastive estimation with Adagrad, from the given parameters on."""

    def __init__(self, start: Parameters, unigram: np.ndarray, seed: int):
        self.p = Parameters(*(x.copy() for x in start.arrays()))
        self.noise_log = np.log(NOISE * unigram)
        self.upto = np.cumsum(unigram)
        self.rng = np.random.default_rng(seed)
        self.squares = [np.full_like(x, 0.05) for x in start.arrays()]
        self.tokens = self.steps = 0

    def batch(self, seq: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p = self.p
        drawn = np.minimum(np.searchsorted(self.upto, self.rng.random(DRAWN)), len(self.upto) - 1)
        before, further = p.context[one], p.context[two]
        h = before * p.weight[0] + further * p.weight[1]
        mine, noise = p.target[seq], p.target[drawn]
        # the tokens should be told from the noise, and each drawn class stands for NOISE / DRAWN of a token's noise
        good = 1 / (1 + np.exp(np.clip((h * mine).sum(1) + p.bias[seq] - self.noise_log[seq], -30, 30)))
        bad = 1 / (1 + np.exp(np.clip(self.noise_log[drawn] - h @ noise.T - p.bias[drawn], -30, 30))) * (-NOISE / DRAWN)
        to_h = good[:, None] * mine + bad @ noise
        grads = [np.zeros_like(x) for x in p.arrays()]
        _add_rows(grads[0], np.concatenate([one, two]), np.concatenate([to_h * p.weight[0], to_h * p.weight[1]]))
        _add_rows(grads[1], np.concatenate([seq, drawn]), np.concatenate([good[:, None] * h, bad.T @ h]))
        grads[2][0], grads[2][1] = (to_h * before).sum(0), (to_h * further).sum(0)
        grads[3] += np.bincount(seq, good, len(p.bias)) + np.bincount(drawn, bad.sum(0), len(p.bias))
        for x, g, square in zip(p.arrays(), grads, self.squares):
            g /= np.sqrt(len(seq))
            square += g * g
            x += RATE * g / np.sqrt(square)
        self.tokens += len(seq)
        self.steps += 1

    def take(self, seq: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """All tokens, in random order."""
        order = self.rng.permutation(len(seq))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            self.batch(seq[part], one[part], two[part])


def train_round(docs: DataFrame, frequent, start: Parameters, unigram: np.ndarray) -> Parameters:
    """The parameters after every text of docs, averaged over the tasks by their tokens; a row a class goes to the driver."""
    size, k = start.context.shape[1], len(unigram)
    given = docs.sparkSession.sparkContext.broadcast((start, unigram))  # classes x (2 x size + 2) numbers
    names = [f"v{i}" for i in range(2 * size + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, few = Trainer(*given.value, seed=TaskContext.get().partitionId() + 1), []
        for b in batches:
            for _, _, raw, off in chunks(b.column(0)):
                hashes, words, starts = word_hashes(raw, off)
                some = class_sequence(frequent.value.find(hashes, endings(raw, starts))[2], words)
                trainer.take(*some)
                if trainer.steps < LEAST_STEPS:
                    few.append(some)
                else:
                    few = []
        if not trainer.tokens:
            return
        seen = trainer.tokens
        while trainer.steps < LEAST_STEPS:
            for some in few:
                trainer.take(*some)
        p = trainer.p
        # a row a class, and one for the position weights
        table = np.concatenate([np.concatenate([p.context, p.target, p.bias[:, None]], 1), np.append(p.weight.ravel(), 0.0)[None, :]]) * seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), pa.array(np.full(k + 1, seen)), *[pa.array(c) for c in table.T]], ["class", "tokens", *names])

    found = docs.select("text").mapInArrow(run, "class int, tokens long, " + ", ".join(f"{n} double" for n in names))
    got = found.groupBy("class").agg(*[(F.sum(n) / F.sum("tokens")).alias(n) for n in names]).toArrow().sort_by("class")
    if not len(got):
        return start
    table = np.stack([got[n].to_numpy() for n in names], 1)
    return Parameters(table[:k, :size], table[:k, size : 2 * size], table[k, : 2 * size].reshape(2, size), table[:k, 2 * size])


@dataclass
class Model:
    p: Parameters
    normaliser: np.ndarray  # (classes, classes): for the contexts one and two places before

    def log10(self, seq: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (self.p.scores(seq, one, two) - self.normaliser[one, two]) / np.log(10)


def normalised(p: Parameters) -> Model:
    k = len(p.bias)
    scores = [(p.context * p.weight[j]) @ p.target.T for j in (0, 1)]
    # exp(a1 + a2 + b) summed over targets is a matrix product of exponentials
    top = [s.max(1) for s in scores]
    left, right = np.exp(scores[0] - top[0][:, None] + p.bias), np.exp(scores[1] - top[1][:, None])
    z = np.empty((k, k), np.float32)
    for at in range(0, k, 64):
        z[at : at + 64] = np.log(np.maximum(left[at : at + 64] @ right.T, 1e-300)) + top[0][at : at + 64, None] + top[1][None, :]
    return Model(p, z)


@dataclass
class Learned:
    """All that training texts teach: counts (key, g, c) of every word in a stored table, and what each task holds."""

    counts: DataFrame
    frequent: Frequent
    model: Model
    split: np.ndarray  # what the count + 1 of a word is divided by within its class of endings
    tokens: int
    ends: int
    distinct: int


def learn(training: DataFrame, tables: Tables, classes: int = CLASSES, frequent_most: int = FREQUENT) -> Learned:
    """The model of these texts (column text). Without texts each class is equally likely."""
    spark = training.sparkSession
    ship_package(spark)
    counts = tables.keep(count_words(training))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    frequent = frequent_words(counts, frequent_most, classes)
    # how often each class occurs: words of their own, and for each class of endings the others
    own = frequent.classes > 0
    often, split = np.zeros(classes), np.ones(ENDINGS + 1)
    often[END] = ends
    often[frequent.classes[own]] = frequent.counts[own]
    for r in counts.groupBy("g").agg(F.sum("c").alias("s"), F.count("*").alias("d")).collect():
        often[r.g] += r.s
        split[r.g] += r.s + r.d
    less = np.bincount(frequent.groups[own], frequent.counts[own], ENDINGS + 1)
    often[: ENDINGS + 1] -= less
    split -= less + np.bincount(frequent.groups[own], minlength=ENDINGS + 1)
    unigram = (often + 1.0) / (often + 1.0).sum()
    shared = spark.sparkContext.broadcast(frequent)  # frequent_most rows at most
    p = first_parameters(unigram, SIZE)
    for part in range(ROUNDS):
        p = train_round(training.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == part), shared, p, unigram)
    shared.unpersist()
    return Learned(counts, frequent, normalised(p), split, totals.n + ends, ends, totals.v + (ends > 0))


def score(docs: DataFrame, training: DataFrame, classes: int = CLASSES, frequent_most: int = FREQUENT, tables: Tables | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs, learned from `training`.

    Tokens are A-Z lower-cased runs without ASCII white space, and one end a text (null: only the end). base_score is
    the add-one unigram log10 probability, score the log-bilinear model's. Without training texts each class is equally
    likely and base_score is 0 for each token. doc_id may repeat or be null; rows are told apart by a number of their own.
    """
    tables = tables or Tables(docs.sparkSession)
    return scored(docs, learn(training, tables, classes, frequent_most), tables)


def scored(docs: DataFrame, learned: Learned, tables: Tables) -> DataFrame:
    """score() by what has been learned."""
    spark = docs.sparkSession
    counts, ends, n_all, v_all = learned.counts, learned.ends, learned.tokens, learned.distinct
    shared = spark.sparkContext.broadcast(learned.frequent)  # frequent_most rows at most
    tables_of = spark.sparkContext.broadcast(learned.model)  # classes^2 numbers
    split_scale = np.log10(learned.split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, m = shared.value, tables_of.value
        end_count = np.log10(ends + 1.0)
        for b in batches:
            ids = b.column(0)
            for i, j, raw, off in chunks(b.column(1)):
                hashes, words, starts = word_hashes(raw, off)
                n = j - i
                distinct, first, slot = np.unique(hashes, return_index=True, return_inverse=True)
                hit, c, cls = f.find(distinct, endings(raw, starts)[first])
                row = rows_of(words)
                logs = np.log10(c + 1.0)
                known_here = (hit & (c > 0))[slot]
                seq, one, two = class_sequence(cls[slot], words)
                of = rows_of(words + np.arange(n + 1))
                by_model = np.bincount(of, m.log10(seq, one, two), n)
                shared_class = cls <= ENDINGS
                base = np.bincount(row, logs[slot], n) + end_count
                within = np.where(shared_class, logs - split_scale[np.minimum(cls, ENDINGS)], 0.0)
                split = np.bincount(row, within[slot], n)
                code, times = np.unique(row[~hit[slot]] * (len(distinct) + 1) + slot[~hit[slot]], return_counts=True)
                tail_row, tail = code // (len(distinct) + 1), distinct[code % (len(distinct) + 1)]
                at = np.searchsorted(tail_row, np.arange(n + 1))
                columns = [
                    ids[i:j], pa.array(np.diff(words) + 1), pa.array(np.bincount(row, known_here, n).astype(np.int64) + (ends > 0)),
                    pa.array(base), pa.array(by_model + split), list_array(tail.view(np.int64), at, pa.int64()), list_array(times.astype(np.int64), at, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "known", "base", "model", "tail", "times"])

    schema = "doc_id long, n_tokens long, known long, base double, model double, tail array<long>, times array<long>"
    heads = docs.select("doc_id", "text").mapInArrow(run, schema)
    heads = tables.keep(heads.withColumn("row", F.monotonically_increasing_id()))
    tail = heads.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("key"), F.col("x.times").alias("t"))
    # the frequent words aren't here, so no key is hot
    found = tail.join(counts, "key").groupBy("row").agg(F.sum("t").alias("k"), F.sum(F.col("t") * F.log10(F.col("c") + 1.0)).alias("l"))
    both = heads.drop("tail", "times").join(found, "row", "left")
    more = F.coalesce("l", F.lit(0.0))
    scale = float(np.log10(n_all + v_all + 1))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def op9_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by what the texts outside the held-out seventh teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, docs.where(~held_out(F.col("doc_id"), 7, 2)))
    return out.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
