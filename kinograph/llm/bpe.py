"""Byte-level BPE: a backtracking encoder and a decoder over an offset table.

The encoder looks up the longest vocabulary token where a token may begin, in a tree of all tokens, and walks the piece from
left to right. A token may follow another only if merging from single bytes would keep the border between them, which
a table of merges and of each token's two parts answers; where no token fits, the walk steps back. Each byte is given up
at most once, so that the work is linear in the piece, and the tokens are those that merging pair by pair gives.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinograph.llm.common import give_back
from kinograph.session import ship_package

# The pattern that cuts text into pieces before the merges of byte-level vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces that a worker remembers, two generations of so many, and places for answers about pairs of tokens.
REMEMBERED, PAIRS = 1 << 16, 1 << 18


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in vocabulary files, as symbol to byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_table(path: str) -> tuple[dict, list[bytes], dict[str, int]]:
    """A vocabulary file's model, the bytes of each id, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    same_cut = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout") if spec["model"].get(k)]
    odd += [x["content"] for x in spec.get("added_tokens", []) if x.get("single_word") or x.get("lstrip") or x.get("rstrip") or x.get("normalized")]
    if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or not same_cut or odd:
        raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary {odd or ''}")
    symbols = byte_symbols()
    vocab: dict[str, int] = spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    table = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for text, i in vocab.items():
        table[i] = bytes(symbols[c] for c in text)
    for text, i in special.items():
        table[i] = text.encode()
    return spec["model"], table, special


class Vocabulary:
    """A vocabulary file in flat arrays, so that nothing stays between the many objects that reading it makes and drops."""

    def __init__(self, path: str):
        model, table, self.special = token_table(path)
        vocab: dict[str, int] = model["vocab"]
        self.offsets = np.cumsum([0, *map(len, table)])
        self.data = b"".join(table)
        self.ordinary = array("i", vocab.values())
        # merges in order of rank: the pair, and the token that it makes
        self.merges = tuple(array("i") for _ in range(3))
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            for ids, token in zip(self.merges, (left, right, left + right)):
                ids.append(vocab[token])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Decoder:
    """The bytes of all tokens one after another, and the offset of each."""

    def __init__(self, path: str):
        v = vocabulary(path)
        self.offsets = v.offsets
        self.data = np.frombuffer(v.data, np.uint8)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of rows of ids that begin at off; bytes that aren't UTF-8 become U+FFFD."""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
        data = self.data[source].tobytes()
        cuts = np.concatenate([[0], ends])[off]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class Pieces(dict):
    """Encoded pieces; one that isn't there is looked for in the generation before, or encoded."""

    def __init__(self, encode, least: int):
        self.encode, self.least, self.old = encode, least, {}

    def __missing__(self, piece: str) -> bytes:
        known = self.old.get(piece)
        if known is None:
            known = self.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= self.least:
                self.old = dict(self)
                self.clear()
            self[piece] = known
        return known


class Encoder:
    """The encoder of one vocabulary file (path)."""

    def __init__(self, path: str):
        import ahocorasick

        v = vocabulary(path)
        self.special = v.special
        # flat tables by id
        self.left, self.right, self.rank, self.shorter, self.length = (array("i", [-1]) * (len(v.offsets) - 1) for _ in range(5))
        # which pair makes which token, and at which rank
        self.merged: dict[int, int] = {}
        for rank, (a, b, whole) in enumerate(zip(*v.merges)):
            self.merged.setdefault(a << 32 | b, rank)
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = a, b, rank
        self.words = words = {v.data[v.offsets[i] : v.offsets[i + 1]].decode("latin-1"): i for i in v.ordinary}
        self.most = max(map(len, words))
        # only its prefixes are asked for
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        # the next shorter token that begins like a token
        for word, i in words.items():
            self.tree.add_word(word)
            self.length[i] = len(word)
            k = len(word) - 1
            while k and word[:k] not in words:
                k -= 1
            if k:
                self.shorter[i] = words[word[:k]]
        self.find = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # a pair's answer has one place, which a later pair may take: (left, right, answer) in 64 bits, -1 at first
        self.pairs = array("q", [-1]) * PAIRS
        self.pieces = Pieces(lambda piece: array("I", self.encode_piece(piece)).tobytes(), REMEMBERED)

    def compatible(self, left: int, right: int) -> int:
        """Whether merging keeps the border between these tokens (0 or 1)."""
        pair = left << 31 | right
        place = (left * 40503 ^ right * 30011) % PAIRS
        known = self.pairs[place]
        if known >> 1 == pair:
            return known & 1
        answer = int(self._compatible(left, right))
        self.pairs[place] = pair << 1 | answer
        return answer

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between these tokens.

        Both are taken apart from the outside in, latest merge first; a merge across the border that has a lower rank
        than the merge that hides its two sides would have come first.
        """
        merged, rank = self.merged, self.rank
        bound = 1 << 60
        while True:
            across = merged.get(left << 32 | right)
            if across is not None and across < bound:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token was made later; before that, its right part stood at the border
                bound, left = a, self.right[left]
            else:  # at equal places the left pair merges first, so that a merge across of this very rank would win too
                bound, right = b + 1, self.left[right]

    def encode_piece(self, piece: bytes) -> list[int]:
        text, words = piece.decode("latin-1"), self.words
        whole = words.get(text)
        if whole is not None:
            return [whole]
        n = len(piece)
        prefix, most = self.tree.longest_prefix, self.most
        length, shorter, compatible = self.length, self.shorter, self.compatible
        # where a walk stepped back from; most pieces have no such place
        shut: set[int] = set()
        out: list[int] = []
        at, last, token = 0, -1, -1
        while at < n:
            if token < 0:
                # the longest token that begins here
                rest = text[at : at + most]
                k = prefix(rest)
                token = words.get(rest[:k], -1)
                while token < 0:
                    k -= 1
                    if k <= 0:
                        raise ValueError(f"no token of the vocabulary begins with {rest[:1]!r}")
                    token = words.get(rest[:k], -1)
            end = at + length[token]
            if (last < 0 or compatible(last, token)) and end not in shut:
                out.append(token)
                at, last, token = end, token, -1
                continue
            following = shorter[token]
            if following >= 0:
                token = following
            else:
                shut.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.uint32(self.special[part]).tobytes())
                continue
            out += map(self.pieces.__getitem__, self.find(part))
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _forget(c: Encoder) -> None:
    """Idle workers stay for later stages; they don't keep a task's pieces."""
    c.pieces.clear()
    c.pieces.old = {}
    give_back()


def _encoded(c: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts and where each text's begin (null: no ids)."""
    rows = [c.encode(t.as_py()) if t.is_valid else b"" for t in texts]
    return np.frombuffer(b"".join(rows), np.int32), np.cumsum([0, *(len(r) // 4 for r in rows)])


def encode(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Adds out: the token ids of each whole text (array<int>; null and empty texts: no ids).

    The strings of the vocabulary's special tokens become those tokens; nothing is added, cut or padded. A column that
    is already named out is replaced. Equal texts get equal ids; there is no shuffle. Fails for a vocabulary file with
    another cut into pieces, a normalizer or other options that plain byte-level BPE doesn't have.
    """
    path = vocabulary or default_vocabulary()
    ship_package(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # of iterator kind, so that Spark doesn't fuse it into each function of its ids, to be run once for each
        c = encoder(path)
        for texts in batches:
            ids, off = _encoded(c, texts)
            yield pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
        _forget(c)

    return df.withColumn(out, ids_of(F.col(text)))


def round_trip(df: DataFrame, text: str = "text", out: str = "coded", vocabulary: str | None = None) -> DataFrame:
    """Adds out: a struct of ids (as encode() gives them), ids_sha256 (of the ids as little-endian unsigned 32-bit integers)
    and decoded (as decode() gives it), all in one pass through Python. A column of that name is replaced."""
    path = vocabulary or default_vocabulary()
    ship_package(df.sparkSession)

    @F.arrow_udf("struct<ids: array<int>, ids_sha256: string, decoded: string>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c, d = encoder(path), decoder(path)
        for texts in batches:
            parts = []
            # in small runs, so that decoding holds a bounded number of temporary arrays
            for at in range(0, max(len(texts), 1), 64):
                ids, off = _encoded(c, texts[at : at + 64])
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                columns = [lists, pa.array(_hashes(ids, off), pa.string()), pa.array(d.decode(ids, off), pa.string())]
                parts.append(pa.StructArray.from_arrays(columns, ["ids", "ids_sha256", "decoded"]))
            yield pa.concat_arrays(parts)
        _forget(c)

    return df.withColumn(out, coded(F.col(text)))


def flat_lists(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row places of an array of integer lists."""
    off = batch.offsets.to_numpy()
    return batch.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Adds out: the text of each list of ids, special tokens included (null: null); no shuffle."""
    path = vocabulary or default_vocabulary()
    ship_package(df.sparkSession)

    @F.arrow_udf(T.StringType())
    def texts_of(lists: pa.Array) -> pa.Array:
        values, off = flat_lists(lists)
        texts = decoder(path).decode(values, off)
        return pa.array([t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())], pa.string())

    return df.withColumn(out, texts_of(F.col(ids)))


def _hashes(ids: np.ndarray, off: np.ndarray) -> list[str]:
    data = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
    return [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.col("coded.ids_sha256").alias("ids_sha256"),
        F.sha2(F.encode("coded.decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
