"""Near duplicates by the Jaccard similarity of word-shingle sets: an exact join over a token-group matrix.

1. Documents with equal sets collapse into one class.
2. A linked set misses few of its partner's tokens. A part of every set's tokens, chosen by hash, shows how many of them any
   other set has at all; sets that nothing can be linked with go no further.
3. The others are partitioned into groups of similar sets: each set's tokens are dealt by hash into segments, more than the
   tokens in which a linked set can differ, so that linked sets agree in one segment at least. A set's group is named by the
   most popular set with which it shares a segment: the one whose segments are in the most sets, such as the text of which
   the others are copies with edits.
4. The token-group matrix holds each group's token union (with the number of members that have each token). A set is a query
   to every group of which some member shares a segment with it; its overlap with the group's union bounds its overlap with
   any member. Only groups that can reach the threshold are opened.
5. In an opened group a query is first compared with the member that heads most of their shared segments (the most popular
   one of each), then with the
   heads of the others, if these are in other components by then: links contract sets to components. Where an opened group
   still has members in other components, a second matrix over components, with all tokens, bounds again, and what it opens
   is compared in full.

No link between different texts is lost: a pair is left out only where a bound shows that it can't be linked, or where
both sets are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.llm.common import Tables, binary_array, chunks, giving_back, mix, rows_of, shingle_sets, signed, word_hashes
from kinograph.llm.components import connected_components
from kinograph.session import ship_package

#: Size classes grow by this ratio; a pair's sizes are in one class or in neighbouring ones.
RATIO = 1.3
#: Bits of the filter by which tasks pass over texts of sets that go no further; the join behind it decides.
FILTER_BITS = 1 << 24
#: The share of tokens that stands for a set in the first matrix, in units of 1 - threshold (above 1); smaller sets, of up to
#: WHOLE tokens, are stood for by all of theirs.
SAMPLED, WHOLE = 1.75, 40
#: Groups of so many members aren't bounded by their union in the second matrix.
FEW = 3
#: A task compares so many tokens among each other before it hands them on.
HELD = 1_000_000


def size_classes(num: int, den: int, largest: int) -> np.ndarray:
    """Lower bounds of the size classes, beyond `largest`. One class down holds every smaller size of a similar set."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * max(RATIO, 1.05 * den / num))))
    return np.array(bounds, np.int64)


def segment_numbers(bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size class the number of segments, and how many of them a set may leave empty without keys for those.

    Linked sets differ in at most (den - num) / num of the smaller one's size, so many segments and one more would do if
    none were empty; the others make up for the segments that are empty by chance.
    """
    differ = (bounds[1:] - 1) * (den - num) // num
    least = differ + 1.0
    empty = least * np.exp(-bounds[:-1] / least)
    spare = np.ceil(1.5 * empty + 2 * np.sqrt(empty)).astype(np.int64) + 1
    return differ + 1 + spare, spare


def segment_keys(values: np.ndarray, off: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each set (values, beginning at off): all segments that aren't empty under its own size class and, where a
    similar smaller set may be of the class below, under that class; a set with more empty segments than are made up for
    has keys for the empty ones too. Returns keys, where each row's begin, and for each key the size class under which it stands
    and how many keys of that class a linked set shares at least: as many as there are segments less those that may differ
    and those that are empty."""
    n = np.diff(off)
    bounds = size_classes(num, den, int(n.max(initial=1)) + 1)
    own = np.searchsorted(bounds, n, "right") - 1
    numbers, spares = segment_numbers(bounds, num, den)
    lowest = np.searchsorted(bounds, np.maximum(-(-n * num // den), 1), "right") - 1
    keys, rows, levels, least = [], [], [], []
    values = mix(values, 3)
    for down in (0, 1):
        which = np.flatnonzero((n > 0) & (own - down >= (own if down == 0 else lowest)) & (own - down >= 0))
        if not len(which):
            continue
        level = own[which] - down
        m = numbers[level]
        base = np.concatenate([[0], np.cumsum(m)])
        sizes = n[which]
        inner = np.repeat(np.arange(len(which)), sizes)
        v = values[np.repeat(off[which] - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())]
        segment = base[inner] + ((v >> np.uint64(40)).astype(np.int64) % m[inner])
        with np.errstate(over="ignore"):
            contents = np.zeros(base[-1], np.uint64)
            order = np.argsort(segment, kind="stable")
            s = segment[order]
            cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            if len(cuts):
                contents[s[cuts]] = np.add.reduceat(mix(v[order], 5), cuts)
            owner = np.repeat(np.arange(len(which)), m)
            number = np.arange(base[-1]) - base[owner]
            tag = mix(number.astype(np.uint64) * np.uint64(1 << 20) + level[owner].astype(np.uint64), 11)
        filled = np.zeros(base[-1], bool)
        filled[segment] = True
        empty = m - np.add.reduceat(filled.astype(np.int64), base[:-1])
        wanted = filled | (empty > spares[level])[owner]
        keys.append(mix(contents ^ tag, 13)[wanted])
        rows.append(which[owner][wanted])
        levels.append(level[owner][wanted].astype(np.int32))
        least.append((1 + spares[level] - empty)[owner][wanted].astype(np.int32))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    k, r, v, m = (np.concatenate(x) for x in (keys, rows, levels, least))
    order = np.argsort(r, kind="stable")
    return k[order], np.searchsorted(r[order], np.arange(len(off))), v[order], m[order]


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    for b in batches:
        ids = b.column(0)
        for i, j, raw, off in chunks(b.column(1)):
            hashes, words, _ = word_hashes(raw, off)
            yield ids[i:j], *shingle_sets(hashes, words, width)


def _signature(values: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each set; 0 sums for empty ones."""
    total = np.zeros(len(off) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(off))
    if len(filled):
        with np.errstate(over="ignore"):
            total[filled] = np.add.reduceat(mix(values, seed), off[filled])
    return mix(total, seed)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), s1, s2 (a 128-bit hash of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values, off in _sets(batches, width):
            sums = [signed(_signature(values, off, seed)) for seed in (21, 22)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(off)), *sums], ["doc_id", "n", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, n long, s1 long, s2 long")


def _new(s1: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which sets come up for the first time in a task; empty ones never do."""
    fresh = np.zeros(len(s1), bool)
    for k, (x, size) in enumerate(zip(s1.tolist(), n.tolist())):
        if size and x not in seen:
            seen.add(x)
            fresh[k] = True
    return fresh


def in_sample(values: np.ndarray, n: np.ndarray, num: int, den: int, whole: float) -> np.ndarray:
    """Which tokens (of sets of n tokens each) are in the sample; all of those of sets of up to `whole` tokens."""
    share = min(1.0, SAMPLED * (den - num) / den)
    return ((mix(values, 17) >> np.uint64(11)).astype(np.float64) <= share * 2.0**53) | (n <= whole)


def needed(values: np.ndarray, off: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens count for each set in the first matrix, and how many of those a linked set has at least (0 or less: any
    set will do). A linked set has num / den of a set's tokens or more."""
    n = np.diff(off)
    counts = in_sample(values, np.repeat(n, n), num, den, WHOLE)
    return counts, np.bincount(rows_of(off)[counts], minlength=len(n)) - (n - -(-n * num // den))


def _visible(values: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tokens that a set shows to others: those that count for any set that may be linked with it."""
    return in_sample(values, n, num, den, WHOLE * den / num)


_OWN = 1 << 30


def linkable(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(s1) of the sets of which other sets have enough tokens.

    A token that two sets of a task have is known to be shared there and then, so that no token has more rows than there are
    tasks. Copies in several tasks are each counted in full, which leaves the sign of the sum as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []  # tokens, their sets' numbers, whether they count; the sets and how many tokens each needs
        size = base = 0

        def rows(token, s1, c):
            for at in range(0, len(token), 1 << 16):
                part = slice(at, at + (1 << 16))
                ids = pa.nulls(len(token[part]), pa.int64()) if s1 is None else signed(s1[part])
                yield pa.RecordBatch.from_arrays([signed(token[part]), ids, pa.array(np.broadcast_to(c, len(token))[part].astype(np.int32))], ["token", "s1", "c"])

        def hand_on():
            if not held:
                return
            t, o, k, ids, need = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(t, kind="stable")
            t, o, k = t[order], o[order], k[order]
            first = np.ones(len(t), bool)
            first[1:] = t[1:] != t[:-1]
            of = np.cumsum(first) - 1
            lone = np.bincount(of)[of] == 1 if len(t) else np.zeros(0, bool)
            here = np.bincount(o[~lone & k], minlength=len(ids))
            # in the sets' order, which packs well
            mine = np.flatnonzero(lone)[np.argsort(order[lone])]
            yield from rows(t[mine], ids[o[mine]], np.where(k[mine], 0, -1))
            yield from rows(t[first & ~lone], None, 0)
            yield from rows(ids, ids, here - need + _OWN)

        for _, values, off in _sets(batches, width):
            s1, n = _signature(values, off, 21), np.diff(off)
            fresh = _new(s1, n, seen)
            counts, need = needed(values, off, num, den)
            row = rows_of(off)
            there = fresh[row] & _visible(values, n[row], num, den)
            number = base + np.cumsum(fresh) - 1
            held.append((values[there], number[row[there]], counts[there], s1[fresh], need[fresh]))
            base += int(fresh.sum())
            size += int(there.sum())
            if size > HELD:
                yield from hand_on()
                size = base = 0
        yield from hand_on()

    # c: 0 for a token that counts for its set, -1 for one that doesn't; _OWN and more in a set's own row
    found = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(giving_back(run), "token long, s1 long, c int")
    by_token = Window.partitionBy("token")
    shared = (F.min("s1").over(by_token) < F.max("s1").over(by_token)) | F.max(F.col("s1").isNull()).over(by_token)
    worth = F.when(F.col("c") > 0, F.col("c") - _OWN).when((F.col("c") == 0) & F.col("shared"), 1)
    marked = found.withColumn("shared", shared).where("s1 is not null").select("s1", worth.alias("v")).where("v is not null")
    return marked.groupBy("s1").agg(F.sum("v").alias("v")).where("v >= 0").select("s1")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits, whatever the input: the bits of the hashes of all ids are set, and few others."""
    place = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("p"))
    bits = place.groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[bits["w"].to_numpy()] = bits["b"].to_numpy().astype(np.uint32)
    return out


def token_sets(docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(s1, n, need, tokens): each set of nodes (doc_id, s1) once, with its sorted shingle hashes as bytes.

    The bitmap of doc_ids only saves the work on other texts; the join decides.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted():
            for b in batches:
                place = b.column("p").to_numpy()
                mask = (bitmap.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1
                yield b.filter(pa.array(mask.astype(bool)))

        seen: set[int] = set()
        for _, values, off in _sets(wanted(), width):
            s1, n = _signature(values, off, 21), np.diff(off)
            fresh = _new(s1, n, seen)
            need = needed(values, off, num, den)[1]
            rows = pa.RecordBatch.from_arrays([signed(s1), pa.array(n), pa.array(need.astype(np.int64)), binary_array(values, off)], ["s1", "n", "need", "tokens"])
            yield rows.filter(pa.array(fresh))

    rows = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("p"))
    found = rows.mapInArrow(giving_back(run), "s1 long, n long, need long, tokens binary").join(nodes.select("s1"), "s1", "left_semi")
    return found.dropDuplicates(["s1"])


def _each_set(sets: DataFrame, columns: list[str], schema: str, rows) -> DataFrame:
    """rows(values, off) of runs of sets, where `off` says where each set's tokens begin: arrays of equal length, the first the
    set's place in the run, which becomes its s1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids, blobs = part.column(0), part.column(1)
                sizes = np.array([len(x.as_buffer()) // 8 for x in blobs], np.int64)
                off = np.concatenate([[0], np.cumsum(sizes)])
                values = np.frombuffer(b"".join(x.as_py() for x in blobs), np.uint64)
                row, *others = rows(values, off)
                for at in range(0, len(row), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[cut])), *[pa.array(x[cut].view(np.int64) if x.dtype == np.uint64 else x[cut]) for x in others]], columns)

    return sets.select("s1", "tokens").mapInArrow(giving_back(run), schema)


def segments(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(s1, key, level, least): the keys of each set, as segment_keys() gives them."""

    def rows(values, off):
        keys, at, level, least = segment_keys(values, off, num, den)
        return rows_of(at), keys, level, least

    return _each_set(sets, ["s1", "key", "level", "least"], "s1 long, key long, level int, least int", rows)


def matrix_tokens(sets: DataFrame, num: int, den: int, whole: bool) -> DataFrame:
    """(s1, token, counts): the tokens that each set shows in the first matrix and whether they count for itself, or all."""

    def rows(values, off):
        row, n = rows_of(off), np.diff(off)
        if whole:
            return row, values, np.ones(len(row), bool)
        there = _visible(values, n[row], num, den)
        return row[there], values[there], needed(values, off, num, den)[0][there]

    return _each_set(sets, ["s1", "token", "counts"], "s1 long, token long, counts boolean", rows)


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets' intersection is at least num / den of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("ta"), batch.column("tb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep[k] = den * common >= num * (len(x) + len(y) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    # the same columns on both sides, so that one exchange of the sets serves both joins
    slim = sets.select("s1", "tokens")
    both = pairs.select("a", "b").join(slim.alias("x"), F.col("a") == F.col("x.s1")).select("a", "b", F.col("x.tokens").alias("ta"))
    both = both.join(slim.alias("y"), F.col("b") == F.col("y.s1")).select("a", "b", "ta", F.col("y.tokens").alias("tb"))
    return both.mapInArrow(giving_back(run), "a long, b long")


def _sizes_fit(x: Column, y: Column, num: int, den: int) -> Column:
    return F.least(x, y) * den >= F.greatest(x, y) * num


def popular_first(segments: DataFrame) -> DataFrame:
    """Segments (s1, key, ...) of keys that several sets have, with rank, by which the most popular set comes first, and lo, the
    first rank of the key. Sums and joins, so that no task holds all rows of a key."""
    counts = segments.groupBy("key").agg(F.count("*").alias("sets"), F.min("s1").alias("lowest"), F.max("s1").alias("last")).where("lowest < last")
    shared = segments.join(counts.select("key", "sets"), "key")
    popular = shared.groupBy("s1").agg(F.sum("sets").alias("popular"))
    ranked = shared.drop("sets").join(popular, "s1").withColumn("rank", F.struct((-F.col("popular")).alias("p"), "s1")).drop("popular")
    return ranked.join(ranked.groupBy("key").agg(F.min("rank").alias("lo")), "key")


def _shared_keys(keyed: DataFrame, what: str) -> DataFrame:
    """The rows of keys that have several values of `what`; sums and a join, so that no task holds all rows of a key."""
    several = keyed.groupBy("key").agg(F.min(what).alias("lo"), F.max(what).alias("hi")).where("lo < hi").select("key", "lo")
    return keyed.join(several, "key")


def open_groups(keyed: DataFrame, sets: DataFrame, num: int, den: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(s1, g, h): the groups h that each set s1, itself of group g, can be linked with by the bound of the matrix; and their
    heads: (s1, h, head, keys), the most popular member of h for some segment that it shares with the set, if its size fits,
    and for how many segments.

    keyed (key, s1, n, need, g, rank) has the sets of keys that several share.
    """
    first = keyed.groupBy("key", F.col("g").alias("h")).agg(F.min(F.struct("rank.p", "s1", "n")).alias("first"), F.min("s1").alias("lowest"), F.max("s1").alias("last"))
    met = keyed.join(first, "key").where("g <> h or lowest < last")
    head = F.when((F.col("first.s1") != F.col("s1")) & _sizes_fit(F.col("n"), F.col("first.n"), num, den), F.col("first.s1"))
    met = met.groupBy("s1", "need", "g", "h", "level", "least", head.alias("head")).agg(F.count("*").alias("keys"))
    # a linked set of h shares so many segments with this one, each with some member of h
    met = met.withColumn("all_keys", F.sum("keys").over(Window.partitionBy("s1", "h", "level"))).where("all_keys >= least")
    met = tables.keep(met.groupBy("s1", "need", "g", "h", "head").agg(F.sum("keys").alias("keys")))
    asked = tables.keep(met.select("s1", "need", "g", "h").distinct(), "queries")
    # the union of each group, and how many members have each token of it
    group_of = keyed.select("s1", "g").distinct()
    shown = tables.keep(matrix_tokens(sets, num, den, whole=False).join(group_of, "s1"))
    matrix = shown.groupBy(F.col("g").alias("h"), "token").agg(F.count("*").alias("members"))
    counted = asked.select("s1", "g", "h").join(shown.where("counts").select("s1", "token"), "s1")
    overlap = counted.join(matrix, ["h", "token"]).where((F.col("g") != F.col("h")) | (F.col("members") > 1)).groupBy("s1", "h").agg(F.count("*").alias("c"))
    opened = asked.join(overlap, ["s1", "h"], "left").where(F.coalesce("c", F.lit(0)) >= F.col("need"))
    opened = tables.keep(opened.select("s1", "g", "h"), "opened")
    heads = met.where("head is not null").select("s1", "h", "head", "keys").join(opened.select("s1", "h"), ["s1", "h"], "left_semi")
    return opened, tables.keep(heads)


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that aren't in one component (groups: id, component)."""
    named = pairs
    for side in ("a", "b"):
        named = named.join(groups.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    return named.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(*pairs.columns)


def compare_heads(heads: DataFrame, sets: DataFrame, num: int, den: int, tables: Tables) -> DataFrame:
    """(id, component): each set linked with heads in its opened groups, first with the one of most shared segments, then with
    the others that are in other components."""
    first = heads.groupBy("s1").agg(F.max_by("head", F.struct("keys", "head")).alias("head"))
    pair = lambda df: df.select(F.least("s1", "head").alias("a"), F.greatest("s1", "head").alias("b")).distinct()
    links = tables.keep(verify(tables.keep(pair(first)), sets, num, den), "links")
    groups = connected_components(links, tables)
    others = pair(heads.join(first, ["s1", "head"], "left_anti"))
    more = tables.keep(verify(tables.keep(apart(others, groups)), sets, num, den), "other_links")
    return connected_components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), tables)


def pairs_left(keyed: DataFrame, opened: DataFrame, heads: DataFrame, sets: DataFrame, groups: DataFrame, num: int, den: int, tables: Tables) -> DataFrame:
    """(a, b): the pairs of sets in opened groups that are in different components (groups: id, component) and that the
    second matrix, of the components' token unions, doesn't rule out. keyed: key, s1, n, label."""
    members = keyed.select("s1", F.col("label").alias("h")).distinct().groupBy("h").agg(F.count("*").alias("members"))
    # a group whose other members were all heads has been compared
    met = heads.groupBy("s1", "h").agg(F.countDistinct("head").alias("met"))
    others = F.col("members") - (F.col("g") == F.col("h")).cast("int") - F.coalesce("met", F.lit(0))
    unfinished = opened.join(members, "h").join(met, ["s1", "h"], "left").where(others > 0).select("s1", "g", "h")
    # a link shows in both directions: some other member of h has the set's own group unfinished
    back = unfinished.groupBy(F.col("g").alias("h"), F.col("h").alias("g")).agg(F.count("*").alias("there"))
    unfinished = tables.keep(unfinished.join(back, ["g", "h"]).where(F.col("there") > (F.col("g") == F.col("h")).cast("int")).select("s1", "h"))
    named = keyed.join(unfinished.select("s1").distinct(), "s1", "left_semi").join(groups.select(F.col("id").alias("s1"), "component"), "s1", "left")
    named = named.select("key", "level", "least", "s1", "n", "label", F.coalesce("component", "s1").alias("g"))
    rest = tables.keep(_shared_keys(named, "g").drop("lo"))
    rest_sets = rest.select("s1", "n", "g").distinct()
    owned = tables.keep(matrix_tokens(sets.join(rest_sets.select("s1"), "s1", "left_semi"), num, den, whole=True).select("s1", "token").join(rest_sets, "s1"))
    several = owned.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi")
    # shared: tokens that some other component has; an intersection is no larger than this of either set
    elsewhere = owned.join(several.select("token"), "token", "left_semi").groupBy("s1").agg(F.count("*").alias("shared"))
    enough = lambda common, x, y: common * (num + den) >= (x + y) * num
    left = tables.keep(rest.join(elsewhere, "s1").where(F.col("shared") * den >= F.col("n") * num))
    by_group = left.groupBy("key", F.col("g").alias("h")).agg(F.max("shared").alias("most_shared"), F.min("n").alias("least_n"))
    may_reach = (F.col("h") < F.col("g")) & enough(F.least("shared", "most_shared"), F.col("n"), F.col("least_n"))
    queries = left.join(by_group, "key").where(may_reach).groupBy("s1", "n", "shared", "h", "level", "least").agg(F.count("*").alias("keys"))
    queries = tables.keep(queries.where("keys >= least").select("s1", "n", "shared", "h").distinct())
    # the union of a group of very few members bounds no better than they do: such groups are opened as they are
    size = left.select("s1", F.col("g").alias("h")).distinct().groupBy("h").agg(F.count("*").alias("size"))
    sized = tables.keep(queries.join(size, "h"))
    few = sized.where(F.col("size").between(2, FEW)).select("s1", "n", "shared", "h", F.col("n").alias("c"), F.col("n").alias("core"))
    tokens = owned.join(left.select("s1").distinct(), "s1", "left_semi")
    # in a larger group, most members share the tokens of its core; each of its other tokens, the rare ones, is in few of them
    of_group = tokens.join(size.where(F.col("size") > FEW).withColumnRenamed("h", "g"), "g").select(F.col("g").alias("h"), "token", "s1", "size")
    union = of_group.groupBy("h", "token", "size").agg(F.count("*").alias("members"))
    union = tables.keep(union.select("h", "token", (F.col("members") * F.col("members") > F.col("size")).alias("common")))
    asked = tokens.select("s1", "token").join(sized.where(F.col("size") > FEW), "s1")
    overlap = asked.join(union, ["h", "token"]).groupBy("s1", "n", "shared", "h").agg(F.count("*").alias("c"), F.count_if("common").alias("core"))
    opened_again = tables.keep(overlap.where(F.col("c") * den >= F.col("n") * num).unionByName(few), "opened_again")
    rare = tables.keep(of_group.join(union.where("not common"), ["h", "token"]).select("h", "token", F.col("s1").alias("other")))
    members = left.select(F.col("s1").alias("other"), F.col("n").alias("other_n"), F.col("shared").alias("other_shared"), F.col("g").alias("h"), F.col("label").alias("other_label")).distinct()
    members = members.join(rare.groupBy("other").agg(F.count("*").alias("rare")), "other", "left")
    members = tables.keep(members.withColumn("other_core", F.col("other_n") - F.coalesce("rare", F.lit(0))).drop("rare"))
    # a linked member that has a rare token of the set ...
    with_rare = tokens.select("s1", "token").join(opened_again.select("s1", "h"), "s1").join(rare, ["h", "token"]).groupBy("s1", "h", "other").agg(F.count("*").alias("both"))
    with_rare = with_rare.join(opened_again, ["s1", "h"]).join(members, ["other", "h"])
    with_rare = with_rare.where(enough(F.least(F.least("core", "other_core") + F.col("both"), "shared", "other_shared"), F.col("n"), F.col("other_n")))
    # ... and one that has none, so that both have enough of the core; by size, since few sizes are within reach then
    sizes = members.groupBy("h", "other_n").agg(F.max(F.least("other_core", "other_shared")).alias("most"))
    reached = opened_again.join(sizes, "h").where(enough(F.least("core", "shared", "most"), F.col("n"), F.col("other_n"))).drop("c", "most")
    reached = left.select("key", "level", "least", "s1").join(reached, "s1")
    within = left.select("key", F.col("s1").alias("other"), F.col("least").alias("other_least")).join(members, "other")
    met = reached.join(within, ["key", "h", "other_n"]).where(enough(F.least("core", "other_core", "shared", "other_shared"), F.col("n"), F.col("other_n")))
    met = met.groupBy("s1", "other", "other_label", "level", "least", "other_least").agg(F.count("*").alias("keys"))
    met = met.where(F.col("keys") >= F.greatest("least", "other_least")).select("s1", "other", "other_label")
    met = met.unionByName(with_rare.select("s1", "other", "other_label"))
    # a group of one member is that member, and its shared keys have been counted
    lone = sized.where(F.col("size") == 1).join(members, "h").where(enough(F.least("shared", "other_shared"), F.col("n"), F.col("other_n")))
    met = met.unionByName(lone.select("s1", "other", "other_label")).distinct()
    # a link shows in both directions: only members of groups that the first matrix opened for the set
    return met.join(unfinished.select("s1", F.col("h").alias("other_label")), ["s1", "other_label"], "left_semi").select(F.col("s1").alias("a"), F.col("other").alias("b"))


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, tables: Tables | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text; other columns are ignored).

    Words are runs without ASCII white space, A-Z lower-cased; a set is the distinct runs of `width` words; a shorter
    text is one shingle, and a text without words (or null) has an empty set and is linked with nothing. Two rows
    are linked where den * intersection >= num * union (0 < num <= den); component_id is the smallest doc_id reachable by
    links. Rows that repeat a doc_id are rows of their own, each linked by its own text; equal texts are linked. Rows without
    a doc_id have no component and link nothing. tables keeps `queries`, `opened`,
    `links`, `other_links` and `more_links` by name.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold has to be above 0 and at most 1")
    ship_package(docs.sparkSession)
    tables = tables or Tables(docs.sparkSession)
    signed_docs = tables.keep(signatures(docs, width))
    same = ["n", "s1", "s2"]
    classes = tables.keep(signed_docs.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")))
    nodes = tables.keep(classes.join(linkable(docs, width, num, den), "s1", "left_semi").select(F.col("rep").alias("doc_id"), "s1"))
    sets = tables.keep(token_sets(docs, nodes, width, num, den))

    # the partition: a set's group has the name of the most popular set with which it shares a segment
    shared = tables.keep(popular_first(segments(sets, num, den)))
    enough = shared.groupBy("s1", "level").agg(F.min("lo").alias("lo"), F.count("*").alias("c"), F.max("least").alias("least")).where("c >= least")
    label = enough.groupBy("s1").agg(F.min("lo")["s1"].alias("g"))
    keyed = shared.select("key", "s1", "level", "least", "rank").join(enough.select("s1", "level"), ["s1", "level"], "left_semi")
    keyed = tables.keep(keyed.join(label, "s1").join(sets.select("s1", "n", "need"), "s1"))
    opened, heads = open_groups(keyed, sets, num, den, tables)
    groups = compare_heads(heads, sets, num, den, tables)
    pairs = tables.keep(pairs_left(keyed.withColumnRenamed("g", "label"), opened, heads, sets, groups, num, den, tables))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("s1")).distinct()
    more = tables.keep(verify(pairs, sets.join(asked, "s1", "left_semi"), num, den), "more_links")

    final = connected_components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), tables)
    found = classes.join(final.select(F.col("id").alias("s1"), "component"), "s1", "left").select(*same, "rep", F.coalesce("component", "s1").alias("component"))
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = found.join(least, "component").select(*same, "component_id")
    out = signed_docs.select("doc_id", *same).join(named, same, "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"))


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: three-word shingles, intersection at least 90 % of the union."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, 3, 90, 100)
