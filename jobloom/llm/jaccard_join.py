"""Jaccard self-join on word n-grams by a size-aware heavy-light join.

Two texts link when ``den * |intersection| >= num * |union|`` of their sets of
distinct ``shingle``-word n-grams. Equal sets are one node. Then, by set size:

* light sets enumerate, for every partner size, all subsets of the overlap that
  the threshold asks for; sets that share a subset have that overlap;
* heavy sets scan inverted lists: with n-grams ordered by rarity, only the rarest
  few of a set can hold the first shared one, so only they are in the lists, and a
  list's pairs must pass length and positional bounds and a bound on the overlap
  from both prefixes.

The boundary is the size at which the sum of both costs is least, from the sizes
of all sets and the measured load of the lists.

A list never yields all its pairs. First every member is compared with the
list's head only (the one with the fewest rarer n-grams before it); those found
similar become one component. Then members outside the head's component are
compared with all members of other components, which makes the links whole: a
pair within one component need not be tested. Candidate pairs are verified on the
full sets. Groups of near copies thus cost their size, not its square.

Rarity is counted over all documents, in count-min sketches of bounded size: one of
n-grams, one of words (whose product estimates an n-gram too rare to stand out in
the first). Any order gives right results; the sketches only make it a good one.

Defined results: null and empty texts and texts without words have an empty set,
are linked with nothing and are their own component; a text with fewer words than
``shingle`` is one n-gram; repeated rows are one node; a component's id is its
smallest document id, nulls ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import flat_bytes, map_arrow, release, stage, text_bytes
from jobloom.llm.components import components

#: Cells of the word sketch and of the filter on verified nodes: fixed sizes. The n-gram
#: sketch gets a cell for every GRAM_LOAD n-grams, up to GRAM_CELLS.
GRAM_CELLS = 1 << 24
GRAM_LOAD = 24
WORD_CELLS = 1 << 20
FILTER_BITS = 1 << 24
KEY_BITS = 1 << 25
#: Sets of this size or more are never light.
LIGHT_LIMIT = 64
CACHE_WORDS = 150_000
_SLICES = 64
#: The level of an n-gram expected once; those expected less often have lower ones.
_ONE = 64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _grams(text: bytes | None, k: int, known: _WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, n-gram hashes) of a text, in order, repeats included."""
    words = (text or b"").translate(_FOLD).split()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(w))
    n = len(w) - k + 1 if k else 0
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + n]) * _MIX
        h ^= h >> np.uint64(29)
    return w, h


class Rarity:
    """Order of n-grams: a byte of estimated frequency (rare first), then the hash."""

    def __init__(self, grams: list[np.ndarray], words: np.ndarray, shingle: int) -> None:
        """``grams``: the cells of the n-gram sketch in slices, so that temporaries stay small."""
        total, cells = sum(int(g.sum(dtype=np.int64)) for g in grams), sum(map(len, grams))
        noise = total / cells
        loud = noise + 4 * math.sqrt(noise) + 1
        self.level = np.concatenate([np.where(g > loud, _ONE + np.ceil(np.log2(np.maximum(g, 1))), 0).astype(np.uint8) for g in grams])
        self.total = math.log2(max(1, words.sum(dtype=np.int64)))
        self.word = (np.log2(np.maximum(words, 1)) - self.total).astype(np.float32)
        self.shingle = shingle
        #: how many n-grams of other sets an n-gram meets in its list, on average
        self.load = max(0.0, sum(float((g.astype(float) ** 2).sum()) for g in grams) / max(1, total) - noise - 1)

    def keys(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The set of a text: sorted distinct keys, rarest n-gram first."""
        n, k = len(h), min(self.shingle, len(w))
        own = self.word[(w % np.uint64(len(self.word))).astype(np.int64)]
        guess = np.full(n, self.total, np.float32)
        for j in range(k):
            guess += own[j : j + n]
        level = np.maximum(self.level[(h % np.uint64(len(self.level))).astype(np.int64)], np.clip(_ONE + np.ceil(guess), 0, 127).astype(np.uint8))
        return np.unique((level.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)))


def overlap(n: int, m: int, num: int, den: int) -> int:
    """The least overlap of linked sets of these sizes."""
    return -(-num * (n + m) // (num + den))


def _partners(n: int, num: int, den: int) -> range:
    return range(-(-num * n // den), n * den // num + 1)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def subset_count(n: int, num: int, den: int) -> int:
    """Subsets that a light set of this size enumerates (equal sets are one node already)."""
    return sum(math.comb(n, c) for m in _partners(n, num, den) if (c := overlap(n, m, num, den)) <= min(n, m) and not n == m == c)


def choose_boundary(sizes: np.ndarray, heavier: int, load: float, num: int, den: int) -> int:
    """The size from which sets are heavy. ``heavier``: list entries of sets beyond ``sizes``."""
    lists = [int(c) * prefix_length(n, num, den) * (1 + load) if n else 0 for n, c in enumerate(sizes)]
    subsets = [int(c) * subset_count(n, num, den) if n else 0 for n, c in enumerate(sizes)]
    total = lambda x: sum(subsets[:x]) + sum(lists[-(-num * x // den) :]) + heavier
    return min(range(1, len(sizes)), key=lambda x: (total(x), x))


def _subset_keys(keys: np.ndarray, boundary: int, num: int, den: int) -> list[int]:
    n, out = len(keys), []
    values = [x.to_bytes(8, "little") for x in keys.tolist()]
    for m in _partners(n, num, den):
        c = overlap(n, m, num, den)
        if c > min(n, m) or n == m == c or m >= boundary:
            continue
        tag = f"{min(n, m)},{max(n, m)}".encode()
        out += [xxhash.xxh3_64_intdigest(b"".join(s), seed=1) ^ xxhash.xxh3_64_intdigest(tag) for s in combinations(values, c)]
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Small counts in few bytes: the width first, then the compressed values."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or counts.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}")


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Rows (slice, data: packed counts), summed by slice. There are a few fixed slices."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(_unpacked(d).astype(np.int64) for d in t.column("data").to_pylist())
        return pa.table({"slice": pa.array(t.column("slice").to_pylist()[:1], pa.int32()), "data": pa.array([_packed(total)], pa.binary())})

    return {r["slice"]: _unpacked(bytes(r["data"])) for r in rows.groupBy("slice").applyInArrow(add, "slice int, data binary").collect()}


def _measure(texts: DataFrame, shingle: int, num: int, den: int) -> tuple[Rarity, int]:
    """One pass over all texts: both sketches and the sizes; gives order and boundary."""
    length = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    cells = 1 << 16
    while cells < GRAM_CELLS and cells * GRAM_LOAD < length / 6:  # a word takes some six bytes
        cells *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held_g, held_w, held = _WordHash(), [], [], 0
        grams, words, sizes = np.zeros(cells, np.int32), np.zeros(WORD_CELLS, np.int32), np.zeros(LIGHT_LIMIT + 1, np.int32)

        def empty() -> None:
            for cells, parts in ((grams, held_g), (words, held_w)):
                if parts:
                    np.add.at(cells, (np.concatenate(parts) % np.uint64(len(cells))).astype(np.int64), 1)
                    parts.clear()

        for b in batches:
            for t in text_bytes(b.column(0)):
                w, h = _grams(t, shingle, known)
                h = np.unique(h)
                if not len(h):
                    continue
                if len(h) < LIGHT_LIMIT:
                    sizes[len(h)] += 1
                else:
                    sizes[LIGHT_LIMIT] += prefix_length(len(h), num, den)
                held_g.append(h)
                held_w.append(w)
                held += len(w)
                if held > 1 << 18:
                    empty()
                    held = 0
        empty()
        parts = [*np.split(grams, _SLICES), *np.split(words, _SLICES), sizes]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([_packed(p) for p in parts], pa.binary())], ["slice", "data"])

    got = _summed(map_arrow(texts, run, "slice int, data binary"))
    if not got:
        return Rarity([np.zeros(cells, np.int64)], np.zeros(WORD_CELLS, np.int64), shingle), 1
    rarity = Rarity([got[i] for i in range(_SLICES)], np.concatenate([got[i] for i in range(_SLICES, 2 * _SLICES)]), shingle)
    sizes = got[2 * _SLICES].astype(np.int64)
    return rarity, choose_boundary(sizes[:LIGHT_LIMIT], int(sizes[LIGHT_LIMIT] * (1 + rarity.load)), rarity.load, num, den)


def _digest(keys: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(keys.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _text_hash(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)


def _signatures(docs: DataFrame, id_col: str, text_col: str, rarity, boundary: int, shingle: int, num: int, den: int) -> DataFrame:
    """(id, row, text, n, d0, d1, keys): ``keys`` are subset keys of light, prefix keys of heavy sets
    (``listed`` of them; those of light sets that heavy ones may meet hold both)."""
    least = -(-num * boundary // den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = _WordHash(), rarity.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, rows, ns, d0, d1, keys, listed, hashes = [], [], [], [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                own = order.keys(*_grams(t, shingle, known))
                n, got = len(own), []
                if n >= least:
                    got = own[: prefix_length(n, num, den)].view(np.int64).tolist()
                listed.append(len(got))
                hashes.append(_text_hash(t))
                if 0 < n < boundary:
                    got += np.array(_subset_keys(own, boundary, num, den), np.uint64).view(np.int64).tolist()
                x, y = _digest(own)
                ids.append(i)
                rows.append(row)
                ns.append(n)
                d0.append(x)
                d1.append(y)
                keys.append(got)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *(pa.array(x, pa.int64()) for x in (rows, hashes, ns, d0, d1)), pa.array(keys, pa.list_(pa.int64())), pa.array(listed, pa.int64())], ["id", "row", "text", "n", "d0", "d1", "keys", "listed"])

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"id {kind}, row long, text long, n long, d0 long, d1 long, keys array<long>, listed long")


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Length and positional bounds for two entries of a list."""
    n, m, p, q = (F.greatest(F.col(f"{x}.{y}"), F.lit(0)) for y in ("n", "pos") for x in (a, b))
    need = F.floor((num * (n + m) + (num + den - 1)) / F.lit(num + den))
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (F.least(n - p, m - q) >= need)


def _prefix_bound(a: str, b: str, num: int, den: int) -> Column:
    """What both prefixes tell of the overlap: up to the smaller of their ends, an n-gram
    that the other prefix lacks is not in the other set."""
    n, m, p, q = (F.col(f"{x}.{y}") for y in ("n", "prefix") for x in (a, b))
    end, common = F.least(F.array_max(p), F.array_max(q)), F.size(F.array_intersect(p, q))
    own = lambda keys: F.size(F.filter(keys, lambda k: k <= end)) - common
    need = F.floor((num * (n + m) + (num + den - 1)) / F.lit(num + den))
    return (F.size(p) == 0) | (F.size(q) == 0) | ((n - own(p) >= need) & (m - own(q) >= need))


def _pairs(x: DataFrame, y: DataFrame, on: Column, num: int, den: int) -> DataFrame:
    got = x.alias("x").join(y.alias("y"), on & _may_link("x", "y", num, den))
    return got.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _bits_of(longs: DataFrame, size: int) -> np.ndarray:
    """Packed bits of all values in columns of longs: fixed size, may say yes too often, never no."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            for i in range(b.num_columns):
                bits[(b.column(i).to_numpy().view(np.uint64) % np.uint64(size)).astype(np.int64)] = True
        for i, part in enumerate(np.split(np.packbits(bits), _SLICES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "data"])

    def either(t: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(d, np.uint8) for d in t.column("data").to_pylist()])
        return pa.table({"slice": pa.array(t.column("slice").to_pylist()[:1], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    rows = map_arrow(longs, run, "slice int, data binary").groupBy("slice").applyInArrow(either, "slice int, data binary").collect()
    packed = np.zeros((_SLICES, size // 8 // _SLICES), np.uint8)
    for r in rows:
        packed[r["slice"]] = np.frombuffer(bytes(r["data"]), np.uint8)
    return packed.reshape(-1)


def _has(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = (values.view(np.uint64) % np.uint64(8 * len(packed))).astype(np.int64)
    return (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def _entries(whole: DataFrame, bits) -> DataFrame:
    """(key, node, n, pos) of the keys that may be shared; ``pos`` is -1 for subset keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = bits.value
        for b in batches:
            node, n, listed = (b.column(i).to_numpy() for i in range(3))
            keys = b.column(3).flatten().to_numpy()
            sizes = pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(node)), sizes)
            at = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(_has(packed, keys))
            row, at = row[keep], at[keep]
            pos = np.where(at < listed[row], at, -1)
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(node[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))], ["key", "node", "n", "pos"])

    return map_arrow(whole.select("node", "n", "listed", "keys"), run, "key long, node long, n int, pos int")


def _verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, rarity, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs that link, by the intersection of their whole sets."""
    spark = pairs.sparkSession
    ends = nodes.select("node", "d0", "d1", "text")
    named = stage(pairs.join(ends.toDF("a", "a0", "a1", "at"), "a").join(ends.toDF("b", "b0", "b1", "bt"), "b"), "pairs")
    bits = spark.sparkContext.broadcast(_bits_of(named.select("at", "bt"), FILTER_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order, packed = _WordHash(), rarity.value, bits.value
        for b in batches:
            d0, d1, data, had = [], [], [], set()
            for t in text_bytes(b.column(0)):
                cell = _text_hash(t) % (1 << 64) % FILTER_BITS
                if not packed[cell >> 3] >> (7 - (cell & 7)) & 1:
                    continue
                own = order.keys(*_grams(t, shingle, known))
                x, y = _digest(own)
                if len(own) and (x, y) not in had:
                    had.add((x, y))
                    d0.append(x)
                    d1.append(y)
                    data.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(data, pa.binary())], ["d0", "d1", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            (xs, xo), (ys, yo) = flat_bytes(b.column(2)), flat_bytes(b.column(3))
            for i in range(b.num_rows):
                x, y = xs[xo[i] : xo[i + 1]].view(np.uint64), ys[yo[i] : yo[i + 1]].view(np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    made = map_arrow(texts, sets, "d0 long, d1 long, data binary").dropDuplicates(["d0", "d1"])
    got = named.join(made.toDF("a0", "a1", "x"), ["a0", "a1"]).join(made.toDF("b0", "b1", "y"), ["b0", "b1"])
    out = stage(map_arrow(got.select("a", "b", "x", "y"), compare, "a long, b long"), "links")
    release(spark, named)
    return out


def join(docs: DataFrame, num: int = 80, den: int = 100, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles`` and ``component_id``, the smallest id that its links reach."""
    spark = docs.sparkSession
    texts = docs.select(text_col)
    measured, boundary = _measure(texts, shingle, num, den)
    rarity = spark.sparkContext.broadcast(measured)
    signed = stage(_signatures(docs, id_col, text_col, rarity, boundary, shingle, num, den), "signatures")
    sets = signed.where(F.col("n") > 0)
    least_row = F.min(F.struct("row", "text")).alias("r")
    nodes = sets.groupBy("d0", "d1").agg(least_row, F.min("id").alias("first_id")).select("d0", "d1", F.col("r.row").alias("node"), F.col("r.text").alias("text"), "first_id")
    nodes = stage(nodes, "nodes")

    whole = sets.groupBy("d0", "d1").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("listed").alias("listed"))
    whole = stage(whole.select("node", "n", "listed", "keys"), "whole")
    members = stage(signed.select("id", "n", "d0", "d1"), "members")
    release(spark, signed)  # the keys of copies are not needed

    shared = stage(whole.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > 1).select("key"), "shared")
    bits = spark.sparkContext.broadcast(_bits_of(shared, KEY_BITS))
    lists = stage(_entries(whole, bits).join(shared, "key"), "lists")
    release(spark, shared)
    met = lists.select("node").distinct()
    prefixes = stage(whole.join(met, "node", "left_semi").select("node", "n", F.slice("keys", F.lit(1), F.col("listed").cast("int")).alias("prefix")), "prefixes")

    release(spark, whole)

    head = lists.groupBy("key").agg(F.min(F.struct("pos", "node", "n")).alias("h")).select("key", "h.*")
    tried = _pairs(head, lists, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")), num, den)
    tried = stage(tried, "tried")

    def bounded(pairs: DataFrame) -> DataFrame:
        both = pairs.join(prefixes.alias("x"), F.col("a") == F.col("x.node")).join(prefixes.alias("y"), F.col("b") == F.col("y.node"))
        return both.where(_prefix_bound("x", "y", num, den)).select("a", "b")

    links = _verify(bounded(tried), nodes, texts, rarity, shingle, num, den)

    found = components(links)
    named = lists.join(found, "node", "left").select("key", "node", "n", "pos", F.coalesce("component", "node").alias("c"))
    named = stage(named, "named")
    release(spark, lists, found)
    mixed = named.groupBy("key").agg(F.min(F.struct("pos", "node", "c")).alias("h"), F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("lo") != F.col("hi")).select("key", F.col("h.c").alias("hc"), F.col("h.node").alias("head"))
    rest = stage(named.join(mixed, "key").where(F.col("node") != F.col("head")), "rest")  # the head has met all
    release(spark, named)
    outside = rest.where(F.col("c") != F.col("hc"))
    more = _pairs(outside, rest, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")), num, den)
    more = bounded(more.join(tried, ["a", "b"], "left_anti"))
    more = _verify(more, nodes, texts, rarity, shingle, num, den)
    release(spark, rest, tried, prefixes)
    found = components(links.unionByName(more))

    ids = nodes.join(found, "node", "left").select("d0", "d1", "first_id", F.coalesce("component", "node").alias("c"))
    ids = stage(ids, "classes")
    least = ids.groupBy("c").agg(F.min("first_id").alias("component_id"))
    classes, ids = ids, stage(ids.join(least, "c").select("d0", "d1", "component_id"), "classes")
    release(spark, classes, nodes, links, more)
    out = members.where("n > 0").join(ids, ["d0", "d1"]).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    alone = members.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(alone)
