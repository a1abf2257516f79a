"""Benchmark decontamination by a prefix-filtered set join.

Every window (``window`` consecutive words of a benchmark item; a shorter item is
one window) is a set of shingles that must be contained whole, so of its
shingles, ordered by rarity in the documents, the rarest one is the necessary
prefix. Documents join on those prefix shingles only. A match is kept if the
window fits between the document's ends at the place that the shingle's position
fixes (length and positional bounds), and is then verified word by word.

The first pass counts in how many places of all documents each benchmark shingle
occurs; the second joins. Documents never move: the benchmark is sent to them in
blocks of at most ``block_bytes`` of text, one at a time, so nothing sent grows with
the data; a larger benchmark takes more passes, and what they find is staged between.

Defined results: a null or empty text has no words and no hits; an item without
words has no window; items that share a window are all found; repeated document
rows are judged each for itself; ties in rarity go to the smaller hash; whole texts
are read; columns of the input named like those made here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import map_arrow, release, stage, text_bytes, words_of

WINDOW = 10
SHINGLE = 5
#: Text of the benchmark that is indexed and sent at once; its index takes some ten times that.
BLOCK_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_keys(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key for each ``k`` consecutive word numbers; 0 where a word is unknown."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        known &= part != 0
        key = (key ^ part) * _MIX
        key ^= key >> np.uint64(29)
    key[~known] = 0
    return key


@dataclass
class Windows:
    """The windows of a block of items, and after ``rank`` their prefix shingles; flat arrays, so that a block stays small."""

    vocab: dict[bytes, int] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)  # of the items
    words: dict[int, np.ndarray] = field(default_factory=dict)  # window size -> distinct windows, one a row
    owners: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # window size -> (first owner of each window, numbers of its items)
    counted: dict[int, np.ndarray] = field(default_factory=dict)  # shingle size -> sorted keys
    prefix: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)  # window size -> sorted keys, window, position

    def add_all(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        found: dict[int, tuple[list, list]] = {}
        for name, words in items:
            if not words:
                continue
            ids = np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in words), np.uint32, len(words))
            size = min(window, len(ids))
            rows, owner = found.setdefault(size, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, size))
            owner.append(np.full(len(ids) - size + 1, len(self.names)))
            self.names.append(name)
        for size, (rows, owner) in found.items():
            distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)], 1), axis=0)
            self.words[size] = distinct
            self.owners[size] = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]

    def keys(self, size: int, shingle: int) -> np.ndarray:
        """The shingle keys of all windows of a size, one window a row."""
        own, k = self.words[size], min(shingle, size)
        flat = shingle_keys(own.ravel().astype(np.uint64), k)
        return flat[(np.arange(len(own)) * size)[:, None] + np.arange(size - k + 1)]

    def index(self, shingle: int) -> None:
        sizes: dict[int, list[np.ndarray]] = {}
        for size in self.words:
            sizes.setdefault(min(shingle, size), []).append(self.keys(size, shingle).ravel())
        self.counted = {k: np.unique(np.concatenate(v)) for k, v in sorted(sizes.items())}

    def rank(self, counts: dict[int, np.ndarray], shingle: int) -> None:
        for size in self.words:
            keys, k = self.keys(size, shingle), min(shingle, size)
            df = counts[k][np.searchsorted(self.counted[k], keys)]
            ties = np.where(df == df.min(1, keepdims=True), keys, np.iinfo(np.uint64).max)
            at = ties.argmin(1)  # the rarest, then the smallest key
            own = keys[np.arange(len(keys)), at]
            order = np.argsort(own, kind="stable")
            self.prefix[size] = own[order], order, at[order]

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.uint64, len(words))

    def matches(self, ids: np.ndarray, shingle: int) -> list[tuple[int, int, int]]:
        """(start, size, window) of every occurrence in a document."""
        out, known = [], {}
        for size, (keys, window, position) in self.prefix.items():
            if size > len(ids):
                continue
            k = min(shingle, size)
            own = known.setdefault(k, shingle_keys(ids, k))
            low = np.searchsorted(keys, own)
            for i in np.flatnonzero((keys[np.minimum(low, len(keys) - 1)] == own) & (own != 0)).tolist():
                for e in range(low[i], np.searchsorted(keys, own[i], "right")):
                    start = i - int(position[e])
                    if 0 <= start <= len(ids) - size and np.array_equal(ids[start : start + size], self.words[size][window[e]]):
                        out.append((start, size, int(window[e])))
        return out

    def items_of(self, size: int, window: int) -> list[str]:
        first, owner = self.owners[size]
        return [self.names[i] for i in owner[first[window] : first[window + 1]]]


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int, block_bytes: int) -> Iterator[tuple[Windows, bool]]:
    """Items in blocks of bounded size, and whether there are several; only one is on the driver at a time."""
    own = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total * 2 // block_bytes)) if total > block_bytes else 1
    for part in range(parts):
        block = Windows()
        rows = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part) if parts > 1 else own
        block.add_all([(r.i, words_of(r.t.encode())) for r in sorted(rows.distinct().collect())], window)
        block.index(shingle)
        if block.words:
            yield block, parts > 1


def shingle_counts(docs: DataFrame, block: Windows, text_col: str) -> dict[int, np.ndarray]:
    """Occurrences in all documents of each shingle of a block."""
    shared = docs.sparkSession.sparkContext.broadcast((block.vocab, block.counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, counted = shared.value
        sums = {k: np.zeros(len(keys), np.int64) for k, keys in counted.items()}
        for b in batches:
            for t in text_bytes(b.column(0)):
                if not t:
                    continue
                words = words_of(t)
                ids = np.fromiter(map(vocab.get, words, repeat(0)), np.uint64, len(words))
                for k, keys in counted.items():
                    own = shingle_keys(ids, k)
                    own = own[own != 0]
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    at = at[keys[at] == own]
                    if len(at):
                        np.add.at(sums[k], at, 1)
        for k, v in sums.items():
            at = np.flatnonzero(v)
            for lo in range(0, len(at), 1 << 16):
                part = at[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part), pa.array(v[part])], ["k", "i", "n"])

    rows = map_arrow(docs.select(text_col), run, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()
    out = {k: np.zeros(len(keys), np.int64) for k, keys in block.counted.items()}
    for r in rows:
        out[r.k][r.i] = r.n
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with what the benchmark shares with each.

    ``n_words``; ``hit_spans``: disjoint, sorted (first word, end) of all words
    inside an occurrence; ``n_hit``; ``item_ids``: the items, sorted as strings.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "hit_spans", "n_hit", "item_ids")]
    kept = [F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    made = {"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "hit_spans": F.lit(None).cast("array<struct<start:bigint,end:bigint>>"), "item_ids": F.lit(None).cast("array<string>")}
    out = docs.select(*kept, *(v.alias(k) for k, v in made.items()), F.col(text_col).alias("_text"))
    found = False
    for block, several in _blocks(items, item_id, item_text, window, shingle, block_bytes):
        block.rank(shingle_counts(docs, block, text_col), shingle)
        block.counted = {}
        had, (out, shared) = out, _join(out, block, shingle)
        found = True
        if several:  # one block is with the workers at a time
            out = stage(out, "hits")
            shared.destroy()
            release(docs.sparkSession, had)
    out = out if found else _join(out, Windows(), shingle)[0]
    return out.select(*(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)), *made)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _join(docs: DataFrame, block: Windows, shingle: int) -> tuple[DataFrame, Broadcast]:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = docs.schema
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            names = b.schema.names
            col = {n: b.column(i) for i, n in enumerate(names)}
            n_words, n_hit, spans, items = [], [], [], []
            for t, old, had in zip(text_bytes(col["_text"]), col["hit_spans"].to_pylist(), col["item_ids"].to_pylist()):
                words = words_of(t or b"")
                hits = w.matches(w.number(words), shingle) if words else []
                own = _merge([(s["start"], s["end"]) for s in old or ()] + [(s, s + n) for s, n, _ in hits])
                n_words.append(len(words))
                n_hit.append(sum(e - s for s, e in own))
                spans.append([{"start": s, "end": e} for s, e in own])
                items.append(sorted({*(had or ()), *(i for n, x in {h[1:] for h in hits} for i in w.items_of(n, x))}))
            col |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hit_spans": pa.array(spans, span), "item_ids": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([col[n] for n in names], names)

    return map_arrow(docs, run, schema), shared
