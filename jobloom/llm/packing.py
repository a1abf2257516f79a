"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents longer than a sequence are cut into full pieces and a rest; only rests
are packed. What to pack is a histogram of lengths with at most ``capacity``
entries, whatever the number of documents, so the plan is made on the driver:
a bin is filled greedily (largest length that still fits first), then best two
fit: its smallest document gives way to two unpacked documents that fit its
expanded gap more tightly. The same pattern of lengths is repeated as long as the
histogram allows. Documents then find their place by their rank among those of
equal length; no document is compared with another and no length is gathered in
one task: ranks are counted by task and offset by the counts of the other tasks.

Defined results: a null or empty text is one piece holding the end id alone;
repeated rows are packed each for itself; an empty table gives no rows; equal
lengths are interchangeable and are ranked in order of appearance.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import cached, map_arrow, stage, text_bytes

CAPACITY = 2048
END_ID = 0
#: Distinct parts of texts whose ids a worker remembers.
CACHE_WORDS = 1_200_000
_STOP = re.compile(rb"(?<=[a-z])[.,](?=\s|$)")


class WordEncoder:
    """Ids of whole texts, from the ids of their words.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its white-space separated parts, one after another. It also folds case
    and starts anew at a full stop or comma that ends a part after an ASCII letter,
    so those are split off and A-Z is folded first, which makes for fewer distinct
    parts. Parts are encoded once and kept. Those of letters only are encoded
    together: each yields one id that ends a word, which tells them apart (checked
    by their number; else they are encoded one by one).
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.limit = cache_words
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)  # of each part in ids; the end is the next one's start
        self.used = 0

    def _encode(self, parts: list[str]) -> Iterator[list[int] | np.ndarray]:
        plain = [p for p in parts if p.isalpha()]
        together = iter(())
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(plain):
                together = iter(np.split(ids, cut[:-1]))
            else:
                plain = []
        apart = iter(self.tokenizer.encode_batch_fast([p for p in parts if not plain or not p.isalpha()], add_special_tokens=False))
        for p in parts:
            yield next(together) if plain and p.isalpha() else next(apart).ids

    def _learn(self, parts: list[bytes]) -> None:
        for lo in range(0, len(parts), 256):
            own = parts[lo : lo + 256]
            for p, ids in zip(own, self._encode([x.decode() for x in own])):
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.resize(self.ids, 2 * len(self.ids))
                n = len(self.number)
                if n + 2 > len(self.start):
                    self.start = np.resize(self.start, 2 * len(self.start))
                self.number[p] = n
                self.start[n] = self.used
                self.ids[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
                self.start[n + 1] = self.used

    def encode(self, text: bytes) -> np.ndarray:
        if b"<|" not in text:  # else it may hold a special token, which must keep its case
            text = _STOP.sub(rb" \g<0>", text.lower())
        parts = text.split()
        if not parts:
            return np.zeros(0, np.uint32)
        try:
            at = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        except KeyError:
            new = list({p for p in parts if p not in self.number})
            if len(self.number) + len(new) > self.limit:
                self.number, self.used = {}, 0
                new = list(set(parts))
            self._learn(new)
            at = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        first, size = self.start[at], self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]


def _encoder(path: str) -> WordEncoder:
    return cached(f"encoder {path}", lambda: WordEncoder(path))


def pieces(docs: DataFrame, tokenizer_path: str, text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids, the end id included, into pieces.

    Per piece: ``keep`` columns, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``part`` and ``rank`` (place among the pieces of its length that its task
    made), and with ``with_ids`` the ids themselves.
    """
    made = ["piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * with_ids]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        counts = np.zeros(capacity + 1, np.int64)
        for b in batches:
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for i, t in enumerate(text_bytes(b.column(len(keep)))):
                own = np.append(encoder.encode(t or b""), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    p = own[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(p))
                    crc.append(zlib.crc32(p.tobytes()))
                    rank.append(counts[len(p)])
                    counts[len(p)] += 1
                    if with_ids:
                        ids.append(p)
            take = pa.array(row, pa.int64())
            cols = [b.column(i).take(take) for i in range(len(keep))]
            cols += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            if with_ids:
                cols.append(pa.array([p.astype(np.int64) for p in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, [*keep, *made])

    kinds = ["int", "long", "long", "long", "int", "long", *["array<long>"] * with_ids]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} {k}" for c, k in zip(made, kinds))])
    return map_arrow(docs.select(*keep, F.col(text_col).alias("_text")), run, schema, keeps=f"encoder {tokenizer_path}")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is used, by best two fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        use = [top]
        left[top] -= 1
        gap = capacity - top
        while gap > 0:
            fit = np.flatnonzero(left[1 : gap + 1])
            if not len(fit):
                break
            use.append(int(fit[-1]) + 1)
            left[use[-1]] -= 1
            gap -= use[-1]
        if gap > 0:
            pair = _best_two(left, gap + use[-1], use[-1])
            if pair:
                left[use.pop()] += 1
                use += pair
                left[pair[0]] -= 1
                left[pair[1]] -= 1
        need = np.bincount(use, minlength=capacity + 1)
        left += need
        times = int((left[need > 0] // need[need > 0]).min())
        left -= times * need
        out.append((sorted(use, reverse=True), times))
    return out


def _best_two(left: np.ndarray, room: int, more_than: int) -> list[int] | None:
    """Two unpacked lengths whose sum is the largest within ``room``, if over ``more_than``."""
    have = np.flatnonzero(left[: room + 1])
    if not len(have):
        return None
    nearest = np.zeros(room + 1, np.int64)  # the largest length at hand up to each length
    nearest[have] = have
    nearest = np.maximum.accumulate(nearest)
    other = nearest[room - have]
    twice = (other == have) & (left[have] < 2)
    if twice.any():
        other[twice] = [nearest[h - 1] if h else 0 for h in have[twice]]
    total = np.where(other > 0, have + other, 0)
    best = int(total.argmax())
    return [int(have[best]), int(other[best])] if total[best] > more_than else None


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for the pieces of a stored table of ``pieces``."""
    spark = cut.sparkSession
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for use, times in plan(histogram, capacity):
        offset = 0
        for length in use:
            slots.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        sequence += times
    tables = {k: np.array(v, np.int64).T for k, v in slots.items()}
    shared = spark.sparkContext.broadcast(tables)  # some entries for each of at most ``capacity`` lengths
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "part"])
    names = [c for c in cut.columns if c not in ("part", "rank", "sequence_id", "offset")]
    types = dict(cut.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            length, rank = b.column(len(names)).to_numpy(), b.column(len(names) + 1).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = length == k
                first, sequences, offsets = table[int(k)]
                at = np.searchsorted(first, rank[own], "right") - 1
                seq[own], off[own] = sequences[at] + rank[own] - first[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "sequence_id long, offset long"])
    return map_arrow(ranked.select(*names, F.col("length").alias("_length"), (F.col("base") + F.col("rank")).alias("_rank")), run, schema)


def pack(docs: DataFrame, tokenizer_path: str, text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their sequence and their place in it."""
    return assign(stage(pieces(docs, tokenizer_path, text_col, capacity, end_id, keep, with_ids), "pieces"), capacity)
