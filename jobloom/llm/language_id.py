"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order: the contexts of up to
``ORDER`` bytes that its training texts hold, over all 256 byte values (A-Z are read
as a-z). A byte that a context has not seen escapes to the next shorter context, with
the escape probability of method C (distinct bytes over occurrences and distinct
bytes), and below the empty context to one of 256 equal bytes; seen bytes are not
excluded there. The trees are frozen after training, so a document's exact code length
is a sum of constants. The language with the shortest code wins.

All trees share their nodes. A node is a string of up to ``ORDER`` + 1 bytes that some
language has seen; the code length of a byte follows from the longest node that ends at
it and the longest one that ends before it, so one node is looked up for each byte,
whatever the number of languages.

Defined results: a null text, an empty text and a text without letters give
``und`` with score 0. Ties go to the language that sorts first. Whole texts are
scored. Rows are independent, so repeated rows and skewed sources make no difference.
With no training rows every text is ``und``. Columns of the input named ``lang_pred``
or ``score`` are replaced; other extra columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import flat_bytes, map_arrow

#: The model is fitted on a bounded sample: at most SAMPLE_ROWS distinct labelled texts of
#: each language, those with the smallest hash of their text, as far as they come to
#: SAMPLE_BYTES together. Texts of over LONG_BYTES come last, and the first text always counts.
SAMPLE_ROWS = 400
SAMPLE_BYTES = 4 << 20
LONG_BYTES = 64 << 10
#: Longest context in bytes.
ORDER = 4
_SLICE = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _named(codes: np.ndarray, m: int) -> np.ndarray:
    """A string of ``m`` bytes as one number; no two strings have the same."""
    return codes | np.uint64(m << 56)


class Strings:
    """An open hash table from strings to the rows of the model."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), _slot(keys, self.bits)
        while len(left):
            free = self.rows[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            own = left[free][first]
            self.keys[slots], self.rows[slots] = keys[own], own
            again = np.ones(len(left), bool)
            again[np.flatnonzero(free)[first]] = False
            left, at = left[again], (at[again] + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = _slot(keys, self.bits)
        out = self.rows[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.rows[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return out


@dataclass
class PpmModel:
    langs: list[str]
    order: int
    strings: Strings
    #: By string (the last one is the empty string) and language: what a byte that ends the
    #: string adds, with the escapes of the byte after it; and these escapes alone.
    bits: np.ndarray
    escapes: np.ndarray

    def nodes(self, flat: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The longest known string that ends at each byte of a slice, within its document."""
        head = max(0, lo - self.order)
        s = _FOLD[flat[head:hi]].astype(np.uint64)
        s = np.concatenate([np.zeros(self.order - (lo - head), np.uint64), s])
        n = hi - lo
        first = np.searchsorted(offsets, [lo, hi - 1], "right") - 1
        sizes = np.minimum(offsets[first[0] + 1 : first[1] + 2], hi) - np.maximum(offsets[first[0] : first[1] + 1], lo)
        room = np.arange(lo, hi) - np.repeat(offsets[first[0] : first[1] + 1], sizes) + 1
        codes = [s[self.order :]]
        for j in range(1, self.order + 1):
            codes.append(codes[-1] | s[self.order - j : self.order - j + n] << np.uint64(8 * j))
        out = np.full(n, -1, np.int32)
        left = np.arange(n)
        for m in range(self.order + 1, 0, -1):
            able = left[room[left] >= m]
            out[able] = self.strings.find(_named(codes[m - 1][able], m))
            left = left[out[left] < 0]
        out[left] = len(self.bits) - 1
        return out

    def code_lengths(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each document (rows) under each language (columns).

        Works through slices of bounded size, so a document may have any length.
        """
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for lo in range(0, len(flat), _SLICE):
            hi = min(lo + _SLICE, len(flat))
            node = self.nodes(flat, offsets, lo, hi)
            first, last = np.searchsorted(offsets, [lo, hi - 1], "right") - 1
            starts, ends = np.maximum(offsets[first : last + 1], lo), np.minimum(offsets[first + 1 : last + 2], hi)
            keep = np.flatnonzero(ends > starts)
            out[first + keep] += np.add.reduceat(self.bits[node], starts[keep] - lo, axis=0)
            over = keep[ends[keep] == offsets[first + keep + 1]]  # documents that end here
            out[first + over] += self.escapes[-1] - self.escapes[node[ends[over] - 1 - lo]]
        return out


def fit(samples: list[tuple[str, str]], order: int = ORDER) -> PpmModel:
    """Fit from (text, language) pairs held in memory."""
    by_lang: dict[str, list[bytes]] = {}
    for text, lang in samples:
        if text and lang is not None:
            by_lang.setdefault(lang, []).append(text.encode())
    langs = sorted(by_lang)
    known, counts = [], []  # of the strings of 1 to order + 1 bytes
    for m in range(1, order + 2):
        found = [_strings(by_lang[lang], m) for lang in langs]
        known.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *(f[0] for f in found)])))
        counts.append(np.zeros((len(known[-1]), len(langs))))
        for i, (codes, n) in enumerate(found):
            counts[-1][np.searchsorted(known[-1], codes), i] = n
    code = np.full((1, len(langs)), 8.0)  # below the empty context, any of 256 bytes
    down = np.zeros((1, len(langs)))  # escapes from a context to that of no byte
    bits, escapes = [], []
    for m, (codes, n) in enumerate(zip(known, counts)):
        # a string's context is all but its last byte; one context down, it loses its first byte
        if m:
            context = np.searchsorted(known[m - 1], codes >> np.uint64(8))
            shorter = np.searchsorted(known[m - 1], codes & np.uint64((1 << 8 * m) - 1))
        else:
            context = shorter = np.zeros(len(codes), np.int64)
        total, distinct = np.zeros(down.shape), np.zeros(down.shape)
        np.add.at(total, context, n)
        np.add.at(distinct, context, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            stay = -np.log2(n / (total + distinct)[context])
        below = code[shorter] if m else code[context]
        down = down + leave  # by context, now as seen from it
        escapes.append(down)
        if m:
            bits[-1] = bits[-1] + down
        code = np.where(n > 0, stay, leave[context] + below)
        bits.append(code - down[context])
        down = down[shorter] if m else np.repeat(down, len(codes), 0)
    escapes.append(down)  # of the longest strings: those of their context
    bits[-1] = bits[-1] + down
    names = np.concatenate([_named(codes, m + 1) for m, codes in enumerate(known)])
    empty = escapes.pop(0)
    return PpmModel(langs, order, Strings(names), np.concatenate([*bits, 8.0 + empty]), np.concatenate([*escapes, empty]))


def _strings(texts: list[bytes], m: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings of ``m`` bytes, their counts), none across two texts."""
    parts = []
    for t in texts:
        s = _FOLD[np.frombuffer(t, np.uint8)].astype(np.uint64)
        code = np.zeros(max(0, len(s) - m + 1), np.uint64)
        for j in range(m):
            code = code << np.uint64(8) | s[j : j + len(code)]
        parts.append(code)
    return np.unique(np.concatenate(parts), return_counts=True)


def bounded_sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """The labelled texts that a model is fitted on, at most ``SAMPLE_ROWS`` and ``SAMPLE_BYTES`` a language.

    Texts are told apart by hash, so rows of one text or one id count once. Counts of
    distinct hashes bound the hash first, so that what is ranked has a bounded size
    whatever the number of documents.
    """
    h = F.xxhash64(F.col(text_col), F.lit(8))
    known = labelled.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), h.alias("_h"))
    counts = {r[0]: r[1] for r in known.groupBy("_lang").agg(F.approx_count_distinct("_h")).collect()}  # one row for each language of the model
    if not counts:
        return []
    # of a language's hashes, a share that holds some more than enough of them
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 3.0 * (SAMPLE_ROWS + 50) / max(1, n)))))
    some = known.where(F.pmod("_h", F.lit(10**9)) < F.try_element_at(share, F.col("_lang")) * 1e9)
    keys = some.groupBy("_lang", "_h").agg(F.max(F.octet_length("_text")).alias("_n"))
    w = Window.partitionBy("_lang").orderBy(F.col("_n") > LONG_BYTES, "_h")
    ranked = keys.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= SAMPLE_ROWS).withColumn("_sum", F.sum("_n").over(w))
    picked = ranked.where((F.col("_sum") <= SAMPLE_BYTES) | (F.col("_rn") == 1)).select("_lang", "_h")
    # at most SAMPLE_ROWS rows a language are broadcast and as many texts come back
    got = some.join(F.broadcast(picked), ["_lang", "_h"]).groupBy("_lang", "_h").agg(F.min("_text").alias("_text")).select("_text", "_lang").collect()
    return sorted((r[0], r[1]) for r in got)


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score`` (posterior with equal priors)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    types = dict(docs.dtypes)
    read = keep if text_col in keep else [*keep, text_col]
    at = read.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = b.column(at)
            flat, offsets = flat_bytes(text)
            letters = [bool(t) and _LETTER.search(t) is not None for t in text.to_pylist()]
            ok = np.array(letters, bool) & bool(m.langs)
            names, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if m.langs and b.num_rows:
                bits = m.code_lengths(flat, offsets)
                best = bits.argmin(1)
                gap = np.minimum(bits - bits.min(1, keepdims=True), 60)
                score = np.where(ok, 1.0 / np.exp2(-gap).sum(1), 0.0)
                names = [m.langs[i] if g else "und" for i, g in zip(best, ok)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string", "score double"])
    return map_arrow(docs.select(*read), run, schema)


def fold_of(col: Column | str, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col) % folds
