"""Toxicity by the nearest labelled examples, found exactly with a block-max index.

Terms are all words of the labelled examples, and the first ``STEM`` bytes of longer
words; their document frequencies are counted over all documents. Texts are TF-IDF
vectors over those terms, in which terms held by chi-squared to go with the label
weigh more. The nearest examples by cosine are found exactly: rare terms are read
from inverted lists, frequent ones are known by their largest weight in every block
of examples; the blocks of the highest bounds are read first, and a block whose upper
bound is below the k-th best score so far is skipped. Neighbours vote with a weight that falls with their distance,
shrunk to the rate among examples that hold no term of more weight. The score is
the vote, calibrated by logistic regression on the votes that examples get from the
others.

The examples are a bounded sample: at most ``SAMPLE_ROWS`` labelled rows, those with
the smallest hash of their id. Each one that holds a word is in the index. One task
reads them and makes the index; the driver passes terms, their counts and the packed
index on, and holds neither examples nor their words.

Defined results: the evidence of a score is its neighbours if one of them is toxic,
and empty otherwise; null and empty texts, and texts without a word of the examples,
get that rate and have no evidence; null labels are not
used; an id labelled more than once counts as toxic if any label says so; equal
cosines go to the smaller id; without labelled rows every score is 0; repeated rows
are scored each for itself.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import map_arrow, release, stage, text_bytes, trim, words_of

SAMPLE_ROWS = 12_000
#: A term in so many examples and of so high a chi-squared (1 degree of freedom) weighs its chi-squared, others 1.
TERM_ROWS = 8
TERM_CHI = 30.0
#: Terms in more than this share of the examples are frequent.
FREQUENT = 0.05
#: Texts counted at once, texts scored at once, and more than the rounding of their first scores.
COUNTED = 512
TEXTS = 256
#: Bytes of a packed index that travel as one row.
PIECE = 4 << 20
SLACK = 1e-4
#: Blocks of the highest bounds that are read first.
BEGIN = 4
#: Examples whose votes calibrate the score.
CALIBRATION_ROWS = 2_000
#: Bytes of a stem; as a term it carries a mark that no word has.
STEM = 5
_MARK = b"*"
BLOCK = 64
NEIGHBOURS = 16
#: A vote's weight is 1 / (EDGE + distance); the prior has PRIOR_VOTES votes at distance 1.
EDGE = 0.05
PRIOR_VOTES = 1.0
THRESHOLD = 0.3


def features(words: set[bytes]) -> set[bytes]:
    return words | {w[:STEM] + _MARK for w in words if len(w) > STEM}


def bytes_of(col: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls; ``to_pylist`` takes many times as long."""
    return col.to_numpy(zero_copy_only=False).tolist()


class Terms:
    """Finds the terms in lists of words."""

    def __init__(self, terms: list[bytes] | pa.Array) -> None:
        terms = bytes_of(terms) if isinstance(terms, pa.Array) else terms
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith(_MARK)}
        self.stems = {t[:STEM]: i for i, t in enumerate(terms) if t.endswith(_MARK)}
        self.size = len(terms)

    def counts(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences), sorted by text and term.

        A term is looked up once for each distinct word of all these texts.
        """
        found = pa.array(list(chain.from_iterable(texts)), pa.binary()).dictionary_encode()
        words = bytes_of(found.dictionary)
        kind = np.int32 if len(texts) * self.size < 1 << 31 else np.int64  # narrow pairs sort faster
        word = np.fromiter(map(self.words.get, words, repeat(-1)), kind, len(words))
        stems = pc.binary_slice(found.dictionary, 0, STEM).dictionary_encode()
        stem = np.fromiter(map(self.stems.get, bytes_of(stems.dictionary), repeat(-1)), kind, len(stems.dictionary))[stems.indices.to_numpy()]
        stem[pc.binary_length(found.dictionary).to_numpy() <= STEM] = -1
        text = np.repeat(np.arange(len(texts), dtype=kind) * kind(self.size), [len(t) for t in texts])
        at = found.indices.to_numpy()
        pairs = np.concatenate([(text + t[at])[t[at] >= 0] for t in (word, stem)]) if len(words) else np.zeros(0, np.int64)
        pairs, n = np.unique(pairs, return_counts=True)
        return *np.divmod(pairs.astype(np.int64), max(1, self.size)), n


class Lists:
    """The inverted lists: (examples, weights) of each term, side by side in one array."""

    def __init__(self, first: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> None:
        self.first = first
        self.pairs = np.empty(len(rows), [("row", np.int32), ("weight", np.float32)])
        self.pairs["row"], self.pairs["weight"] = rows, weights

    @property
    def weights(self) -> np.ndarray:
        return self.pairs["weight"]

    def __getitem__(self, t: int) -> tuple[np.ndarray, np.ndarray, int]:
        part = self.pairs[self.first[t] : self.first[t + 1]]
        return part["row"], part["weight"], len(part)

    def sums(self, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """The part of the scores of ``n`` examples that these terms give."""
        first, size = self.first[at], self.first[at + 1] - self.first[at]
        own = np.repeat(first - np.cumsum(size) + size, size)
        own += np.arange(len(own))
        # both halves of a pair are read at once
        pairs = self.pairs.view(np.int64)[own].view(self.pairs.dtype)
        return np.bincount(pairs["row"], np.repeat(x, size) * pairs["weight"], minlength=n)


@dataclass
class Examples:
    """A block-max index over the labelled examples that hold a word.

    Examples are arranged so that a block holds like ones: blocks of other languages
    and topics then have low bounds.
    """

    terms: Terms
    idf: np.ndarray  # times the weight of the term
    ids: np.ndarray  # of the examples
    toxic: np.ndarray
    rate: float  # toxic among examples without a term that weighs more than 1
    lists: Lists
    has_labels: bool
    #: A vote's log odds, times the slope and plus the bias, are the score's.
    slope: float = 1.0
    bias: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}

    @property
    def dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each frequent term (others: -1), their weights by example and their largest weights by block."""
        if "_dense" not in self.__dict__:
            n, size = len(self.ids), np.diff(self.lists.first)
            often = np.flatnonzero(size > FREQUENT * n)
            place = np.full(len(size), -1)
            place[often] = np.arange(len(often))
            table = np.zeros((-(-n // BLOCK) * BLOCK, len(often)), np.float32)
            for i, t in enumerate(often):
                rows, weights, _ = self.lists[t]
                table[rows, i] = weights
            self._dense = place, table, table.reshape(len(table) // BLOCK, BLOCK, table.shape[1]).max(1)
        return self._dense

    def vectors(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The unit vectors of some texts: bounds of each in (terms, weights)."""
        text, at, n = self.terms.counts(texts)
        x = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt(np.bincount(text, x * x, minlength=len(texts)))
        return np.searchsorted(text, np.arange(len(texts) + 1)), at, x / norm[text]

    def nearest(self, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], k: int = NEIGHBOURS, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of highest cosine over 0, best first, and their cosines.

        ``without`` names one example for each vector that is no neighbour of it.
        """
        first, at, weights = vectors
        place, table, peak = self.dense
        m, n, blocks = len(first) - 1, len(table), len(peak)
        rare, x = np.zeros((m, n)), np.zeros((m, table.shape[1]))
        for i in range(m):
            own, w = at[first[i] : first[i + 1]], weights[first[i] : first[i + 1]]
            to = place[own]
            often = to >= 0
            x[i, to[often]] = w[often]
            rare[i] = self.lists.sums(own[~often], w[~often], n)
        x32 = x.astype(np.float32)
        bound = rare.reshape(m, blocks, BLOCK).max(2) + x32 @ peak.T
        scores = np.full(rare.shape, -1.0)

        def read(need: np.ndarray) -> None:
            for b in np.flatnonzero(need.any(0)):
                part, own = slice(b * BLOCK, (b + 1) * BLOCK), np.flatnonzero(need[:, b])
                scores[own, part] = rare[own, part] + x32[own] @ table[part].T
            if without is not None:
                scores[np.arange(m), without] = -1.0

        # the blocks of the highest bounds give a lower bound of the k-th best score
        begun = np.argsort(-bound, 1)[:, :BEGIN]
        need = np.zeros((m, blocks), bool)
        np.put_along_axis(need, begun, True, 1)
        read(need)
        known = np.take_along_axis(scores.reshape(m, blocks, BLOCK), begun[:, :, None], 1).reshape(m, -1)
        least = np.maximum(0, np.partition(known, -k, 1)[:, -k]) if known.shape[1] >= k else np.zeros(m)
        read(~need & (bound >= least[:, None] - SLACK))
        out = []
        for i in range(m):
            own = np.flatnonzero(scores[i] >= max(least[i] - SLACK, 1e-30))
            if len(own) > k:
                got = scores[i, own]
                own = own[got >= np.partition(got, len(got) - k)[len(got) - k] - SLACK]
            used = np.flatnonzero(x[i])
            exact = rare[i, own] + table[own[:, None], used] @ x[i, used]
            top = np.lexsort((self.ids[own], -np.round(exact, 12)))[:k]
            out.append((own[top], exact[top]))
        return out

    def votes(self, texts: list[list[bytes]], without: list[int] | None = None) -> list[tuple[float | None, list[int]]]:
        """The vote of each text's neighbours, and these, best first; None for a text without a term."""
        out: list[tuple[float | None, list[int]]] = [(None, [])] * len(texts)
        prior = PRIOR_VOTES / (EDGE + 1)
        first, at, x = self.vectors(texts)
        full = np.flatnonzero(np.diff(first)) if len(self.ids) else []
        bounds = np.append(first[full], first[-1]) if len(full) else []  # texts without a term take no entries
        for lo in range(0, len(full), TEXTS):
            part = full[lo : lo + TEXTS]
            for i, (own, score) in zip(part, self.nearest((bounds[lo : lo + TEXTS + 1], at, x), without=None if without is None else np.array(without)[part])):
                vote = 1 / (EDGE + np.maximum(0, 1 - score))
                out[i] = float((vote @ self.toxic[own] + prior * self.rate) / (vote.sum() + prior)), own.tolist()
        return out

    def judge_all(self, texts: list[list[bytes]]) -> list[tuple[float, list[int]]]:
        """The score of each text and its neighbours, best first."""
        if not self.has_labels:
            return [(0.0, [])] * len(texts)
        return [(self.rate if v is None else self.calibrated(v), own) for v, own in self.votes(texts)]

    def judge(self, words: list[bytes]) -> tuple[float, list[int]]:
        return self.judge_all([words])[0]

    def calibrated(self, vote: float) -> float:
        return 1 / (1 + math.exp(-self.slope * _log_odds(vote) - self.bias))


class Packed:
    """An index in the pieces that a task made of it.

    Workers read it as ``Examples``; on the driver it is unpacked only if an attribute is asked for.
    """

    def __init__(self, pieces: pa.ChunkedArray) -> None:
        self._pieces = pieces

    def __reduce__(self) -> tuple:
        return unpacked, (self._pieces,)

    def __getattr__(self, name: str) -> object:
        if name.startswith("_"):
            raise AttributeError(name)
        if "_index" not in self.__dict__:
            self._index = unpacked(self._pieces)
        return getattr(self._index, name)


def unpacked(pieces: pa.ChunkedArray) -> Examples:
    return pickle.loads(b"".join(p.as_buffer() for p in pieces))


def packed(index: Examples) -> Iterator[pa.RecordBatch]:
    data = memoryview(pickle.dumps(index, pickle.HIGHEST_PROTOCOL))
    for lo in range(0, len(data), PIECE):
        yield pa.RecordBatch.from_arrays([pa.array([data[lo : lo + PIECE]], pa.binary())], ["piece"])


class Sent:
    """Pickles as ``make(*args)``, which then runs where it is read."""

    def __init__(self, make: Callable, *args: object) -> None:
        self.call = make, args

    def __reduce__(self) -> tuple:
        return self.call


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def calibrate(index: Examples, texts: list[bytes], rows: list[int]) -> None:
    """Fit slope and bias (Platt) to the votes of the other examples on each of these ``rows`` of the index."""
    z, y = [], []
    for lo in range(0, len(rows), TEXTS):
        part = rows[lo : lo + TEXTS]
        for (v, _), row in zip(index.votes([words_of(t) for t in texts[lo : lo + TEXTS]], without=part), part):
            if v is not None:
                z.append(_log_odds(v))
                y.append(index.toxic[row])
    del index._dense
    z, y = np.array(z), np.array(y)
    pos = y.sum()
    if not 0 < pos < len(y):
        return
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a = np.stack([z, np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton's method with a weak prior on the identity
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - goal) + 1e-3 * (w - [1, 0])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), slope)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    if w[0] > 0:
        index.slope, index.bias = float(w[0]), float(w[1])


def _arranged(table: np.ndarray) -> np.ndarray:
    """An order of the examples in which like ones are neighbours: spherical k-means on the frequent terms."""
    n = len(table)
    k = max(1, n // (8 * BLOCK))
    centre = table[:: max(1, n // k)][:k]
    for _ in range(5):
        own = (table @ centre.T).argmax(1)
        centre = np.stack([table[own == c].sum(0) if (own == c).any() else centre[c] for c in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return np.argsort(own, kind="stable")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` examples (id, text, label) from the labelled documents, by hash of the id."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    marks = marks.join(docs.where(F.col(text_col).isNotNull()).select(id_col).distinct(), id_col, "left_semi")
    picked = marks.orderBy(F.xxhash64(F.col(id_col), F.lit(10)), id_col).limit(rows)
    # at most ``rows`` rows of two columns
    got = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).join(F.broadcast(picked), id_col).groupBy(id_col, text_col).agg(F.max("_label").alias("_label"))
    return got.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("_label").alias("label"))


def over_examples(sample: DataFrame, make: Callable[[list[tuple[int, bytes, int]]], Iterator[pa.RecordBatch]], schema: str) -> pa.Table:
    """What one task makes of all examples, which are a bounded sample, in order of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[int, bytes, int]] = []
        for b in batches:
            examples += zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist())
        yield from make(sorted(examples))

    return map_arrow(sample.coalesce(1), run, schema).toArrow()


def weigh_terms(examples: list[tuple[int, bytes, int]]) -> tuple[list[bytes], np.ndarray]:
    """All terms of the examples and their weights."""
    n, toxic = len(examples), sum(y for _, _, y in examples)
    place: dict[bytes, int] = {}
    found = [np.fromiter((place.setdefault(t, len(place)) for t in features(set(words_of(text)))), np.int32) for _, text, _ in examples]
    terms = sorted(place)
    order = np.fromiter(map(place.__getitem__, terms), np.int64, len(terms))
    del place
    none = [np.zeros(0, np.int32)]
    df, pos = (np.bincount(np.concatenate(none + own), minlength=len(terms))[order].astype(float) for own in (found, [f for f, e in zip(found, examples) if e[2]]))
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (pos * n - df * toxic) ** 2 / (df * (n - df) * toxic * (n - toxic))
    told = (df >= TERM_ROWS) & (pos * n > df * toxic) & (df < n) & (toxic < n) & (chi >= TERM_CHI)
    return terms, np.where(told, chi, 1.0)


def document_counts(docs: DataFrame, terms: pa.Array, text_col: str = "text") -> tuple[int, np.ndarray]:
    """(documents, documents that hold each term), over all documents."""
    shared, size = docs.sparkSession.sparkContext.broadcast(Sent(Terms, terms)), len(terms)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, 0
        sums = np.zeros(size, np.int64)
        for b in batches:
            texts = text_bytes(b.column(0))
            total += len(texts)
            for lo in range(0, len(texts), COUNTED):
                found = own.counts([words_of(t or b"") for t in texts[lo : lo + COUNTED]])[1]
                np.add.at(sums, found, 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([total, *sums[at].tolist()], pa.int64())], ["term", "n"])

    out = np.zeros(size + 1, np.int64)  # the last one is the number of documents
    got = map_arrow(docs.select(text_col), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    shared.destroy()
    return int(out[-1]), out[:-1]


def build(examples: list[tuple[int, bytes, int]], terms: list[bytes], total: int, df: np.ndarray, weights: np.ndarray | float = 1.0, calibration: int = CALIBRATION_ROWS) -> Examples:
    """The index; weights of examples are kept as single floats, and scores are exact for these."""
    idf = (np.log((1 + total) / (1 + df.astype(float))) + 1) * weights
    none = Lists(np.zeros(len(terms) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    index = Examples(Terms(terms), idf, np.zeros(0, np.int64), np.zeros(0), 0.0, none, bool(examples))
    telling = np.broadcast_to(np.asarray(weights) > 1, len(terms))
    sizes, at, xs, bare = [], [], [], np.ones(len(examples), bool)
    for lo in range(0, len(examples), COUNTED):
        first, own, x = index.vectors([words_of(t) for _, t, _ in examples[lo : lo + COUNTED]])
        sizes.append(np.diff(first))
        at.append(own.astype(np.int32))
        xs.append(x.astype(np.float32))
        bare[lo + np.repeat(np.arange(len(first) - 1), np.diff(first))[telling[own]]] = False
    toxic = np.array([float(y) for _, _, y in examples])
    share = toxic.sum() / max(1, len(examples))
    index.rate = float((toxic[bare].sum() + share) / (bare.sum() + 1))
    if not examples:
        return index
    sizes, flat, x = np.concatenate(sizes), np.concatenate(at), np.concatenate(xs)
    del at, xs
    kept = np.flatnonzero(sizes)

    if len(kept):
        n, sizes = len(kept), sizes[kept]
        size = np.bincount(flat, minlength=len(terms))
        place = np.full(len(terms), -1, np.int32)
        often = np.flatnonzero(size > FREQUENT * n)
        place[often] = np.arange(len(often))
        rows = np.repeat(np.arange(n, dtype=np.int32), sizes)
        own = np.flatnonzero(place[flat] >= 0)
        table = np.zeros((n, len(often)), np.float32)
        table[rows[own], place[flat[own]]] = x[own]
        order = _arranged(table)
        del table, own
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n)
        rows = rank[rows]
        by = np.lexsort((rows, flat))
        del flat
        index.lists = Lists(np.concatenate([[0], np.cumsum(size)]), rows[by], x[by])
        kept = kept[order]
        del x, rows, by
    trim()
    index.ids = np.array([examples[i][0] for i in kept], np.int64)
    index.toxic = toxic[kept]
    if len(kept) > 1 and calibration:
        rows = np.arange(0, len(kept), max(1, -(-len(kept) // calibration)))
        calibrate(index, [examples[i][1] for i in kept[rows]], rows.tolist())
        trim()
    return index


def fit(docs: DataFrame, train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Examples | Packed:
    """Index the labelled rows of ``train``; counts are over all of ``docs``."""
    spark = docs.sparkSession
    sample = stage(labelled_sample(train, labels, id_col, text_col, label_col), "toxicity-examples")

    def weighed(examples: list[tuple[int, bytes, int]]) -> Iterator[pa.RecordBatch]:
        terms, weights = weigh_terms(examples)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(weights, pa.float64())], ["term", "weight"])

    got = over_examples(sample, weighed, "term binary, weight double")
    terms, weights = got.column(0).combine_chunks(), got.column(1).to_numpy()
    total, df = document_counts(docs, terms, text_col)
    shared = spark.sparkContext.broadcast((terms, total, df, weights))  # bounded by the sample

    def built(examples: list[tuple[int, bytes, int]]) -> Iterator[pa.RecordBatch]:
        terms, *counted = shared.value
        yield from packed(build(examples, bytes_of(terms), *counted))

    pieces = over_examples(sample, built, "piece binary").column(0)
    shared.destroy()
    release(spark, sample)
    # without examples no task may have run
    return Packed(pieces) if len(pieces) else build([], [], total, df)


def score(docs: DataFrame, index: Examples | Packed, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score``, ``predicted`` and ``evidence`` (ids of the neighbours)."""
    made = ["score", "predicted", "evidence"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample and the number of terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            got = []
            texts = text_bytes(b.column(len(keep)))
            for lo in range(0, len(texts), COUNTED):
                got += own.judge_all([words_of(t or b"") for t in texts[lo : lo + COUNTED]])
            s = [g[0] for g in got]
            proof = [[int(own.ids[i]) for i in g[1]] if any(own.toxic[i] for i in g[1]) else [] for g in got]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32()), pa.array(proof, pa.list_(pa.int64()))], [*keep, *made])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double, predicted int, evidence array<long>"])
    return map_arrow(docs.select(*keep, F.col(text_col).alias("_text")), run, schema)
