"""Decontamination, packing and language identification against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from jobloom.llm import decontaminate as dc
from jobloom.llm import language_id as li
from jobloom.llm import packing
from jobloom.llm import queries as q

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, n_words long, score double, piece string"
ODD = [(1, None, "en", 1, 1.0, "x"), (2, "", None, 2, 2.0, "y"), (3, "...!", "en", 3, None, None), (4, "one two", "en", 4, 4.0, "z"), (4, "one two", "en", 4, 4.0, "z"), (None, "Éa éa 12 é", None, None, None, None), (6, "word " * 50_000, "en", 1, 1.0, "x")]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_windows(docs, items, window=10):
    where = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            where[tuple(w[k : k + n])].add(str(i))
    sizes = {len(w) for w in where}
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := where.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    got |= own
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontaminate_matches_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = q.op5_decontaminate(spark, sf)
    want = brute_windows(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[2] for r in want)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontaminate_odd_rows(spark, block_bytes):
    items = [(1, "a b c"), (2, "A, b"), (3, None), (4, ""), (5, "q " * 12 + "end of it"), (5, "a b"), (6, "b c d e f g h i j k l m")]
    texts = [(1, "a b c d e f g h i j k l m n"), (2, "x a b y"), (3, None), (4, ""), (5, "q " * 30 + "end"), (5, "a b"), (6, "q " * 10 + "end of it")]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, n_hit string")
    out = dc.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = [(r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.n_hit > 0) for r in out.collect()]
    assert sorted(got, key=str) == brute_windows(texts, items)
    assert dc.decontaminate(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = dc.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == 7 and not any(r.n_hit for r in none)


def test_pack_is_whole_and_tight(spark, sf):
    own = Tokenizer.from_file(q.tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q.op7_pack(spark, sf).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    import numpy as np

    for d, rows in by_doc.items():
        ids = np.array([*own.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        rows.sort(key=lambda r: r.piece)
        for k, r in enumerate(rows):
            part = ids[2048 * k : 2048 * (k + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 2048 * k, len(part), zlib.crc32(part.tobytes()))
        assert sum(r.length for r in rows) == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= 1 + -(-sum(r.length for r in got) // 2048)


def test_pack_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = packing.pack(docs, q.tokenizer_path(), keep=["doc_id", "lang", "piece"], with_ids=True).collect()
    own = Tokenizer.from_file(q.tokenizer_path())
    want = Counter((r[0], len(own.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in ODD)
    have = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length
        have[r.doc_id].append(r.length)
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in want.items())
    assert sorted(have[4]) == [3, 3] and have[1] == [1] and have[2] == [1]
    assert packing.pack(docs.limit(0), q.tokenizer_path(), keep=["doc_id"]).count() == 0


def test_word_encoder_forgets():
    encoder = packing.WordEncoder(q.tokenizer_path(), cache_words=3)
    whole = packing.WordEncoder(q.tokenizer_path())
    for text in ("a b c", "c d e f g a", "it's a-b <|endoftext|> x y É", "a b c d e f g"):
        assert encoder.encode(text.encode()).tolist() == whole.tokenizer.encode(text, add_special_tokens=False).ids == whole.encode(text.encode()).tolist()


def test_plan_uses_all_once():
    import random

    for seed in range(30):
        r = random.Random(seed)
        left = {r.randint(1, 64): r.randint(1, 9) for _ in range(r.randint(0, 20))}
        used = defaultdict(int)
        for use, times in packing.plan(left, 64):
            assert sum(use) <= 64 and times > 0
            for x in use:
                used[x] += times
        assert used == left


def test_language_id_held_out(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q.op8_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out and truth[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.95 * len(out)


class PlainPpm:
    """Escape method C over byte contexts, byte by byte, from counts in dictionaries."""

    def __init__(self, texts, order):
        self.order, self.seen = order, {}
        for t in texts:
            for i, b in enumerate(t):
                for k in range(min(order, i) + 1):
                    own = self.seen.setdefault(t[i - k : i], {})
                    own[b] = own.get(b, 0) + 1

    def probability(self, context, b):
        p = 1.0
        for k in range(min(self.order, len(context)), -1, -1):
            own = self.seen.get(context[len(context) - k :])
            if own is None:
                continue
            total = sum(own.values()) + len(own)
            if b in own:
                return p * own[b] / total
            p *= len(own) / total
        return p / 256

    def bits(self, text):
        return sum(-math.log2(self.probability(text[max(0, i - self.order) : i], b)) for i, b in enumerate(text))


@pytest.mark.parametrize("order", [1, 3, li.ORDER])
def test_language_id_code_lengths_are_exact(order):
    r = random.Random(order)
    texts = {lang: ["".join(r.choice(abc) for _ in range(r.randint(1, 120))) for _ in range(6)] for lang, abc in {"x": "ab c", "y": "cd eé", "z": "日本 語abAB"}.items()}
    model = li.fit([(t, lang) for lang, own in texts.items() for t in own], order)
    asked = [*texts["x"], *texts["z"][:2], "", "a", "zz é ab", "日本語\x00", "AbBa"] + ["".join(r.choice("abcdeé 日語q") for _ in range(60)) for _ in range(10)]
    flat = np.frombuffer(b"".join(t.encode() for t in asked), np.uint8)
    got = model.code_lengths(flat, np.cumsum([0, *(len(t.encode()) for t in asked)]))
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    for i, lang in enumerate(model.langs):
        plain = PlainPpm([t.encode().translate(fold) for t in texts[lang]], order)
        assert got[:, i] == pytest.approx([plain.bits(t.encode().translate(fold)) for t in asked])
        # without exclusion the probabilities of all bytes come to no more than 1
        assert sum(plain.probability(b"ab", b) for b in range(256)) <= 1 + 1e-9


def test_language_id_long_text_and_many_languages():
    texts = [(f"{chr(97 + i)}{chr(98 + i)} " * 40, f"l{i:02}") for i in range(20)]
    model = li.fit(texts)
    assert model.order == li.ORDER and len(model.langs) == 20
    long = ("ab " * 300_000).encode()
    one = model.code_lengths(np.frombuffer(long, np.uint8), np.array([0, len(long)]))
    cut = model.code_lengths(np.frombuffer(long * 2, np.uint8), np.array([0, len(long), 2 * len(long)]))
    assert one[0] == pytest.approx(cut[0]) and one[0] == pytest.approx(cut[1]) and one[0].argmin() == 0


def test_language_id_sample_is_bounded(spark):
    rows = [(1, f"text number {i} of one id", "en") for i in range(900)] + [(None, "texte sans nom", "fr")] * 700 + [(i, "x" * (li.LONG_BYTES + i), "de") for i in range(80)]
    sample = li.bounded_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: [t for t, own in sample if own == lang] for lang in ("en", "fr", "de")}
    assert len(counts["en"]) == li.SAMPLE_ROWS and counts["fr"] == ["texte sans nom"] and 1 < sum(map(len, counts["de"])) <= li.SAMPLE_BYTES


def test_language_id_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    model = li.fit(li.bounded_sample(docs))
    got = {(r.doc_id, r.lang_pred) for r in li.identify(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (6, "en")} <= got
    assert {r.lang_pred for r in li.identify(docs, li.fit([])).collect()} == {"und"}
    assert li.identify(docs.limit(0), model).count() == 0
