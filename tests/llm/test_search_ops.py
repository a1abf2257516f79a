"""Top-k search, WARC, sharding and the Jaccard join against plain versions."""

import base64
import gzip
import hashlib
import io
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import components as cc
from jobloom.llm import jaccard_join as jj
from jobloom.llm import queries as q
from jobloom.llm import sharding, topk_search, warc
from jobloom.llm.common import staging_path


def brute_topk(rows, is_query, k):
    use = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in use:
        if is_query(i):
            asked[i] = min(v, asked.get(i, v))
    out = []
    for i, v in asked.items():
        long = lambda x: max(-(2**63), min(2**63 - 1, x))
        scores = sorted((-long(sum(a * b for a, b in zip(v, w))), j) for j, w in use if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def test_topk_matches_brute_force(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, q.op1_topk_search(spark, sf).collect())) == brute_topk(rows, lambda i: i % 100 == 0, 10)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_topk_odd_rows(spark, block_rows):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1e-4]) for _ in range(3)]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 1.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0]), (104, []), (None, [1.0, 1.0, 1.0]), (0, [1.0, 1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (200, [1.0]), (300, [9e15, -9e15, 3e15]), (10, [2.0])]
    df = spark.createDataFrame([(*x, "y") for x in rows], "vec_id long, embedding array<double>, score string")
    got = topk_search.search(topk_search.scaled(df), F.col("id") % 10 == 0, 4, query_rows=3, block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, lambda i: i % 10 == 0, 4)
    assert topk_search.search(topk_search.scaled(df.limit(0)), F.col("id") % 10 == 0, 4).count() == 0


def test_topk_stops_before_the_lists_end():
    """Bounds drop candidates, reading stops early, and what is left is what full scores give."""
    rng = np.random.default_rng(0)
    c = np.concatenate([rng.integers(-3, 3, (500, 4)), rng.integers(900, 999, (12, 4))])
    qs = rng.integers(-9, 9, (6, 4))
    qs[0] = 0
    best = topk_search.Best(np.arange(1000, 1006), qs, 5)
    best.read([(np.arange(512), c)], 512)
    assert best.reads < 0.7 * 6 * c.size and best.resolved < 6 * 512 / 4
    for block in (64, 200):  # scores that earlier blocks have left are bounds for later ones
        parts = topk_search.Best(np.arange(1000, 1006), qs, 5)
        parts.read([(np.arange(512), c)], block)
        for i, own in enumerate(qs):
            s = c @ own
            want = np.lexsort((np.arange(512), -s))[:5]
            for b in (best, parts):
                assert b.found[i][0].tolist() == want.tolist() and b.found[i][1].tolist() == s[want].tolist()


def test_topk_stops_early_on_the_given_vectors(spark):
    rows = topk_search.scaled(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).orderBy("id").collect()
    ids, v = np.array([r.id for r in rows]), np.array([r.v for r in rows])
    best = topk_search.Best(ids[ids % 100 == 0], v[ids % 100 == 0], 10)
    best.read([(ids, v)], topk_search.BLOCK_ROWS)
    asked = len(best.ids)
    assert best.reads < asked * v.size and best.resolved <= asked * topk_search.CONTENDERS * 10


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def brute_warc(rows):
    first = {}
    for i, p in rows:
        if i is not None:
            first[p or ""] = min(i, first.get(p or "", i))
    return sorted(((i, len((p or "").encode()), b32((p or "").encode()), *(("response", None) if first.get(p or "") == i else ("revisit", first[p or ""]))) for i, p in rows), key=str)


def test_warc_round_trip(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, q.op3_warc(spark, sf).collect()), key=str) == brute_warc(rows)


def test_warc_odd_rows_and_ranges(spark):
    random.seed(3)
    big = base64.b85encode(random.randbytes(60_000)).decode()
    rows = [(1, "http://a/\r\nb c", None), (2, None, ""), (3, "u", "é" * 100), (4, "v", "é" * 100), (None, "w", "é" * 100), (4, "v", "é" * 100), (7, "x", big), (8, "y", big + "z"), (9, "z", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, id string").repartition(2)
    path = staging_path(spark, "warc")
    warc.write(pages, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = warc.read(spark, path).collect()
        assert warc.scan(spark, path).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert Counter((r.payload_digest, r.payload_bytes, r.record_type) for r in got) == Counter({(b32(b""), 0, "response"): 1, (b32(b""), 0, "revisit"): 1, (b32(("é" * 100).encode()), 200, "response"): 1, (b32(("é" * 100).encode()), 200, "revisit"): 3, (b32(big.encode()), len(big), "response"): 1, (b32((big + "z").encode()), len(big) + 1, "response"): 1, (b32(b"\r\n\r\n"), 4, "response"): 1})
    assert {r.payload.decode() for r in got if r.id == "7"} == {big}
    assert all(r.verified for r in got if r.record_type == "response")
    assert {(r.id, r.refers_to) for r in got if r.record_type == "revisit"} == {("2", "1"), ("4", "3"), (None, "3")}
    empty = staging_path(spark, "warc")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_min_bytes(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")], "page_id long, url string, html string")
    path = staging_path(spark, "warc")
    warc.write(pages, path, min_bytes=3)
    assert {(r.id, r.record_type) for r in warc.read(spark, path).collect()} == {("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")}


def test_warc_survives_false_magic(spark, tmp_path):
    """The magic inside members, at every range cut, and a damaged member."""
    random.seed(5)
    out, want = io.BytesIO(), []
    for i in range(40):
        payload = b"".join(warc.MAGIC + random.randbytes(random.randint(0, 60)) for _ in range(12)) + b"%d" % i
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}:0>\r\nWARC-Payload-Digest: sha1:{b32(payload)}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the magics stay as they are
        out.write(packer.compress(head + block + b"\r\n\r\n") + packer.flush())
        want.append((str(i), b32(payload)))
    out.write(gzip.compress(b"WARC/1.1\r\nbroken")[:-6])
    (tmp_path / "a.warc").write_bytes(out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("300", "701", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = warc.read(spark, str(tmp_path)).collect()
            assert sorted((r.id, r.payload_digest) for r in got if r.record_type == "response") == sorted(want)
            assert [r.record_type for r in got if r.record_type != "response"] == ["damaged"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


@pytest.mark.parametrize("name", ["x.warc", "x.warc.gz"])
def test_warc_reads_foreign_archives(spark, tmp_path, name):
    """Members that another writer made, in one file that is cut into ranges unless its name forbids it."""
    import gzip

    payloads = [f"<p>page {i}</p>".encode() * (1 + 40 * (i % 7)) for i in range(20)]
    data = b""
    for i, p in enumerate(payloads):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + p
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://e.org/{i}\r\nContent-Length: {len(http)}\r\n\r\n"
        data += gzip.compress(head.encode() + http + b"\r\n\r\n")
    (tmp_path / name).write_bytes(data)
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = warc.read(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    assert sorted((r.url, bytes(r.payload)) for r in got) == sorted((f"http://e.org/{i}", p) for i, p in enumerate(payloads))


def check_shards(docs, got, shards):
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((d, size(t), crc(t)) for d, t in docs) == Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    slots = defaultdict(list)
    where = {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert where.setdefault(r.doc_id, r.shard) == r.shard
        assert 0 <= r.shard < shards and r.grown_shard in (r.shard, shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_whole(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(docs, q.op4_sharding(spark, sf).collect(), 40)


def test_sharding_odd_rows(spark):
    rows = [(i, "x" * i) for i in range(60)] + [(7, "same"), (7, "same"), (None, None), (None, "t"), (None, "t"), (1000, "é" * 5000)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, slot int, size string")
    paths = [staging_path(spark, "shards") for _ in range(3)]
    for p, d in zip(paths, (docs, docs.repartition(3), docs.limit(0))):
        sharding.write_shards(d, p, 3, bucket_bytes=1000)
    got = sharding.read_shards(spark, paths[0]).drop("slot_").collect()
    check_shards(rows, got, 3)
    again = sharding.read_shards(spark, paths[1]).collect()
    assert Counter((r.doc_id, r.shard, r.slot, r.text_crc32) for r in got) == Counter((r.doc_id, r.shard, r.slot, r.text_crc32) for r in again)
    assert sharding.read_shards(spark, paths[2]).count() == 0
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert order != sorted(order)


def plain_shard(doc_id, shards, seed=sharding.SEED):
    """The shard whose hash of (id, shard, seed) is highest, by xxhash itself; a null id leaves the hash as it is."""
    import struct

    import xxhash

    def step(fmt, v, h):
        return h if v is None else xxhash.xxh64(struct.pack(fmt, v), seed=h).intdigest()

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    scores = [signed(step("<i", seed, step("<i", j, step("<q", doc_id, 42)))) for j in range(shards)]
    return scores.index(max(scores))


def test_sharding_law_matches_a_plain_version(spark):
    ids = [None, 0, 1, -5, 2**62, *range(100, 400)]
    docs = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    path = staging_path(spark, "shards")
    sharding.write_shards(docs, path, 7)
    for r in sharding.read_shards(spark, path).collect():
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, 7), plain_shard(r.doc_id, 8))


def test_sharding_hot_record_fills_no_bucket(spark):
    rows = [(1, "hot text")] * 3000 + [(None, None)] * 1500 + [(i, "x" * 30) for i in range(10, 600)]
    path = staging_path(spark, "shards")
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, 3, bucket_bytes=4000)
    got = sharding.read_shards(spark, path).collect()
    check_shards(rows, got, 3)
    sizes = Counter()
    for r in got:
        sizes[r.bucket] += r.size
    assert len(sizes) > 10 and max(sizes.values()) < 8 * 4000


def test_sharding_shuffles_evenly(spark):
    """Places after the shuffle say nothing about ids: ranks of ids by slot correlate no more than by chance."""
    path = staging_path(spark, "shards")
    sharding.write_shards(spark.range(6000).selectExpr("id AS doc_id", "cast(id AS string) AS text"), path, 2, bucket_bytes=20_000)
    got = sharding.read_shards(spark, path).collect()
    for s in (0, 1):
        ids = np.array([r.doc_id for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)])
        assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 4 / len(ids) ** 0.5
        assert abs(np.corrcoef(ids[:-1], ids[1:])[0, 1]) < 4 / len(ids) ** 0.5


def brute_join(docs, num, den, k):
    sets = []
    for _, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * min(len(a), len(b)) >= num * max(len(a), len(b)) and den * (n := len(a & b)) >= num * (len(a) + len(b) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def test_jaccard_matches_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_join(docs, 90, 100, 3)
    assert sorted(map(tuple, q.op9_jaccard_join(spark, sf).collect()), key=str) == want
    assert any(c != d for d, _, c in want)


@pytest.mark.parametrize(("num", "den", "k", "seed"), [(90, 100, 3, 0), (80, 100, 5, 1), (80, 100, 1, 2), (3, 5, 2, 3)])
def test_jaccard_near_copies(spark, num, den, k, seed):
    """Chains and stars of edited copies, light and heavy, with hot passages."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (5, "one"), (None, "one two"), (7, "one  two"), (None, None)]
    for g in range(14):
        size = r.choice([3, 9, 12, 15, 19, 22, 40, 90, 150])
        own = [f"w{r.randint(0, 60) if g % 3 else r.randint(0, 5000)}" for _ in range(size)] + passage * (g % 2)
        for _ in range(14):
            rows.append((r.randint(100, 10**6), " ".join(own)))
            if r.random() < 0.8:
                for _ in range(r.randint(1, 2)):
                    own = own[:]
                    own[r.randrange(len(own))] = f"e{r.randint(0, 10**6)}"
            if r.random() < 0.3:
                own = own + [f"t{r.randint(0, 99)}"]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, n int")
    got = jj.join(docs, num, den, k)
    assert sorted(map(tuple, got.collect()), key=str) == brute_join(rows, num, den, k)


def test_jaccard_empty(spark):
    assert jj.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boundary_follows_cost():
    sizes = np.zeros(64, np.int64)
    sizes[10:40] = 5
    low, high = (jj.choose_boundary(sizes, 0, load, 90, 100) for load in (0.0, 1e6))
    assert low <= high and high > 20


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 5)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_staging_is_shared_folder(spark):
    assert Path(staging_path(spark, "x").removeprefix("file://")).parts[:2] == (os.sep, "tmp")
