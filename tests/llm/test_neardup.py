import random

import numpy as np
import pytest
import xxhash

from kmerloom.llm import hamming, neardup
from kmerloom.llm.components import components
from tests.llm.data import empty, odd


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    for c in b"\t\n\r\x0b\x0c":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, radius=3):
    root = {i: i for i in points}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(points)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any((a ^ b).bit_count() <= radius for a in points[i] for b in points[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in points}


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_equals_brute_force(spark, name):
    docs = odd(spark) if name == "odd" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    points = {}
    for r in rows:
        if r.doc_id is not None:
            points.setdefault(r.doc_id, set()).add(brute_fp(r.text))
    want = brute_components(points)
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got if r.doc_id is not None) == sorted((r.doc_id, brute_fp(r.text), want[r.doc_id]) for r in rows if r.doc_id is not None)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(want.values())


def test_empty(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.one_of_each(empty(spark)).count() == 0


def clustered(n_groups=12, size=40):
    rng = random.Random(9)
    out = set()
    for _ in range(n_groups):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.add(x)
            if rng.random() < 0.7:
                x ^= 1 << rng.randrange(64)
            else:
                x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("tile", [4096, 16])
@pytest.mark.parametrize("n", [None, 1 << 27, 1 << 35])
def test_links_and_counts_in_tiles(spark, monkeypatch, tile, n):
    """Light buckets, heavy buckets cut into tiles, and one, two or three agreeing blocks: all equal brute force."""
    monkeypatch.setattr(hamming, "TILE", tile)
    fps = clustered()
    points = spark.createDataFrame([(f - 2**64 if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, id long")
    n = n or len(fps)
    edges = hamming.in_buckets(points, 3, n, hamming.forest(3), "u long,v long")
    links = edges.collect()
    assert all((fps[r.u] ^ fps[r.v]).bit_count() <= 3 for r in links)
    root = {r.id: r.root for r in components(edges).collect()}
    want = brute_components({i: {f} for i, f in enumerate(fps)})
    assert {i: root.get(i, i) for i in want} == want
    got = {r.id: r.m for r in hamming.in_buckets(points, 3, n, hamming.counts(3, n), "id long,m long").groupBy("id").sum("m").withColumnRenamed("sum(m)", "m").collect()}
    a = np.array(fps, np.uint64)
    near = (np.bitwise_count(a[:, None] ^ a[None, :]) <= 3).sum(1) - 1
    assert {i: got.get(i, 0) for i in range(len(fps))} == dict(enumerate(near.tolist()))


def test_components_of_long_chains(spark):
    rng = random.Random(4)
    order = list(range(400))
    rng.shuffle(order)
    edges = [(a, b) for a, b in zip(order[:199], order[1:200])] + [(a, b) for a, b in zip(order[200:399], order[201:400])] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for part in (order[:200], order[200:], [1000, 1001]):
        assert {got.get(i, i) for i in part} == {min(part)}


def test_texts_of_one_id_are_one_document(spark):
    """3 and 5 share text A, 5 also has B, 7 has B: all three are one component, though A and B aren't near."""
    rng = random.Random(8)
    a, b, c = (" ".join("".join(rng.choices("etaoinshr", k=5)) for _ in range(60)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (None, c)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]


def test_tiles_find_every_pair(monkeypatch):
    """Tiles of any size give all pairs within the radius, each once; a forest links what they link."""
    fps = np.array(clustered(6, 60), np.uint64)
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1)))}
    for strip in (1, 7, 64, 1000):
        monkeypatch.setattr(hamming, "STRIP", strip)
        got = [p for x, y in hamming.near_tiles(fps, 3) for p in zip(x.tolist(), y.tolist())]
        assert len(got) == len(set(got)) and set(got) == {(int(i), int(j)) for i, j in want}
        links = hamming.forest(3)(0, fps, np.arange(len(fps)), np.full(len(fps), 2))
        assert len(links) < len(fps)
        root = brute_components({i: {int(f)} for i, f in enumerate(fps)})
        trees = {i: i for i in root}
        for u, v in links:
            a, b = trees[u], trees[v]
            trees = {k: a if t == b else t for k, t in trees.items()}
        assert len(set(trees.values())) == len(set(root.values()))
