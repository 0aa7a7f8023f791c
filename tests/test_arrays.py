"""Hashes as arrays, and what is folded or asked in buckets, against one k-mer at a time."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import arrays as A
from kmerloom.functions import kmers as K
from kmerloom.operators import buckets as B
from kmerloom.operators import lineage as L
from kmerloom.operators import overlap as O
from kmerloom.operators import sketch as S

random.seed(3)
TEXTS = ["", None, "abc", "ab" * 60, "".join(random.choice("ACGTNacgt") for _ in range(300)), "größe übung \U0001f600 " * 30, "x" * 16, "ACGTTGCA" * 9]
FLIP = str.maketrans("ACGTacgt", "TGCAtgca")


def kmers(text, ks):
    return [text[i : i + k] for k in ks for i in range(len(text) - k + 1)] if text else []


def digest(name, word):
    return int(hashlib.md5(word.encode()).hexdigest()[:16], 16) if name == "md5" else int(K.murmur3_x64([word.encode()])[0])


@pytest.mark.parametrize("name", A.NAMES)
@pytest.mark.parametrize("ks", [[16], [3, 5], [60]])
@pytest.mark.parametrize("canonical,valid_only", [(False, False), (True, False), (True, True)])
def test_hashes_of_any_text(name, ks, canonical, valid_only):
    for row, values, counts in A.hashed_texts(pa.array(["cut off", *TEXTS])[1:], ks, name, canonical, valid_only):
        for i, (end, n) in enumerate(zip(np.cumsum(counts), counts)):
            words = [w for w in kmers(TEXTS[row + i], ks) if not valid_only or set(w) <= set("ACGTacgt")]
            want = [min(digest(name, w), digest(name, w.translate(FLIP)[::-1])) if canonical else digest(name, w) for w in words]
            assert sorted(values[end - n : end].tolist()) == sorted(want)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(B, "HELD", 40)  # so that many blocks meet
    monkeypatch.setattr(B, "BLOCK", 40)


def rows(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(i, "".join(rng.choice("ab") for _ in range(i)), rng.choice("xyz")) for i in range(60)], "id int, seq string, g string").repartition(3)


def test_blocks_fold_and_answer(spark, small_blocks):
    df = rows(spark)
    data = df.collect()
    depth = Counter(f"{digest('md5', w):016x}" for r in data for w in kmers(r.seq, [7]))
    assert {r.hash: r.depth for r in S.depth(df, [7]).collect()} == depth
    assert {r.hash: r.depth for r in S.depth(df, [7], 9).collect()} == {h: n for h, n in depth.items() if n >= 9}
    want = {r.id: sorted({h for w in kmers(r.seq, [7]) if depth[h := f"{digest('md5', w):016x}"] >= 15})[:6] for r in data}
    for more in ({}, {"depths": S.depth(df, [7])}, {"over": df}):
        assert {r.id: r.sketch for r in S.masked_sketches(df, [7], 6, 15, **more).collect()} == want, more


def test_own_hashes_of_groups(spark, small_blocks):
    df = rows(spark)
    groups = {}
    for r in df.collect():
        for w in kmers(r.seq, [9]):
            groups.setdefault(f"{digest('md5', w):016x}", set()).add(r.g)
    want = {(min(g), h) for h, g in groups.items() if len(g) == 1}
    assert {tuple(r) for r in L.group_unique(df, "g", 9).collect()} == want
    some = sorted(groups)[::3]
    among = spark.createDataFrame([(h,) for h in some], "hash string")
    assert {tuple(r) for r in L.group_unique(df, "g", 9, among=among).collect()} == {x for x in want if x[1] in some}


def test_panel_that_is_asked_counts_like_a_join(spark, monkeypatch):
    a, b = S.sketches(rows(spark), [5], None), S.sketches(rows(spark).filter("id % 7 = 0").withColumn("id", F.col("id") + 100), [5], None)
    asked = {(r.read_id, r.ref_id): (r.shared, r.read_size) for r in O.hits(a, b).filter("ref_id IS NOT NULL").collect()}
    assert {(r.read_id, r.ref_id): r.shared for r in O.pairs_local(a, b).collect()} == {k: n for k, (n, _) in asked.items()}
    monkeypatch.setattr(O, "FEW", 0)
    assert asked == {(r.read_id, r.ref_id): (r.shared, r.read_size) for r in O.hits(a, b).filter("ref_id IS NOT NULL").collect()} and asked


def test_many_deep_hashes_are_no_error(spark, monkeypatch):
    from kmerloom.operators import counters
    from kmerloom.plans import catalogue as Q

    want = {n: sorted(map(str, Q.QUERIES[n](spark, "/root/testdata/sf0.001").collect())) for n in ("classify_deep_hashes", "stream_filter_report")}
    for module in (counters, Q):
        monkeypatch.setattr(module, "DEEP", 10)
    for n, w in want.items():
        assert sorted(map(str, Q.QUERIES[n](spark, "/root/testdata/sf0.001").collect())) == w
