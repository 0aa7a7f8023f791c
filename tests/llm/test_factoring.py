import random
from collections import Counter

import numpy as np
import pytest

from kmerloom.llm import factoring
from tests.llm.data import empty, odd, odd_rows


def brute(rows, least=13):
    """(id, words, removed, kept) of every row, by the smallest id of every window spelled out."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for a in range(len(w) - least + 1):
            if i is not None:
                key = tuple(w[a : a + least])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - least + 1):
            if i is not None and first[tuple(w[a : a + least])] < i:
                gone.update(range(a, a + least))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


def passages(seed=1, n=150):
    """Documents put together from shared stretches of every length around the limit, cut and joined at any word."""
    rng = random.Random(seed)
    pool = [[f"{p}.{k}" for k in range(60)] for p in range(12)]
    rows = []
    for i in rng.sample(range(1000), n):
        words = []
        for _ in range(rng.randint(0, 6)):
            p, a = rng.choice(pool), rng.randint(0, 50)
            words += p[a : a + rng.randint(1, 30)] + [f"own{i}.{rng.randint(0, 3)}"] * rng.randint(0, 2)
        rows.append((i, " ".join(words)))
    return rows


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


@pytest.mark.parametrize("least,size,parts", [(13, 1 << 23, 3), (13, 20, 7), (5, 1 << 23, 2), (2, 100, 5), (1, 100, 2)])
def test_equals_brute_force(spark, monkeypatch, least, size, parts):
    """Windows that meet in slices, in blocks and at factor boundaries, for several limits; a run of one word repeated."""
    from kmerloom.llm import common

    monkeypatch.setattr(common, "SLICE_BYTES", 3000)
    rows = passages() + [(2000, "same " * 40), (2001, "same " * 14 + "end"), (2002, "same " * 12), (1999, "\tsame\n" * 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert got(factoring.dedup_substrings(docs, least, size)) == brute(rows, least)


def test_odd_rows(spark):
    """Null and repeated ids, null and very long texts, ties, clashing columns."""
    rows = [(r[0], r[1]) for r in odd_rows()] + [(61, odd_rows()[3][1]), (62, odd_rows()[3][1].upper())]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, key int, runs string, n_words int")
    assert got(factoring.dedup_substrings(docs)) == brute(rows)
    assert factoring.dedup_substrings(empty(spark)).count() == 0 and factoring.dedup_substrings(odd(spark)).count() == len(odd_rows())


def test_factors_stand_in_their_documents(spark):
    rows = passages(2)
    text = {i: t.split() for i, t in rows}
    found = factoring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = 0
    for r in found:
        for f in r.factors:
            n += 1
            assert f.length >= 13 and f.ref_id < r.doc_id
            assert text[r.doc_id][f.begin : f.begin + f.length] == text[f.ref_id][f.ref_begin : f.ref_begin + f.length]
    assert n > 30


def test_hashes_tell_windows_apart():
    """Order, length and single words decide."""
    lists = [[b"a", b"b", b"c"], [b"a", b"c", b"b"], [b"a", b"b"], [b"ab", b"c"], [b"a", b"b", b"c"]]
    own, place, hashed, anchor = factoring.windows(lists, 2)
    key = {}
    for o, p, h in zip(own.tolist(), place.tolist(), hashed.tolist()):
        key.setdefault(h, set()).add(tuple(lists[o][p : p + 2]))
    assert all(len(v) == 1 for v in key.values()) and len(key) == 5 and np.array_equal(own, [0, 0, 1, 1, 2, 3, 4, 4])
