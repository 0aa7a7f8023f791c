from collections import defaultdict

import corpus_pipeline as P
from kmerloom.llm import likeness
from tests.llm.data import empty, odd_rows

D = "/root/testdata/sf0.01"


def words(text):
    return [w for w in (text or "").encode().lower().split()]


def shingles(text):
    w = words(text)
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """Ids that stay, by counting the common shingles of all pairs of texts."""
    sets = defaultdict(set)
    for i, t in rows:
        sets[frozenset(shingles(t))].add(i)
    each, parent = list(sets), {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    for same in sets.values():
        for i in same:
            join(min(same), i)
    holders = defaultdict(list)
    for k, s in enumerate(each):
        both = defaultdict(int)
        for x in s:
            for other in holders[x]:
                both[other] += 1
            holders[x].append(k)
        for other, n in both.items():
            if 5 * n >= 4 * (len(s) + len(each[other]) - n):
                join(min(sets[s]), min(sets[each[other]]))
    return {i for i in parent if root(i) == i}


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = P.near_dedup_stage(spark, docs, D)
    want = kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id for r in got.select("doc_id").collect()} == want and len(want) < docs.count()


def test_tiles_and_odd_rows(spark, monkeypatch):
    """A block of many tiles, with texts on both sides of 0.8, and every odd row."""
    monkeypatch.setattr(likeness, "TILE", 256)
    base = [f"w{i}" for i in range(100)]
    rows = [(1000 + k, " ".join(base[: 100 - k])) for k in range(60)] + [(2000 + k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 100, 3)]
    rows += [(r[0], r[1]) for r in odd_rows() if r[0] is not None]
    docs = spark.createDataFrame(rows + [(None, rows[0][1]), (None, None)], "doc_id long, text string")
    got = [r.doc_id for r in likeness.one_of_each(docs).collect()]
    assert {i for i in got if i is not None} == kept(rows) and got.count(None) == 2
    assert likeness.one_of_each(empty(spark)).count() == 0
