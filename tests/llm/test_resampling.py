import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from kmerloom.llm import resampling
from tests.llm.data import empty, odd, odd_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, buckets=10_000, share=(5, 100), least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *runs(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for text in target for f in runs(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, n, fs in found:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    best = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = best[: len(best) * share[0] // share[1]]
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in best[len(drawn) :]] + [(*r, None) for r in out if r[1] < least], key=repr)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("task,buckets", [(1 << 20, 10_000), (500, 10_000), (1 << 20, 7)])
def test_equals_brute_force(spark, monkeypatch, task, buckets):
    """One task a range and many, few and many buckets, odd rows, equal rows of one id and of no id, clashing columns."""
    monkeypatch.setattr(resampling, "TASK", task)
    rows = [(r[0], r[1]) for r in odd_rows()] + [(200 + i, f"the {'same ' * (i % 5)}words {'Äpfel été 42 ' * 9} go on and on x{i % 3}") for i in range(60)]
    rows += [(300, rows[0][1])] * 3 + [(None, rows[2][1])] * 4
    target = ["the words go on", None, "", "été 42 the the"]
    docs = spark.createDataFrame([(i, t, 1, 2, "c", "r") for i, t in rows], "doc_id long, text string, range int, key long, copies string, rank string").repartition(5)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "doc_id long, text string")
    got = collected(resampling.resample(docs, goal, share=(40, 100), buckets=buckets))
    want = brute(rows, target, buckets, (40, 100))
    # rows of one id and score are equal but for the text, so a rank may go to either
    assert Counter(r[:5] for r in got) == Counter(r[:5] for r in want)
    assert Counter((r[0], r[4], r[5]) for r in got) == Counter((r[0], r[4], r[5]) for r in want)


def test_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = collected(resampling.resample(docs, bench.selectExpr("item_id AS doc_id", "text")))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()]) and sum(r[5] is not None for r in got) > 5


def test_empty(spark):
    assert resampling.resample(empty(spark), odd(spark)).count() == 0
    docs = odd(spark)
    got = collected(resampling.resample(docs, empty(spark)))
    want = brute([(r[0], r[1]) for r in odd_rows()], [])
    assert Counter(r[:5] for r in got) == Counter(r[:5] for r in want)
