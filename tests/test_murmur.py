import random

import pytest

from kmerloom.functions import kmers as K
from kmerloom.functions.murmur import with_murmur3
from kmerloom.operators import sketch as S
from kmerloom.plans.catalogue import QUERIES

FLIP = str.maketrans("ACGT", "TGCA")


def python_hash(kmer):
    return f"{int(K.murmur3_x64([kmer.encode()])[0]):016x}"


@pytest.mark.parametrize("k", [1, 8, 9, 15, 16, 17, 24, 31, 32, 40])
def test_every_length(spark, k):
    """One word to three blocks, with and without a tail, both strands; null stays null; the session's arithmetic is as before."""
    rng = random.Random(k)
    kmers = ["".join(rng.choices("ACGT", k=k)) for _ in range(20)]
    df = spark.createDataFrame([(m, 7) for m in kmers] + [(None, 8)], "kmer string, hash int")
    before = spark.conf.get("spark.sql.ansi.enabled")
    one, both = ({r.kmer: r.hash for r in with_murmur3(df, "kmer", k, canonical=c).collect()} for c in (False, True))
    assert one == {m: python_hash(m) for m in kmers} | {None: None}
    assert both == {m: min(python_hash(m), python_hash(m.translate(FLIP)[::-1])) for m in kmers} | {None: None}
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_known_values(spark):
    df = spark.createDataFrame([("hello",)], "kmer string")
    assert with_murmur3(df, "kmer", 5, seed=0).first().hash == "cbd8a7b341bd9b02"


def test_sketches_and_tables(spark):
    """Rows without a k-mer keep an empty sketch; masked letters are left out; the same as by the Arrow hash."""
    rows = [(1, "ACGTTGCANACGTACGTA"), (2, "AC"), (3, None), (4, "NNNNNNNNNNNN"), (5, "ACGTTGCATTTGGGCCC" * 3)]
    df = spark.createDataFrame(rows, "id long, seq string")
    got = {r.id: r.sketch for r in S.sketches(df, [5, 8], 6, "murmur3", True, True).collect()}
    want = {}
    for i, seq in rows:
        found = [(seq or "")[a : a + k] for k in (5, 8) for a in range(len(seq or "") - k + 1)]
        want[i] = sorted({min(python_hash(m), python_hash(m.translate(FLIP)[::-1])) for m in found if "N" not in m})[:6]
    assert got == want
    table = S.hash_table(df, [5], "murmur3", False, True).collect()
    assert sorted((r.id, r.pos, r.hash) for r in table) == sorted((i, a, python_hash(seq[a : a + 5])) for i, seq in rows if seq for a in range(len(seq) - 4) if "N" not in seq[a : a + 5])


@pytest.mark.parametrize("name", ["classify_documented", "count_documented"])
def test_no_python_worker(spark, name, capsys):
    QUERIES[name](spark, "/root/testdata/sf0.001").explain("formatted")
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan and "Project" in plan
