import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.functions import packed as P
from kmerloom.operators import sketch as S

FLIP = str.maketrans("ACGTacgt", "TGCAtgca")


@pytest.mark.parametrize("k", [1, 2, 15, 16, 30, 31])
def test_packed_and_back(spark, k):
    rng = random.Random(k)
    kmers = ["".join(rng.choices("ACGT", k=k)) for _ in range(30)] + ["A" * k, "T" * k]
    df = spark.createDataFrame([(m,) for m in kmers], "kmer string").withColumn("code", P.pack(F.col("kmer")))
    rows = P.other_strand(df, "code", k, "o").select("kmer", "code", P.unpack(F.col("code"), k).alias("back"), P.unpack(F.col("o"), k).alias("other")).collect()
    assert all(r.back == r.kmer and r.other == r.kmer.translate(FLIP)[::-1] for r in rows)
    assert [r.kmer for r in sorted(rows, key=lambda r: r.code)] == sorted(kmers)


def test_depths_by_packed_kmers(spark):
    """The same depths as by hashes, for both strands, small letters, masked letters, several lengths and every hash."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("ACGT", k=60)) + rng.choice(["", "N", "acgtacgt"]) + "ACGTTGCA" * 3) for i in range(20)] + [(90, None), (91, "AC")]
    df = spark.createDataFrame(rows, "id long, seq string")
    for name, canonical, valid_only, ks in (("md5", False, False, [5, 8]), ("md5", True, True, [31, 33]), ("xxhash64", True, False, [8]), ("murmur3", True, True, [5, 8]), ("murmur3", True, False, [33])):
        how = {"name": name, "canonical": canonical, "valid_only": valid_only}
        want = Counter(r.hash for r in S.hash_table(df, ks, **how).collect())
        assert {r.hash: r.depth for r in S.depth(df, ks, **how).collect()} == want, how


@pytest.mark.parametrize("k", [1, 5, 16, 30, 31])
@pytest.mark.parametrize("canonical", [False, True])
def test_kmers_cut_out_of_packed_windows(spark, k, canonical):
    """Every k-mer once: whole and short windows, small and other letters, letters of two chars; few rows are made of a text before its k-mers are longs."""
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (0, k - 1, k, 31, 32, 47, 200)] + ["ACGTN" * 20, "acgtACGT" * 9 + "T" * 40, "AC\n\U0001f600GT" * 12]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "seq string")
    want = Counter(min(w, w.translate(FLIP)[::-1]) if canonical else w for t in texts for w in (t[i : i + k] for i in range(len(t) - k + 1)))
    for valid in (False, True):
        some = {w: n for w, n in want.items() if not valid or set(w) <= set("ACGTacgt")}
        rows = P.spelled(df, k, canonical, valid).groupBy("code", "text").count().select(F.coalesce("text", P.unpack(F.col("code"), k)).alias("w"), "code", "count").collect()
        assert {r.w: r["count"] for r in rows} == some and len(rows) == len(some)
        assert all((r.code is not None) == (set(r.w) <= set("ACGT")) for r in rows)


@pytest.mark.parametrize("k", [3, 8, 16, 31])
def test_murmur3_of_packed_kmers(spark, k):
    from kmerloom.functions.murmur import with_murmur3

    rng = random.Random(k)
    kmers = ["".join(rng.choices("ACGT", k=k)) for _ in range(30)] + ["T" * k, "A" * k]
    df = spark.createDataFrame([(m,) for m in kmers], "kmer string").withColumn("code", P.pack(F.col("kmer"))).withColumn("none", F.lit(None).cast("string"))
    for canonical in (False, True):
        want = {r.kmer: r.hash for r in with_murmur3(df, "kmer", k, canonical=canonical).collect()}
        made = with_murmur3(df, "none", k, canonical=canonical, code="code")
        assert {r.kmer: r.hash for r in made.collect()} == want
    stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(made._jdf.queryExecution().executedPlan())
    assert all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.length()))  # longer methods are never compiled by the JVM
