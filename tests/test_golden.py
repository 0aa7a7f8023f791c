"""Hand-computed micro inputs."""

from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators import lineage as L
from kmerloom.operators import overlap as O
from kmerloom.operators import sketch as S
from kmerloom.operators import variants as V

REFS = [(0, 0, "ACGTACGTAA"), (1, 1, "ACGTTGCATT"), (2, 2, "GGGGCCCCGG")]
READS = [(10, "ACGTTGCA"), (11, "TTTTTTTT"), (12, "ACGTACGT")]


def seqs(spark, rows, schema="id long, seq string"):
    return spark.createDataFrame(rows, schema)


def test_kmers_and_sketch(spark):
    df = seqs(spark, [(1, "ACGTTGCA"), (2, "ACG"), (3, ""), (4, None)])
    got = {r.id: r.k for r in df.select("id", K.kmers(F.col("seq"), 4).alias("k")).collect()}
    assert got == {1: ["ACGT", "CGTT", "GTTG", "TTGC", "TGCA"], 2: [], 3: [], 4: []}
    sk = {r.id: r.sketch for r in S.sketches(df, [4], 3).collect()}
    assert sk[1] == ["385df0ea49d02d95", "5c15f97a88433c48", "cfbe5fe38870d8a5"] and sk[2] == sk[4] == []


def test_canonical(spark):
    df = spark.createDataFrame([("CGTT",), ("AACG",), ("GTTG",), ("CAAC",), ("TTGC",), ("ACGT",), ("TGCA",)], "k string")
    got = {r.k: r.h for r in df.select("k", K.kmer_hash(F.col("k"), canonical=True).alias("h")).collect()}
    assert got["CGTT"] == got["AACG"] == "ce9d0ecb223f36a6" and got["GTTG"] == got["CAAC"] == "179c8d9d65e06833"
    assert got["TTGC"] == "780c29234023a155" and got["ACGT"] == "f1f8f4bf413b16ad" and got["TGCA"] == "5c15f97a88433c48"


def test_overlap_and_depth(spark):
    refs = seqs(spark, REFS, "id long, ord int, seq string")
    a, b = S.sketches(seqs(spark, READS), [4], None), S.sketches(refs, [4], None)
    want = {(10, 0): 1, (10, 1): 5, (12, 0): 4, (12, 1): 1}
    for pairs in (O.pairs, O.pairs_local):
        assert {(r.read_id, r.ref_id): r.shared for r in pairs(a, b).collect()} == want
    v = {r.read_id: (r.ref_id, r.shared, r.diff_prefix, r.diff_runner_up) for r in O.verdicts(b.join(refs.select("id", "ord"), "id"), O.hits(a, b)).collect()}
    assert v == {10: (1, 5, 4, 4), 11: (0, 0, 1, 0), 12: (0, 4, 5, 3)}
    f = {r.read_id: (r.ref_id, r.shared, r.diff_prefix) for r in O.verdicts(b.join(refs.select("id", "ord"), "id"), O.hits(a, b), start=0).collect()}
    assert f == {10: (1, 5, 4), 11: (None, 0, 0), 12: (0, 4, 4)}
    depth = {r.hash: r.depth for r in S.depth(seqs(spark, READS), [4]).collect()}
    named = {r.k: r.h for r in spark.createDataFrame([("ACGT",), ("TTTT",), ("TGCA",)], "k string").select("k", K.kmer_hash(F.col("k")).alias("h")).collect()}
    assert depth[named["ACGT"]] == 3 and depth[named["TTTT"]] == 5 and depth[named["TGCA"]] == 1 and len(depth) == 9
    freq = sorted(r.n_refs for r in S.sample_frequency(refs, [4]).collect())
    assert len(freq) == 18 and freq[-1] == 2 and freq[-2] == 1


def test_group_unique(spark):
    df = spark.createDataFrame([(1, "A", "ACGTA"), (2, "A", "ACGTT"), (3, "B", "ACGTC"), (4, "C", "GGGTA")], "id long, g string, seq string")
    names = {r.h: r.k for r in df.select(F.explode(K.kmers(F.col("seq"), 3)).alias("k")).select("k", K.kmer_hash(F.col("k")).alias("h")).collect()}
    got = sorted((r.g, names[r.hash]) for r in L.group_unique(df, "g", 3).collect())
    assert got == [("A", "GTT"), ("B", "GTC"), ("C", "GGG"), ("C", "GGT")]


def test_call(spark):
    refs = seqs(spark, [(1, "ACGTTGCATC")])
    reads = seqs(spark, [(i, "ACGTTGCATC") for i in range(2)] + [(10 + i, "ACGTAGCATC") for i in range(8)])
    depths = S.depth(reads, [4])
    profile = V.depth_profile(refs, depths, 4, 3)
    assert [(r.avg_depth, r.depth) for r in profile.orderBy("pos").collect()] == [(10, 10), (6, 2), (4, 2), (2, 2), (2, 2), (4, 10), (7, 10)]
    calls = lambda **o: sorted((r.pos, r.orig, r.alt, r.kc, r.md, r.rd, r.od) for r in V.call(refs, reads, 4, 3, **o).collect())
    assert calls() == [(5, "T", "-", 1, 10, 6, 2), (5, "T", "A", 1, 8, 6, 2), (6, "T", "-", 1, 10, 6, 2)]
    assert calls(strict=True) == [(5, "T", "A", 1, 8, 6, 2)]
    assert len(calls(extras=True)) >= 3


def test_perturbations(spark):
    row = spark.range(1).select(K.substitutions(F.lit("ACGT")).alias("s"), K.deletions(F.lit("ACGTA")).alias("d"), K.insertions(F.lit("ACGT")).alias("i")).first()
    assert len(row.s) == 12 and {x.kmer for x in row.s if x.at == 0} == {"CCGT", "GCGT", "TCGT"}
    assert [x.kmer for x in row.d] == ["CGTA", "AGTA", "ACTA", "ACGA", "ACGT"]
    assert {x.kmer for x in row.i if x.at == 1} == {"AACG", "ACCG", "AGCG", "ATCG"}


def test_assignment_repair(spark):
    schema = "read_id long, n_hashes long, type_shared long, lin array<struct<name:string,sim:double,shared:long>>, sublin array<struct<name:string,sim:double,shared:long>>"
    rows = [
        (1, 100, 20, [("A", 0.2, 20)], [("A1", 0.1, 9)]),
        (2, 100, 20, [("A", 0.2, 20)], [("B1", 0.1, 9), ("A2", 0.05, 5)]),
        (3, 100, 20, [("A", 0.2, 8)], [("B1", 0.1, 9), ("A2", 0.05, 5)]),
        (4, 40, 20, [("A", 0.2, 20)], [("A1", 0.1, 9)]),
        (5, 100, 20, [], []),
    ]
    got = {r.read_id: (r.lineage, r.sublineage) for r in L.assign(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("A", "A1"), 2: ("A", "A2"), 3: ("A", ""), 5: ("", "")}
