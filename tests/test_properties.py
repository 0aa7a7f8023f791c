import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators import overlap as O
from kmerloom.operators import scoring
from kmerloom.operators import sketch as S


def test_murmur3_known_values():
    """Published x64_128 test values (first half)."""
    assert K.murmur3_x64([b""], 0)[0] == 0
    assert K.murmur3_x64([b"hello"], 0)[0] == 0xCBD8A7B341BD9B02
    assert K.murmur3_x64([b"The quick brown fox jumps over the lazy dog"], 0)[0] == 0xE34BBC7BBC071B6C


def test_hash_kinds(spark):
    df = spark.createDataFrame([("ACGT",), (None,), ("TTTT",)], "k string")
    rows = df.select(*(K.kmer_hash(F.col("k"), n).alias(n) for n in K.HASHES)).collect()
    assert len(rows[0].murmur3) == 16 and rows[1].murmur3 is None and isinstance(rows[0].xxhash64, int)
    top = spark.createDataFrame([(1, "ACGTTGCA")], "id long, seq string")
    h = [x % 2**64 for x in S.sketches(top, [4], 3, "xxhash64").first().sketch]
    every = [x % 2**64 for x in top.select(K.hashes(F.col("seq"), [4], "xxhash64")).first()[0]]
    assert h == sorted(every)[:3]


def test_strand_invariance_and_merge(spark):
    rng = random.Random(1)
    rows = [(i, i % 5, "".join(rng.choices("ACGT", k=rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g long, seq string")
    both = df.select(K.bottom(K.hashes(F.col("seq"), [5], canonical=True), None).alias("a"), K.bottom(K.hashes(K.reverse_complement(F.col("seq")), [5], canonical=True), None).alias("b"))
    assert all(r.a == r.b for r in both.collect())
    sk = S.sketches(df, [5], 8).join(df.select("id", "g"), "id")
    merged = {r.g: r.sketch for r in S.merge(sk, "g", 8).collect()}
    whole = {}
    for r in S.sketches(df, [5], None).join(df.select("id", "g"), "id").collect():
        whole.setdefault(r.g, set()).update(r.sketch)
    assert merged == {g: sorted(v)[:8] for g, v in whole.items()}


def test_prefix_difference_equals_loop(spark):
    rng = random.Random(2)
    vectors = [[rng.choice([0, 0, 1, 2, 3, 3]) for _ in range(5)] for _ in range(80)]
    refs = spark.createDataFrame([(100 + j, j, ["x"]) for j in range(5)], "id long, ord int, sketch array<string>")
    rows = [(i, 100 + j, n, 9) for i, v in enumerate(vectors) for j, n in enumerate(v) if n] + [(i, None, 0, 9) for i, v in enumerate(vectors) if not any(v)]
    hits = spark.createDataFrame(rows, "read_id long, ref_id long, shared long, read_size int")
    for start in (-1, 0):
        got = {r.read_id: (r.ref_id, r.diff_prefix) for r in O.verdicts(refs, hits, start).collect()}
        for i, v in enumerate(vectors):
            best, at, diff = start, None, 0
            for j, n in enumerate(v):
                if n > best:
                    diff, best, at = n - best, n, 100 + j
            assert got[i] == (at, diff if at is not None else 0), (v, start)


def test_masks(spark):
    df = spark.createDataFrame([(1, "AAAAAC"), (2, "AAAAAG"), (3, "CCCCCC")], "id long, seq string")
    kept = {r.id: len(r.sketch) for r in S.masked_sketches(df, [4], None, 2).collect()}
    assert kept == {1: 1, 2: 1, 3: 1}
    rare = {r.id: len(r.sketch) for r in S.max_samples_sketches(df, [4], None, 1).collect()}
    assert rare == {1: 1, 2: 1, 3: 1}
    assert isinstance(S.approximate_depth(df, [4]), (bytes, bytearray))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=20))
def test_murmur3_is_per_value(values):
    one = [int(K.murmur3_x64([v])[0]) for v in values]
    assert one == [int(x) for x in K.murmur3_x64(values)]


def test_mixtures(spark):
    assert scoring.reads_needed(100, 7906, 0.5) == 1582
    designs = scoring.random_mixtures(list("ABCDEF"), 20, 7)
    assert designs == scoring.random_mixtures(list("ABCDEF"), 20, 7)
    for d in designs:
        assert abs(sum(p for _, p, _ in d) - 1) < 0.01 and 2 <= len(d) <= 5 and all(p >= 0.04 - 1e-9 for _, p, _ in d)
    line = spark.range(1).select(scoring.feature_line(F.lit(1), F.lit("a|b"), "ns", F.create_map(F.lit("x"), F.lit(2)))).first()[0]
    assert line == "1 1.0 `a_b|ns x:2"
    train = spark.createDataFrame([(["a", "b"], 1.0), (["c"], 0.0)] * 10, "f array<string>, y double")
    assert [r.prediction for r in scoring.lineage_model(train, train.limit(2), "f", "y").collect()] == [1.0, 0.0]
    words = spark.createDataFrame([(1.0,), (-1.0,), (0.0,)], "s double").select(scoring.verdict(F.col("s")).alias("v")).collect()
    assert [r.v for r in words] == ["COINF", "PURE", "UNKNOWN"]


def test_near_classes_lose_no_link(spark):
    """Against all pairs: copies, near copies, sketches below the bound, empty and null ones."""
    import random

    from kmerloom.operators import overlap

    rng = random.Random(4)
    base = [f"h{i}" for i in range(40)]
    data = [(i, sorted(rng.sample(base, 30))) for i in range(40)] + [(50, sorted(base[:30])), (51, sorted(base[:30])), (52, base[:5]), (53, []), (54, None), (55, [])]
    got = {r.id: (r.class_id, r.links) for r in overlap.near_classes(spark.createDataFrame(data, "id long, sketch array<string>"), 24).collect()}
    classes = {}
    for i, s in data:
        classes.setdefault(tuple(s or ()), i)
    for i, s in data:
        s = tuple(s or ())
        assert got[i] == (classes[s], sum(t != s and len(set(s) & set(t)) >= 24 for t in classes))
    assert len(got) == len(data)
    assert overlap.near_classes(spark.createDataFrame([], "id long, sketch array<string>"), 24).count() == 0
