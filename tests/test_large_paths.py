"""The ways that large inputs take give what the small ones give; plans hold what is promised of them."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators import lineage as L
from kmerloom.operators import overlap as O
from kmerloom.operators import sketch as S
from kmerloom.plans import commands as C


def made(spark, n=30, seed=3):
    rng = random.Random(seed)
    rows = [(i, "ABC"[i % 3], "".join(rng.choices("ACGT", k=rng.randint(0, 70)))) for i in range(n)] + [(n, None, None), (n + 1, "A", "")]
    return spark.createDataFrame(rows, "id long, g string, seq string")


def refs(spark):
    return made(spark, 12, 4).filter("seq is not null").withColumn("ord", F.col("id"))


@pytest.mark.parametrize("name", ["md5", "xxhash64"])
def test_joined_overlap_equals_broadcast(spark, monkeypatch, name):
    run = lambda: sorted(map(str, C.classify(made(spark), refs(spark), [4], 40, min_depth=2, name=name).collect()))
    small = run()
    monkeypatch.setattr(O, "FEW", 0)
    monkeypatch.setattr(S, "DEEP", 0)
    assert run() == small and len(small) == 32


def test_joined_groups_equal_broadcast(spark, monkeypatch):
    run = lambda: sorted((str(r.g), r.hash) for r in L.group_unique(made(spark), "g", 5).collect())
    small = run()
    held = {}
    for r in made(spark).collect():
        for i in range(len(r.seq or "") - 4):
            held.setdefault(r.seq[i : i + 5], set()).add(r.g)
    by_hash = {r.h: r.k for r in spark.createDataFrame([(k,) for k in held], "k string").select("k", K.kmer_hash(F.col("k")).alias("h")).collect()}
    assert sorted((g, by_hash[h]) for g, h in small) == sorted((str(next(iter(g))), k) for k, g in held.items() if len(g) == 1)
    monkeypatch.setattr(L, "GROUPS", 0)
    assert run() == small


def test_a_panel_beyond_its_bound_is_refused(spark, monkeypatch):
    sk = S.sketches(refs(spark), [4], None)
    monkeypatch.setattr(O, "FEW", 10)
    with pytest.raises(ValueError, match="too large"):
        O.pairs_local(sk, sk)


def test_all_counts_has_every_reference(spark):
    panel = S.sketches(refs(spark), [4], None).join(refs(spark).select("id", "ord"), "id")
    got = O.all_counts(panel, O.hits(S.sketches(made(spark), [4], None), panel)).collect()
    n = panel.count()
    assert len(got) == 32 and all(len(r.counts) == n for r in got)
    sets = {r.id: set(r.sketch) for r in S.sketches(made(spark), [4], None).collect()}
    own = [set(r.sketch) for r in panel.orderBy("ord").collect()]
    assert {r.read_id: r.counts for r in got} == {i: [len(s & o) for o in own] for i, s in sets.items()}


def test_near_classes_in_tiles(spark, monkeypatch):
    """Joined up to any number of classes a hash, beyond it in tiles of three: links as by all pairs, each once."""
    rng = random.Random(6)
    base = [f"h{i}" for i in range(30)]
    data = [(i, sorted(rng.sample(base, rng.randint(20, 26)))) for i in range(50)]
    monkeypatch.setattr(O, "TILE", 3)
    want = {i: sum(len(set(s) & set(t)) >= 18 for j, t in data if j != i) for i, s in data}
    assert sum(want.values()) > 100
    for light in (0, 12, 1000):
        monkeypatch.setattr(O, "LIGHT", light)
        assert {r.id: r.links for r in O.near_classes(spark.createDataFrame(data, "id long, sketch array<string>"), 18).collect()} == want


def test_a_hot_group_is_cut_before_its_shuffle(spark):
    """Spark limits each group to its smallest hashes on both sides of the exchange."""
    sk = S.sketches(made(spark), [4], 10).join(made(spark).select("id", "g"), "id")
    plan = S.merge(sk, "g", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_prepared_depths_are_not_copied(spark, monkeypatch):
    """The depth table is read where it lies, never made durable, and is gone once the verdicts are safe; texts are dealt to blocks once."""
    from kmerloom.operators import buckets
    from kmerloom.plans import catalogue as Q

    made, folders = [], []
    keep, fresh = Q.durable, Q.fresh_folder
    monkeypatch.setattr(Q, "durable", lambda df: made.append(df.columns) or keep(df))
    monkeypatch.setattr(Q, "fresh_folder", lambda s, n: folders.append(fresh(s, n)) or folders[-1])
    rows = Q.QUERIES["classify_prepared_depths"](spark, "/root/testdata/sf0.001")
    assert rows.count() == 200 and made == [rows.columns] and len(folders) == 1
    path = spark._jvm.org.apache.hadoop.fs.Path(folders[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    depths = spark.createDataFrame([("0" * 16, 2)], "hash string, depth long")
    masked = buckets.masked(made_ids(spark), [4], 10, 2, depths=depths)
    masked.collect()
    assert masked._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1


def made_ids(spark):
    return made(spark).select("id", "seq")
