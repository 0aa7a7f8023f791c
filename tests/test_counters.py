import random

import numpy as np
import pytest

from kmerloom.functions import kmers as K
from kmerloom.operators import counters as N
from kmerloom.operators import sketch as S
from kmerloom.plans import commands as C
from kmerloom.streaming.classify import filter_report, write_report


def reads(spark, n=60, seed=3):
    rng = random.Random(seed)
    genomes = ["".join(rng.choices("ACGT", k=300)) for _ in range(3)]
    rows = [(i, (g := genomes[i % 3])[(a := rng.randint(0, 200)) : a + 80] + "".join(rng.choices("ACGT", k=20))) for i in range(n)]
    return spark.createDataFrame([*rows, (900, ""), (901, None)], "id long, seq string"), spark.createDataFrame([(i, i, g) for i, g in enumerate(genomes)], "id long, ord long, seq string")


@pytest.mark.parametrize("name", ["md5", "xxhash64"])
def test_counters_never_count_too_few(spark, name):
    """Estimates are depths or more; few are off by more than the bound; tables of parts add up to that of the whole; a narrow table still never counts too few."""
    df, _ = reads(spark)
    hashed = S.hash_table(df, [11], name)
    real = {r.hash: r.depth for r in S.depth(df, [11], name=name).collect()}
    numbers, depths = N.as_numbers(np.array(list(real), object if name == "md5" else np.int64)), np.array(list(real.values()))
    for width in (1, 256, 1 << 14):
        known = N.count_min(hashed, width, 4)
        off = known.lookup(numbers) - depths
        assert known.table.shape == (4, width) and known.table[0].sum() == depths.sum() and off.min() >= 0
        assert (off > np.e / width * depths.sum()).mean() <= np.exp(-4)
    parts = [N.count_min(S.hash_table(df.filter(f"id % 2 = {i}"), [11], name), 256, 4) for i in (0, 1)]
    assert (parts[0].merged(parts[1]).table == N.count_min(hashed, 256, 4).table).all()
    with pytest.raises(ValueError):
        N.count_min(hashed, 100)


def test_masks_equal_the_joined_form(spark, monkeypatch):
    df, panel = reads(spark)
    depths = S.depth(df, [11])
    want = {r.id: r.sketch for r in S.masked_sketches(df, [11], 40, 3).collect()}
    for known in (N.deep_hashes(depths, 3), N.count_min(depths.selectExpr("explode(array_repeat(hash, int(depth))) AS hash"), 1 << 18)):
        got = {r.id: r.sketch for r in S.masked_sketches(df, [11], 40, 3, depths=known).collect()}
        assert got == {i: v if i != 901 else got[901] for i, v in want.items()} and not got[901]
    both = [sorted(map(tuple, C.classify(df, panel, [11], min_depth=3, depths=d).collect()), key=repr) for d in (None, N.deep_hashes(depths, 3))]
    assert both[0] == both[1]
    assert N.deep_hashes(depths, 10**6).lookup(np.array([1], np.uint64)).tolist() == [False]
    monkeypatch.setattr(N, "DEEP", 5)
    with pytest.raises(ValueError, match="too many"):
        N.deep_hashes(depths, 1)


def test_list_filter(spark, monkeypatch):
    """No key of the list is refused, few others pass, and a search is the same with and without a filter."""
    keys = spark.range(5000).selectExpr("xxhash64(id) AS hash")
    known = N.list_filter(keys)
    own = N.as_numbers(np.array([r.hash for r in keys.collect()]))
    assert known.lookup(own).all() and known.lookup(np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64)).mean() < 0.02
    df, panel = reads(spark)
    wanted = S.kmer_table(panel.filter("id = 1"), [11])
    found = {c: sorted(map(tuple, S.search(df, wanted, [11], c).collect())) for c in (False, True)}
    monkeypatch.setattr(N, "MOST_BITS", 8)
    assert N.list_filter(keys) is None
    assert found == {c: sorted(map(tuple, S.search(df, wanted, [11], c).collect())) for c in (False, True)} and found[False]
    assert S.search(df, wanted.limit(0), [11]).count() == 0


def test_report_goes_on_where_it_stopped(spark, tmp_path):
    """A stream stopped and started again writes every read once, by the filter's rules."""
    df, panel = reads(spark)
    sketched = S.sketches(panel, [11]).join(panel.select("id", "ord"), "id")
    known = N.deep_hashes(S.depth(df, [11]), 2)
    rows = df.collect()
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        write_report(filter_report(stream, sketched, [11], min_matches=5, depths=known, min_depth=2), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = {r.value.split("\t")[0]: r.value.split("\t")[1:] for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert len(got) == len(rows) and spark.read.text(str(tmp_path / "out")).count() == len(rows)
    passed = {f"Sample: {r.id}" for r in C.filter_reads(df, panel, [11], min_depth=2, min_matches=5).collect()}
    assert {k for k, v in got.items() if "FAIL" not in v[-1]} == passed and passed
    assert got["Sample: 900"] == ["Result: ", "0", "0", "FAIL:DEPTH FAIL:MATCHES FAIL:DIFF"] and K.HASHES
