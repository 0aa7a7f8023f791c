"""K-mers that travel as stretches of text, against one k-mer at a time."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kmerloom.functions import arrays as A
from kmerloom.operators import lineage as L
from kmerloom.operators import sketch as S
from kmerloom.operators import stretches as T

from .test_arrays import FLIP, TEXTS, digest, kmers

SHORT = "".join(random.Random(4).choice("abcdefgh ") for _ in range(3000))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(T, "HELD", 500)  # so that many blocks meet
    monkeypatch.setattr(A, "SLICE", 200)


@pytest.mark.parametrize("k", [3, 16, 31])
@pytest.mark.parametrize("canonical", [False, True])
def test_every_kmer_lies_in_one_stretch(k, canonical):
    data, offsets = A.text_bytes(pa.array([*TEXTS, SHORT]))
    start, length, bucket, row = T.cut(data, offsets, k, canonical)
    cut, at = [], {}
    for s, n, b, r in zip(start.tolist(), length.tolist(), bucket.tolist(), row.tolist()):
        text = data[s : s + n].tobytes().decode()
        assert text in [*TEXTS, SHORT][r]
        for w in kmers(text, [k]):
            cut.append(w)
            at.setdefault(min(w, w.translate(FLIP)[::-1]) if canonical else w, set()).add(b)
    assert Counter(cut) == Counter(w for t in [*TEXTS, SHORT] for w in kmers(t, [k]))
    assert all(len(b) == 1 for b in at.values())


@pytest.mark.parametrize("canonical,valid_only", [(False, False), (True, False), (True, True)])
def test_depths_and_own_hashes(spark, small, canonical, valid_only):
    texts = [(t, g) for t in [*TEXTS, SHORT[:900], SHORT[500:1200]] for g in "xy"[: 1 + (t != SHORT[:900])]]
    df = spark.createDataFrame(texts, "seq string, g string").repartition(3)
    depth, groups = Counter(), {}
    for t, g in texts:
        for w in kmers(t, [16]):
            if not valid_only or set(w) <= set("ACGTacgt"):
                h = f"{min(digest('md5', w), digest('md5', w.translate(FLIP)[::-1])) if canonical else digest('md5', w):016x}"
                depth[h] += 1
                groups.setdefault(h, set()).add(g)
    how = {"canonical": canonical, "valid_only": valid_only}
    assert sorted(tuple(r) for r in S.depth(df, [16], **how).collect()) == sorted(depth.items())
    assert sorted(tuple(r) for r in S.depth(df, [16], 3, **how).collect()) == sorted((h, n) for h, n in depth.items() if n >= 3)
    assert sorted(tuple(r) for r in L.group_unique(df, "g", 16, **how).collect()) == sorted((min(g), h) for h, g in groups.items() if len(g) == 1)


def test_what_travels_is_less_than_the_hashes():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(2000)]
    text = " ".join(rng.choice(words, 60_000))
    data, offsets = A.text_bytes(pa.array([text]))
    rows = T._rows([(data, *T.cut(data, offsets, 16, False)[:3])], [])
    assert rows.nbytes < 4 * len(text)  # hashes: eight bytes for each of its k-mers


@pytest.mark.parametrize("min_depth", [0, 2])
@pytest.mark.parametrize("alone", [False, True])
def test_lineages_by_stretches_and_by_blocks(spark, small, monkeypatch, alone, min_depth):
    from kmerloom.operators import buckets
    from kmerloom.plans import commands as C

    texts = [*TEXTS, SHORT[:900], SHORT[500:1200], SHORT[600:1000]] * 2
    reads = spark.createDataFrame([(i, t, "xa xb ya".split()[i % 3] if i % 5 else None) for i, t in enumerate(texts)], "id long, seq string, name string").repartition(3)
    types = spark.createDataFrame([(7, SHORT[550:700], 0), (8, "nothing that is there, nor there", 1), (9, "ACGTTGCA" * 3, 2)], "id long, seq string, ord int")
    panel = None if alone else reads.filter("id % 4 > 0").select("seq", "name")
    found = lambda: sorted(map(str, C.lineages(reads, types, panel, [16], min_depth).collect()))
    refused = lambda *a, **k: pytest.fail("k-mers travel as hashes")
    with monkeypatch.context() as m:
        m.setattr(buckets, "group_counts", refused)
        m.setattr(buckets, "masked", refused)
        some = found()
    monkeypatch.setattr(T, "LEAST", 99)
    monkeypatch.setattr(C, "_best_types", lambda r, t, ks, n, **how: C.classify(r, t, ks, None, n, **how))
    assert some == found() and "shared=" in str(some)


def test_a_stream_writes_stretches(spark, tmp_path):
    """Depths over several batches are those of the table, and what is kept is less than eight bytes for each k-mer."""
    from kmerloom.streaming.classify import depth_totals, write_depths

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("etaoin shrdlu"), 20_000)) for _ in range(4)] + [*TEXTS, SHORT, SHORT]
    spark.createDataFrame([(t,) for t in texts], "seq string").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write_depths(stream, 16, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.select("batch").distinct().count() == 3
    want = Counter(f"{digest('md5', w):016x}" for t in texts for w in kmers(t, [16]))
    assert {r.hash: r.depth for r in depth_totals(found.drop("batch"), 16).collect()} == want
    assert sum(p.stat().st_size for p in tmp_path.glob("out/*/*.parquet")) < 7 * sum(want.values())


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("canonical,valid_only", [(False, False), (True, False), (True, True)])
def test_masks_by_stretches_and_by_hashes(spark, small, monkeypatch, apart, canonical, valid_only):
    from kmerloom.operators import buckets

    monkeypatch.setattr(T, "BLOCK", 700)
    texts = [*TEXTS, SHORT[:900], SHORT[500:1200], SHORT[600:1000], None, "", "short"]
    reads = spark.createDataFrame(list(enumerate(texts)), "id long, seq string").repartition(3)
    over = reads.filter("id % 2 = 0").union(reads.filter("id % 3 = 0")) if apart else None
    how = {"canonical": canonical, "valid_only": valid_only}
    for s in (20, None):
        found = lambda m, k: {r.id: r.sketch for r in m(reads, k, s, 2, over, **how).collect()}
        want = found(buckets.masked, [16])
        with monkeypatch.context() as m:
            m.setattr(buckets, "masked", lambda *a, **k: pytest.fail("k-mers travel as hashes"))
            got = {r.id: r.sketch for r in S.masked_sketches(reads, [16], s, 2, over, **how).collect()}
        assert got == want == found(T.masked, 16) and len(got) == len(texts)
        assert any(want.values()) or valid_only and apart  # few of these texts have such k-mers twice


def test_types_are_counted_where_the_kmers_meet(spark, small):
    """Shared hashes with every type, rare ones left out, without another pass over the rows; a type that nobody meets and one that all meet."""
    texts = [*TEXTS, SHORT[:900], SHORT[500:1200], SHORT[600:1000], SHORT[:900]]
    types = {1: SHORT[550:700], 2: "nothing that is there, nor there", 3: SHORT[100:700], 4: "short"}
    reads = spark.createDataFrame([(i, t, 1 + i % 2, 1) for i, t in enumerate(texts)], "id long, seq string, a long, b long").repartition(3)
    panel = spark.createDataFrame(list(types.items()), "place long, seq string")
    depth = Counter(w for t in texts for w in kmers(t, [16]))
    for least in (0, 2, 3):
        deep = {w for w, n in depth.items() if n >= least}
        want = {(i, p, n) for i, t in enumerate(texts) for p, u in types.items() if (n := len(set(kmers(t, [16])) & set(kmers(u, [16])) & deep))}
        got = T.group_counts(reads, 16, (2, 1), None, least, panel).filter("level = 2").collect()
        assert {(r.id, r.place, r.shared) for r in got} == want and len(got) == len(want) > 0
