import math
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import numpy as np

from kmerloom.llm import mixing, queries, sharding
from tests.llm.data import CLASHES, empty, odd


def test_shards(spark, tmp_path):
    docs = odd(spark)
    done = sharding.shards(docs, 4, bucket_bytes=2000)
    rows = done.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect()) and set(done.columns) == set(docs.columns) | {"size", "shard", "slot"}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == len((r.text or "").encode()) + 16 and r.score == "x"
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {(r.shard, r.slot): (r.doc_id, r.text) for r in sharding.shards(docs.repartition(7), 4, bucket_bytes=2000).collect()}
    assert again == {(r.shard, r.slot): (r.doc_id, r.text) for r in rows}, "the order depends on rows and seed alone"
    assert [r.doc_id for r in sharding.shards(docs, 4, seed=2, bucket_bytes=2000).orderBy("slot", "shard").collect()] != [r.doc_id for r in done.orderBy("slot", "shard").collect()]
    assert sharding.shards(empty(spark), 4).count() == 0
    sharding.write_shards(done, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


def test_order_is_a_replay_of_both_passes(spark):
    """The same buckets and permutations by plain Python: hash of all columns, rows in the fixed order, swaps from the end."""
    from pyspark.sql import functions as F

    docs = odd(spark, clashes=False).select("doc_id", "text")
    n, seed = docs.count(), 3
    keyed = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))
    buckets = sharding.LEAST_BUCKETS
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(0).cast("long")), F.lit(buckets))).collect()
    order = []
    for b in range(buckets):
        rows = sorted((r for r in keyed if r.bucket == b), key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        places = list(range(len(rows)))
        picks = np.random.default_rng([seed, b]).integers(0, np.arange(1, len(rows) + 1)) if rows else []
        for i in range(len(rows) - 1, 0, -1):
            places[i], places[picks[i]] = places[picks[i]], places[i]
        order += [(rows[p].doc_id, rows[p].text) for p in places]
    got = sharding.shards(docs, 7, seed=seed).collect()
    starts = [s * n // 7 for s in range(8)]
    assert {(r.shard, r.slot): (r.doc_id, r.text) for r in got} == {(s, p - starts[s]): order[p] for s in range(7) for p in range(starts[s], starts[s + 1])}


def test_equal_rows_fill_no_bucket(spark):
    """A third of all rows is one and the same: its copies are dealt over all buckets, in the same order however the input lies."""
    rows = [(7, "the same text again " * 5)] * 3000 + [(i, f"text {i}") for i in range(100, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sharding.shards(docs.repartition(k), 40, bucket_bytes=20_000).collect() for k in (3, 8)]
    assert {(r.shard, r.slot): (r.doc_id, r.text) for r in runs[0]} == {(r.shard, r.slot): (r.doc_id, r.text) for r in runs[1]}
    assert Counter((r.doc_id, r.text) for r in runs[0]) == Counter(rows)
    per = Counter(r.shard for r in runs[0] if r.doc_id == 7)
    assert len(per) == 40 and max(per.values()) < 3 * min(per.values())
    by = defaultdict(list)
    for r in runs[0]:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_pass_two_writes_the_shards_in_order(spark, tmp_path):
    docs = odd(spark, clashes=False)
    done = sharding.shards(docs, 5, bucket_bytes=2000)
    sharding.write_shards(done, str(tmp_path / "s"))
    import glob

    import pyarrow.parquet as pq

    want = defaultdict(list)
    for r in sorted(done.collect(), key=lambda r: (r.shard, r.slot)):
        want[r.shard].append((r.doc_id, r.text))
    for shard, rows in want.items():
        files = [pq.ParquetFile(f).read().to_pylist() for f in glob.glob(f"{tmp_path}/s/shard={shard}/*.parquet")]
        assert all([r["slot"] for r in f] == list(range(f[0]["slot"], f[0]["slot"] + len(f))) for f in files)
        assert [(r["doc_id"], r["text"]) for f in sorted(files, key=lambda f: f[0]["slot"]) for r in f] == rows
    plan = done.sortWithinPartitions("shard", "slot")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(shard" not in plan


def test_fisher_yates_is_even():
    seen = Counter(tuple(sharding.fisher_yates(4, np.random.default_rng(i))) for i in range(24_000))
    assert len(seen) == 24 and all(800 < n < 1200 for n in seen.values())


def fill(budget, nodes):
    """Shares by repeated passes: nodes are (weight, capacity)."""
    share, open_ = [0.0] * len(nodes), set(range(len(nodes)))
    while open_ and budget > 1e-9:
        total = sum(nodes[i][0] for i in open_)
        if not total:
            break
        full = {i for i in open_ if nodes[i][1] - share[i] <= budget * nodes[i][0] / total + 1e-9}
        for i in full:
            budget -= nodes[i][1] - share[i]
            share[i] = nodes[i][1]
        if not full:
            for i in open_:
                share[i] += budget * nodes[i][0] / total
            return share
        open_ -= full
    return share


def brute_mix(rows, fraction, epochs):
    """rows: (doc_id, path, tokens)."""
    leaves = defaultdict(list)
    for doc_id, path, n in rows:
        leaves[path].append((doc_id, n))
    cap = {p: epochs * sum(n for _, n in v) for p, v in leaves.items()}
    budget = {(): min(sum(cap.values()), int(sum(n for *_, n in rows) * fraction))}
    for depth in (1, 2, 3):
        for parent in {p[: depth - 1] for p in leaves}:
            kids = sorted({p[:depth] for p in leaves if p[: depth - 1] == parent})
            got = fill(budget[parent], [(queries.WEIGHTS.get(k, 1.0), sum(c for p, c in cap.items() if p[:depth] == k)) for k in kids])
            budget.update(zip(kids, got))
    out = Counter()
    for p, docs in leaves.items():
        t, b = sum(n for _, n in docs), math.floor(budget[p] + 0.0005)
        whole = b // t if t else 0
        for e in range(whole):
            out.update((i, e) for i, _ in docs)
        at = 0
        for i, n in sorted(docs, key=lambda d: (md5(f"mix:{whole}:{d[0]}".encode()).hexdigest(), d[0])):
            if at < b - whole * t:
                out[(i, whole)] += 1
            at += n
    return out


def test_mix_equals_brute_force_and_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    domain = lambda s: "web" if s in queries.WEB else "books" if s in queries.BOOKS else "other"
    rows = [(r.doc_id, (domain(r.source), r.lang, r.source), len(r.text.split())) for r in docs.collect()]
    for fraction, epochs in ((0.6, 3), (0.9, 1), (2.5, 4)):
        got = Counter((r.doc_id, r.epoch) for r in mixing.mix(docs, queries.levels(), queries.WEIGHTS, fraction, epochs).collect())
        assert got == brute_mix(rows, fraction, epochs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    cols = ["doc_id", "domain", "lang", "source", "epoch", "tokens"]
    sql = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.MIX_SQL})").fetchall()
    assert sorted(sql) == sorted(map(tuple, queries.op6_hierarchical_mix(spark, "/root/testdata/sf0.001").select(*cols).collect()))


def test_mix_odd_rows(spark):
    docs = odd(spark)
    done = mixing.mix(docs, queries.levels(), queries.WEIGHTS, 0.5, 2)
    rows = done.collect()
    assert rows and all(c in done.columns for c in CLASHES if c not in ("tokens", "epoch")) and {r.score for r in rows} == {"x"}
    assert mixing.mix(docs, queries.levels(), queries.WEIGHTS, 1.0, 1).count() >= docs.filter("length(trim(text)) > 0").count()
    assert mixing.mix(empty(spark), queries.levels(), {}, 0.5).count() == 0
