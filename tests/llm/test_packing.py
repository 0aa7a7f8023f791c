import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from kmerloom.llm import packing, queries
from tests.llm.data import empty, odd


def check(spark, docs, size, **options):
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    own = Tokenizer.from_file(queries.TOKENIZER[0])
    want = defaultdict(list)
    for i, t in texts:
        want[i].append([*own.encode(t, add_special_tokens=False).ids, 1])
    rows = packing.pack(docs, queries.TOKENIZER, size, with_ids=True, **options).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    for i, lists in want.items():
        if len(lists) == 1:
            got = sorted(pieces[i], key=lambda r: r.start)
            assert sum((r.ids for r in got), []) == lists[0] and all(r.doc_tokens == len(lists[0]) for r in got)
        else:
            assert sum(r.length for r in pieces[i]) == sum(map(len, lists))
    return len(sequences), sum(map(len, sum(want.values(), [])))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(6)
    n, tokens = check(spark, docs, 2048, width=32)
    assert tokens / (n * 2048) > 0.93
    n2, _ = check(spark, docs, 2048, width=2, fan_in=2)
    assert n2 >= n


def test_odd_rows(spark):
    check(spark, odd(spark), 64)
    assert packing.pack(empty(spark), queries.TOKENIZER).count() == 0


def test_packer_places_best_fit_and_closes_the_fullest():
    done = {}
    p = packing.Packer(10, 2, lambda n, held: done.setdefault(n, held))
    for length, name in ((6, "a"), (3, "b"), (4, "c"), (8, "d"), (1, "e")):
        p.put(length, name)
    # b goes beside a (room 1); c opens the second window; d fits neither, so the fullest (a, b) closes; e goes beside d, where it leaves less room than beside c
    assert done == {0: [(0, "a"), (6, "b")]} and [[x for _, x in p.held[n]] for n in (1, 2)] == [["c"], ["d", "e"]]
    q = packing.Packer(10, 1, lambda n, held: done.setdefault(("q", n), held))
    q.put(6, "a")
    q.put(7, "b")
    assert done[("q", 0)] == [(0, "a")] and len(q.open) == 1
