import itertools
import zlib

import numpy as np

from kmerloom.llm import quality, toxicity
from tests.llm.data import empty, odd

D = "/root/testdata/sf0.1"


def held_out(spark, scored, label):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    return [(r.score, r.predicted, r.y, r.held_out, r.doc_id) for r in scored.join(labels.selectExpr("doc_id", f"{label} as y"), "doc_id").collect()]


def auc(rows):
    s = np.array([r[0] for r in rows])
    y = np.array([r[2] for r in rows])
    good, bad = s[y == 1], s[y == 0]
    return float((good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean())


def test_quality_on_held_out_labels(spark):
    rows = held_out(spark, quality.quality(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")), "quality")
    assert all(r[3] == (zlib.crc32(str(r[4]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r[3]]
    assert auc(out) > 0.98 and np.mean([p == y for _, p, y, *_ in out]) > 0.97


def test_toxicity_on_held_out_labels(spark):
    rows = held_out(spark, toxicity.toxicity(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")), "toxic")
    assert all(r[3] == (zlib.crc32(str(r[4]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r[3]]
    assert auc(out) > 0.94 and np.mean([p == y for _, p, y, *_ in out]) > 0.97
    clean = [p for _, p, y, *_ in out if y == 0]
    assert np.mean(clean) < 0.01


def test_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(40)] + [(None, 1, 1), (5, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for run, cut in ((quality.quality, 0.7), (toxicity.toxicity, 0.5)):
        got = run(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) and r.held_out is not None for r in got)
        assert len({r.score for r in got if r.doc_id in (0, 58, 59)}) == 1
        assert run(empty(spark), labels).count() == 0
        assert run(docs, labels.limit(0)).count() == docs.count()
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_marginals_equal_enumeration():
    field = toxicity.Field(-1.2, {"=bad": 2.5, "mea": 1.1}, np.array([[0.4, -0.7], [-0.2, 0.6]]), frozenset(), np.zeros(5))
    for n, spots in ((1, [(0, 2.5)]), (5, [(1, 2.5), (4, 1.1)]), (7, [(0, 1.1), (1, 2.5), (6, 0.3)]), (6, [(3, 2.5)])):
        score = np.zeros(n)
        for i, e in spots:
            score[i] = e
        total, hit = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=n):
            x = sum((field.bias + score[i]) * s for i, s in enumerate(states)) + sum(field.move[a, b] for a, b in zip(states, states[1:]))
            total += np.exp(x)
            hit += np.exp(x) * np.array(states)
        want = hit / total
        assert np.allclose(field.marginals(n, spots), [want[i] for i, _ in spots])
        p, moves, z = toxicity._expected(np.array([field.bias + score]), np.array([n]), field.move)
        assert np.allclose(p[0], want) and np.isclose(z[0], np.log(total)) and np.isclose(moves.sum(), n - 1)


def test_spans_point_at_the_words():
    clean = ["the quick brown fox jumps over it again and again today"] * 40
    toxic = [f"the quick brown idiot number {w} jumps over it" for w in "abcdefgh" for _ in range(3)]
    field = toxicity.train([(t, 0) for t in clean] + [(t, 1) for t in toxic])
    _, spans = field.read("Over there the IDIOT jumps")
    assert [("Over there the IDIOT jumps")[a:b] for a, b in spans] == ["IDIOT"]
    assert field.read("the fox jumps")[1] == []


def test_offsets_hold_where_lower_case_is_longer():
    """A dotted capital I becomes two characters in lower case; spans count those of the text itself."""
    field = toxicity.train([("the quick brown fox jumps over it again", 0)] * 40 + [(f"the quick brown idiot number {w} jumps", 1) for w in "abcdefgh" for _ in range(3)])
    text = "İİ over İstanbul the IDIOT jumps"
    assert [text[a:b] for a, b in field.read(text)[1]] == ["IDIOT"]
    assert len(toxicity.lowered(text)) == len(text)
