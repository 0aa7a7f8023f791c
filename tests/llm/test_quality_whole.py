import random
import zlib

import numpy as np

from kmerloom.llm import quality


def graded(n, seed=7):
    """(id, text, label) with some labels of either kind the wrong way round."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.6
        words = "some plain words of a quiet text about rivers".split() if good else "BUY | !!! 777 click now text of words".split()
        out.append((i, " ".join(rng.choices(words, k=rng.randint(3, 30))) + rng.choice([".", "", " !"]), int(good != (rng.random() < 0.1))))
    return out


def test_all_pairs_and_the_best_cut(spark):
    """The slope of the loss over every pair is zero, and no cut of the scores agrees with more labels."""
    rows = graded(400)
    x, y = np.array([quality.raw_features(t) for _, t, _ in rows]), np.array([v for *_, v in rows])
    train = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "x array<double>, y int").repartition(3)
    model = quality.fit(train)
    wide = quality.widened(x)
    assert np.allclose(model.mean, wide.mean(0)) and np.allclose(model.scale, wide.std(0) + 1e-6)
    z = quality.leveled(wide, model.mean, model.scale)
    apart = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    slope = 1e-4 * model.weights - (apart / (1 + np.exp(apart @ model.weights))[:, None]).mean(0)
    assert np.abs(slope).max() < 1e-6
    raw = model.raw(wide)
    right = lambda cut: ((raw >= cut) == (y == 1)).sum()
    assert right(model.cut) == max(right(c) for c in [*raw, raw.max() + 1]) and np.isclose(model.width, raw.std() / 4)
    for q in (0.1, 0.5):
        cut = quality.fit(train, q).cut
        assert abs((raw < cut).sum() - round(q * len(raw))) == min(abs((raw < c).sum() - round(q * len(raw))) for c in [*raw, raw.max() + 1])


def test_no_labelled_row_is_left_out(spark, monkeypatch):
    """More labelled rows than were once taken: every one that isn't held out is learned from, each id once."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda train, quantile=None: seen.append(train) or quality.constant(0, 0))
    rows = graded(9000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, _, v in rows if i % 20] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert quality.quality(docs, labels).count() == 9001
    want = [(t, v) for i, t, v in rows if i % 20 and zlib.crc32(str(i).encode()) % 4 != 2]
    got = seen[0].collect()
    assert len(got) == len(want) > 6000 and sum(r.y for r in got) == sum(v for _, v in want)
    assert np.allclose(np.sum([r.x for r in got], 0), np.sum([quality.raw_features(t) for t, _ in want], 0))
