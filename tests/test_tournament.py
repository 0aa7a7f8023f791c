import random

import numpy as np
import pytest

from kmerloom.operators import tournament as T


def samples(spark, n, seed):
    """Five classes, two of which differ in the product of two features alone."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b = rng.choice([-1.0, 1.0]), rng.choice([-1.0, 1.0])
        kind = rng.choice("pqr")
        label = ("same" if a * b > 0 else "other") if kind == "p" else kind if kind == "q" else rng.choice(["r1", "r2"])
        features = {"a": a, "b": b, f"kind_{kind}": 1.0} | ({label: 1.0} if kind == "r" else {})
        rows.append((i, label, features | {"noise": rng.gauss(0, 0.2)}))
    return spark.createDataFrame([*rows, (n, None, {"a": 1.0}), (n + 1, "unknown", None)], "id long, label string, features map<string,double>")


CLASSES = ["other", "q", "r1", "r2", "same"]


def right(df):
    rows = [r for r in df.collect() if r.label in CLASSES]
    return sum(r.label == r.predicted for r in rows) / len(rows)


def test_held_out_rows(spark):
    """Products of features tell classes apart that single ones can't; one wrong learner costs a life, not the answer."""
    train, test = samples(spark, 500, 1).repartition(3), samples(spark, 200, 2)
    crossed = T.train(train, CLASSES, 1 << 12, order=2, passes=8)
    plain = T.train(train, CLASSES, 1 << 12, order=1, passes=8)
    assert right(T.predict(test, crossed)) > 0.97 and right(T.predict(test, plain)) < 0.95
    spoiled = T.Tournament(CLASSES, crossed.weights.copy(), lives=3)
    spoiled.weights[spoiled.pairs()[1, 2]] *= -1  # q against r1 is always decided wrongly
    single = T.Tournament(CLASSES, spoiled.weights, lives=1)
    assert right(T.predict(test, spoiled)) >= right(T.predict(test, single))


def test_every_class_can_win():
    """With right learners the right class wins from every place, for any number of classes and lives."""
    for n in range(1, 9):
        for lives in (1, 2, 3):
            classes = [str(i) for i in range(n)]
            for won in range(n):
                t = T.Tournament(classes, np.zeros((max(1, n * (n - 1) // 2), 1)), lives)
                for (a, b), m in t.pairs().items():
                    t.weights[m, 0] = 1.0 if a == won else -1.0
                assert t.play(np.array([0]), np.array([1.0])) == classes[won]


def test_features_and_bounds(spark):
    at, values = T.hashed_features([("b", 2.0), ("a", 1.0), ("zero", 0.0)], 1 << 20, 2)
    assert len(at) == 1 + 2 + 3 and np.isclose(np.linalg.norm(values), 1.0)
    assert T.hashed_features([], 8)[1].tolist() == [1.0]
    with pytest.raises(ValueError):
        T.train(spark.createDataFrame([], "label string, features map<string,double>"), [str(i) for i in range(300)], 1 << 14)
    empty = T.train(spark.createDataFrame([], "label string, features map<string,double>"), ["x", "y"], 8, passes=1)
    assert not empty.weights.any()
