"""Many-class models on hashed features with products of features, by an error-correcting tournament of binary learners.

Classes meet in elimination rounds: in every round the classes still in it are paired, a binary learner for each match says which one goes on, and the loser drops into the next lower bracket; after ``lives``
losses a class is out. The last class left is the answer, so a match that is decided wrongly costs a life, not the answer. Which learner meets which pair is the same for every row.

Learners are trained in all partitions at once: every task makes passes over its own rows from the averaged weights of the pass before, and hands on
its weights and number of rows, which are averaged. Driver and tasks hold the weights of all learners, ``classes (classes - 1) / 2 * buckets`` numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of all learners there may be (8 bytes each).
MOST = 1 << 25


def hashed_features(weights: list[tuple[str, float]], buckets: int, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of a row's features by name, of the products of up to ``order`` of them (a feature with itself too), and of a constant."""
    names = sorted((n, float(v)) for n, v in weights if v)
    out: dict[int, float] = {crc32(b"constant") % buckets: 1.0}
    for size in range(1, order + 1):
        for chosen in combinations_with_replacement(names, size):
            at = crc32("\x1f".join(n for n, _ in chosen).encode()) % buckets
            out[at] = out.get(at, 0.0) + float(np.prod([v for _, v in chosen]))
    at = np.fromiter(out, np.int64, len(out))
    values = np.fromiter(out.values(), float, len(out))
    return at, values / max(1.0, float(np.linalg.norm(values)))


@dataclass
class Tournament:
    """``weights[m]`` is the learner of the m-th pair of ``classes``; above 0 the first class of the pair wins."""

    classes: list[str]
    weights: np.ndarray
    lives: int = 2
    order: int = 2

    def pairs(self) -> dict[tuple[int, int], int]:
        return {p: m for m, p in enumerate(combinations(range(len(self.classes)), 2))}

    def play(self, at: np.ndarray, values: np.ndarray) -> str:
        """The class left over for one row."""
        margins, pairs = self.weights[:, at] @ values, self.pairs()
        left = dict.fromkeys(range(len(self.classes)), self.lives)
        while len(left) > 1:
            brackets: dict[int, list[int]] = {}
            for c, lives in left.items():
                brackets.setdefault(lives, []).append(c)
            matches = [(a, b) for own in brackets.values() for a, b in zip(own[::2], own[1::2])]
            if not matches:  # one class in each bracket: the two with the fewest lives meet
                a, b = sorted(sorted(left, key=lambda c: (left[c], c))[:2])
                matches = [(a, b)]
            for a, b in matches:
                a, b = min(a, b), max(a, b)
                loser = b if margins[pairs[a, b]] > 0 else a
                left[loser] -= 1
                if not left[loser]:
                    del left[loser]
        return self.classes[next(iter(left))]


def _rows(batch: pa.RecordBatch, buckets: int, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for features in batch["features"].to_pylist():
        yield hashed_features(features or [], buckets, order)


def train(rows: DataFrame, classes: list[str], buckets: int = 1 << 14, order: int = 2, lives: int = 2, passes: int = 10, rate: float = 1.0, penalty: float = 1e-4) -> Tournament:
    """A tournament learned from ``rows(label, features map<string,double>)`` by logistic loss: a row teaches the matches of its own class. Rows of other labels, or without one, teach nothing; null features are none.

    ``passes`` are jobs, each of which starts from the average of the one before, weighted by rows; a lost task makes its own pass again.
    """
    pairs = list(combinations(range(len(classes)), 2))
    if len(pairs) * buckets > MOST:
        raise ValueError(f"{len(pairs)} learners of {buckets} weights are more than {MOST}")
    number = {c: i for i, c in enumerate(classes)}
    own = [[(m, 1.0 if p[0] == c else -1.0) for m, p in enumerate(pairs) if c in p] for c in range(len(classes))]
    table = rows.filter(F.col("label").isin(classes)).select("label", "features")
    weights = np.zeros((len(pairs), buckets))
    context = rows.sparkSession.sparkContext
    for turn in range(passes):
        shared, step = context.broadcast(weights), rate / (1 + turn) ** 0.5

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, n = shared.value.copy(), 0
            for batch in batches:
                for label, (at, values) in zip(batch["label"].to_pylist(), _rows(batch, buckets, order)):
                    n += 1
                    match, sign = (np.array(x) for x in zip(*own[number[label]]))
                    block = np.ix_(match, at)
                    margin = sign * (w[block] @ values)
                    w[block] += step * ((sign / (1 + np.exp(np.clip(margin, -50, 50))))[:, None] * values[None, :] - penalty * w[block])
            if n:
                for m in range(len(pairs)):
                    yield pa.RecordBatch.from_pydict({"learner": pa.array([m], pa.int32()), "n": pa.array([n], pa.int64()), "w": [(w[m] * n).tobytes()]})

        def total(group: pa.Table) -> pa.Table:
            w = sum(np.frombuffer(x) for x in group["w"].to_pylist())
            return pa.table({"learner": pa.array([group["learner"][0].as_py()], pa.int32()), "n": pa.array([sum(group["n"].to_pylist())], pa.int64()), "w": [w.tobytes()]})

        kind = "learner int, n long, w binary"
        parts = table.mapInArrow(learn, kind).withColumn("way", F.pmod(F.spark_partition_id(), F.lit(64)))
        some = parts.groupBy("learner", "way").applyInArrow(lambda g: total(g.drop_columns("way")), kind)
        weights = weights.copy()
        for r in some.groupBy("learner").applyInArrow(total, kind).toLocalIterator():
            weights[r.learner] = np.frombuffer(r.w) / r.n
        shared.unpersist()
    return Tournament(list(classes), weights, lives, order)


def predict(rows: DataFrame, model: Tournament) -> DataFrame:
    """``rows(features map<string,double>, ...)`` with ``predicted``: the class that is left."""
    shared, buckets = rows.sparkSession.sparkContext.broadcast(model), model.weights.shape[1]

    @F.pandas_udf("string")
    def played(features: pd.Series) -> pd.Series:
        found = shared.value
        return pd.Series([found.play(*hashed_features(list((f or {}).items()), buckets, found.order)) for f in features], dtype=object)

    return rows.withColumn("predicted", played("features"))
