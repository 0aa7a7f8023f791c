"""Quality by Bradley-Terry ranking: scores learned from all preference pairs of the labelled texts, cut at a score quantile."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import arrow_map, durable

_DIGITS = re.compile(r"\d+")
_MARKS = re.compile(r"[^\w\s]+")


def raw_features(text: str) -> list[float]:
    """Shape of a whole text: lengths, repetition, case, marks. No label, language, source or id enters."""
    words, lines = text.split(), text.split("\n")
    n, chars = len(words), max(1, len(text) - text.count(" "))
    unique = len(set(words))
    again = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    upper = sum(map(str.isupper, words))
    marked = sum(len(m) for m in _MARKS.findall(text)) / chars
    bare = sum(w[-1].isalnum() for w in words)
    odd = sum(not (w[-1].isalnum() or w[-1] in ".,;:?") for w in words)
    longest = max(map(len, words), default=0)
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    m = max(1, n)
    return [
        np.log1p(n), np.log1p(chars / m), np.log1p(longest), again / m, unique / m, np.log1p(unique) / np.log1p(m), upper / m, marked, bare / m, odd / m,
        stops / m, sum(map(len, _DIGITS.findall(text))) / chars, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), text.count("|") / m, float(n == 0),
    ]


#: Numbers that ``raw_features`` gives.
RAW = 16


def features(texts: list[str]) -> np.ndarray:
    return widened(np.array([raw_features(t) for t in texts], float).reshape(len(texts), RAW))


def widened(x: np.ndarray) -> np.ndarray:
    """Shares also enter as roots and as 'more than a trace', so that a partly spoilt text stands out."""
    shares = x[:, [3, 6, 7, 9, 11, 12, 14]]
    return np.hstack([x, np.sqrt(shares), np.minimum(1, shares / 0.03), x[:, [4]] * x[:, [0]], (x[:, [5]] - 0.9) ** 2])


def leveled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # raw score at the chosen quantile
    width: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return leveled(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the raw score; 0.7 exactly at the quantile's cut."""
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.width + np.log(0.7 / 0.3), -40, 40)))


def newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Logistic loss of x @ w against y in {0, 1}, mean over rows, with a ridge; Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(x) + ridge * w
        h = (x * (p * (1 - p) / len(x))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def constant(good: int, bad: int) -> Ranker:
    """The ranker of labels of one kind only, or none."""
    k = features([""]).shape[1]
    share = 0.9 if good else 0.1 if bad else 0.5
    return Ranker(np.zeros(k), np.ones(k), np.zeros(k), np.log(0.7 / 0.3) - np.log(share / (1 - share)), 1.0)


def learn(sample: list[tuple[str, int]], pairs: int = 60_000, seed: int = 5, quantile: float | None = None) -> Ranker:
    """Of few texts in memory, over random pairs of a good and a bad one (``fit`` takes all pairs of a table): P(a preferred to b) = logistic(w (a - b)).

    Scores are cut at ``quantile`` of the sample's scores (0.25: a quarter of the texts falls below); without one, at the quantile that
    agrees best with the sample's labels (ties: the middle one). With labels of one kind only there are no pairs: every score is then that kind's (0.9 or 0.1), 0.5 without any label.
    """
    x, y = features([t for t, _ in sample]), np.array([v for _, v in sample])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return constant(len(good), len(bad))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    sign = np.where(rng.random(pairs) < 0.5, 1.0, -1.0)  # both orders, so that both answers occur
    weights = newton((z[a] - z[b]) * sign[:, None], (sign > 0).astype(float), 1e-4)
    raw = z @ weights
    order = np.argsort(raw)
    right = np.concatenate([[0], np.cumsum(y[order] == 0)]) + (y == 1).sum() - np.concatenate([[0], np.cumsum(y[order] == 1)])
    best = np.flatnonzero(right == right.max())
    k = int(best[len(best) // 2]) if quantile is None else round(quantile * len(raw))  # so many of the sample fall below
    edge = np.concatenate([[raw[order[0]] - 1], raw[order], [raw[order[-1]] + 1]])
    cut = (edge[k] + edge[k + 1]) / 2
    return Ranker(mean, scale, weights, float(cut), float(max(1e-3, raw.std() / 4)))


# --- all pairs of a table: rows meet by their scores, so a step's work is that of the rows, not of their pairs

#: Scores meet in bins so wide, with the powers 0 to ORDER of the distance from a bin's middle; a pair's chance is then right to 1e-7.
BIN, ORDER = 1 / 16, 3
#: Weights' ridge, and the norm they can't exceed by it.
RIDGE, NORM = 1e-4, 120.0
Sums = tuple[np.ndarray, np.ndarray]


def merged(parts: list[Sums]) -> Sums:
    """Rows of numbers summed by key."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    values = np.zeros((len(keys), parts[0][1].shape[1]))
    np.add.at(values, at, np.concatenate([v for _, v in parts]))
    return keys, values


def summed(train: DataFrame, work: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums | None:
    """What ``work`` makes of the features and labels of each batch of ``train(x, y)``, summed by its keys in the tasks and again in the driver; None of no row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, y in map(_arrays, batches):
            if len(y):
                total = merged([work(x, y)] if total is None else [total, work(x, y)])
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(total)], pa.binary())})

    made = [pickle.loads(r.sums) for r in train.select("x", "y").mapInArrow(part, "sums binary").collect()]
    return merged(made) if made else None


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _features(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _features(column: pa.Array) -> np.ndarray:
    return widened(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, RAW))


def binned(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Sums:
    """By bin and label (2 bin + label) the sums of (1, z) times each power of the score's distance from the bin's middle."""
    s = z @ weights
    b = np.floor(s / BIN).astype(np.int64)
    d = s - (b + 0.5) * BIN
    order = np.argsort(2 * b + y, kind="stable")
    keys, starts = np.unique((2 * b + y)[order], return_index=True)
    one = np.hstack([np.ones((len(z), 1)), z])[order]
    return keys, np.hstack([np.add.reduceat(one * (d[order] ** k)[:, None], starts) for k in range(ORDER + 1)])


class Meeting:
    """Mean logistic loss of all pairs of a good and a bad row with its slope, and each bin's weight in the curvature, from ``binned``'s sums."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weights: np.ndarray):
        self.low = int(keys.min() // 2)
        n, cols = int(keys.max() // 2) - self.low + 1, len(weights) + 1
        kinds = np.zeros((2, n, ORDER + 1, cols))
        kinds[keys % 2, keys // 2 - self.low] = values.reshape(len(keys), ORDER + 1, cols)
        bad, good = kinds
        self.pairs = bad[:, 0, 0].sum() * good[:, 0, 0].sum()
        size = 1 << (2 * n).bit_length()
        apart = BIN * ((np.arange(size) + size // 2) % size - size // 2)  # of a bin that lies so many bins higher, around the ring
        p = 1 / (1 + np.exp(-np.clip(apart, -700, 700)))
        slope = p * (1 - p)
        chance = [p, slope, slope * (1 - 2 * p), slope * (1 - 6 * slope)]
        cost = [np.logaddexp(0, apart), *chance[:3]]

        def met(mass: np.ndarray, kernel: np.ndarray) -> np.ndarray:
            """For each bin the sum of all bins' masses times the kernel of how far they lie above it."""
            wave = np.conj(np.fft.rfft(kernel))
            return np.fft.irfft(np.fft.rfft(mass, size, axis=0) * (wave[:, None] if mass.ndim > 1 else wave), size, axis=0)[:n]

        def total(own: np.ndarray, other: np.ndarray, kernels: list[np.ndarray], up: bool) -> np.ndarray:
            """Sum over all pairs of own (1, z) times the kernel of the bad score less the good one; ``up``: own rows are the good ones."""
            out = np.zeros(cols)
            for k in range(ORDER + 1):
                for m in range(ORDER + 1 - k):
                    kernel = kernels[k + m] if up else kernels[k + m][-np.arange(size)]
                    sign = (-1) ** (k if up else m)
                    out += sign / (factorial(k) * factorial(m)) * (met(other[:, m, 0], kernel) @ own[:, k])
            return out

        self.loss = total(good, bad, cost, True)[0] / self.pairs + RIDGE / 2 * weights @ weights
        self.gradient = (total(bad, good, chance, False) - total(good, bad, chance, True))[1:] / self.pairs + RIDGE * weights
        self.bends = np.array([met(good[:, 0, 0], slope), met(bad[:, 0, 0], slope)]) / self.pairs
        across = good[:, 0, 1:].T @ met(bad[:, 0, 1:], slope) / self.pairs
        self.across = across + across.T

    def bent(self, z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Sums:
        """The rows' own part of the curvature, all scores in the middle of their bins."""
        b = np.clip(np.floor(z @ weights / BIN).astype(np.int64) - self.low, 0, self.bends.shape[1] - 1)
        return np.zeros(1, np.int64), ((z * np.maximum(0, self.bends[y, b])[:, None]).T @ z).reshape(1, -1)


def fit(train: DataFrame, quantile: float | None = None) -> Ranker:
    """Bradley-Terry over all pairs of a good and a bad row of ``train(x, y)``: P(a preferred to b) = logistic(w (a - b)), Newton steps, each two passes over all rows.

    Scores are cut at ``quantile`` of all rows' scores, else where most of the rows are on the side of their label (ties: in the middle). The driver
    holds sums by bin of the score alone. Labels of one kind: see ``constant``.
    """
    sums = summed(train, lambda x, y: (y, np.hstack([np.ones((len(y), 1)), x])))
    n = {int(k): int(v[0]) for k, v in zip(*sums)} if sums else {}
    if len(n) < 2:
        return constant(n.get(1, 0), n.get(0, 0))
    mean = sums[1][:, 1:].sum(0) / sum(n.values())
    apart = summed(train, lambda x, y: (np.zeros(1, np.int64), ((x - mean) ** 2).sum(0, keepdims=True)))
    scale = np.sqrt(apart[1][0] / sum(n.values())) + 1e-6

    def meeting(w: np.ndarray) -> Meeting:
        return Meeting(*summed(train, lambda x, y: binned(leveled(x, mean, scale), y, w)), w)

    weights = np.zeros(len(mean))
    now = meeting(weights)
    for _ in range(50):
        h = summed(train, partial(lambda x, y, now, w: now.bent(leveled(x, mean, scale), y, w), now=now, w=weights))[1][0].reshape(len(mean), -1)
        step = np.linalg.solve(h - now.across + RIDGE * np.eye(len(mean)), now.gradient)
        while True:
            tried = weights - step
            tried *= min(1, NORM / max(NORM, np.linalg.norm(tried)))
            then = meeting(tried)
            if then.loss <= now.loss + 1e-12 or np.abs(step).max() < 1e-6:
                break
            step = step / 2
        moved = np.abs(tried - weights).max()
        weights, now = tried, then
        if moved < 1e-6 or np.abs(now.gradient).max() < 1e-7:
            break
    return _cut(train, Ranker(mean, scale, weights, 0.0, 1.0), n, quantile)


def _cut(train: DataFrame, ranker: Ranker, n: dict[int, int], quantile: float | None) -> Ranker:
    """``ranker`` with its cut and width: equal scores are one row, running counts are those of its range and of the ranges below."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in map(_arrays, batches):
            yield pa.RecordBatch.from_pydict({"raw": pa.array(ranker.raw(x)), "y": pa.array(y, pa.int64())})

    each = train.select("x", "y").mapInArrow(scored, "raw double, y long").groupBy("raw").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    ranges = durable(each.orderBy("raw").withColumn("p", F.spark_partition_id()))
    sizes = ranges.groupBy("p").agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum(F.col("raw") * F.col("n")).alias("s")).orderBy("low").collect()
    below, good, before, starts = 0, 0, sizes[0].low - 2, []
    for r in sizes:
        starts.append((r.p, below, good, before))
        below, good, before = below + r.n, good + r.good, r.high
    over = Window.partitionBy("p").orderBy("raw")
    run = over.rowsBetween(Window.unboundedPreceding, -1)
    known = F.broadcast(train.sparkSession.createDataFrame(starts, "p int, n0 long, good0 long, before double"))
    cuts = ranges.join(known, "p").select(
        "raw", F.coalesce(F.lag("raw").over(over), "before").alias("prev"), (F.col("n0") + F.coalesce(F.sum("n").over(run), F.lit(0))).alias("below"),
        (F.col("good0") + F.coalesce(F.sum("good").over(run), F.lit(0))).alias("lost"),
    )
    end = train.sparkSession.createDataFrame([(before + 2, before, below, good)], "raw double, prev double, below long, lost long")  # behind all of them
    cuts = durable(cuts.unionByName(end).withColumn("right", F.col("below") - F.col("lost") + (n[1] - F.col("lost"))))
    if quantile is None:
        best = cuts.filter(F.col("right") == cuts.agg(F.max("right")).first()[0])
        ends = best.agg(F.min("raw"), F.max("raw")).first()
        off = F.abs(F.col("raw") - (ends[0] + ends[1]) / 2)
    else:
        best, off = cuts, F.abs(F.col("below") - round(quantile * below)).cast("double")
    at = best.agg(F.min(F.struct(off.alias("off"), "raw", "prev")).alias("at")).first()["at"]
    middle = sum(r.s for r in sizes) / below
    spread_ = ranges.agg(F.sum(F.col("n") * (F.col("raw") - middle) ** 2)).first()[0]
    return Ranker(ranker.mean, ranker.scale, ranker.weights, (at.raw + at.prev) / 2, max(1e-3, float(np.sqrt(spread_ / below)) / 4))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, cut: float = 0.7, quantile: float | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, from a ranker fitted on all labelled rows whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``, cut at ``quantile`` of their scores (see ``fit``).

    Whole texts, read once: their features (128 bytes a row) are kept in the shared folder, learned from where there is a label, and scored. Null text is empty; null ids keep their rows
    (held_out false); repeated rows get equal scores; other columns are ignored. Labels without an id or value are left out; of several labels of an id the largest holds, of several texts that of the smallest hash.
    """
    text = F.coalesce("text", F.lit(""))

    def rows(batch: dict[str, list]) -> dict[str, list]:
        return {"doc_id": batch["doc_id"], "digest": batch["digest"], "x": [raw_features(t) for t in batch["text"]]}

    held = lambda c: F.coalesce(F.crc32(c.cast("string")) % modulus == held_out, F.lit(False))
    measured = durable(arrow_map(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("digest"), text.alias("text")), rows, "doc_id long, digest long, x array<double>"))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).cast("int").alias("y"))
    train = durable(measured.join(known, "doc_id").groupBy("doc_id").agg(F.min_by("x", "digest").alias("x"), F.first("y").alias("y")).select("x", "y"))
    model = fit(train, quantile)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_features(batch.column(1))), pa.float64())], ["doc_id", "score"])

    scored = measured.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
