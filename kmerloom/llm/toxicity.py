"""Toxic spans by a linear-chain conditional random field; forward-backward marginals add up to document scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import arrow_map, fitted, slices
from kmerloom.llm.quality import newton

WORD = re.compile(r"[^\W\d_]+")
#: Token features: the word, and its beginnings of these lengths (stems that take many endings).
STEMS = (3, 4, 5, 6, 7)


def lowered(text: str) -> str:
    """Lower case, character by character where a letter's lower case is longer, so that offsets stay those of ``text``."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def token_features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in STEMS if len(word) >= n)]


def useful_features(words: list[list[str]], y: np.ndarray, least_docs: int = 3, least_lift: float = 6.0) -> dict[str, float]:
    """Log lift of features whose rate a token in toxic texts is ``least_lift`` times that in the others, seen in ``least_docs`` toxic texts."""
    total = [1, 1]
    for ws, label in zip(words, y):
        total[label] += len(ws)
    times: tuple[Counter, Counter] = (Counter(), Counter())  # of each word, in the other texts and in toxic ones
    docs: Counter = Counter()
    known: dict[str, list[str]] = {}
    for ws, label in zip(words, y):
        times[label].update(ws)
        if label:
            docs.update({f for w in set(ws) for f in known.setdefault(w, token_features(w))})
    docs = Counter({f: k for f, k in docs.items() if k >= least_docs})  # the others' counts aren't needed
    rate: tuple[Counter, Counter] = (Counter(), Counter())
    for label in (0, 1):
        for w, k in times[label].items():
            for f in token_features(w):
                if f in docs:
                    rate[label][f] += k
    out = {}
    for f in docs:
        lift = ((rate[1][f] + 0.1) / total[1]) / ((rate[0][f] + 0.5) / total[0])
        if lift >= least_lift:
            out[f] = float(np.log(lift))
    return out


@dataclass
class Field:
    """Two states: 0 clean, 1 toxic. ``bias`` and ``weights`` score state 1 at a token, ``move[i, j]`` a step from i to j."""

    bias: float
    weights: dict[str, float]
    move: np.ndarray
    known: frozenset
    doc: np.ndarray

    def emission(self, word: str) -> float | None:
        """Score of state 1 beyond the bias; None for a word without any learned feature."""
        found = [self.weights[f] for f in token_features(word) if f in self.weights]
        return sum(found) if found else None

    def marginals(self, n: int, spots: list[tuple[int, float]]) -> list[float]:
        """P(toxic) at the given (token, emission) places of a text of n tokens, by forward-backward over the whole text.

        Tokens between the places all have the same step matrix, so a stretch of them is a power of it, taken by its eigenvalues; the
        result is that of a token-by-token pass.
        """
        step = np.exp(self.move) * np.array([1.0, np.exp(self.bias)])[None, :]
        power = _powers(step)
        here = [np.array([1.0, np.exp(self.bias + e)]) for _, e in spots]
        move = np.exp(self.move)
        ahead, v, at = [], None, -1
        for (i, _), d in zip(spots, here):
            gap = i - at - 1
            if v is None:  # the text starts with even odds of both states
                v = (np.array([1.0, np.exp(self.bias)]) @ power(gap - 1)) @ move * d if gap else d.copy()
            else:
                v = (v @ power(gap)) @ move * d
            v = v / v.sum()
            ahead.append(v)
            at = i
        behind, u, at = [], np.ones(2), n
        for k in range(len(spots) - 1, -1, -1):
            gap = at - spots[k][0] - 1
            u = power(gap) @ u if at == n else power(gap) @ (move @ (here[k + 1] * u))
            u = u / u.sum()
            behind.append(u)
            at = spots[k][0]
        out = []
        for v, u in zip(ahead, reversed(behind)):
            p = v * u
            out.append(float(p[1] / p.sum()))
        return out

    def read(self, text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Document features and the character spans of tokens more likely toxic than not (neighbouring ones join)."""
        low = lowered(text)
        words = WORD.findall(low)
        flagged = {}
        for w in set(words):
            if w[:3] in self.known or f"={w}" in self.known:
                e = self.emission(w)
                if e is not None:
                    flagged[w] = e
        n = len(words)
        if not flagged:
            return doc_features(n, []), []
        spots = [(i, flagged[w]) for i, w in enumerate(words) if w in flagged]
        p = self.marginals(n, spots)
        toxic = {i for (i, _), x in zip(spots, p) if x > 0.5}
        spans: list[tuple[int, int]] = []
        if toxic:
            previous = -2
            for i, m in enumerate(WORD.finditer(low)):
                if i in toxic:
                    if previous == i - 1:
                        spans[-1] = (spans[-1][0], m.end())
                    else:
                        spans.append(m.span())
                    previous = i
        return doc_features(n, p), spans

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.doc, -40, 40)))


def _powers(step: np.ndarray):
    """k -> step^k up to a factor, from the eigenvalues of the positive 2x2 matrix (distinct by Perron)."""
    half, det = np.trace(step) / 2, np.linalg.det(step)
    root = np.sqrt(half * half - det)
    big, small = half + root, half - root
    lead = (step - small * np.eye(2)) / (big - small)
    rest = np.eye(2) - lead
    ratio = small / big
    return lambda k: lead + rest * ratio**k


def doc_features(n: int, p: list[float]) -> np.ndarray:
    """Expected toxic tokens, their share of the text, the largest marginal: what the document score is made of."""
    e = sum(p)
    return np.array([1.0, np.log1p(e), np.log((e + 0.05) / (n + 10.0)), max(p, default=0.0), np.log1p(n)])


def _expected(score: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded forward-backward, scaled at every step: marginals of state 1, expected moves, log Z. ``score`` is chunks x places."""
    b, m = score.shape
    live = np.arange(m)[None, :] < length[:, None]
    step = np.exp(move)
    top = np.maximum(score, 0) * live
    here = np.stack([np.exp(-top), np.exp(score * live - top)], 2)
    ahead, z = np.empty((m, b, 2)), top.sum(1)
    v = here[:, 0]
    for t in range(m):
        v = np.where(live[:, t, None], (v @ step) * here[:, t], v) if t else v
        total = v.sum(1, keepdims=True)
        ahead[t] = v = v / total
        z += np.log(total[:, 0])
    p, moves, u = np.empty((m, b)), np.zeros((b, 2, 2)), np.ones((b, 2))
    for t in range(m - 1, -1, -1):
        both = ahead[t] * u
        p[t] = both[:, 1] / both.sum(1)
        if t:
            x = here[:, t] * u
            joint = ahead[t - 1][:, :, None] * step * x[:, None, :]
            moves += joint * (live[:, t] / joint.sum((1, 2)))[:, None, None]
            x = x @ step.T
            u = np.where(live[:, t, None], x / x.sum(1, keepdims=True), u)
    return p.T * live, moves, z


def ascend(f: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, rounds: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """Where the concave ``f`` (value, gradient) is largest, by limited-memory quasi-Newton steps with halving, until no part of the gradient exceeds ``tolerance``."""
    value, g = f(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= tolerance:
            break
        d, taken = g.copy(), []
        for s, y in reversed(past):
            taken.append((s @ d) / (s @ y))
            d -= taken[-1] * y
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).max())
        for (s, y), k in zip(past, reversed(taken)):
            d += s * (k - (y @ d) / (s @ y))
        size, slope = 1.0, g @ d
        while True:
            new = theta + size * d
            high, at = f(new)
            if high >= value + 1e-4 * size * slope or size < 1e-9:
                break
            size /= 2
        if (new - theta) @ (g - at) > 0:
            past = [*past, (new - theta, g - at)][-memory:]
        theta, value, g = new, high, at
    return theta


def train(sample: list[tuple[str, int]], chunk: int = 32, rounds: int = 300, tolerance: float = 1e-4, at_once: int = 4096) -> Field:
    """Token labels come from the documents' labels: in a toxic text, a token whose best feature has a high lift is toxic, all others are clean.

    The field is fitted on all chunks of ``chunk`` tokens by quasi-Newton ascent on the conditional likelihood with a ridge,
    until no part of the gradient exceeds ``tolerance`` a chunk, ``rounds`` steps at most. Chunks without a useful feature differ by their
    length alone, so those of a length are one chunk with their number as its weight. The document layer is logistic regression on the marginals.
    Without toxic or clean texts every score is near the only kind seen (0.5 without any).
    """
    y = np.array([v for _, v in sample], int)
    known_words: dict[str, str] = {}
    words = [[known_words.setdefault(w, w) for w in WORD.findall(lowered(t))] for t, _ in sample]  # one string a word
    lifts = useful_features(words, y) if len(set(y.tolist())) == 2 else {}
    empty = Field(-4.0, {}, np.zeros((2, 2)), frozenset(), np.zeros(5))
    if not lifts:
        share = (y.sum() + 0.5) / (len(y) + 1)
        empty.doc[0] = np.log(share / (1 - share))
        return empty
    index = {f: i for i, f in enumerate(sorted(lifts))}
    strong = float(np.log(12))
    plain_word: tuple[list[int], float] = ([], 0.0)
    cache: dict[str, tuple[list[int], float]] = {}
    chunks: list[tuple[list[list[int]], list[int], float]] = []
    plain: Counter = Counter()
    for ws, label in zip(words, y):
        rows, tags = [], []
        for w in ws:
            if w not in cache:
                fs = [f for f in token_features(w) if f in index]
                cache[w] = ([index[f] for f in fs], max(lifts[f] for f in fs)) if fs else plain_word
            ids, lift = cache[w]
            rows.append(ids)
            tags.append(int(label and lift >= strong))
        for i in range(0, len(rows), chunk):
            part = rows[i : i + chunk]
            if any(part):
                chunks.append((part, tags[i : i + chunk], 1.0))
            else:
                plain[len(part)] += 1
    chunks += [([[]] * n, [0] * n, float(m)) for n, m in sorted(plain.items())]
    length = np.array([len(c[0]) for c in chunks])
    tag, weight = np.zeros((len(chunks), chunk)), np.array([c[2] for c in chunks])
    at_row, at_col, at_f = [], [], []
    for r, (part, tags, _) in enumerate(chunks):
        tag[r, : len(tags)] = tags
        for c, ids in enumerate(part):
            at_row += [r] * len(ids)
            at_col += [c] * len(ids)
            at_f += ids
    at_row, at_col, at_f = (np.array(a, int) for a in (at_row, at_col, at_f))
    t0, t1 = tag[:, :-1].astype(int), tag[:, 1:].astype(int)
    inside = np.arange(1, chunk)[None, :] < length[:, None]
    seen = np.stack([np.stack([((t0 == i) & (t1 == j) & inside).sum(1) for j in (0, 1)], 1) for i in (0, 1)], 1)
    tagged = tag * weight[:, None]
    counted = np.concatenate([[tagged.sum()], (seen * weight[:, None, None]).sum(0).ravel(), np.bincount(at_f, tagged[at_row, at_col], len(index))])
    place = at_row * chunk + at_col

    def likelihood(theta: np.ndarray) -> tuple[float, np.ndarray]:
        score = theta[0] + np.bincount(place, theta[5:][at_f], len(chunks) * chunk).reshape(len(chunks), chunk)
        value, g = counted @ theta - 0.25 * (theta @ theta), counted - 0.5 * theta
        for i in range(0, len(chunks), at_once):
            p, moves, z = _expected(score[i : i + at_once], length[i : i + at_once], theta[1:5].reshape(2, 2))
            w = weight[i : i + at_once]
            value -= w @ z
            score[i : i + at_once] = p * w[:, None]  # what is expected, from here on
            g[1:5] -= (moves * w[:, None, None]).sum(0).ravel()
        g[0] -= score.sum()
        g[5:] -= np.bincount(at_f, score.ravel()[place], len(index))
        return value, g

    start = np.zeros(1 + 4 + len(index))
    start[0] = -3.0
    theta = ascend(likelihood, start, rounds, tolerance * weight.sum())
    weights = {f: float(theta[5 + i]) for f, i in index.items()}
    known = frozenset({f[:3] for f in weights if f[0] != "="} | {f for f in weights if f[0] == "="})
    field = Field(float(theta[0]), weights, theta[1:5].reshape(2, 2), known, np.zeros(5))
    x = np.array([field.read(t)[0] for t, _ in sample])
    field.doc = newton(x, y.astype(float), 1e-3)
    return field


SCHEMA = "doc_id long, score double, spans string"


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6000, modulus: int = 5, held_out: int = 0, cut: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every document, from a field fitted on at most ``sample`` labelled rows.

    ``spans`` are "begin-end" characters of toxic stretches. Whole texts; null text is empty; null ids keep their rows (held_out false);
    repeated rows get equal scores; other columns are ignored. Nothing is shuffled but the label table.
    """
    model = fitted(docs, labels, "toxic", modulus, held_out, sample, "toxic", train)

    def rows(batch: dict[str, list]) -> dict[str, list]:
        found = [model.read(t or "") for t in batch["text"]]
        s = model.score(np.array([x for x, _ in found]).reshape(len(found), 5))
        return {"doc_id": batch["doc_id"], "score": s, "spans": [",".join(f"{a}-{b}" for a, b in spans) for _, spans in found]}

    scored = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, SCHEMA)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "spans")


def keep_clean(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **options) -> DataFrame:
    """``docs`` without those scored ``cut`` or more; all columns stay. The score is computed beside the row, so nothing is joined."""
    model = fitted(docs, labels, "toxic", options.get("modulus", 5), options.get("held_out", 0), options.get("sample", 6000), "toxic", train)

    def toxic(batches):
        for b in chain.from_iterable(map(slices, batches)):
            text = b.column(b.schema.get_field_index("text")).to_pylist()
            x = np.array([model.read(t or "")[0] for t in text]).reshape(len(text), 5)
            yield b.filter(pa.array(model.score(x) < cut))

    return docs.mapInArrow(toxic, docs.schema)
