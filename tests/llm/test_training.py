import itertools
import random

import numpy as np

from kmerloom.llm import quality, toxicity


def texts():
    rng = random.Random(3)
    plain = [" ".join(rng.choices("the a fox dog tree runs over under and it is blue".split(), k=rng.randint(1, 90))) for _ in range(60)]
    return [(t, 0) for t in plain] + [(t + " idiot " + rng.choice(["moron", "fox", "idiots here"]), 1) for t in plain[:20]]


def likelihood(sample, field, move, bias, weights, chunk=32):
    """Log-likelihood of every chunk's tags less the ridge, token by token and chunk by chunk."""
    words = [toxicity.WORD.findall(toxicity.lowered(t)) for t, _ in sample]
    lifts = toxicity.useful_features(words, np.array([y for _, y in sample]))
    total = -0.25 * (bias**2 + (move**2).sum() + sum(w * w for w in weights.values()))
    for ws, (_, y) in zip(words, sample):
        for i in range(0, len(ws), chunk):
            score, tags = [], []
            for w in ws[i : i + chunk]:
                fs = [f for f in toxicity.token_features(w) if f in lifts]
                score.append(bias + sum(weights[f] for f in fs))
                tags.append(int(y and max((lifts[f] for f in fs), default=0) >= np.log(12)))
            ahead = np.array([0.0, score[0]])
            for s in score[1:]:
                ahead = np.logaddexp(ahead[0] + move[0], ahead[1] + move[1]) + np.array([0, s])
            total += sum(s for s, t in zip(score, tags) if t) + sum(move[a, b] for a, b in itertools.pairwise(tags)) - np.logaddexp(*ahead)
    return total


def test_field_is_the_likelihoods_optimum():
    """Over all chunks, those without a feature too, no parameter can be moved for a better likelihood."""
    sample = texts()
    field = toxicity.train(sample, tolerance=1e-7)
    assert len(field.weights) >= 2
    value = lambda b, m, w: likelihood(sample, field, m, b, w)
    h = 1e-4
    slopes = [(value(field.bias + h, field.move, field.weights) - value(field.bias - h, field.move, field.weights)) / (2 * h)]
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = h
        slopes.append((value(field.bias, field.move + d, field.weights) - value(field.bias, field.move - d, field.weights)) / (2 * h))
    for f in list(field.weights)[:4]:
        up, down = ({**field.weights, f: field.weights[f] + e} for e in (h, -h))
        slopes.append((value(field.bias, field.move, up) - value(field.bias, field.move, down)) / (2 * h))
    assert np.abs(slopes).max() < 1e-3


def test_ascend_finds_the_top():
    a = np.diag([1.0, 10.0, 100.0])
    top = np.array([1.0, -2.0, 3.0])
    found = toxicity.ascend(lambda x: (-0.5 * (x - top) @ a @ (x - top), -a @ (x - top)), np.zeros(3), 100, 1e-9)
    assert np.allclose(found, top)


def graded():
    rng = random.Random(7)
    good = [". ".join(" ".join(rng.choices("some plain words of a quiet text about rivers".split(), k=12)) for _ in range(4)) + "." for _ in range(80)]
    bad = [" ".join(rng.choices("BUY | !!! 777 CLICK click $$$ now".split(), k=rng.randint(5, 60))) for _ in range(60)]
    return [(t, 1) for t in good] + [(t, 0) for t in bad]


def test_ranker_is_the_optimum_of_its_pairs():
    """The weights' gradient of the pairwise logistic loss, pair by pair, is zero."""
    sample = graded()
    model = quality.learn(sample, pairs=2000, seed=11)
    x, y = quality.features([t for t, _ in sample]), np.array([v for _, v in sample])
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    rng = np.random.default_rng(11)
    a, b = rng.choice(np.flatnonzero(y == 1), 2000), rng.choice(np.flatnonzero(y == 0), 2000)
    g = 1e-4 * model.weights
    for i, j in zip(a, b):
        d = z[i] - z[j]
        g -= d / (1 + np.exp(np.clip(d @ model.weights, -30, 30))) / 2000
    assert np.abs(g).max() < 1e-6


def test_quantile_cuts_the_sample():
    sample = graded()
    x = quality.features([t for t, _ in sample])
    for q in (0.1, 0.25, 0.5, 0.9):
        s = quality.learn(sample, quantile=q).score(x)
        assert abs((s < 0.7).mean() - q) < 0.02
    best = quality.learn(sample)
    assert np.mean((best.score(x) >= 0.7) == [v == 1 for _, v in sample]) > 0.99
