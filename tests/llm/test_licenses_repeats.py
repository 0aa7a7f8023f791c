"""Templates of any length whose words repeat."""

import random

from kmerloom.llm import licenses as L


def scan(text, template, least=0.8):
    cut = {"t": template.split()}
    return L.scan_text(text, cut, frozenset(cut["t"]), least)


def test_repeating_templates_are_found():
    for template in ("a b a b", "a a a", "a b b a a b b a", "x y " * 40):
        for text in (template, f"z q {template} c z", f"{template} . {template}"):
            found = scan(text, template)
            assert found and found[0][1] == 1.0, (template, text)
            assert text[found[0][3] : found[0][4]].split() == template.split()


def test_cycled_words():
    """A text that holds nine tenths of a template of 3000 words, 700 cycled; strays before it don't matter."""
    rng = random.Random(1)
    template = [f"w{i % 700}" for i in range(3000)]
    kept = [w if rng.random() < 0.9 else "other" for w in template]
    found = scan(" ".join(["w0 w5 stray"] * 3 + kept), " ".join(template))
    assert len(found) == 1 and found[0][2] >= sum(a == b for a, b in zip(template, kept))


def test_doubled_words_of_a_long_template():
    """No frame a word: each word of the template twice in the text."""
    n = 10_000
    template = [f"w{i}" for i in range(n)]
    cut = L.align([w for w in template[:2000] for _ in "ab"], template[:2000], {w: [2 * i, 2 * i + 1] for i, w in enumerate(template[:2000])}, 0, 2000, 0, 4000)
    assert [i for i, _ in cut] == list(range(2000)) and all(a < b for (_, a), (_, b) in zip(cut, cut[1:]))
    assert len(L.align(template, template, {w: [i] for i, w in enumerate(template)}, 0, n, 0, n)) == n


def test_longest_common_sequence_of_repeats():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(1, 12))] for _ in "ab")
        where = {w: [j for j, v in enumerate(b) if v == w] for w in "xyz" if w in b}
        got = L.common(a, where, 0, len(a), 0, len(b))
        assert all(a[i] == b[j] for i, j in got) and all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(got) == best[-1][-1]
