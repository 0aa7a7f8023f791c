import itertools
import random

from kmerloom.llm import licenses
from tests.llm.data import empty, odd


def test_rising_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        b = rng.sample(range(20), rng.randint(0, 8))
        pairs = list(enumerate(b))
        got = licenses.rising(pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        best = max((k for k in range(len(b) + 1) if any(list(c) == sorted(c) for c in itertools.combinations(b, k))), default=0)
        assert len(got) == best


def test_scan(spark):
    words = "lorem the ipsum of dolor a sit version and is to in text from under".split()
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choices(words, k=n))
    t = licenses.TEMPLATES
    texts = [filler(200) + "\n" + t["GPL-3.0"] + "\n" + filler(300), t["MIT"] + " " + t["MIT"] + " " + filler(50), filler(40) + t["Apache-2.0-header"].upper() + filler(20), filler(500), "Licensed under the Apache\n * License, Version 2.0.", t["GPL-3.0-header"].replace("redistribute it", "redistribute"), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [got[i].license for i in range(8)] == ["GPL-3.0", "MIT", "Apache-2.0-header", None, "Apache-2.0", "GPL-3.0-header", None, None]
    assert texts[0][got[0].begin : got[0].end] == t["GPL-3.0"].rstrip(".") and got[0].coverage == 1.0 and 0.9 < got[5].coverage < 1


def test_whole_notices_among_stray_words():
    """A notice that stands in the text word for word is found in full, whatever words of templates stand before and after it."""
    rng = random.Random(3)
    templates = {k: [m.group().lower() for m in licenses.WORD.finditer(v)] for k, v in licenses.TEMPLATES.items()}
    vocabulary = frozenset(w for t in templates.values() for w in t)
    some = sorted(vocabulary) + ["lorem", "ipsum", "dolor"] * 40
    for _ in range(300):
        name = rng.choice(list(templates))
        own = templates[name] + ["amet"] * 20
        stray = lambda: rng.choices(rng.choice([some, own]), k=rng.randint(0, 120))
        words = [*stray(), *templates[name], *stray()]
        assert (name, 1.0) in {g[:2] for g in licenses.scan_text(" ".join(words), templates, vocabulary)}, " ".join(words)


def test_odd_rows(spark):
    docs = odd(spark)
    got = licenses.license_scan(docs).collect()
    assert len(got) == docs.count() and all(r.license is None for r in got)
    assert licenses.license_scan(empty(spark)).count() == 0


def test_documents_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.license for r in licenses.license_scan(docs).collect()}
    shorts = {k: v for k, v in licenses.TEMPLATES.items() if k in ("Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT")}
    for r in docs.select("doc_id", "text").collect():
        inside = {k for k, v in shorts.items() if v.lower() in r.text.lower()}
        assert (got[r.doc_id] in inside) if inside else got[r.doc_id] is None


def common(a, b):
    """Length of the longest common subsequence, by the full table."""
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else max(last[j + 1], now[j]))
        last = now
    return last[-1]


def test_alignment_against_the_full_table():
    """Edited notices in texts that hold stray words of theirs: an alignment is a common subsequence, and nearly the longest one."""
    rng = random.Random(6)
    templates = {k: [m.group().lower() for m in licenses.WORD.finditer(v)] for k, v in licenses.TEMPLATES.items()}
    matched = longest = 0
    for name, template in templates.items():
        for _ in range(6):
            noise = ["lorem", "ipsum", "dolor"] * 10 + template[:3]
            words = rng.choices(noise, k=rng.randint(0, 40))
            for w in template:
                turn = rng.random()
                words += [] if turn < 0.04 else ["amet"] if turn < 0.08 else [w, "sic"] if turn < 0.12 else [w]
            words += rng.choices(noise, k=rng.randint(0, 40))
            where = {}
            for i, w in enumerate(words):
                where.setdefault(w, []).append(i)
            pairs = licenses.align(words, template, where, 0, len(template), 0, len(words))
            assert all(template[i] == words[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
            best = common(template, words)
            assert len(pairs) <= best <= licenses.possible(template, where, 0, len(words))
            matched, longest = matched + len(pairs), longest + best
    assert matched > 0.97 * longest


def test_every_match_with_its_span(spark):
    t = licenses.TEMPLATES
    texts = [f"{t['MIT']} x {t['Apache-2.0']} y {t['MIT']}", t["BSD-3-Clause-text"], t["MIT-text"] + " lorem " + t["ISC-text"], t["Apache-2.0-header"]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    names = lambda i: [m.license for m in got[i].matches]
    assert names(0) == ["MIT", "Apache-2.0", "MIT"] and got[0].n_licenses == 2
    assert [texts[0][m.begin : m.end] for m in got[0].matches] == [t[m.license].rstrip(".") for m in got[0].matches]
    assert names(1) == ["BSD-3-Clause-text"] and names(2) == ["MIT-text", "ISC-text"] and names(3) == ["Apache-2.0-header"] and got[3].coverage == 1.0
