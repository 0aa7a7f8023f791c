import hashlib
import re

import pytest

from kmerloom.llm import fim
from tests.llm.data import empty, odd, odd_rows

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=50):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    tokens = TOKEN.findall(text)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(tokens), "plain", None, None, text
    spm = h4 % 100 < 80
    return doc_id, len(tokens), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_equals_brute_force(spark, chunk):
    """Chunks from one character on, every odd row, extra columns of clashing names."""
    more = [(100 + i, t) for i, t in enumerate(["<P> mark", "a <S", "<<S>", " lead", "trail ", "\x0b\x0c x\ty\r\n z", "no break space", "😀 é " * 40, "x" * 200, " " * 200])] * 2
    rows = [(r[0], r[1]) for r in odd_rows()] + more
    rows = [(i, t[:300] if t and chunk < 64 else t) for i, t in rows]
    docs = spark.createDataFrame([(i, t, "k", 1, "o") for i, t in rows], "doc_id long, text string, key string, chunk int, output string")
    done = fim.restore(fim.fill_in_middle(docs, rate=90, chunk=chunk)).collect()
    assert ordered(r[:6] for r in done) == ordered(brute(i, t, 90) for i, t in rows)
    assert sorted(r.restored for r in done) == sorted(t or "" for _, t in rows)
    assert {r.form for r in done} == {"plain", "spm", "psm"}


def test_cuts_at_both_ends(spark):
    """Ranks 0 and n, and both cuts at one place, occur and restore."""
    docs = spark.range(400).selectExpr("id AS doc_id", "'a b ' AS text")
    done = fim.restore(fim.fill_in_middle(docs, rate=100, chunk=2)).collect()
    assert {(r.prefix_chars, r.middle_chars) for r in done} == {(a, b - a) for a in (0, 1, 3, 4) for b in (0, 1, 3, 4) if a <= b}
    assert all(r.restored == "a b " and r.n == 3 for r in done)


def test_empty_and_columns(spark):
    assert fim.fill_in_middle(empty(spark)).count() == 0
    assert fim.fill_in_middle(odd(spark)).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
