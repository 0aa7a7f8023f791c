"""Odd and very long entities, and a scanner that shares no pattern with the operator."""

import ipaddress
import random
import re

import pytest

from kmerloom.llm import pii
from tests.llm.test_pii import run

B = "x" * 30
LONG = ["x@" + "b." * 20_000 + "com", "a." * 500_000 + "b", "q" * 1_000_000, "1 " * 100_000, "sk-" * 50_000, "Mr. " + "Ab" * 100_000, "a@b@c@" * 50_000, ".-_" * 200_000 + "jo@host.org", "ab:" * 100_000, "\"'" * 100_000]


@pytest.fixture(scope="module")
def long(spark):
    return run(spark, LONG)


def test_long_tokens_end_and_are_replaced(long):
    assert long[0] != LONG[0] and long[0].endswith(".example.org") and long[1:3] == LONG[1:3] and len(long[3]) == len(LONG[3]) != 0 and long[3] != LONG[3]
    assert long[7].startswith(".-_" * 1000) and long[7].endswith(".example.org") and "jo@" not in long[7]
    assert "Ab" * 50 not in long[5] and long[6] == LONG[6] and long[8] == LONG[8] and long[9] == LONG[9]


def addresses(text):
    """Mail addresses by hand: a token with one at sign between letters or digits, and a dot in its right side."""
    for token in re.split(r"[\s,;()<>]+", text):
        token = re.sub(r"^\W+|\W+$", "", token)
        left, _, right = token.partition("@")
        if left and right and "@" not in right and "." in right and left[-1].isalnum():
            yield token.lower()


def test_documents_by_an_independent_scanner(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    new = {r.doc_id: r.text for r in pii.replace_pii(docs, "key").collect()}
    seen = {}
    for r in docs.collect():
        for old in addresses(r.text):
            assert old not in new[r.doc_id].lower()
        before, after = list(addresses(r.text)), list(addresses(new[r.doc_id]))
        assert len(before) == len(after)
        for a, b in zip(before, after):
            assert seen.setdefault(a, b) == b and b.endswith(".example.org")
        for token in re.findall(r"(?<![\w.])\d+\.\d+\.\d+\.\d+(?![\w.])", r.text):
            assert token not in new[r.doc_id].split()
    assert len(seen) > 50 and len(set(seen.values())) == len(seen), "distinct addresses stay distinct"


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_types_are_kept(spark):
    out = run(spark, ["DE89370400440532013000 = DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "from 8.8.8.8", "fe80::1ff:fe23:4567:890a, 2001:db8:0:0:0:0:0:1 and 2001:db8::1", "AB@x.org ab@x.org"])
    a, b = out[0].split(" = ")
    assert a == b.replace(" ", "") and a.startswith("DE") and mod97(a) == 1 and a[4:].isdigit() and "370400440532" not in a
    assert out[1][:2] == "GB" and mod97(out[1]) == 1 and out[1][5:9].isalpha() and len(out[1]) == 27
    assert ipaddress.ip_address(out[2].split()[1]).is_reserved
    first, second, third = re.split(r", | and ", out[3])
    assert second == third != first and all(ipaddress.ip_address(x) in ipaddress.ip_network("2001:db8::/32") for x in (first, second))
    x, y = out[4].split()
    assert x.lower() == y.lower()


def test_lone_names_of_known_people(spark):
    out = run(spark, ["Mr. John Smith came. John left, and Smith's dog met O'Brien.", "John and Smith, of another text"])
    given, surname = re.match(r"Mr\. ([\w-]+) (\w+) came", out[0]).groups()
    assert out[0] == f"Mr. {given} {surname} came. {given} left, and {surname}'s dog met O'Brien." and given != "John" and surname != "Smith"
    assert out[1] == "John and Smith, of another text"


def test_distinct_where_a_shape_is_full(spark):
    """All 26 mailboxes of one letter, and all of one-letter ones in another script: no surrogate of that shape is free."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = run(spark, [f"{x}@host.org" for x in letters])
    boxes = [t.split("@")[0] for t in out]
    assert len(set(boxes)) == 26 and not set(boxes) & set(letters) and len({t.split("@")[1] for t in out}) == 1


def test_nothing_written_holds_a_part(spark):
    docs = spark.createDataFrame([(1, "Mr. Xaver Quabbel, xaver.quabbel@quabbelhost.org, +1 682 555 5413")], "doc_id long, text string")
    found = pii.mentions(docs, "key").collect()
    assert len(found) == 5
    for word in ("xaver", "quabbel", "5413"):
        assert word not in str(found).lower()


def test_same_text_hash_or_id_gathers_nothing(spark):
    rng = random.Random(1)
    rows = [(None, f"mail {rng.choice('abc')}@host.org") for _ in range(300)]
    got = pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()
    assert len(got) == 300 and len({r.text for r in got}) == 3
