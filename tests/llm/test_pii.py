import regex

from kmerloom.llm import pii
from tests.llm.data import empty, odd


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace_pii(df, "key").orderBy("doc_id").collect()]


def test_shapes_and_coreference(spark):
    texts = ["Mail jo.d2@Host.example.com, JO.D2@HOST.EXAMPLE.COM", "+1 (682) 555-5413 and +1 682 555 5413", "4111 1111 1111 1111 / 4111111111111111", "Mr. John Smith saw Mrs Smith", "Г-н Иван Петров", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "10.20.30.40 and 123-45-6789", "Version 2.0.1 of 2024, nothing here"]
    out = run(spark, texts)
    a, b = out[0].removeprefix("Mail ").split(", ")
    assert a.upper() == b and regex.fullmatch(r"[a-z]{2}\.[a-z]\d@[A-Za-z]{4}-[0-9a-f]{6}\.example\.org", a, flags=regex.I) and "jo.d2" not in a
    x, y = out[1].split(" and ")
    assert regex.sub(r"\D", "", x) == regex.sub(r"\D", "", y) and x.startswith("+1 (") and x[3:] != texts[1][3:17] and y.count(" ") == 3
    x, y = out[2].split(" / ")
    assert x.replace(" ", "") == y and luhn(y) == 0 and y != "4111111111111111" and y[0] == "4"
    m = regex.fullmatch(r"Mr\. (\w[\w-]*) (\w+) saw Mrs (\w+)", out[3])
    assert m[2] == m[3] != "Smith" and all(n in pii.GIVEN[("latin", "m")] for n in m[1].split("-"))
    m = regex.fullmatch(r"Г-н (\w[\w-]*) (\w+)", out[4])
    assert regex.fullmatch(r"\p{Cyrillic}+", m[2]) and all(n in pii.GIVEN[("cyrillic", "m")] for n in m[1].split("-"))
    assert regex.fullmatch(r'token = "[0-9a-f]{40}"', out[5]) and out[5] != texts[5]
    assert regex.fullmatch(r"\d+\.\d+\.\d+\.\d+ and \d{3}-\d{2}-\d{4}", out[6]) and "10.20.30.40" not in out[6] and "123-45-6789" not in out[6]
    assert out[7] == texts[7]
    assert run(spark, texts) == out and pii.replace_pii(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), "other").first().text != out[0]


def test_distinct_when_lists_are_short(spark):
    """More given names than the list has: every pair of people stays apart, and surnames stay shared."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"{x.upper()}{y}lla" for x in letters for y in "aeo"]
    out = run(spark, [f"Mrs. {n} Brown" for n in names])
    given = [t.split(" ")[1] for t in out]
    assert len(set(given)) == len(names) and len({t.split(" ")[2] for t in out}) == 1
    assert not {g.lower() for g in given} & {n.lower() for n in names}


def test_documents_against_a_plain_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    plain = {k: regex.compile(p.replace(r"\p{Is", r"\p{")) for k, p in pii.PATTERNS.items()}
    new = {r.doc_id: r for r in pii.replace_pii(docs, "key").collect()}
    touched = 0
    for r in docs.collect():
        found = {m.group() for p in plain.values() for m in p.finditer(r.text)}
        g = new[r.doc_id]
        assert (g.text == r.text) == (not found) and (g.n_entities > 0) == bool(found)
        touched += bool(found)
        assert not any(f in g.text for f in found if len(f) > 9) and g.n_chars == len(g.text) and g.lang == r.lang
    assert touched > 300


def test_odd_rows(spark):
    docs = odd(spark)
    got = pii.replace_pii(docs, "key")
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert set(got.columns) == set(docs.columns) and pii.replace_pii(empty(spark), "key").count() == 0
