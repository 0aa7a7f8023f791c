from pyspark.sql import functions as F

from kmerloom.llm import likeness, pii

NAMES = {"_hash": "7L", "_found": "array('mine')", "_told": "1", "_again": "'x'", "_gone": "2L", "row": "'r'", "t": "'t'", "id": "5", "n": "6", "again": "3", "told": "true", "text_hash": "9", "found": "'f'"}


def test_columns_of_any_name_stay(spark):
    """Columns named like a step's own come back as they were, and hold nothing of the text."""
    text = "write to a.b@c.org please, this is a text of some words"
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "nothing to see")], "doc_id long, text string").withColumns({c: F.expr(e) for c, e in NAMES.items()})
    said = pii.replace_pii(docs, "key").collect()
    assert {r.doc_id: r.n_entities for r in said} == {1: 1, 2: 1, 3: 0, 4: 0} and "a.b@c.org" not in str(said)
    kept = likeness.one_of_each(docs).collect()
    assert {r.doc_id for r in kept} == {1, 3, 4}
    before = {r.doc_id: r.asDict() for r in docs.collect()}
    for r in [*said, *kept]:
        assert all(r[c] == before[r.doc_id][c] for c in NAMES)


def test_numbers_that_are_no_cards(spark):
    """Times, book numbers and versions stay; cards and addresses go."""
    rows = ["at 1700000000000 sharp", "ISBN 978-3-16-148410-0 here", "isbn 9783161484100", "version 1.2.3.4 of it", "card 4111 1111 1111 1111 now", "host 10.1.2.3 up", "card 4222222222222222 x"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.replace_pii(docs, "key").collect()}
    assert [got[i] == (rows[i], 0) for i in range(len(rows))] == [True] * 4 + [False] * 3
