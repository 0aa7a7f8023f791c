import random

import pytest

from kmerloom.llm import pii

rng = random.Random(5)
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
text = lambda chars, n: "".join(rng.choices(chars, k=n))
SECRETS = {
    "quoted 201": ('token = "', text(LETTERS + "0123456789._-", 201), '"'), "quoted 300": ("password: '", text(LETTERS, 300), "'"), "quoted 5000": ('secret="', text(LETTERS + "0123456789", 5000), '"'),
    "hex 129": ("sum ", text("0123456789abcdef", 129), " end"), "capital hex 400": ("sum ", "AB12" + text("0123456789ABCDEF", 396), " end"), "hex of letters": ("sum ", text("abcdef", 40), " end"),
    "capital hex of letters": ("sum ", text("ABCDEF", 40), " end"), "AKIA": ("key ", "AKIA" + text(LETTERS[26:], 16), " end"), "gh": ("key ", "ghp_" + text(LETTERS, 36), " end"),
    "sk": ("key ", "sk-" + text(LETTERS, 30), " end"),
}


@pytest.fixture(scope="module")
def replaced(spark):
    docs = spark.createDataFrame([(i, "".join(parts)) for i, parts in enumerate(SECRETS.values())], "doc_id long, text string")
    return [(r.text, r.n_entities) for r in pii.replace_pii(docs, "key").orderBy("doc_id").collect()]


@pytest.mark.parametrize("at, name", list(enumerate(SECRETS)))
def test_no_part_of_a_secret_stays(replaced, at, name):
    (before, secret, after), (got, n) = SECRETS[name], replaced[at]
    assert n == 1 and got.startswith(before) and got.endswith(after)
    new = got[len(before) : len(got) - len(after)]
    assert len(new) == len(secret) and not any(secret[i : i + 8] in new for i in range(len(secret) - 7))
