"""Small tables with every odd case: null and repeated ids, null, empty, blank and very long texts, copies, clashing columns."""

import random

CLASHES = ["fp", "tokens", "shard", "slot", "size", "epoch", "score", "h", "part", "cut", "range", "row", "bucket", "whole", "n_entities", "_hash", "_found", "_told", "_again", "_gone", "_names", "t", "n", "id", "found", "told", "again", "text_hash"]


def odd_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    long = text(30_000)
    base = [text(80) for _ in range(30)]
    near = [b.replace(b.split()[40], "changed", 1) for b in base[:6]]
    rows = [(i, t) for i, t in enumerate(base + near)]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "one two"), (55, "ONE Two"), (56, long), (57, long + " tail"), (58, base[0]), (59, base[0]), (60, "naïve   ÄÖ 語 テスト <|endoftext|> 😀"), (None, base[1]), (None, None), (61, base[2]), (61, base[2])]
    return [(i, t, ("en", "de", None)[k % 3], ("src0", "src7", None, "src15")[k % 4], len(t) if t else None) for k, (i, t) in enumerate(rows)]


def odd(spark, clashes: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df


def empty(spark):
    return odd(spark).limit(0)
