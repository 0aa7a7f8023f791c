import numpy as np

from kmerloom.llm import likeness
from kmerloom.llm.neardup import majority


def test_fingerprints_make_blocks(spark):
    """Points without a common band key meet by their fingerprints: equal ones, and those up to 3 bits apart, by others too; 4 bits don't."""
    fps = [0, 0, 0b111, 0b111111, 0b1111 << 40, -1]
    points = spark.createDataFrame([(i, 5, fp, [1000 + i]) for i, fp in enumerate(fps)], "id long, n long, fp long, keys array<long>")
    assert sorted((r.id, r.root, r.n) for r in likeness.blocks(points).collect()) == [(0, 0, 5), (1, 0, 5), (2, 0, 5), (3, 0, 5)]


def test_near_copies_without_bands(spark, monkeypatch):
    """With bands that never agree the fingerprints alone find near copies, and the exact check keeps unlike texts of near fingerprints."""
    monkeypatch.setattr(likeness, "band_keys", lambda s: np.array([hash(s.tobytes())], np.int64).view(np.uint64))
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(reversed(words))]
    bits = int(np.bitwise_count(np.bitwise_xor(*majority([likeness.shingle_set(t) for t in texts[:2]]))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bits <= likeness.RADIUS and sorted(r.doc_id for r in likeness.one_of_each(docs).collect()) == [0, 2]
