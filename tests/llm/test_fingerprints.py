import hashlib

import numpy as np

from kmerloom.llm import isomedia, simhash
from tests.llm.data import empty, odd


def brute(text):
    h, w = simhash.terms(text)
    votes = [0.0] * 64
    for x, k in zip(h.tolist(), w.tolist()):
        for b in range(64):
            votes[b] += k if x >> b & 1 else -k
    return sum(1 << b for b in range(64) if votes[b] > 1e-9)


def test_report_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in simhash.fingerprint_report(docs).collect()}
    fps = [brute(r.text) for r in rows]
    distinct = np.array(sorted(set(fps)), np.uint64)
    for i, r in enumerate(rows):
        following = rows[(i + 1) % len(rows)]
        n = len(r.text) // 4
        new = r.text[: len(r.text) - n] + following.text[:n]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert g.fingerprint == f"{fps[i]:016x}" and g.edited_fingerprint == f"{brute(new):016x}"
        assert abs(g.near_next - simhash.likeness(fps[i], fps[(i + 1) % len(rows)])) < 1e-9 and 0 <= g.near_edited <= 1
        assert g.n_near == (np.bitwise_count(distinct ^ np.uint64(fps[i])) <= 3).sum() - 1
    near = [g.near_edited for g in got.values()]
    assert sum(near) / len(near) > 0.6 > 0.3 > sum(g.near_next for g in got.values()) / len(got)


def test_odd_rows(spark):
    docs = odd(spark)
    got = simhash.fingerprint_report(docs).collect()
    assert len(got) == docs.count() and len({r.fingerprint for r in got if r.doc_id in (0, 58, 59)}) == 1
    assert {r.n_chars for r in got if r.doc_id in (50, 51)} == {0}
    assert all(r.near_edited == 1.0 for r in got if r.n_chars < 4)
    assert simhash.fingerprint_report(empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")
    assert simhash.fingerprint_report(one).first().near_next == 1.0


def test_media_round_trip(spark):
    docs = odd(spark)
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in isomedia.store(docs).collect():
        raw = (texts[r.doc_id][0] if r.doc_id is not None else None)
        payload = isomedia.read_tracks(r.media)[0]
        back = b"".join(bytes(r.media[a : a + n]) for a, n in payload.samples())
        assert len(back) % 64 == 0 and len(back) >= 64 and len(back) == r.payload_bytes and hashlib.sha256(back).hexdigest() == r.payload_sha256
        if raw is not None:
            assert back == raw.encode() + bytes(len(back) - len(raw.encode())) and len(back) - len(raw.encode()) <= 64
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
        assert "codec=raw" in r.feature and payload.seconds() * 8000 == len(back)
        assert [f"{a}+{n}" for a, n in payload.keyframes()] == r.keyframe_ranges.split(",")
    assert isomedia.store(empty(spark)).count() == 0


def test_foreign_files():
    """32-bit offsets, 64-bit and open-ended boxes, unknown boxes between, samples of different sizes, no sync table, damage."""
    from struct import pack

    samples = [b"a" * 5, b"b" * 7, b"c" * 3, b"d" * 9]
    entry = isomedia.box(b"avc1", bytes(78))

    def movie(at):
        stbl = isomedia.box(
            b"stbl", isomedia.full(b"stsd", pack(">I", 1), entry), isomedia.full(b"stts", pack(">III", 1, 4, 512)), isomedia.full(b"stsc", pack(">IIIIIII", 2, 1, 3, 1, 2, 1, 1)),
            isomedia.full(b"stsz", pack(">II4I", 0, 4, 5, 7, 3, 9)), isomedia.full(b"stco", pack(">III", 2, at, at + 15)),
        )
        mdia = isomedia.box(b"mdia", isomedia.full(b"mdhd", pack(">IIIIHH", 0, 0, 1000, 2048, 0, 0)), isomedia.full(b"hdlr", bytes(4), b"vide", bytes(13)), isomedia.box(b"minf", stbl))
        return pack(">I4sQ", 1, b"moov", 0) + isomedia.box(b"free", b"xx") + isomedia.box(b"trak", isomedia.box(b"junk", b"?"), mdia)

    def sized(body):
        return body[:8] + pack(">Q", len(body)) + body[16:]

    at = len(sized(movie(0))) + 8
    data = sized(movie(at)) + pack(">I4s", 0, b"mdat") + b"".join(samples)
    track = isomedia.read_tracks(data)[0]
    assert (track.codec, track.handler, track.seconds()) == ("avc1", "vide", 2.048)
    assert [data[a : a + n] for a, n in track.samples()] == samples == [data[a : a + n] for a, n in track.keyframes()]
    for cut in range(0, len(data), 7):
        isomedia.read_tracks(data[:cut])
    assert isomedia.read_tracks(b"not a movie at all") == []
