"""Files that no writer makes, and forms that this package's own writer doesn't use."""

import resource
from struct import pack

from kmerloom.llm import isomedia as m


def track(stbl: bytes, number: int = 1) -> bytes:
    tkhd = m.full(b"tkhd", pack(">III", 0, 0, number), bytes(68))
    return m.box(b"trak", tkhd, m.box(b"mdia", m.full(b"mdhd", pack(">IIII", 0, 0, 1000, 500)), m.full(b"hdlr", bytes(4), b"vide", bytes(13)), m.box(b"minf", m.box(b"stbl", stbl))))


def test_deep_nesting():
    depth = 100_000
    head = b"".join(pack(">I4s", 8 * (depth - i), b"moov") for i in range(depth))
    assert m.read_tracks(head) == []
    inner = track(m.full(b"stsz", pack(">II", 4, 2)))
    wrapped = b"".join(pack(">I4s", 8 * (depth - i) + len(inner), b"moov") for i in range(depth)) + inner
    assert m.read_tracks(wrapped)[0].sizes.n == 2


def test_declared_counts_cost_nothing():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    huge = 2**32 - 1
    tables = m.full(b"stsz", pack(">II", 1, huge)), m.full(b"stsc", pack(">IIII", 1, 1, huge, 1)), m.full(b"stco", pack(">II", 1, 0))
    data = m.box(b"moov", track(b"".join(tables)))
    found = m.read_tracks(data)[0]
    assert found.samples() == [(i, 1) for i in range(len(data))] and len(found.keyframes()) == len(data)
    for kind in (b"stsz", b"stz2", b"stts", b"stsc", b"stco", b"co64", b"stss", b"elst"):
        body = pack(">II", 0, huge) if kind == b"stsz" else pack(">BBBBI", 0, 0, 0, 16, huge) if kind == b"stz2" else pack(">I", huge)
        assert m.read_tracks(m.box(b"moov", track(m.full(kind, body))))[0].samples() == []
    zero = m.box(b"moov", track(m.full(b"stsz", pack(">II", 0, 0)) + m.full(b"stsc", pack(">IIII", 1, 1, huge, 1)) + m.full(b"stco", pack(">II", 1, 0))))
    assert m.read_tracks(zero)[0].samples() == []
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50_000


def test_compact_sizes_edits_and_several_entries():
    entries = m.box(b"avc1", bytes(78)) + m.box(b"hvc1", bytes(78))
    for width, coded in ((4, bytes([0x57, 0x30])), (8, bytes([5, 7, 3])), (16, pack(">3H", 5, 7, 3))):
        stbl = m.full(b"stsd", pack(">I", 2), entries) + m.full(b"stz2", pack(">BBBBI", 0, 0, 0, width, 3), coded) + m.full(b"stsc", pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 2)) + m.full(b"stco", pack(">III", 2, 10, 40)) + m.full(b"stss", pack(">III", 2, 1, 3))
        edits = m.box(b"edts", m.full(b"elst", pack(">IIiI", 1, 500, -1, 0x10000)))
        data = m.box(b"moov", track(stbl + edits))
        t = m.read_tracks(data)[0]
        assert t.codecs == ["avc1", "hvc1"] and t.edits == [(500, -1)]
        assert t.samples() == [(10, 5), (15, 7), (40, 3)] and t.keyframes() == [(10, 5), (40, 3)]


def test_fragments():
    """Sizes and flags of a run, of the fragment's header and of the file's defaults; runs that follow one another."""
    moov = m.box(b"moov", track(m.full(b"stsd", pack(">I", 1), m.box(b"avc1", bytes(78))), 7), m.box(b"mvex", m.full(b"trex", pack(">IIIII", 7, 1, 0, 6, m.NOT_SYNC))))
    sized = m.full(b"trun", pack(">IiI", 3, 100, 0), pack(">III", 4, 5, 6), flags=m.RUN_OFFSET | m.RUN_FIRST | m.RUN_SIZE)
    plain = m.full(b"trun", pack(">I", 2))
    flagged = m.full(b"trun", pack(">I", 2), pack(">II", 0, m.NOT_SYNC), flags=m.RUN_FLAGS)
    moof = m.box(b"moof", m.full(b"mfhd", pack(">I", 1)), m.box(b"traf", m.full(b"tfhd", pack(">I", 7)), sized, plain, flagged))
    data = moov + moof + m.box(b"mdat", bytes(200))
    t = m.read_tracks(data)[0]
    at = len(moov) + 100
    assert t.samples() == [(at, 4), (at + 4, 5), (at + 9, 6), (at + 15, 6), (at + 21, 6), (at + 27, 6), (at + 33, 6)]
    assert t.keyframes() == [(at, 4), (at + 27, 6)]
    assert m.read_tracks(moof) == []
    for cut in range(0, len(data), 3):
        m.read_tracks(data[:cut])


def test_samples_are_bounded_by_the_file():
    """Tables that point to one place again and again give no more bytes of samples than the file has."""
    chunks = track(m.full(b"stsz", pack(">II", 1, 2**32 - 1)) + m.full(b"stsc", pack(">IIII", 1, 1, 5000, 1)) + m.full(b"stco", pack(">I", 1000), pack(">I", 100) * 1000))
    data = m.box(b"moov", chunks) + bytes(5000)
    assert 0 < len(m.read_tracks(data)[0].samples()) <= len(data)
    moov = m.box(b"moov", track(m.full(b"stsd", pack(">I", 1), m.box(b"avc1", bytes(78))), 7), m.box(b"mvex", m.full(b"trex", pack(">IIIII", 7, 1, 0, 1, 0))))
    runs = [m.full(b"trun", pack(">Ii", 13_000, 0), flags=m.RUN_OFFSET) for _ in range(400)]
    data = moov + m.box(b"moof", m.full(b"mfhd", pack(">I", 1)), m.box(b"traf", m.full(b"tfhd", pack(">I", 7)), *runs)) + bytes(3000)
    assert 0 < len(m.read_tracks(data)[0].samples()) <= len(data)
