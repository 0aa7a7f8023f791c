"""Files cut at every byte give the same records; block-wise and plain gzip; the source through Spark."""

import gzip
import io
import random
import zlib

import pytest

from kmerloom.sources import fastx
from kmerloom.sources import ranges as R


def blocked(data: bytes, size: int = 100) -> bytes:
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = packer.compress(part) + packer.flush()
        out += R.BLOCK_MAGIC + b"\0\0\0\0\0\xff\x06\0" + R.BLOCK_FIELD + (len(raw) + 25).to_bytes(2, "little") + raw + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out


def reads(n: int, wrap: int = 0, seed: int = 1) -> bytes:
    """Records whose qualities are full of marks, some empty, some of several lines."""
    rng = random.Random(seed)
    lines = lambda t: "\n".join(t[j : j + wrap] for j in range(0, len(t), wrap)) if wrap else t
    rows = [(i, size) for i, size in enumerate(rng.choices(range(40), k=n))]
    return "".join(f"@r{i} c {i}\n{lines(''.join(rng.choices('ACGTN', k=s)))}\n+\n{lines(''.join(rng.choices('@>+I', k=s)))}\n" for i, s in rows).encode()


def parts(kind, data, cuts):
    edges = [0, *cuts, None]
    return [r for a, b in zip(edges, edges[1:]) for r in R.read_range(kind(io.BytesIO(data)), a << kind.shift, None if b is None else b << kind.shift)]


@pytest.mark.parametrize("back,wrap", [(1 << 20, 0), (1 << 20, 7), (400, 7), (40, 0)])
def test_cut_at_every_byte(monkeypatch, back, wrap):
    for name, value in (("BACK", back), ("FURTHER", 2), ("CHUNK", 64)):
        monkeypatch.setattr(R, name, value)
    data = reads(20, wrap)
    whole = parts(R.Plain, data, [])
    assert [r[1] for r in whole] == [f"r{i}" for i in range(20)] and all(len(r[3]) == len(r[4]) for r in whole)
    assert all(parts(R.Plain, data, [cut]) == whole for cut in range(1, len(data)))
    packed = blocked(data)
    text = [r[1:] for r in whole]
    assert all([r[1:] for r in parts(R.Blocked, packed, [cut])] == text for cut in range(1, len(packed), 3))
    places = [r[0] for r in parts(R.Blocked, packed, [200])]
    assert places == sorted(set(places)) and parts(R.Plain, data, range(30, len(data), 50)) == whole


def test_grammar():
    """The same as the parser of whole files, for FASTA, wrapped lines, noise, cut and overlong qualities."""
    for text in ("@r1 first read\nacgt\nAC\n+\n@>+II\nI\n@r2\tx\nTTTT\n+r2\nIIII\n", ">a\r\nAC GT\r\n\r\n>b c d\r\nGG", "noise\n>a\n", "", "@r\nACGT\n+\nII\n", ">x\n@y\nAC\n> z\nA"):
        got = [r[1:] for r in R.records(R.split_lines([(0, text.encode())]))]
        assert got == list(fastx.parse(text.splitlines())), text
    fasta = "".join(f">s{i} x\nACG\nTT@A\n" for i in range(30)).encode()
    assert all(parts(R.Plain, fasta, [cut]) == parts(R.Plain, fasta, []) for cut in range(1, len(fasta)))
    with pytest.raises(R.Broken, match="record at 0"):
        parts(R.Plain, b"@a\nAC\n+\nIII\n@b\nA\n+\nI\n", [])


def test_gzip_members(monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 50)
    data = reads(200)
    packed = gzip.compress(data[:3000]) + gzip.compress(data[3000:]) + b"\0" * 20
    assert parts(R.Stream, packed, []) == parts(R.Plain, data, [])
    assert [R.kind_of(x[:18]) for x in (data, packed, blocked(data))] == ["plain", "stream", "blocked"]


def test_source(spark, tmp_path):
    """Several files and kinds at once, split into many ranges; empty files and folders; text that isn't Latin."""
    data = reads(300, 7)
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.fq").write_bytes(data)
    (tmp_path / "in/deep/b.fq.gz").write_bytes(gzip.compress(data))
    (tmp_path / "in/c.fq.bgz").write_bytes(blocked(data, 3000))
    (tmp_path / "in/d.fa").write_text(">é ü ß\nACGT\n>n\nNN\n")
    (tmp_path / "in/empty.fq").write_text("")
    (tmp_path / "in/_hidden").write_text(">no\nA\n")
    want = sorted((r[1], r[3], r[4]) for r in parts(R.Plain, data, []))
    found = R.scan_fastx(spark, str(tmp_path / "in"), split_bytes=700)
    assert found.rdd.getNumPartitions() > 30
    rows = found.collect()
    for end in ("a.fq", "b.fq.gz", "c.fq.bgz"):
        own = [r for r in rows if r.path.endswith(end)]
        assert sorted((r.name, r.seq, r.qual) for r in own) == want
        assert [r.name for r in sorted(own, key=lambda r: r.pos)] == [f"r{i}" for i in range(300)]
    assert sorted((r.name, r.comment, r.seq, r.qual) for r in rows if r.path.endswith("d.fa")) == [("n", "", "NN", None), ("é", "ü ß", "ACGT", None)]
    assert len(rows) == 902 and R.scan_fastx(spark, str(tmp_path / "in/*.fa")).select("seq").count() == 2
    assert R.scan_fastx(spark, str(tmp_path / "in/empty.fq")).count() == 0
    with pytest.raises(Exception, match="No such|not exist|no-such"):
        R.scan_fastx(spark, str(tmp_path / "no-such"))
