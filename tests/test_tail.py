import gzip
import io

import pytest

from kmerloom.sources import tail as T


def fastq(a, b):
    return "".join(f"@r{i} c\nACGT{'ACGT' * (i % 3)}\n+\n@>+I{'IIII' * (i % 3)}\n" for i in range(a, b)).encode()


def test_batches_end_at_records(tmp_path):
    """Whatever has come so far, batches hold whole records, once each, in order."""
    path, data = str(tmp_path / "in.fq"), fastq(0, 12)
    assert T.whole_records(path, 0, 5) == ([], 0)
    for rows in (1, 3, 100):
        at, names = 0, []
        for size in [*range(0, len(data), 7), len(data)]:
            (tmp_path / "in.fq").write_bytes(data[:size])
            found, end = T.whole_records(path, at, rows)
            again = list(T.TailReader(path, rows).readBetweenOffsets({"byte": at}, {"byte": end}))
            assert [r[1:] for r in again] == found
            names += [r[1] for r in found]
            at = end
        (tmp_path / f"in.fq{T.ENDED}").touch()
        while (step := T.whole_records(path, at, rows))[0]:
            names += [r[1] for r in step[0]]
            at = step[1]
        (tmp_path / f"in.fq{T.ENDED}").unlink()
        assert names == [f"r{i}" for i in range(12)] and at == len(data)


@pytest.mark.parametrize("packed", [False, True])
def test_spool(tmp_path, packed):
    path, data = str(tmp_path / "spooled"), fastq(0, 50)
    T.spool(io.BytesIO(gzip.compress(data[:900]) + gzip.compress(data[900:]) if packed else data), path)
    assert (tmp_path / "spooled").read_bytes() == data and len(T.whole_records(path, 0, 100)[0]) == 50


def test_a_stream_stopped_and_started_again(spark, tmp_path):
    path = str(tmp_path / "in.fq")

    def run():
        stream = T.stream_tail(spark, path, 7).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out"))
        query = stream.start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.name, r.seq, r.qual) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    with open(path, "wb") as f:
        f.write(fastq(0, 20) + b"@r20 c\nAC")
    assert [n for n, _, _ in run()] == sorted(f"r{i}" for i in range(20))
    with open(path, "ab") as f:
        f.write(fastq(20, 33)[len(b"@r20 c\nAC") :])
    (tmp_path / f"in.fq{T.ENDED}").touch()
    got = run()
    assert len(got) == 33 and {n for n, _, _ in got} == {f"r{i}" for i in range(33)} and all(len(s) == len(q) for _, s, q in got)
