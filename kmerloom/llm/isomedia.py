"""ISO base media files: nested boxes walked, sample tables decoded, keyframe byte ranges kept, payloads left as they are."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from kmerloom.llm.common import arrow_map

#: Fixed values of the format: boxes that hold boxes, the full boxes among them, and the unity matrix of a header.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: This writer's choices: 8-bit mono PCM at 8 kHz, so many bytes a sample, samples a chunk; each chunk starts with a sync sample.
RATE, SAMPLE_BYTES, CHUNK_SAMPLES = 8000, 64, 16


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_pcm(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit samples ('raw '), in chunks, movie header first, 64-bit chunk offsets."""
    n = len(payload) // SAMPLE_BYTES
    assert n and n * SAMPLE_BYTES == len(payload)
    chunks = -(-n // CHUNK_SAMPLES)
    tail = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] if chunks > 1 else []
    if not runs or tail != CHUNK_SAMPLES:
        runs.append((chunks, tail, 1))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    sync = range(1, n + 1, CHUNK_SAMPLES)

    def movie(first: int) -> bytes:
        offsets = [first + i * CHUNK_SAMPLES * SAMPLE_BYTES for i in range(chunks)]
        table = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, SAMPLE_BYTES)),
            full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)), full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)), full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)),
        )
        media = box(
            b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=3)
        head = full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, len(payload)), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", head, box(b"trak", track, media))

    start = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    long = len(payload) >= 2**32 - 8
    first = len(start) + len(movie(0)) + (16 if long else 8)
    return start + movie(first) + box(b"mdat", payload)


def walk(data: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start, begin, end) of every box, depth first: start is its header's, begin and end its body's. Sizes 0 (to the end) and 1
    (64 bits) are understood; a box that overruns ends its level. Levels wait on a list, so any depth is read."""
    levels = [(0, len(data))]
    while levels:
        at, end = levels.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                continue
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            continue
        levels.append((at + size, end))
        yield kind, at, at + head, at + size
        if kind in CONTAINERS:
            levels.append((at + head, at + size))


@dataclass
class Sizes:
    """Sizes of ``n`` samples: all ``same``, or those of ``table``. What a header declares isn't spelled out, so it costs no memory."""

    n: int = 0
    same: int = 0
    table: np.ndarray | None = None

    def each(self) -> Iterator[int]:
        if self.table is None:
            for _ in range(self.n if self.same else 0):
                yield self.same
        else:
            yield from map(int, self.table)


@dataclass
class Run:
    """Samples of a fragment: where they begin, their sizes, and which of them are sync samples (all without a table)."""

    at: int
    sizes: Sizes
    sync: np.ndarray | None = None
    first: bool = True
    others: bool = True


@dataclass
class Track:
    id: int = 0
    codecs: list[str] = field(default_factory=list)
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    #: (samples, delta) of each stretch; (duration, media time) of each edit
    deltas: list[tuple[int, int]] = field(default_factory=list)
    edits: list[tuple[int, int]] = field(default_factory=list)
    sizes: Sizes = field(default_factory=Sizes)
    runs: list[tuple[int, int]] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    sync: frozenset[int] | None = None
    fragments: list[Run] = field(default_factory=list)
    #: bytes of the file: no sample ends behind it
    limit: int = 0

    @property
    def codec(self) -> str:
        return self.codecs[0] if self.codecs else ""

    def marked(self) -> Iterator[tuple[int, int, bool]]:
        """(offset, bytes, sync sample?) of each sample in the order of its chunks, then of its fragments. Samples behind the file's end, and all
        after them in their table, don't exist, nor do those beyond as many bytes in all as the file has, however often tables point to one place."""
        sizes, i, run, left = self.sizes.each(), 0, -1, self.limit
        for c, at in enumerate(self.offsets, 1):
            while run + 1 < len(self.runs) and self.runs[run + 1][0] <= c:
                run += 1
            for _ in range(self.runs[run][1] if run >= 0 else 0):
                n = next(sizes, None)
                if n is None or at + n > self.limit or n > left:
                    sizes = iter(())
                    break
                i, left = i + 1, left - n
                yield at, n, self.sync is None or i in self.sync
                at += n
        for f in self.fragments:
            at = f.at
            for k, n in enumerate(f.sizes.each()):
                if at + n > self.limit or n > left:
                    break
                left -= n
                yield at, n, bool(f.sync[k]) if f.sync is not None and (k or not f.first) else f.first if not k else f.others
                at += n

    def samples(self) -> list[tuple[int, int]]:
        """(offset, bytes) of each sample."""
        return [(a, n) for a, n, _ in self.marked()]

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges of sync samples; without a sync table every sample is one."""
        return [(a, n) for a, n, key in self.marked() if key]

    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0


def _table(body: memoryview, kind: str, at: int, n: int) -> np.ndarray:
    """n values of a table that says so; fewer bytes than that are damage."""
    if n * np.dtype(kind).itemsize > len(body) - at:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(body, kind, n, at)


def _u32(body: memoryview, at: int, n: int = 1) -> tuple[int, ...]:
    return struct.unpack_from(f">{n}I", body, at)


#: Fixed values of the format: flags of a track's fragment (what it carries before its samples) and of a run of samples.
BASE, DESCRIPTION, DURATION, SIZE, FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
RUN_OFFSET, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT, NOT_SYNC = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800, 0x10000


def _sample_table(t: Track, kind: bytes, body: memoryview) -> None:
    """One box below a track into the track."""
    if kind == b"tkhd":
        t.id = _u32(body, 20 if body[0] else 12)[0]
    elif kind == b"mdhd":
        t.timescale, t.duration = struct.unpack_from(">IQ", body, 20) if body[0] else _u32(body, 12, 2)
    elif kind == b"hdlr":
        t.handler = bytes(body[8:12]).decode("latin-1")
    elif kind == b"stsd":
        at = 8
        while at + 8 <= len(body):
            size, codec = struct.unpack_from(">I4s", body, at)
            t.codecs.append(codec.decode("latin-1"))
            at += max(8, size)
    elif kind == b"elst":
        wide = body[0] == 1
        v = _table(body, ">u8,>i8,>u4" if wide else ">u4,>i4,>u4", 8, _u32(body, 4)[0])
        t.edits = [(int(x[0]), int(x[1])) for x in v]
    elif kind == b"stts":
        v = _table(body, ">u4", 8, 2 * _u32(body, 4)[0]).tolist()
        t.deltas = list(zip(v[::2], v[1::2]))
    elif kind == b"stsz":
        same, n = _u32(body, 4, 2)
        t.sizes = Sizes(n, same) if same else Sizes(n, 0, _table(body, ">u4", 12, n))
    elif kind == b"stz2":
        width, n = body[7], _u32(body, 8)[0]
        if width == 4:
            both = _table(body, "u1", 12, -(-n // 2))
            t.sizes = Sizes(n, 0, np.stack([both >> 4, both & 15], 1).ravel()[:n])
        elif width in (8, 16):
            t.sizes = Sizes(n, 0, _table(body, f">u{width // 8}", 12, n))
    elif kind == b"stsc":
        v = _table(body, ">u4", 8, 3 * _u32(body, 4)[0]).tolist()
        t.runs = list(zip(v[::3], v[1::3]))
    elif kind == b"stco":
        t.offsets = _table(body, ">u4", 8, _u32(body, 4)[0]).tolist()
    elif kind == b"co64":
        t.offsets = _table(body, ">u8", 8, _u32(body, 4)[0]).tolist()
    elif kind == b"stss":
        t.sync = frozenset(_table(body, ">u4", 8, _u32(body, 4)[0]).tolist())


def _fragment(body: memoryview, moof: int, defaults: dict[int, tuple]) -> tuple[int, int, int, int]:
    """(track, where its data begin, default size, default flags) of a track's fragment header."""
    flags, track = _u32(body, 0)[0] & 0xFFFFFF, _u32(body, 4)[0]
    size, mark = defaults.get(track, (0, 0))
    at, base = 8, moof
    if flags & BASE:
        base, at = struct.unpack_from(">Q", body, at)[0], at + 8
    at += 4 * bool(flags & DESCRIPTION) + 4 * bool(flags & DURATION)
    if flags & SIZE:
        size, at = _u32(body, at)[0], at + 4
    if flags & FLAGS:
        mark = _u32(body, at)[0]
    return track, base, size, mark


def _run(body: memoryview, base: int, size: int, mark: int, follows: int) -> Run:
    """A run of samples; without an offset it begins where the last one ended."""
    flags, n = _u32(body, 0)[0] & 0xFFFFFF, _u32(body, 4)[0]
    at, begin, first = 8, follows, None
    if flags & RUN_OFFSET:
        begin, at = base + struct.unpack_from(">i", body, at)[0], at + 4
    if flags & RUN_FIRST:
        first, at = not _u32(body, at)[0] & NOT_SYNC, at + 4
    fields = [f for f in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if flags & f]
    sizes, sync = Sizes(n, size), None
    if fields:
        rows = _table(body, ">u4", at, n * len(fields)).reshape(n, len(fields))
        if RUN_SIZE in fields:
            sizes = Sizes(n, 0, rows[:, fields.index(RUN_SIZE)])
        if RUN_FLAGS in fields:
            sync = rows[:, fields.index(RUN_FLAGS)] & NOT_SYNC == 0
    plain = not mark & NOT_SYNC
    return Run(begin, sizes, sync, plain if first is None and sync is None else bool(sync[0]) if first is None and n else bool(first), plain)


def read_tracks(data: bytes) -> list[Track]:
    """Tracks of a file by its headers alone, with their fragments; sample bytes aren't looked at. Foreign bytes give no tracks, a damaged table
    counts as absent, and what a table declares beyond its bytes or the file's is never built."""
    view = memoryview(data)
    tracks: list[Track] = []
    end, moof, header, follows, defaults = 0, 0, None, 0, {}
    for kind, start, a, b in walk(data):
        try:
            if kind == b"trak":
                tracks.append(Track(limit=len(data)))
                end = b
            elif kind == b"moof":
                moof = follows = start
                header = None
            elif kind == b"trex":
                track, _, _, size, mark = _u32(view, a + 4, 5) if b - a >= 24 else (0,) * 5
                defaults[track] = (size, mark)
            elif kind == b"tfhd":
                header = _fragment(view[a:b], moof, defaults)
                follows = header[1]
            elif kind == b"trun" and header:
                run = _run(view[a:b], *header[1:], follows)
                follows = run.at + (int(run.sizes.table.sum()) if run.sizes.table is not None else run.sizes.n * run.sizes.same)
                for t in tracks:
                    if t.id == header[0] and run.at >= 0:
                        t.fragments.append(run)
                        break
            elif tracks and b <= end:
                _sample_table(tracks[-1], kind, view[a:b])
        except (struct.error, IndexError, ValueError):
            continue  # a table cut short stays empty
    return tracks


def describe(track: Track, samples: int, keyframes: int) -> str:
    return f"codec={track.codec.strip()} handler={track.handler} seconds={track.seconds():.3f} samples={samples} keyframes={keyframes}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, keyframe_ranges string"


def store(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Each text as a media column: UTF-8 bytes, zero-padded to a positive multiple of 64, as 8-bit samples of an ISO file.

    The digests are of bytes read back by the sample tables. A null text counts as empty (64 zero bytes); rows stay one to one, repeated
    and null ids included; other columns are ignored. Work is row by row, nothing is shuffled.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            raw = (text or "").encode()
            media = write_pcm(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
            track = read_tracks(media)[0]
            found = list(track.marked())
            keys = [f"{a}+{n}" for a, n, key in found if key]
            back = b"".join(media[a : a + n] for a, n, _ in found)
            values = (doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(track, len(found), len(keys)), media if keep_media else None, ",".join(keys))
            for column, v in zip(out.values(), values):
                column.append(v)
        return out

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), rows, SCHEMA)
