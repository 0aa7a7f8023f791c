"""k-mers of a whole Arrow column as arrays of 64-bit hashes: windows over the bytes in numpy, no string a k-mer.

``md5`` (its first 8 bytes) and ``murmur3`` give the numbers whose 16 hex digits functions/kmers.py speaks of; unsigned order is the order of the digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: k-mers hashed at once, so that what a step makes stays in the cache; characters worked on at once.
CHUNK, SLICE = 1 << 14, 1 << 20
NAMES = ("md5", "murmur3")
_SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(b"ACGTacgt")] = list(b"TGCAtgca")
_OTHER = str.maketrans("ACGTacgt", "TGCAtgca")
_MASKED = np.ones(256, bool)
_MASKED[list(b"ACGTacgt")] = False
_DIGITS = np.frombuffer("".join(f"{i:04x}" for i in range(1 << 16)).encode(), "<u4")
_VALUE = np.full(256, 16, np.uint8)
_VALUE[list(b"0123456789abcdef")] = range(16)


def _md5(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """First 64 bits of the MD5 of n messages of one block, given as 16 words of 32 bits (numbers where all agree)."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(words[g], int):
            np.add(f, np.uint32((int(_SINES[i]) + words[g]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, words[g], out=f)
            np.add(f, _SINES[i], out=f)
        r = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(r), out=t)
        np.right_shift(f, np.uint32(32 - r), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _murmur3(words: list[np.ndarray], length: int, seed: int = 42) -> np.ndarray:
    """First 64 bits of MurmurHash3 x64_128 of messages of one length, given as little-endian words of 64 bits (the last ones padded with zeros)."""
    c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    h1 = np.full(len(words[0]), seed, np.uint64)
    h2 = h1.copy()
    for b in range(length // 16):
        h1 = (_turn(h1 ^ (_turn(words[2 * b] * c1, 31) * c2), 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
        h2 = (_turn(h2 ^ (_turn(words[2 * b + 1] * c2, 33) * c1), 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
    if length % 16 > 8:
        h2 = h2 ^ (_turn(words[-1] * c2, 33) * c1)
    if length % 16:
        h1 = h1 ^ (_turn(words[2 * (length // 16)] * c1, 31) * c2)
    h1, h2 = h1 ^ np.uint64(length), h2 ^ np.uint64(length)
    h1 = h1 + h2
    h2 = h2 + h1
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h1, h2 = ((h ^ (h >> np.uint64(33))) * np.uint64(factor) for h in (h1, h2))
    return (h1 ^ (h1 >> np.uint64(33))) + (h2 ^ (h2 >> np.uint64(33)))


def hash_windows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int, name: str) -> np.ndarray:
    """Hash of every stretch of the bytes ``data`` by its start and length."""
    wide = np.zeros(len(data) + 24, np.uint32)
    wide[: len(data)] = data
    word = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    if isinstance(lengths, int):
        return _hashed_windows(data, word, starts, lengths, name)
    out = np.zeros(len(starts), np.uint64)
    for n in np.flatnonzero(np.bincount(lengths)).tolist():
        rows = np.flatnonzero(lengths == n)
        out[rows] = _hashed_windows(data, word, starts[rows], n, name)
    return out


def _hashed_windows(data: np.ndarray, word: np.ndarray, starts: np.ndarray, length: int, name: str) -> np.ndarray:
    """The same of one length; ``word`` are the four bytes from each place on."""
    if name == "md5" and length > 55:  # more than one block
        raw = data.tobytes()
        return np.array([int.from_bytes(hashlib.md5(raw[s : s + length]).digest()[:8]) for s in starts.tolist()], np.uint64)
    out = np.empty(len(starts), np.uint64)
    whole, rest = divmod(length, 4)
    keep = np.uint32((1 << 8 * rest) - 1)
    for i in range(0, len(starts), CHUNK):
        s = starts[i : i + CHUNK]
        words: list = [word[s + 4 * j] for j in range(whole)]
        tail = word[s + 4 * whole] & keep if rest else None
        if name == "md5":
            words.append(tail | np.uint32(0x80 << 8 * rest) if rest else 0x80)
            words += [0] * (14 - len(words)) + [8 * length, 0]
            out[i : i + CHUNK] = _md5(words, len(s))
        else:
            words += [tail] if rest else []
            words = [w.astype(np.uint64) for w in words]
            words += [np.zeros(len(s), np.uint64)] * (len(words) % 2)
            out[i : i + CHUNK] = _murmur3([a | b << np.uint64(32) for a, b in zip(words[::2], words[1::2])], length)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column and where each begins and ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _hashed(data: np.ndarray, offsets: np.ndarray, k: int, name: str, canonical: bool, valid_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers (of code points) and how many each text has."""
    plain = not len(data) or int(data.max()) < 128
    first = np.arange(len(data)) if plain else np.flatnonzero(data & 0xC0 != 0x80)  # where characters begin
    ends = offsets if plain else np.searchsorted(first, offsets)
    chars, edge = len(first), np.append(first, len(data))
    fits = np.arange(chars) + k <= np.repeat(ends[1:], np.diff(ends))
    at = np.flatnonzero(fits)
    starts = first[at]
    lengths = k if plain else edge[at + k] - starts
    if valid_only:
        bad = np.concatenate([[0], np.cumsum(_MASKED[data])])
        good = bad[starts + lengths] == bad[starts]
        at, starts, lengths = at[good], starts[good], lengths if plain else lengths[good]
    out = hash_windows(data, starts, lengths, name)
    if canonical and len(at):
        if plain:
            out = np.minimum(out, hash_windows(_COMPLEMENT[data][::-1], len(data) - starts - k, k, name))
        else:
            back = np.frombuffer(data.tobytes().decode().translate(_OTHER)[::-1].encode(), np.uint8)
            out = np.minimum(out, hash_windows(back, np.flatnonzero(back & 0xC0 != 0x80)[chars - at - k], lengths, name))
    return out, np.diff(np.searchsorted(at, ends))


def hashed_texts(column: pa.Array, ks: list[int], name: str = "md5", canonical: bool = False, valid_only: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, hashes, counts) by slices of rows of a column: the first row, all hashes in order of rows (of a row in any order) and how many each row has."""
    data, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        each = [_hashed(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], k, name, canonical, valid_only) for k in ks]
        values, counts = each[0]
        if len(ks) > 1:
            owner = np.concatenate([np.repeat(np.arange(end - row), n) for _, n in each])
            values, counts = np.concatenate([v for v, _ in each])[np.argsort(owner, kind="stable")], sum(n for _, n in each)
        yield row, values, counts
        row = end


def distinct(values: np.ndarray) -> np.ndarray:
    """The values once each, ascending."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def smallest(values: np.ndarray, counts: np.ndarray, s: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its distinct values, ascending, the first s of them."""
    ends = np.cumsum(counts)
    kept = [distinct(values[e - n : e])[:s] for e, n in zip(ends.tolist(), counts.tolist())]
    return np.concatenate(kept) if kept else values, np.array([len(x) for x in kept], np.int64)


def hexed(values: np.ndarray) -> pa.Array:
    """16 hex digits of each number."""
    digits = _DIGITS[values.astype(">u8").view(">u2")]
    return pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(np.arange(0, 16 * len(values) + 16, 16, np.int32)), pa.py_buffer(digits)])


def numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes as unsigned numbers (16 hex digits, or longs), and which of them are hashes: others, nulls too, are none."""
    if pa.types.is_integer(values.type):
        return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), values.is_valid().to_numpy(zero_copy_only=False)
    data, offsets = text_bytes(values)
    ok = np.diff(offsets) == 16
    digits = _VALUE[data.reshape(-1, 16) if ok.all() else data[(offsets[:-1][ok][:, None] + np.arange(16))]]
    good = (digits < 16).all(1)
    pairs = (digits[:, ::2] << 4) | digits[:, 1::2]
    out = np.zeros(len(values), np.uint64)
    out[ok] = np.where(good, np.ascontiguousarray(pairs).view(">u8").ravel().astype(np.uint64), np.uint64(0))
    ok[ok] = good
    return out, ok


def listed(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
