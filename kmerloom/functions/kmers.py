"""k-mers, strands and hashes as column expressions.

A hash is, by name: ``md5`` (16 hex digits, whose string order is the unsigned order), ``xxhash64`` (a long, ordered as unsigned
after a flip of the sign bit) or ``murmur3`` (64 bits of x64_128, seed 42, as 16 hex digits, by an Arrow UDF).

How k-mers are hashed is said by three keywords everywhere (``**how`` where a function only hands them on): ``name`` of the hash,
``canonical`` (the smaller hash of both strands) and ``valid_only`` (k-mers beyond A, C, G, T are masked).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from kmerloom.functions import arrays as A

BASES, COMPLEMENT = "ACGTacgt", "TGCAtgca"


def normalise(seq: Column) -> Column:
    """Sequences are compared in upper case."""
    return F.upper(seq)


def dna(text: Column) -> Column:
    """A fixed ACGT projection of any text: its letters a-z in turn become A, C, G, T, A, ...; all else goes."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def kmers(seq: Column, k: int) -> Column:
    """All overlapping substrings of length k, in order; none for a shorter or null text. One linear pass by look-ahead."""
    return F.coalesce(F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), 1), F.array().cast("array<string>"))


def kmers_multi(seq: Column, ks: list[int]) -> Column:
    """k-mers of several lengths, one list after the other."""
    return F.flatten(F.array(*(kmers(seq, k) for k in ks)))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENT))


def is_valid(kmer: Column) -> Column:
    """Only A, C, G and T; other k-mers count as masked."""
    return kmer.rlike(r"^[ACGTacgt]+\z")


def _fmix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def murmur3_x64(values: list[bytes], seed: int = 42) -> np.ndarray:
    """First 64 bits of MurmurHash3 x64_128 of each value; values of one length are hashed together.

    The multipliers and rotations are the published algorithm's fixed values.
    """
    c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    out = np.zeros(len(values), np.uint64)
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        padded = -(-int(n) // 16) * 16
        data = np.zeros((len(rows), padded), np.uint8)
        if n:
            data[:, :n] = np.frombuffer(b"".join(values[i] for i in rows), np.uint8).reshape(len(rows), n)
        words = data.view("<u8")
        h1 = np.full(len(rows), seed, np.uint64)
        h2 = h1.copy()
        for b in range(int(n) // 16):
            h1 = (turn(h1 ^ (turn(words[:, 2 * b] * c1, 31) * c2), 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
            h2 = (turn(h2 ^ (turn(words[:, 2 * b + 1] * c2, 33) * c1), 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
        if n % 16:
            h2 = h2 ^ (turn(words[:, -1] * c2, 33) * c1) if n % 16 > 8 else h2
            h1 = h1 ^ (turn(words[:, -2] * c1, 31) * c2)
        h1, h2 = h1 ^ np.uint64(n), h2 ^ np.uint64(n)
        h1 = h1 + h2
        h2 = h2 + h1
        out[rows] = _fmix(h1) + _fmix(h2)
    return out


@F.pandas_udf(StringType())
def _murmur3_hex(values: pd.Series) -> pd.Series:
    hashed = murmur3_x64([v.encode() for v in values.fillna("")])
    return pd.Series([f"{h:016x}" for h in hashed.tolist()]).where(values.notna().to_numpy(), None)


@F.pandas_udf(ArrayType(StringType()))
def _murmur3_list(lists: pd.Series) -> pd.Series:
    """The same of whole lists, hashed together."""
    hexed = [f"{h:016x}" for h in murmur3_x64([v.encode() for values in lists for v in values]).tolist()]
    ends = np.cumsum([len(values) for values in lists], dtype=np.int64)
    return pd.Series([hexed[e - len(values) : e] for e, values in zip(ends.tolist(), lists)], dtype=object)


HASHES: dict[str, Callable[[Column], Column]] = {
    "md5": lambda c: F.substring(F.md5(c), 1, 16),
    "xxhash64": lambda c: F.xxhash64(c),
    "murmur3": lambda c: _murmur3_hex(c),
}


def order_key(h: Column, name: str) -> Column:
    """What unsigned hash order is for a hash of this name."""
    return h.bitwiseXOR(F.lit(-(2**63))) if name == "xxhash64" else h


def kmer_hash(kmer: Column, name: str = "md5", canonical: bool = False) -> Column:
    """The k-mer's hash, or the smaller hash of its two strands."""
    h = HASHES[name]
    if not canonical:
        return h(kmer)
    both = [order_key(h(c), name) for c in (kmer, reverse_complement(kmer))]
    return order_key(F.least(*both), name)


def hashes(seq: Column, ks: list[int], name: str = "md5", canonical: bool = False, valid_only: bool = False) -> Column:
    """Hash of every k-mer in sequence order, duplicates kept; masked k-mers are left out."""
    listed = kmers_multi(seq, ks)
    listed = F.filter(listed, is_valid) if valid_only else listed
    if name != "murmur3":
        return F.transform(listed, lambda x: kmer_hash(x, name, canonical))
    # a Python hash can't run inside an array function, so it takes the lists
    one = _murmur3_list(listed)
    return F.zip_with(one, _murmur3_list(F.transform(listed, reverse_complement)), lambda a, b: F.least(a, b)) if canonical else one


def hash_type(name: str = "md5") -> str:
    return "bigint" if name == "xxhash64" else "string"


def depth_key(kmer: Column, canonical: bool = False) -> Column:
    """A long that stands for the k-mer (or for both its strands) where only equality counts."""
    return F.xxhash64(F.least(kmer, reverse_complement(kmer)) if canonical else kmer)


def slot(h: Column, slots: int, name: str = "md5") -> Column:
    """Which of ``slots`` counters a hash falls into."""
    return F.pmod(h if name == "xxhash64" else F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(slots))


def bottom(h: Column, s: int | None, name: str = "md5") -> Column:
    """The s smallest distinct hashes, ascending as unsigned; all of them without s."""
    keyed = F.transform(h, lambda x: order_key(x, name)) if name == "xxhash64" else h
    ranked = F.sort_array(F.array_distinct(keyed))
    ranked = F.slice(ranked, 1, s) if s else ranked
    return F.transform(ranked, lambda x: order_key(x, name)) if name == "xxhash64" else ranked


def sketch(seq: Column, ks: list[int], s: int | None, name: str = "md5", canonical: bool = False, valid_only: bool = False, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> Column:
    """The s smallest distinct hashes of the sequence's k-mers, ascending as unsigned (all of them without s; none for null), hashed as arrays. ``keep`` says which of many hashes count."""
    if name not in A.NAMES:
        if keep is not None:
            raise ValueError(f"{name} hashes have no filter")
        return bottom(hashes(seq, ks, name, canonical, valid_only), s, name)

    @F.arrow_udf(ArrayType(StringType()))
    def made(column: pa.Array) -> pa.Array:
        values, counts = [], []
        for _, v, n in A.hashed_texts(column, ks, name, canonical, valid_only):
            if keep is not None:
                kept = keep(v)
                v, n = v[kept], np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(n)])])
            v, n = A.smallest(v, n, s)
            values.append(A.hexed(v))
            counts.append(n)
        return A.listed(pa.concat_arrays(values), np.concatenate(counts)) if values else pa.array([], pa.list_(pa.string()))

    return made(seq)


def substitutions(kmer: Column) -> Column:
    """array<struct<at int, orig, alt, kmer>>: each base of A, C, G, T replaced by each of the three others."""
    def at(i: Column) -> Column:
        base = F.substring(kmer, i + 1, F.lit(1))
        swapped = lambda a: F.struct(i.alias("at"), base.alias("orig"), a.alias("alt"), F.concat(F.substring(kmer, F.lit(1), i), a, F.substring(kmer, i + 2, F.length(kmer))).alias("kmer"))
        return F.transform(F.filter(F.array(*map(F.lit, "ACGT")), lambda a: (a != base) & base.isin(*"ACGT")), swapped)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(kmer) - 1), at))


def deletions(stretch: Column, width: int = 1) -> Column:
    """array<struct<at int, orig, kmer>>: the stretch without ``width`` neighbouring bases, at each place."""
    def at(i: Column) -> Column:
        return F.struct(i.alias("at"), F.substring(stretch, i + 1, F.lit(width)).alias("orig"), F.concat(F.substring(stretch, F.lit(1), i), F.substring(stretch, i + 1 + width, F.length(stretch))).alias("kmer"))

    return F.when(F.length(stretch) >= width, F.transform(F.sequence(F.lit(0), F.length(stretch) - width), at)).otherwise(F.expr("cast(array() as array<struct<at:int,orig:string,kmer:string>>)"))


def insertions(kmer: Column) -> Column:
    """array<struct<at int, alt, kmer>>: one base put in before each place but the first; the last base falls off."""
    def at(i: Column) -> Column:
        return F.transform(F.array(*map(F.lit, "ACGT")), lambda a: F.struct(i.alias("at"), a.alias("alt"), F.concat(F.substring(kmer, F.lit(1), i), a, F.substring(kmer, i + 1, F.length(kmer) - i - 1)).alias("kmer")))

    none = F.expr("cast(array() as array<struct<at:int,alt:string,kmer:string>>)")
    return F.when(F.length(kmer) >= 2, F.flatten(F.transform(F.sequence(F.lit(1), F.length(kmer) - 1), at))).otherwise(none)


def six(number: Column) -> Column:
    """A number as text with six decimals."""
    return F.format_string("%.6f", F.round(number, 6))


def ratio_text(shared: Column, total: Column) -> Column:
    """shared/total as text."""
    return F.concat_ws("/", shared.cast("string"), total.cast("string"))


def concise(pairs: Column) -> Column:
    """'k:v;...' of array<struct<v, k>>, falling by v, then by k."""
    return F.array_join(F.transform(F.array_sort(pairs, lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda p: F.concat_ws(":", p["k"], p["v"].cast("string"))), ";")
