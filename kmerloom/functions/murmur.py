"""MurmurHash3 x64_128 of k-mer tables in DataFrame functions: 64-bit words, no Python worker.

The hash needs products and sums modulo 2^64. Long columns give them when an overflow isn't an error, so the steps are made with
``spark.sql.ansi.enabled`` off; Spark settles that when a step is made, and the session's own setting is back before the table is used. (Spark Connect settles it
later, so there the setting has to be off.) A value that is used twice is a column of its own first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.kmers import reverse_complement
from kmerloom.functions.packed import other_strand

#: The published algorithm's fixed values: two multipliers, those of the final mix, and what a block adds to each half.
C1, C2, MIX1, MIX2, ADD1, ADD2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x52DCE729, 0x38495AB5


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Arithmetic on longs in tables made here is modulo 2^64."""
    setting = "spark.sql.ansi.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _long(n: int) -> Column:
    """A 64-bit number as the long of the same bits."""
    return F.lit(n - 2**64 if n >= 2**63 else n).cast("long")


def _turned(x: Column, r: int) -> Column:
    return F.shiftleft(x, r).bitwiseOR(F.shiftrightunsigned(x, 64 - r))


def _xor_shift(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def _spelt(df: DataFrame, bits: dict[str, tuple[Column, int]], k: int) -> DataFrame:
    """``df`` with words ``bits`` (name: column, i): the bytes of letters 8 i to 8 i + 7 (as far as k), of two bits each in the column, the first one lowest."""
    df = df.withColumns({w: F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) for w, (x, i) in bits.items()})
    for shift, mask in ((24, 0x000000FF000000FF), (12, 0x000F000F000F000F), (6, 0x0303030303030303)):
        df = df.withColumns({w: F.col(w).bitwiseOR(F.shiftleft(w, shift)).bitwiseAND(F.lit(mask)) for w in bits})
    ones = F.lit(0x0101010101010101)
    df = df.withColumns({x: y for w in bits for x, y in ((w, F.col(w).bitwiseAND(ones)), (f"{w}h", F.shiftrightunsigned(w, 1).bitwiseAND(ones)))})
    spelt = lambda w: F.lit(0x4141414141414141) + F.col(w) * 2 + F.col(f"{w}h") * 6 + F.col(w).bitwiseAND(F.col(f"{w}h")) * 11  # noqa: E731  A, C, G, T
    return df.withColumns({w: spelt(w).bitwiseAND(_long((1 << 8 * min(8, k - 8 * i)) - 1)) for w, (_, i) in bits.items()}).drop(*(f"{w}h" for w in bits))


def with_murmur3(table: DataFrame, kmer: str, k: int, out: str = "hash", canonical: bool = False, seed: int = 42, code: str | None = None) -> DataFrame:
    """``table`` with the first 64 bits of the hash of its column ``kmer`` as 16 hex digits in ``out``, or with ``canonical`` the smaller one of both strands; null for null.

    K-mers are ``k`` letters of one byte each (masked ones are gone before). Where ``kmer`` is null, the long ``code`` (functions/packed.py) may stand for it.
    """
    kept = [c for c in table.columns if c != out]
    table = table if code is None else other_strand(table.withColumn("_c", F.coalesce(code, F.lit(0))), "_c", k, "_o")
    none = F.col(kmer).isNull() if code is None else F.col(kmer).isNull() & F.col(code).isNull()
    strands = {"_f": F.col(kmer)} | ({"_r": reverse_complement(F.col(kmer))} if canonical else {})
    blocks, n = k // 16, _long(k)
    words = {f"{s}{i}": (s, i) for s in strands for i in range(2 * blocks + 2) if 8 * i < k}
    sides = [f"{s}{h}" for s in strands for h in "ab"]

    def step(df: DataFrame, new: dict[str, Column], drop: list[str] | tuple[str, ...] = ()) -> DataFrame:
        return df.withColumns(new).drop(*drop)

    def word(s: str, i: int) -> Column:
        """Bytes 8 i to 8 i + 7 as a number, the first one highest; zeros behind the end."""
        digits = F.rpad(F.hex(F.substring(strands[s], 8 * i + 1, 8)), 16, "0")
        return F.coalesce(F.conv(digits, 16, -10).cast("long"), F.lit(0))  # what can't be null takes much less code

    with wrapping(table.sparkSession):
        df = step(table.select(*kept, *([] if code is None else ["_c", "_o"])), {w: word(*at) for w, at in words.items()})
        for shift, mask in ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):  # to the first byte lowest
            df = step(df, {w: F.shiftleft(F.col(w).bitwiseAND(F.lit(mask)), shift).bitwiseOR(F.shiftrightunsigned(F.col(w), shift).bitwiseAND(F.lit(mask))) for w in words})
        df = step(df, {w: _turned(F.col(w), 32) for w in words})
        if code is not None:  # the other strand's letters, complemented, are the strand's own from behind
            df = _spelt(df, {f"{w}c": (F.bitwise_not(F.col("_o" if s == "_f" else "_c")), i) for w, (s, i) in words.items()}, k)
            df = step(df, {w: F.when(F.col(code).isNull(), F.col(w)).otherwise(F.col(f"{w}c")) for w in words}, ["_c", "_o", *(f"{w}c" for w in words)])
        df = step(df, {w: F.col(w) * _long(C2 if i % 2 else C1) for w, (_, i) in words.items()})
        df = step(df, {w: _turned(F.col(w), 33 if i % 2 else 31) * _long(C1 if i % 2 else C2) for w, (_, i) in words.items()})
        df = step(df, {x: _long(seed) for x in sides})
        for b in range(blocks):
            for h, other, i, r, more in (("a", "b", 2 * b, 27, ADD1), ("b", "a", 2 * b + 1, 31, ADD2)):
                df = step(df, {f"{s}{h}": F.col(f"{s}{h}").bitwiseXOR(F.col(f"{s}{i}")) for s in strands}, [f"{s}{i}" for s in strands])
                df = step(df, {f"{s}{h}": (_turned(F.col(f"{s}{h}"), r) + F.col(f"{s}{other}")) * _long(5) + _long(more) for s in strands})
        tail = {f"{s}{h}": f"{s}{2 * blocks + j}" for s in strands for j, h in enumerate("ab")}
        df = step(df, {x: (F.col(x).bitwiseXOR(F.col(w)) if w in words else F.col(x)).bitwiseXOR(n) for x, w in tail.items()}, [w for w in tail.values() if w in words])
        df = step(df, {f"{s}a": F.col(f"{s}a") + F.col(f"{s}b") for s in strands})
        df = step(df, {f"{s}b": F.col(f"{s}b") + F.col(f"{s}a") for s in strands})
        for factor in (MIX1, MIX2):
            df = step(df, {x: _xor_shift(F.col(x)) * _long(factor) for x in sides})
        df = step(df, {s: _xor_shift(F.col(f"{s}a")) + _xor_shift(F.col(f"{s}b")) for s in strands}, sides)
    unsigned = lambda x: x.bitwiseXOR(F.lit(-(2**63)))
    lowest = unsigned(F.least(*(unsigned(F.col(s)) for s in strands))) if canonical else F.col("_f")
    return df.select(*kept, F.when(~none, F.lower(F.lpad(F.hex(lowest), 16, "0"))).alias(out))
