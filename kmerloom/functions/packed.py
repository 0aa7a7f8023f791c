"""k-mers of A, C, G and T as one long, two bits a letter, so that k-mers are folded and shuffled as numbers. k is 31 at most; k-mers of one k in order of letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 31
_M1, _M2, _M4, _M8, _M16 = 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF


def packable(kmer: Column) -> Column:
    return kmer.rlike(r"^[ACGT]+\z")


def pack(kmer: Column) -> Column:
    """The long of a k-mer of capital A, C, G, T (A 0, C 1, G 2, T 3, the first letter highest)."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(code: Column, k: int) -> Column:
    """The k-mer of a long."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def other_strand(table: DataFrame, code: str, k: int, out: str) -> DataFrame:
    """``table`` with the long of the other strand of ``code``: complemented letters (3 less a letter), letters in reverse by swapping ever larger groups of bits."""
    x = F.bitwise_not(F.col(code))
    table = table.withColumn(out, x)
    for width, mask in ((2, _M1), (4, _M2), (8, _M4), (16, _M8), (32, _M16)):
        c, m = F.col(out), F.lit(mask)
        table = table.withColumn(out, F.shiftleft(c.bitwiseAND(m), width).bitwiseOR(F.shiftrightunsigned(c, width).bitwiseAND(m)))
    return table.withColumn(out, F.shiftrightunsigned(F.col(out), 64 - 2 * k))


def spelled(seqs: DataFrame, k: int, canonical: bool = False, valid_only: bool = False) -> DataFrame:
    """(code, text) of every k-mer of ``seqs(seq)``, k up to ``LONGEST``: a long where it is of capital A, C, G and T, else its text; of both strands the one that comes first, if canonical.

    Texts are cut into windows of ``LONGEST`` letters that overlap by k - 1, by one look-ahead regular expression; a window is packed once and its k-mers are stretches of its bits.
    """
    step = LONGEST + 1 - k
    cut = F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{{k},{LONGEST}}})).{{1,{step}}}"), 1)
    rows = seqs.select(F.explode_outer(cut).alias("w")).filter(F.col("w").isNotNull())
    rows = rows.select("w", F.length("w").alias("n"), F.when(packable(F.col("w")), pack(F.rpad("w", LONGEST, "A"))).alias("c"))
    rows = other_strand(rows, "c", LONGEST, "r") if canonical else rows
    rows = rows.select("*", F.explode(F.array(*map(F.lit, range(step)))).alias("i")).filter(F.col("i") <= F.col("n") - k)
    each = [F.expr(f"shiftrightunsigned(c, {2 * (step - 1)} - 2 * i)"), *([F.expr("shiftrightunsigned(r, 2 * i)")] if canonical else [])]
    each = [x.bitwiseAND(F.lit((1 << 2 * k) - 1)) for x in each]
    rows = rows.select(F.when(F.col("c").isNull(), F.substring("w", F.col("i") + 1, F.lit(k))).alias("t"), (F.least(*each) if canonical else each[0]).alias("c"))
    rows = rows.filter(F.col("t").isNull() | F.col("t").rlike(r"^[ACGTacgt]+\z")) if valid_only else rows
    t = F.col("t")
    flipped = F.reverse(F.translate(t, "ACGTacgt", "TGCAtgca"))
    packed, text = (F.least(pack(t), pack(flipped)), F.least(t, flipped)) if canonical else (pack(t), t)
    return rows.select(F.coalesce("c", F.when(packable(t), packed)).alias("code"), F.when(~packable(t), text).alias("text"))


def folded(kmers: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(kmer, n) of ``kmers(kmer)``, all of length k: occurrences of every k-mer, or with ``canonical`` of either strand (``kmer`` is the strand that comes
    first). A long a k-mer is folded in place and shuffled; longer k-mers and those with other letters keep their text."""
    plain = packable(F.col("kmer")) if k <= LONGEST else F.lit(False)
    coded = kmers.select(F.when(plain, pack(F.col("kmer"))).alias("code"), F.when(~plain, F.col("kmer")).alias("text"))
    if canonical:
        flipped = F.reverse(F.translate("text", "ACGTacgt", "TGCAtgca"))
        coded = other_strand(coded, "code", min(k, LONGEST), "other").select(F.least("code", "other").alias("code"), F.least("text", flipped).alias("text"))
    counted = coded.groupBy("code", "text").agg(F.count("*").alias("n"))
    return counted.select(F.coalesce(F.col("text"), unpack(F.col("code"), min(k, LONGEST))).alias("kmer"), "n")
