"""Column functions on nucleotide strings over A, C, G, T and N."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases of one packed long: two bits each, and the sign bit stays free.
PACK = 31
EVEN_BITS = 0x5555555555555555


def normalise(seq: Column) -> Column:
    """Upper case, U as T, anything else than A, C, G, T as N."""
    return F.regexp_replace(F.translate(seq, "acgtuU", "ACGTTT"), "[^ACGT]", "N")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def n_count(kmer: Column) -> Column:
    return F.length(kmer) - F.length(F.replace(kmer, F.lit("N"), F.lit("")))


def parts(k: int) -> int:
    return math.ceil(k / PACK)


def _digits(kmer: Column, part: int, to: str) -> Column:
    return F.conv(F.translate(F.substring(kmer, part * PACK + 1, PACK), "ACGTN", to), 4, 10).cast("long")


def packed(kmer: Column, k: int) -> Column:
    """struct(v: array of values, m: array of masks, null without an N): two bits a base, PACK bases a long; N is 0 with its
    mask bit set."""
    masks = F.when(F.contains(kmer, F.lit("N")), F.array(*[_digits(kmer, i, "00001") for i in range(parts(k))]))
    return F.struct(F.array(*[_digits(kmer, i, "01230") for i in range(parts(k))]).alias("v"), masks.alias("m"))


def mismatches(a: Column, b: Column, k: int) -> Column:
    """Hamming distance of two packed k-mers; N differs from everything, N included."""

    def one(i: int) -> Column:
        x = a["v"][i].bitwiseXOR(b["v"][i])
        differs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(EVEN_BITS))
        masks = [F.coalesce(x["m"][i], F.lit(0).cast("long")) for x in (a, b)]
        return F.bit_count(differs.bitwiseOR(masks[0]).bitwiseOR(masks[1]))

    return reduce(lambda x, y: x + y, [one(i) for i in range(parts(k))])


def blocks(k: int, errors: int) -> list[tuple[int, int]]:
    """(offset, length) of errors + 1 blocks that cover k bases; the first ones take the remainder."""
    n = errors + 1
    sizes = [k // n + (i < k % n) for i in range(n)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(n)]
