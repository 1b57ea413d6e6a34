"""Pairs of k-mers within a Hamming distance, on one or both strands.

Distinct k-mers are joined, never windows: equal windows share one search. With no error the join is on the k-mer. With E
errors a k-mer is cut into E + s blocks, of which at least s match exactly: the seeds are all choices of s blocks, joined by
equality and verified on packed bases. One block (s = 1) makes few seeds but short ones, which on a large corpus every k-mer
shares with very many others; s is chosen so that seeds and expected meetings together are fewest. A pair is kept only from
its first s matching blocks, which needs no distinct. A block with an N matches none.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import blocks, mismatches, packed, revcomp
from ..sources.stored import once

MAX_ERRORS = 4
#: Most blocks of a seed.
MOST = 4
#: Real k-mers meet so many times as often as those of random bases would.
UNEVEN = 16


def check(k: int, errors: int) -> None:
    if not 0 <= errors <= MAX_ERRORS:
        raise ValueError(f"E > {MAX_ERRORS} is not supported")
    if k < 1:
        raise ValueError("k must be at least 1")


def queries_of(kmers: DataFrame, both: bool) -> DataFrame:
    """(kmer, strand, q): what to search for; a bag union, so a palindrome is searched twice."""
    plus = kmers.select("kmer", F.lit("+").alias("strand"), F.col("kmer").alias("q"))
    return plus.unionAll(kmers.select("kmer", F.lit("-").alias("strand"), revcomp(F.col("kmer")).alias("q"))) if both else plus


def blocks_per_seed(k: int, errors: int, n: int) -> int:
    """s for a corpus of ``n`` k-mers."""
    def cost(s: int) -> float:
        return comb(errors + s, s) * (1 + UNEVEN * n / 4.0 ** (s * (k // (errors + s))))

    return min((s for s in range(1, MOST + 1) if errors + s <= k), key=cost)


def _choices(k: int, errors: int, s: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    cut = blocks(k, errors + s - 1)
    return cut, list(combinations(range(len(cut)), s))


def _seeds(kmer: Column, k: int, errors: int, s: int) -> Column:
    cut, choices = _choices(k, errors, s)
    made = [F.struct(F.lit(i).alias("b"), F.concat(*[F.substring(kmer, cut[j][0] + 1, cut[j][1]) for j in choice]).alias("seed")) for i, choice in enumerate(choices)]
    return F.filter(F.array(*made), lambda x: ~F.contains(x["seed"], F.lit("N")))


def _same_block(a: Column, b: Column, offset: int, length: int) -> Column:
    x = F.substring(a, offset + 1, length)
    return (x == F.substring(b, offset + 1, length)) & ~F.contains(x, F.lit("N"))


def pairs(searched: DataFrame, targets: DataFrame, k: int, errors: int, n: int = 0, s: int | None = None) -> DataFrame:
    """(kmer, strand, hit, cnt): hit is a k-mer of ``targets`` (kmer, cnt) within ``errors`` mismatches of q. ``n``: how many
    targets there are, more or less; ``s``: blocks of a seed, if they are not to be chosen by it."""
    check(k, errors)
    if k <= errors:
        raise ValueError("every window matches; use the number of windows")
    hits = targets.select(F.col("kmer").alias("hit"), "cnt")
    if errors == 0:
        return searched.filter(~F.contains("q", F.lit("N"))).join(hits.hint("merge"), F.col("q") == F.col("hit")).select("kmer", "strand", "hit", "cnt")
    s = s or blocks_per_seed(k, errors, n)
    cut, choices = _choices(k, errors, s)
    # packed once, not for every seed; what is searched for follows from the k-mer and the strand, so it isn't sent with each
    asks = once(searched, "qp", packed(F.col("q"), k)).select("kmer", "strand", "qp", F.explode(_seeds(F.col("q"), k, errors, s)).alias("s"))
    left = asks.select("kmer", "strand", "qp", "s.*")
    right = once(hits, "hp", packed(F.col("hit"), k)).select("hit", "cnt", "hp", F.explode(_seeds(F.col("hit"), k, errors, s)).alias("s")).select("hit", "cnt", "hp", "s.*")
    met = left.join(right.hint("merge"), ["b", "seed"]).filter(mismatches(F.col("qp"), F.col("hp"), k) <= errors)
    met = met.withColumn("q", F.when(F.col("strand") == "+", F.col("kmer")).otherwise(revcomp(F.col("kmer"))))
    # no block before the last chosen one matches but the chosen ones
    skipped = F.array(*[F.array(*[F.lit(j) for j in range(c[-1]) if j not in c]).cast("array<int>") for c in choices])
    earlier = [F.array_contains(F.get(skipped, F.col("b")), j) & _same_block(F.col("q"), F.col("hit"), o, length) for j, (o, length) in enumerate(cut[:-1])]
    return met.filter(~reduce(lambda x, y: x | y, earlier)).select("kmer", "strand", "hit", "cnt")
