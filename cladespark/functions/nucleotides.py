"""Column functions for nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nucleotides(text: Column) -> Column:
    """The letters A, C, G, T and U of any text, in upper case; U counts as T."""
    return F.translate(F.regexp_replace(F.upper(text), "[^ACGTU]", ""), "U", "T")


def two_bit(seq: Column) -> Column:
    """The string that a packing of two bits a base keeps: whatever is not A, C, G, T or U is an A; lower case too."""
    return F.regexp_replace(F.translate(seq, "U", "T"), "[^ACGT]", "A")


def four_bit(seq: Column) -> Column:
    """Aligned bases: A, C, G, T (U counts as T); whatever else stands for a gap is '-'."""
    return F.regexp_replace(F.translate(seq, "U", "T"), "[^ACGT]", "-")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def kmers(seq: Column, k: int = 15) -> Column:
    """array<string> of all k-mers in order; empty where the sequence is shorter than k."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def pieces(seq: Column, k: int = 15, size: int = 10_000) -> Column:
    """array<string> of overlapping pieces with `size` k-mers each, so that each k-mer is in one piece: exploded before `kmers`, they keep
    the k-mers of a long sequence out of one row."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(0), F.floor((F.length(seq) - k) / size).cast("int")), lambda p: F.substr(seq, p * size + 1, F.lit(size + k - 1)))).otherwise(F.array().cast("array<string>"))
