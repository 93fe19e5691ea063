"""Column functions over nucleotide strings. All are built-in expressions, so they run in the JVM beside the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of the five one-hot slots.
SLOTS = "ATNCG"


def apart(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """``df`` with a column that later lambdas read as a value. A plain projection would be merged into the next one and
    be evaluated again for every element of an array there; an exploded array of one element is not merged."""
    return df.select("*", F.explode(F.array(expression)).alias(name))


def canonical(seq: Column) -> Column:
    """Capital A, C, G and T; any other letter is N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    """A and T, C and G swapped; any other character, lower case included, is N."""
    return F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def window_reverse_complement(kmers: Column) -> Column:
    """Each k-mer reverse-complemented, in reverse order."""
    return F.reverse(F.transform(kmers, reverse_complement))


def count_n(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def is_all_n(seq: Column) -> Column:
    """True for an empty sequence too."""
    return seq.rlike("^N*$")


def one_hot_bits(seq: Column) -> Column:
    """Each base as five characters 0 or 1, in the order of SLOTS; unknown and lower-case letters are N."""
    bits = F.regexp_replace(seq, f"[^{SLOTS}]", "N")
    for i, letter in enumerate(SLOTS):
        bits = F.replace(bits, F.lit(letter), F.lit("0" * i + "1" + "0" * (len(SLOTS) - 1 - i)))
    return bits


def _flags(bits: Column) -> Column:
    return F.transform(F.filter(F.split(bits, ""), lambda b: b != ""), lambda b: b == "1")


def one_hot(seq: Column, width: int) -> Column:
    """``width`` bases in five slots each, in the order of SLOTS; unknown and lower-case letters are N. A sequence that
    is shorter leaves its last slots false."""
    return _flags(F.rpad(one_hot_bits(F.substring(seq, 1, width)), 5 * width, "0"))


def sequence_bits(seq: Column, k: int) -> Column:
    """The one-hot of the floor(length / k) whole k-mers of a raw sequence, the last exact one included, as 0 and 1."""
    return one_hot_bits(F.substring(seq, F.lit(1), F.length(seq) - F.length(seq) % k))


def sequence_to_array(seq: Column, k: int) -> Column:
    """``sequence_bits`` as an array of booleans."""
    return _flags(sequence_bits(seq, k))


def padded(kmers: Column, k: int, window_size: int) -> Column:
    """A window of one-hot k-mers (each 5k booleans) filled up with all-false ones; longer windows are an error."""
    blank = F.array_repeat(F.lit(False), 5 * k)
    short = F.concat(kmers, F.array_repeat(blank, window_size - F.size(kmers)))
    return F.when(F.size(kmers) <= window_size, short).otherwise(F.raise_error(F.lit("a window holds more k-mers than its size")).cast("array<array<boolean>>"))


def attention_mask(kmers: Column, window_size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(window_size - 1)), lambda i: i < F.size(kmers))


def shown(kmer: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s: %d-%d", kmer, start, end)


def as_bits(flags: Column) -> Column:
    """An array of booleans as a string of 0 and 1."""
    return F.array_join(F.transform(flags, lambda b: F.when(b, "1").otherwise("0")), "")
