"""K-mer statistics: counts at stride one, totals, distinct k-mers, average occurrence, and vocabularies by least count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.columns import reverse_complement


def kmer_counts(chunks: DataFrame, k: int, *, both_strands: bool = True) -> DataFrame:
    """``kmer`` and ``n`` over all starts of all chunks, on the forward strand or on both.

    Windows of k bases come from k scans of a regular expression (one for each start modulo k), which is linear in the
    chunk's length. The reverse strand of a count is the count of the reverse complement, so counts are summed first.
    """
    starts = F.sequence(F.lit(0), F.lit(k - 1))
    part = F.substring("chunk", F.col("__o") + 1, F.length("chunk"))
    each = chunks.select("chunk", F.explode(starts).alias("__o")).select(F.explode(F.regexp_extract_all(part, F.lit(f"(?s).{{{k}}}"), 0)).alias("kmer"))
    counts = each.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    if not both_strands:
        return counts
    both = counts.select("kmer", "n").union(counts.select(reverse_complement(F.col("kmer")), "n"))
    return both.groupBy("kmer").agg(F.sum("n").alias("n"))


def summary(counts: DataFrame) -> DataFrame:
    """``total``, ``distinct_kmers`` and ``average``."""
    return counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_kmers"), (F.sum("n") / F.count(F.lit(1))).alias("average"))


def vocabulary(counts: DataFrame, min_count: int) -> DataFrame:
    return counts.where(F.col("n") >= min_count)


def retained(counts: DataFrame, min_counts: list[int]) -> DataFrame:
    """For each least count the number of k-mers that reach it, of how many, and the share."""
    limits = F.explode(F.array(*(F.lit(m) for m in min_counts))).alias("min_count")
    sums = counts.agg(F.count(F.lit(1)).alias("distinct_kmers"), *(F.count_if(F.col("n") >= m).alias(f"m{m}") for m in min_counts))
    kept = F.element_at(F.create_map(*(x for m in min_counts for x in (F.lit(m), F.col(f"m{m}")))), F.col("min_count"))
    return sums.select("*", limits).select("min_count", kept.alias("kept"), "distinct_kmers", (kept / F.col("distinct_kmers")).alias("share"))
