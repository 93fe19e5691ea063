"""Streams of FASTA or Parquet sequence files: the batch operators are stateless per sequence, so they apply as they are;
k-mer counts are a streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators import stats, windows
from strandwork.sources.fasta import SEQUENCES, parse_records


def fasta_stream(spark: SparkSession, folder: str, *, files_per_trigger: int = 64) -> DataFrame:
    """``id`` and ``seq`` of each FASTA file that arrives in a folder."""
    text = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_records(text).withColumn("seq", F.upper("seq"))


def parquet_stream(spark: SparkSession, folder: str, *, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(SEQUENCES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_stream(sequences: DataFrame, k: int, window_size: int, *, sliding: bool = False) -> DataFrame:
    """Windows with coordinates of a stream of sequences."""
    chunks = windows.split_chunks(sequences)
    return windows.windows(windows.passes(chunks, k, sliding=sliding), k, window_size, full_only=True, with_coords=True)


def kmer_count_stream(sequences: DataFrame, k: int) -> DataFrame:
    """Running counts by k-mer of the forward strand; write it in update or complete mode."""
    return stats.kmer_counts(windows.split_chunks(sequences), k, both_strands=False)
