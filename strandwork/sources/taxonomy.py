"""Taxonomy: accessions with their taxon, the parent table, and names, as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_taxonomy(spark: SparkSession, acc2tax: str, nodes: str, names: str, *, sep: str = "\t") -> tuple[DataFrame, DataFrame, DataFrame]:
    """acc2tax (accession, taxon_id), nodes (taxon_id, parent_id, rank) and names (taxon_id, name)."""
    read = spark.read.option("sep", sep)
    return (
        read.schema("accession string, taxon_id bigint").csv(acc2tax),
        read.schema("taxon_id bigint, parent_id bigint, rank string").csv(nodes),
        read.schema("taxon_id bigint, name string").csv(names),
    )
