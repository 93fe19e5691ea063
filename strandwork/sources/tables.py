"""Adapters from a star schema with documents to sequences, features and a taxonomy, for trials and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions.columns import apart
from strandwork.shared import spread

#: Letters A to Z and the mark for anything else, and the base that each becomes.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ-"
BASES = "ACGTACGTACGTANACGTACGTACGTN"


def as_sequences(docs: DataFrame) -> DataFrame:
    """``id`` and ``seq`` of documents: letters become bases, runs of other characters become runs of N."""
    text = F.upper(F.regexp_replace("text", "[^A-Za-z]", "-"))
    return apart(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), "seq", F.translate(text, LETTERS, BASES)).select("id", "seq")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_sequences(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def sequence(spark: SparkSession, sf_dir: str, doc_id: int) -> DataFrame:
    """One sequence; the filter is on the stored number, so it reaches the scan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return as_sequences(docs.where(F.col("doc_id") == doc_id))


def gff3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no`` and ``value``: line items written as GFF3 lines over the documents' ids, some as comments and some
    corrupt (a field short, or without a start)."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    item = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    start = F.pmod(F.col("l_partkey") * 37 + F.col("l_suppkey") * 101, F.lit(1500))
    end = start + F.pmod(F.col("l_orderkey") * 13 + F.col("l_linenumber") * 7, F.lit(160)) - 40
    kind = F.element_at(F.array(*(F.lit(x) for x in ("Gene", "mRNA", "exon", "CDS", "chromosome"))), F.pmod(F.col("l_partkey"), F.lit(5)).cast("int") + 1)
    strand = F.when(F.col("l_linestatus") == "O", "+").when(F.col("l_returnflag") == "R", "-").otherwise(".")
    score = F.when(F.pmod(F.col("l_suppkey"), F.lit(3)) == 0, ".").otherwise(F.col("l_linenumber").cast("string"))
    odd = F.pmod(F.col("l_orderkey") + F.col("l_partkey"), F.lit(97))
    begin = F.when(odd == 1, F.lit("x")).otherwise(start.cast("string"))
    fields = [F.pmod(F.col("l_orderkey"), F.lit(n)), F.lit("table"), kind, begin, end, score, strand, F.pmod(F.col("l_partkey"), F.lit(4))]
    value = F.concat_ws("\t", *(f.cast("string") for f in fields), F.when(odd != 2, F.concat(F.lit("ID="), "l_orderkey")))
    value = F.when(odd == 0, F.concat(F.lit("# "), value)).otherwise(value)
    return item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), value.alias("value"))


def taxonomy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """acc2tax, nodes and names: root 1, regions from 100, nations from 1000; a document's taxon is a nation."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    region, nation = spark.read.parquet(f"{sf_dir}/region.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    r, m = F.col("r_regionkey").cast("bigint") + 100, F.col("n_nationkey").cast("bigint") + 1000
    root = region.limit(1).select(F.lit(1).cast("bigint").alias("taxon_id"), F.lit(1).cast("bigint").alias("parent_id"), F.lit("root").alias("rank"))
    nodes = root.union(region.select(r, F.lit(1).cast("bigint"), F.lit("region"))).union(nation.select(m, F.col("n_regionkey").cast("bigint") + 100, F.lit("nation")))
    names = region.select(r.alias("taxon_id"), F.col("r_name").alias("name")).union(nation.select(m, "n_name"))
    acc = docs.select(F.col("doc_id").cast("string").alias("accession"), (F.pmod(F.col("doc_id"), F.lit(25)) + 1000).alias("taxon_id"))
    return acc, nodes, names
