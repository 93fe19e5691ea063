"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import lines, mixing, neardup, packing, quality
from strandwork.llm.common import saved, shared_dir
from strandwork.llm.queries import public_vocabulary


def _columns(docs: DataFrame, row: str) -> list[Column]:
    return [F.col(row)[c].alias(c) for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Repeated rows are judged alike; null and empty texts fail; ids do not matter."""
    judged = quality.judge(docs, prefix="quality_rules_")
    return judged.where(judged.columns[-1]).select(*(F.col(f"`{c}`") for c in docs.columns))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those of which nothing is left go. Rows equal in id
    and text are one document, and each of them stays; null ids come first."""
    cut = lines.remove_repeated(docs, wrap=lines.WRAP)
    changed = F.col(f"`{cut.columns[-1]}`") > 0
    left = cut.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the least id (a null id last), then of the least hash of its text. Of rows
    equal in id and text one stays, whether they have near duplicates or not."""
    found = saved(neardup.near_duplicates(docs).select("doc_id", "text_key", "group_key"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    grouped = found.where("group_key IS NOT NULL").groupBy("group_key").agg(F.min(place).alias("it")).select("it.doc_id", "it.text_key")
    chosen = grouped.union(found.where("group_key IS NULL").select("doc_id", "text_key").distinct())
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    key = F.xxhash64(F.col("row")["text"])
    same = F.col("row")["doc_id"].eqNullSafe(F.col("doc_id")) & (key == F.col("text_key"))
    if found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return held.join(chosen, same, "left_semi").select(*_columns(docs, "row"))
    # equal rows meet as partial results of their tasks, so their number does not matter
    once = held.groupBy(F.col("row")["doc_id"].alias("one"), key.alias("two")).agg(F.min("row").alias("row")).select("row")
    return once.join(chosen, same, "left_semi").select(*_columns(docs, "row"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken; repeated rows are taken alike."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, in sequences of up to 1024. Repeated rows and null ids are packed."""
    return packing.pack(docs, public_vocabulary)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", cut_repeated_lines),
    ("near duplicates", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]
#: No SQL expresses divergence from trained references, MinHash regions and tokens.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{n}")
            docs = spark.read.parquet(f"{base}/{n}")
    return docs
