"""Small pieces that several operators share: the word rule, shared storage, stable hashing and spreading of hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.shared import release, saved, shared_dir, spread

__all__ = ["WORD", "apart", "free_name", "n_words", "read_table", "release", "saved", "shared_dir", "spread_join"]

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
#: ``bytes.split()`` splits UTF-8 text at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case, as Spark's do)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """An equi-join for keys that many rows of ``left`` may share: they are dealt by a salt too (a hash of ``spread``),
    and the rows of ``right``, which has a key once, are repeated for each salt."""
    salt = free_name(left, "__salt")
    many = left.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    few = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(few, [*keys, salt], how).drop(salt)


def apart(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """``df`` with a column that later expressions read as a value: a projection would be merged into them and be
    evaluated again at each of its uses, an exploded array of one element is not."""
    return df.select("*", F.explode(F.array(expression)).alias(name))
