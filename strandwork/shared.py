"""Tables in the folder that driver and executors share, and dealing out tables of few files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, taken from ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests, notebooks) a temporary folder is set; on a cluster
    that is an error, for its machines could not see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        found = qualified(spark, found)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-shared-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would resolve it with: that of the default file system, if it names none."""
    if "://" in path:
        return path
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that a lost executor costs a read and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes what ``saved`` wrote for these tables, which nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.saved_at
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clean(spark: SparkSession) -> None:
    """Removes what this library has written to the shared folder (saved tables, archives, stages of the pipeline, stores of
    sequences); for the end of a job, when no result is read any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "{saved,warc,pipeline,store}-*")) or ():
        store.delete(found.getPath(), True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew where it lies in fewer files than the cluster has cores: a file of one row group is one task
    whatever the split size. Tables of many files are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
