"""Shared pieces of the operators: reading tables, folds, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    A session without that setting is given one: a temporary folder, which
    only suits a session whose driver and executors share a machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage: a lost executor costs only its running tasks. Readers
    get a plain scan, so joins on it have exchanges that adaptive execution
    can split. The table stays until ``release`` or until the cluster clears
    the folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table this application has staged; results that read them must be written before."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/llm/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; -1 for a null id, which so belongs to no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1)).cast("int")


def spread(doc_id: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) for each id."""
    return F.pmod(F.xxhash64(doc_id, F.lit("spread")), F.lit(1 << 30)) / F.lit(float(1 << 30))
