"""Helpers shared by the training-data operators.

Nothing here collects data: ``materialise`` cuts lineage by writing a table
into the folder that the cluster names in ``spark.checkpoint.dir``, so that a
lost executor costs a reread and not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper and lower letters that the contracts fold; other letters keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ``[\x20\x09-\x0D]``, the white space of the contracts.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, opened with Spark's reader so that any store works.

    Documents and pages in fewer splits than cores are dealt over all cores: a
    file of one row group is one split whatever its size.
    """
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and found._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return found.repartition(cores)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if it is set.

    Only where it is unset and the master is local, as in tests on one machine,
    a temporary folder is made and remembered in the session.  On a cluster an
    unset folder raises: no other is known to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("marlstone.scratch.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("marlstone.scratch.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/marlstone/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def fold_case(text: Column) -> Column:
    """``A-Z`` to lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def sha256_hex(text: Column) -> Column:
    """Lower-case hexadecimal digest of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)
