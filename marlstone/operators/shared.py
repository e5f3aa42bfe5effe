"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master without it, a temporary folder of the session.

    On a cluster an unset folder raises: executors would write where nobody reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("marlstone.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("marlstone.shared.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Cut lineage by a table in the shared folder, with a folder for each value of ``by``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer splits than cores, dealt over all cores.

    A file of one row group is one split whatever its size; tables of many
    files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``no``: the place of each row in a total order, from 0, without one task for all rows.

    Rows are dealt by range and sorted; a row's place is its place in its own
    partition and the rows of the partitions before.  Only counts of partitions
    meet in one task.  The dealt rows are written first, so that a lost executor
    can't change their places.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = save(dealt, "numbered").withColumn("__part", F.shiftright("__at", 33))
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("__part").count().select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(starts), "__part").withColumn("no", place).drop("__part", "__at", "__start")
