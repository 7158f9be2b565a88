"""Tables written once in the folder that driver and executors share, and file-system steps on any Hadoop store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder on a local master, and an error on a cluster, whose machines share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="asofledger-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def discard(made: DataFrame) -> None:
    """Delete what materialize() wrote for made, once nothing will read it again."""
    fs, where = filesystem(made.sparkSession, made.written_at)
    fs.delete(where, True)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of path, and path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = filesystem(spark, path)
    return fs.exists(where)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, where = filesystem(spark, source)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise FileExistsError(f"{source} could not become {target}")


def in_order(df: DataFrame, order: list[str], late: dict[str, Column] | None = None) -> DataFrame:
    """df in ranges of order, sorted within them. late: columns of order that are made of df's own once its rows are shuffled, as they are wider."""
    late = late or {}
    return df.repartitionByRange(*[late.get(c, F.col(c)) for c in order]).withColumns(late).sortWithinPartitions(*order)


def with_row_number(df: DataFrame, order: list[str], name: str = "source_row_number", first: int = 2, late: dict[str, Column] | None = None) -> DataFrame:
    """df with consecutive numbers in a total order, without bringing all rows to one task.

    Rows are range-partitioned and sorted, written once with their partition and place in it, and numbered by the partitions' counts before them (one row per
    partition). Ties beyond order are numbered in any order. Columns of late, as in in_order(), are neither shuffled nor written; discard() deletes what was written.
    """
    place = F.monotonically_increasing_id()
    ranged = in_order(df, order, late).select(*df.columns, F.shiftright(place, 33).alias("__part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))
    held = materialize(ranged, "ordered")
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = held.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    made = held.join(F.broadcast(ahead), "__part").withColumn(name, (F.col("__before") + F.col("__place") + F.lit(first)).cast("long")).drop("__part", "__place", "__before")
    made.written_at = held.written_at
    return made
