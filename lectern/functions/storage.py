"""Settling intermediate results in a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows up to which a settled table is marked for a broadcast
FEW = 200_000
_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    sc = spark.sparkContext
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return str(jdir.get())
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = f"file:///tmp/checkpoints/{sc.applicationId}"
    sc.setCheckpointDir(conf)
    return str(sc._jsc.sc().getCheckpointDir().get())


def settled(df: DataFrame) -> DataFrame:
    """The rows, evaluated once: written as Parquet and read again. Lineage is cut, lost executors do no harm."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _folders.append(path)
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """The rows settled, with their partition (_part) and place within it (_row): after a global sort these give the order."""
    rows = settled(df.withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def small(df: DataFrame) -> DataFrame:
    """The rows settled, and marked for a broadcast if they are at most ``FEW``."""
    rows = settled(df)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def clear(spark: SparkSession) -> None:
    """Deletes what was settled so far. Results that still depend on it can't be evaluated afterwards."""
    sc = spark.sparkContext
    while _folders:
        where = sc._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Few large input partitions dealt out for costly per-row work; otherwise as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * n, key) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df
