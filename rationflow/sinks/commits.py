"""Append-only tables with a commit log.

A table is a folder of parts and a log.  An append writes a part under a new
name and then one line of the log: who wrote it (a run or a stream's query), the
writer's epoch, the part and its rows.  Readers follow the log, so a part that
was not finished is never seen, and an epoch that is written again, by a retry
or a restart, adds nothing: it is in the log already, or, if two attempts ran
side by side, one part of the two counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import path_exists

LOG_SCHEMA = "writer string, epoch long, part string, rows long"


def log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a table's log (none if there is no table yet)."""
    folder = f"{path.rstrip('/')}/log"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(folder)


def append(records: DataFrame, path: str, writer: str, epoch: int = 0) -> bool:
    """Add ``records`` as that epoch of that writer; False if it is there."""
    spark, folder = records.sparkSession, path.rstrip("/")
    if not log(spark, path).where((F.col("writer") == writer) & (F.col("epoch") == epoch)).isEmpty():
        return False
    part, seen = f"p{uuid.uuid4().hex}", Observation()
    records.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/data/part={part}")
    line = spark.createDataFrame([(writer, epoch, part, seen.get["rows"])], LOG_SCHEMA)
    line.coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return True


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The committed rows.  The log is a small table; joined to the part
    folders it prunes those that are not committed."""
    if not path_exists(spark, f"{path.rstrip('/')}/data"):
        return spark.createDataFrame([], schema)
    parts = log(spark, path).groupBy("writer", "epoch").agg(F.min("part").alias("part")).select("part")
    rows = spark.read.schema(StructType([*schema.fields, StructField("part", StringType())])).parquet(f"{path.rstrip('/')}/data")
    return rows.join(parts, "part", "left_semi").select(*schema.names)
