"""Operator 8: contiguous shards of near equal bytes (DataFrame functions only).

Documents are ordered by ``doc_id`` (ties by size, checksum and the row's place
in the written table).  Ranges of that order are summed on their own, the
running total over the range totals (one row a range) gives each range its
offset, and the global prefix sum of a row is that offset plus the running sum
inside its range.  A row goes to the shard in whose n-th part of the total
bytes its first byte falls, so shards are contiguous and at most one row's size
away from the equal cut.  No step holds more than one range in a task.

Defined cases: a null text has size 1 and checksum 0; an empty table gives an
empty result; null ``doc_id`` sorts first; repeated rows take neighbouring
slots; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import shuffle_partitions, written


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    narrow = written(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"))).withColumn("_tie", F.monotonically_increasing_id())
    order = ["doc_id", "size", "text_crc32", "_tie"]
    ranged = written(narrow.repartitionByRange(shuffle_partitions(spark), *order)
                     .withColumn("_range", F.spark_partition_id()))

    totals = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    # one row a range: the only unpartitioned window of the plan
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte_off"),
                            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_off"),
                            F.sum("_bytes").over(everything).alias("_total"))
    inside = Window.partitionBy("_range").orderBy(*order)
    first = (F.col("_byte_off") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
             - F.col("size"))
    placed = (ranged.join(F.broadcast(offsets), "_range")  # one row a partition of the shuffle
              .withColumn("_first", first)
              .withColumn("_row", F.col("_row_off") + F.row_number().over(inside) - 1)
              .withColumn("shard", F.expr(f"cast(_first * {int(n_shards)} div _total as int)")))
    starts = placed.groupBy("shard").agg(F.min("_row").alias("_start"))  # n_shards rows
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
