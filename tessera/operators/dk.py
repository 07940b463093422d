"""Headers of keys spread over shards: rows (key, shard_num, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DataType
from . import keyspace


def create(headers: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The headers with new ones (key, shard_num), and wanted with result: created, exists or bad shard number."""
    ok = wanted.where("shard_num > 0")
    new = keyspace.missing(headers, ok, ["key"]).withColumn("size", F.lit(0).cast("long"))
    there = headers.select("key", F.lit(True).alias("there"))
    result = F.when(F.col("shard_num") <= 0, "shard number").when(F.col("there"), "exists").otherwise("created")
    return headers.unionByName(new.select(headers.columns)), wanted.join(there, "key", "left").withColumn("result", result).drop("there")


def create_shard(headers: DataFrame, keys: DataFrame, data_type: DataType) -> DataFrame:
    """A shard's own header, size 0, whether or not there was one."""
    return keys.select("key", F.lit(int(data_type)).alias("data_type"), F.lit(0).cast("long").alias("size")).unionByName(
        headers.join(keys.select("key"), "key", "left_anti"), allowMissingColumns=True
    )


def change_size(headers: DataFrame, batch: DataFrame) -> DataFrame:
    """Headers after increments (key, seq, incr) in order of seq, the size never below 0. Keys without header are left
    out. The clamp makes this a fold; it is taken as the last sum less the least prefix sum below 0, which aggregates
    and windows can share, so no key's increments are gathered."""
    from pyspark.sql import Window

    j = batch.join(headers.select("key", "size"), "key")
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = j.withColumn("run", F.col("size") + F.sum("incr").over(w))
    ends = sums.groupBy("key").agg(F.max_by("run", "seq").alias("total"), F.min("run").alias("low"))
    return ends.select("key", (F.col("total") - F.least(F.col("low"), F.lit(0))).alias("size"))
