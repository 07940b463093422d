"""Upkeep of stored collections: expiry, garbage, value files, statistics, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import alive
from ..functions.ranges import ttl_bucket_col
from ..schema import Kind

HISTOGRAM_MS, HISTOGRAM_BUCKETS = 2 * 3600 * 1000, 1080
SMALL_FILE_BYTES = 5 * 1024 * 1024


def expiry_index(state: DataFrame) -> DataFrame:
    """state (expire_ms ...) with the sweep bucket of everything that expires."""
    return state.where("expire_ms > 0").withColumn("bucket_sec", ttl_bucket_col(F.col("expire_ms")))


def sweep(index: DataFrame, from_sec: int, to_sec: int) -> DataFrame:
    """What expires in sweep buckets in (from_sec, to_sec]; missed buckets are caught up by the wider range."""
    return index.where((F.col("bucket_sec") > from_sec) & (F.col("bucket_sec") <= to_sec))


def swept(state: DataFrame, due: DataFrame, on: list[str]) -> DataFrame:
    return state.join(due.select(*on), on, "left_anti")


def expiry_histogram(state: DataFrame, now_ms: int, size: Column) -> DataFrame:
    """Bytes and rows by two-hour bucket of expiry: -1 expired, HISTOGRAM_BUCKETS beyond the last, -2 never."""
    b = F.floor((F.col("expire_ms") - now_ms) / HISTOGRAM_MS).cast("long")
    bucket = F.when(F.col("expire_ms") == 0, -2).when(F.col("expire_ms") <= now_ms, -1).when(b >= HISTOGRAM_BUCKETS, HISTOGRAM_BUCKETS).otherwise(b).cast("long")
    return state.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def garbage(state: DataFrame, now_ms: int) -> DataFrame:
    return state.where(~alive(F.col("expire_ms"), now_ms))


def collect_garbage(state: DataFrame, now_ms: int) -> DataFrame:
    return state.where(alive(F.col("expire_ms"), now_ms))


def live_values(values: DataFrame, pointers: DataFrame, on: list[str]) -> DataFrame:
    """Values that the live record of the same key and seq still points to."""
    return values.join(pointers.select(*on), on, "left_semi")


def files_to_compact(values: DataFrame, live: DataFrame, on: list[str], dead_share: float) -> DataFrame:
    """file, total, dead of the value files of which at least dead_share is dead."""
    marked = values.join(live.select(*on, F.lit(1).alias("live")), on, "left")
    n = marked.groupBy("file").agg(F.count("*").alias("total"), F.count_if(F.col("live").isNull()).alias("dead"))
    return n.where(F.col("dead") >= F.col("total") * dead_share)


def slots_to_collect(ops: DataFrame, live: DataFrame, on: list[str], dead_share: float) -> DataFrame:
    """slot, total, dead of the slots of which at least dead_share of the operations is dead."""
    return files_to_compact(ops.withColumn("file", F.col("slot")), live, on, dead_share).withColumnRenamed("file", "slot")


def small_files(files: DataFrame, bytes_below: int = SMALL_FILE_BYTES) -> DataFrame:
    """files (file, bytes) that are small enough to be joined with others."""
    return files.where(F.col("bytes") < bytes_below)


def by_size(files: DataFrame) -> DataFrame:
    """files with their place, the largest first; a store has few files."""
    return files.withColumn("place", F.row_number().over(Window.orderBy(F.desc("bytes"), "file")).cast("long"))


def flush_size(ops: DataFrame, columns: list[str]) -> DataFrame:
    """Records and bytes that a flush of each slot would write, before it does."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return ops.groupBy("slot").agg(F.count("*").alias("records"), F.sum(size).cast("long").alias("bytes"))


def slot_stats(ops: DataFrame) -> DataFrame:
    """Records, deletes and value bytes by slot; a prefix delete counts ten times in the rate."""
    deletes = F.count_if(F.col("kind") == int(Kind.DELETE)) + 10 * F.count_if(F.col("kind") == int(Kind.PREFIX_DELETE))
    return ops.groupBy("slot").agg(F.count("*").alias("records"), deletes.alias("deletes"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).cast("long").alias("value_bytes"))


def needs_flush(records: int, deletes: int, age_sec: int, tables: int) -> bool:
    """Whether a range of records should be rewritten: many deletes, many records, long unflushed or many tables."""
    if tables > 1 and age_sec >= 3600:
        return True
    rate = deletes / records if records else 0.0
    return any(records >= n and rate >= r for n, r in ((1_000_000, 0.0), (200_000, 0.2), (20_000, 0.5), (1000, 0.8)))


def split_points(records: DataFrame, column: str, parts: int) -> list:
    """Bounds that split records into about even ranges of a column."""
    at = [i / parts for i in range(1, parts)]
    return list(records.agg(F.percentile_approx(column, at, 10_000).alias("p")).first()["p"] or []) if at else []


def split(records: DataFrame, column: str, parts: int) -> DataFrame:
    """records with page: the number of their range, up to and including its upper bound."""
    bounds = F.array(*[F.lit(b) for b in split_points(records, column, parts)])
    return records.withColumn("page", F.size(F.filter(bounds, lambda b: b < F.col(column))))


def flush_costs(flushes: DataFrame) -> DataFrame:
    """Mean and last cost of flushes (ts_ms, cost_ms) by day."""
    day = F.floor(F.col("ts_ms") / 86_400_000).cast("long")
    return flushes.groupBy(day.alias("day")).agg(F.avg("cost_ms").alias("mean_ms"), F.max_by("cost_ms", "ts_ms").alias("last_ms"), F.count("*").alias("n"))
