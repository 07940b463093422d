"""Hashes: rows (key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_integer, valid_element
from . import keyspace


def get_all(live: DataFrame) -> DataFrame:
    """Each hash as one row with its fields and values in the byte order of fields. A hash must fit a row here;
    the rows themselves (key, field, value) are the form for unbounded ones."""
    pairs = F.sort_array(F.collect_list(F.struct("field", "value")))
    return live.groupBy("key").agg(pairs.alias("p")).select("key", F.col("p.field").alias("fields"), F.col("p.value").alias("values"))


def get(live: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(live.select("key", "field", "value"), ["key", "field"])


def get_many(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, pos, field) with values, null for misses."""
    return wanted.join(live.select("key", "field", "value"), ["key", "field"], "left")


def set_many(live: DataFrame, batch: DataFrame, need_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """The state after a batch (key, field, value, seq) and, for each key, how many fields are new. Of repeated fields
    the last wins and counts once; invalid ones are skipped; need_key drops writes to hashes that aren't there."""
    batch = batch.where(valid_element(F.col("field"), F.col("value")))
    if need_key:
        batch = batch.join(live.select("key").distinct(), "key", "left_semi")
    w = Window.partitionBy("key", "field").orderBy(F.desc("seq"))
    last = batch.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    on = ["key", "field"]
    added = keyspace.missing(live, last, on)
    state = live.join(last.select(*on), on, "left_anti").unionByName(last.select(live.columns))
    return state, keyspace.count_of(added, "added")


def increment(live: DataFrame, batch: DataFrame) -> DataFrame:
    """key, field, value after adding all increments (key, field, incr); null where the value isn't a number."""
    sums = batch.groupBy("key", "field").agg(F.sum("incr").alias("incr"))
    j = sums.join(live.select("key", "field", F.col("value").alias("old"), F.lit(True).alias("there")), ["key", "field"], "left")
    base = F.when(F.col("there"), as_integer(F.col("old"))).otherwise(F.lit(0).cast("long"))
    return j.select("key", "field", (base + F.col("incr")).alias("value"))


def running(batch: DataFrame) -> DataFrame:
    """The counter's value after each increment, in order of seq."""
    w = Window.partitionBy("key", "field").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return batch.withColumn("value", F.sum("incr").over(w))


def remove(live: DataFrame, batch: DataFrame, keep_empty: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The state without fields (key, field), how many went for each key, and the size of each key afterwards: a key
    that becomes empty goes, or stays with size 0 if keep_empty."""
    return remove_elements(live, batch, ["key", "field"], keep_empty)


def remove_elements(live: DataFrame, batch: DataFrame, on: list[str], keep_empty: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = keyspace.existing(live, batch, on)
    state = live.join(gone.select(*on), on, "left_anti")
    marked = live.select(*on).join(gone.select(*on, F.lit(1).alias("gone")), on, "left")
    sizes = marked.groupBy("key").agg((F.count("*") - F.coalesce(F.sum("gone"), F.lit(0))).alias("size"))
    return state, keyspace.count_of(gone, "removed"), sizes if keep_empty else sizes.where("size > 0")


def length(live: DataFrame) -> DataFrame:
    return keyspace.count_of(live, "size")
