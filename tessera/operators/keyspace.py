"""Reads and writes of whole keys: existence, values, expiry, deletion, scans. All take batches of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.columns import alive, within
from ..schema import DataType, Kind


def exists(state: DataFrame, keys: DataFrame) -> DataFrame:
    """keys with found; expiry doesn't count, as with point reads."""
    return keys.join(state.select("key", F.lit(True).alias("found")).distinct(), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """value and expire_ms of the keys that are there."""
    return keys.join(state.select("key", "value", "expire_ms"), "key")


def meta(ops: DataFrame) -> DataFrame:
    """The newest record of each key that isn't deleted, of whatever type."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return ops.withColumn("__rn", F.row_number().over(w)).where(f"__rn = 1 AND kind != {int(Kind.DELETE)}").drop("__rn")


def expire_at(state: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """requests (key, new_ms) with result: 0 if the key is missing or expired, or has no expiry and gets none; else 1."""
    j = requests.join(state.select("key", "expire_ms"), "key", "left")
    dead = F.col("expire_ms").isNull() | ~alive(F.col("expire_ms"), now_ms)
    return j.withColumn("result", F.when(dead | ((F.col("expire_ms") == 0) & (F.col("new_ms") == 0)), 0).otherwise(1).cast("long")).drop("expire_ms")


def delete(state: DataFrame, keys: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The state without the keys, and keys with result: 1 if a key was there and alive."""
    gone = keys.select("key").distinct()
    there = state.where(alive(F.col("expire_ms"), now_ms)).select("key", F.lit(1).cast("long").alias("result"))
    return state.join(gone, "key", "left_anti"), keys.join(there, "key", "left").withColumn("result", F.coalesce("result", F.lit(0).cast("long")))


def typed(state: DataFrame, data_type: DataType, now_ms: int) -> DataFrame:
    """Alive keys with ok: whether they have the asked type (any, for NONE)."""
    ok = F.lit(True) if data_type == DataType.NONE else F.col("data_type") == int(data_type)
    return state.where(alive(F.col("expire_ms"), now_ms)).withColumn("ok", ok)


def scan(state: DataFrame, now_ms: int, data_type: DataType = DataType.NONE, predicate: Column | None = None, after: tuple[int, str] | None = None, count: int = 10) -> DataFrame:
    """A page of the key space in order of slot and key, after the last row of the page before (slot, key)."""
    rows = state.where(alive(F.col("expire_ms"), now_ms))
    if data_type != DataType.NONE:
        rows = rows.where(F.col("data_type") == int(data_type))
    if predicate is not None:
        rows = rows.where(predicate)
    if after is not None:
        slot, key = after
        rows = rows.where((F.col("slot") > slot) | ((F.col("slot") == slot) & (F.col("key") > key)))
    return rows.select("slot", "key").orderBy("slot", "key").limit(count)


def seek(rows: DataFrame, column: str, at, forward: bool = True) -> DataFrame:
    """The first row at or after `at`, or (not forward) the last one before it."""
    c = F.col(column)
    return rows.where(c >= at).orderBy(c).limit(1) if forward else rows.where(c < at).orderBy(c.desc()).limit(1)


def bounded(rows: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows from low to before high; the bounds that moves keep to."""
    return rows.where(within(F.col(column), low, high, high_open=True))


def first(rows: DataFrame, column: str) -> DataFrame:
    return rows.orderBy(column).limit(1)


def last(rows: DataFrame, column: str) -> DataFrame:
    return rows.orderBy(F.desc(column)).limit(1)


def following(rows: DataFrame, column: str, at) -> DataFrame:
    """The first row after `at`; the one before it is seek(..., forward=False)."""
    return rows.where(F.col(column) > at).orderBy(column).limit(1)


def observed(rows: DataFrame, name: str, columns: list[str]) -> tuple[DataFrame, Observation]:
    """rows as they are, and what whoever reads them learns once they are read: rows, bytes of these columns, null values."""
    o = Observation(name)
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0))
    nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    return rows.observe(o, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("nulls")), o


def existing(live: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Elements of a batch that are there (for removals, membership, writes that need the element)."""
    return wanted.dropDuplicates(on).join(live.select(*on), on, "left_semi")


def missing(live: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Elements of a batch that aren't there yet (for additions and writes that need their absence)."""
    return wanted.dropDuplicates(on).join(live.select(*on), on, "left_anti")


def count_of(elements: DataFrame, name: str, by: str = "key") -> DataFrame:
    return elements.groupBy(by).agg(F.count("*").alias(name))


def effects(ops: DataFrame, add: str, remove: str, element: list[str]) -> DataFrame:
    """ops (op, seq, element) with result: whether each op, in order of seq, changed the element's presence."""
    before = F.lag("op").over(Window.partitionBy(*element).orderBy("seq"))
    was = F.coalesce(before, F.lit(remove)) == add
    result = F.when(F.col("op") == add, ~was).otherwise(was)
    return ops.withColumn("result", result.cast("int").cast("long"))
