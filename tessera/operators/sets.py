"""Sets: rows (key, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import valid_element
from . import keyspace
from .hashes import remove_elements

ON = ["key", "member"]


def add(live: DataFrame, batch: DataFrame, need_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """The state with a batch of members, and how many are new for each key."""
    batch = batch.where(valid_element(F.col("member")))
    if need_key:
        batch = batch.join(live.select("key").distinct(), "key", "left_semi")
    added = keyspace.missing(live, batch.select(*ON), ON)
    return live.select(*ON).unionByName(added), keyspace.count_of(added, "added")


def remove(live: DataFrame, batch: DataFrame, keep_empty: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return remove_elements(live, batch, ON, keep_empty)


def pop(live: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """The first `count` members of each set in byte order, and the state without them."""
    rn = F.row_number().over(Window.partitionBy("key").orderBy("member"))
    popped = live.withColumn("__rn", rn).where(F.col("__rn") <= count).drop("__rn")
    return popped, live.withColumn("__rn", rn).where(F.col("__rn") > count).drop("__rn")


def members(live: DataFrame) -> DataFrame:
    """Members with their place in byte order."""
    return live.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("member")) - 1)


def contains(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, member) with found 1 or 0."""
    return wanted.join(live.select(*ON, F.lit(1).alias("found")), ON, "left").withColumn("found", F.coalesce("found", F.lit(0)).cast("long"))


def random_members(live: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """count > 0: so many distinct members of each set; count < 0: -count draws that may repeat; 0: none. Seeded by
    hashes of members and draws, so that a recomputed task draws the same."""
    if count == 0:
        return live.where("false")
    if count > 0:
        w = Window.partitionBy("key").orderBy(F.xxhash64("member", F.lit(seed)), "member")
        return live.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= count).drop("__rn")
    placed = members(live)
    sizes = live.groupBy("key").agg(F.count("*").alias("n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(-count))))
    draws = draws.withColumn("pos", F.pmod(F.xxhash64("key", "draw", F.lit(seed)), F.col("n")).cast("int"))
    return draws.join(placed, ["key", "pos"]).select("key", "draw", "member")


def cardinality(live: DataFrame) -> DataFrame:
    return keyspace.count_of(live, "size")
