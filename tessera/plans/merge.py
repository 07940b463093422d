"""The merge of an operation log: newest write wins, tombstones, incarnations, prefix deletes, expiry overlay.

Reads are declared as filters over these frames; Catalyst prunes columns and pushes key filters below the windows, whose
partition keys they name. row_number() = 1 becomes a group limit on either side of the shuffle, so a task sends one row
for each key it has seen, however often the key was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Kind


#: Bytes of tables for which spread() gives a partition; a task holds some twenty times as many in memory.
PART_BYTES = 8 * 1024 * 1024


def spread(rows: DataFrame, *on: str) -> DataFrame:
    """rows dealt by hash over as many partitions as the bytes of the tables they come from call for, never fewer than
    shuffles have: aggregates and joins on these columns then hold as much in a task however large the tables are."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # what Spark can't tell counts as a Long's maximum
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PART_BYTES))
    return rows.repartition(n, *on)


def latest(records: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The newest record of each key; of records with one seq the one with the larger kind."""
    order = [F.desc(seq)] + ([F.desc("kind")] if "kind" in records.columns else [])
    w = Window.partitionBy(*keys).orderBy(*order)
    return records.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def live(records: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Newest records that aren't tombstones; a tombstone hides every older record of its key."""
    return latest(records, keys, seq).where(F.col("kind") != int(Kind.DELETE))


def incarnations(ops: DataFrame, barrier: Column, keys: list[str], seq: str = "seq") -> DataFrame:
    """ops with version: how many barriers (deletes of a whole collection) of its key came up to each of them."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return ops.withColumn("version", F.sum(F.when(barrier, 1).otherwise(0)).over(w).cast("long"))


def current(ops: DataFrame, barrier: Column, keys: list[str], seq: str = "seq", version: str | None = None) -> DataFrame:
    """Records after the last barrier of their key, with its seq in `version` (null: there is none) if that is named:
    barriers are few, so their maxima are joined to the records, which need no window."""
    last = ops.where(barrier).groupBy(*keys).agg(F.max(seq).alias("__last"))
    rows = ops.join(last, keys, "left").where(F.col("__last").isNull() | (F.col(seq) > F.col("__last")))
    return rows.withColumnRenamed("__last", version) if version else rows.drop("__last")


def drop_prefix_deleted(records: DataFrame, prefix_deletes: DataFrame, on: list[str]) -> DataFrame:
    """Records whose version isn't prefix-deleted, whatever their seq."""
    return records.join(prefix_deletes.select(*on).distinct(), on, "left_anti")


def strings(ops: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """key, value, expire_ms of strings: the newest value and the newest expiry, unless a delete is newer than the value.
    One aggregate, partial before its shuffle; an expiry that counts can't be older than the value, or the value's wins."""
    keys = keys or ["key"]
    is_set = F.col("kind").isin(int(Kind.SET), int(Kind.SET_SEPARATE))
    barrier = F.col("kind").isin(int(Kind.DELETE), int(Kind.PREFIX_DELETE))
    newest = ops.groupBy(*keys).agg(
        F.max_by("value", F.when(is_set, F.col("seq"))).alias("value"),
        F.max(F.when(is_set, F.col("seq"))).alias("seq"),
        F.max_by("expire_ms", F.when(is_set | (F.col("kind") == int(Kind.EXPIRE_AT)), F.col("seq"))).alias("expire_ms"),
        F.max(F.when(barrier, F.col("seq"))).alias("__gone"),
    )
    return newest.where(F.col("seq").isNotNull() & (F.col("__gone").isNull() | (F.col("seq") > F.col("__gone")))).drop("__gone")


def merge_tiers(*tiers: DataFrame) -> DataFrame:
    """The union of deltas and base; the merge itself decides by seq."""
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def compact(records: DataFrame, keys: list[str], prefix_deletes: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """A base that reads as the records do: no old versions, tombstones or prefix-deleted rows."""
    if prefix_deletes is not None:
        records = drop_prefix_deleted(records, prefix_deletes, on or ["version"])
    return live(records, keys)
