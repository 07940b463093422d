"""Bitmaps: rows (key, offset) of set bits, in segments of 65,536 offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import bit_range, segment
from ..schema import SEGMENT_BITS

ON = ["key", "offset"]


def set_bits(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set bits after writes (key, offset, seq, bit), and each write with prev, the bit before it."""
    by = Window.partitionBy(*ON)
    prev = ops.withColumn("prev", F.coalesce(F.lag("bit").over(by.orderBy("seq")), F.lit(0)).cast("long"))
    last = ops.withColumn("__rn", F.row_number().over(by.orderBy(F.desc("seq")))).where("__rn = 1 AND bit = 1")
    return last.select(*ON), prev


def get_bits(bits: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(bits.select(*ON, F.lit(1).alias("bit")).distinct(), ON, "left").withColumn("bit", F.coalesce("bit", F.lit(0)).cast("long"))


def count(bits: DataFrame, begin: int = 0, end: int = -1) -> DataFrame:
    """Set bits of each bitmap in an inclusive range of offsets; 0 for an empty range. Packed by segment before the
    shuffle: a bucket's bitmap instead of its offsets."""
    r = bit_range(begin, end)
    inside = bits.where(F.col("offset").between(*r)) if r else bits.where("false")
    packed = inside.groupBy("key", F.bitmap_bucket_number("offset").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("offset")).alias("m"))
    sums = packed.groupBy("key").agg(F.sum(F.bitmap_count("m")).alias("n"))
    return bits.select("key").distinct().join(sums, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def first_set(bits: DataFrame, begin: int = 0, end: int = -1, strict: bool = True) -> DataFrame:
    """The first set offset in the range, or -1. Strictly, only the first segment that has bits and meets the range's
    segments is looked at."""
    r = bit_range(begin, end) or (1, 0)
    lo, hi = r
    inside = F.col("offset").between(lo, hi)
    if strict and lo <= hi:
        seg = segment(F.col("offset"))
        near = bits.where(seg.between(lo - lo % SEGMENT_BITS, hi - hi % SEGMENT_BITS))
        base = near.groupBy("key", seg.alias("seg")).agg(F.min(F.when(inside, F.col("offset"))).alias("p"))
        found = base.groupBy("key").agg(F.min(F.struct("seg", F.coalesce("p", F.lit(-1)).alias("p")))["p"].alias("p"))
    else:
        found = bits.where(inside).groupBy("key").agg(F.min("offset").alias("p"))
    return bits.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("p", F.lit(-1)).cast("long").alias("pos"))


def first_clear(bits: DataFrame, begin: int = 0, end: int = -1, strict: bool = True) -> DataFrame:
    """The first clear offset in the range, or -1. Absent segments are skipped when strict, and the range's first
    segment must hold a set bit at or after its begin; else the first gap counts wherever it is."""
    r = bit_range(begin, end)
    keys = bits.select("key").distinct()
    if r is None:
        return keys.select("key", F.lit(-1).cast("long").alias("pos"))
    lo, hi = r
    if not strict:
        b = bits.select(*ON).distinct().where(F.col("offset").between(lo, hi))
        rn = F.row_number().over(Window.partitionBy("key").orderBy("offset"))
        runs = b.withColumn("run", F.col("offset") - rn).where(F.col("run") == lo - 1)
        ends = runs.groupBy("key").agg(F.max("offset").alias("e"))
        gap = F.when(F.col("e").isNull(), lo).when(F.col("e") >= hi, -1).otherwise(F.col("e") + 1)
        return keys.join(ends, "key", "left").select("key", gap.cast("long").alias("pos"))
    seg, s0, s1 = segment(F.col("offset")), lo - lo % SEGMENT_BITS, hi - hi % SEGMENT_BITS
    near = bits.select(*ON).distinct().where(seg.between(s0, s1)).withColumn("seg", seg)
    b = near.where(F.col("offset") >= lo).withColumn("from", F.when(F.col("seg") == s0, F.lit(lo)).otherwise(F.col("seg")))
    run = F.col("offset") - F.row_number().over(Window.partitionBy("key", "seg").orderBy("offset"))
    per = b.withColumn("run", run).groupBy("key", "seg", "from").agg(F.max(F.when(F.col("run") == F.col("from") - 1, F.col("offset"))).alias("e"))
    ended = (F.col("e") >= hi) & F.when(F.col("seg") == s0, F.lit(hi) > F.col("from")).otherwise(F.lit(hi) >= F.col("from"))
    outcome = (
        F.when(F.col("e").isNull(), F.col("from"))
        .when(ended, F.lit(-1))
        .when(F.col("e") + 1 < F.col("seg") + SEGMENT_BITS, F.col("e") + 1)
        .when(F.col("seg") == s1, F.lit(-1))  # a full segment before the last leaves it to the next
    )
    found = per.withColumn("p", outcome.cast("long")).where("p IS NOT NULL").groupBy("key").agg(F.min(F.struct("seg", "p"))["p"].alias("p"))
    begun = near.where(F.col("seg") == s0).groupBy("key").agg((F.max("offset") < lo).alias("stuck"))
    j = keys.join(found, "key", "left").join(begun, "key", "left")
    return j.select("key", F.when(F.coalesce("stuck", F.lit(False)), -1).otherwise(F.coalesce("p", F.lit(-1))).cast("long").alias("pos"))
