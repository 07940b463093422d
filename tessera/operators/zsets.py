"""Sorted sets: rows (key, member, score), ordered by score and then by member in byte order."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lex_bound, valid_element, within
from ..functions.ranges import rank_bounds
from . import keyspace

ON = ["key", "member"]
#: Full-range reads don't see scores from here on.
TOP_SCORE = sys.float_info.max


def _order(reverse: bool = False):
    w = Window.partitionBy("key")
    return w.orderBy(F.desc("score"), F.desc("member")) if reverse else w.orderBy("score", "member")


def visible(live: DataFrame, strict: bool = True) -> DataFrame:
    """What full-range reads see: strictly, members below the largest finite score."""
    return live.where(F.col("score") < TOP_SCORE) if strict else live


def add(live: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after a batch (key, member, score, seq), and how many members are new for each key."""
    batch = batch.where(valid_element(F.col("member")))
    w = Window.partitionBy(*ON).orderBy(F.desc("seq"))
    last = batch.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*ON, "score")
    added = keyspace.missing(live, last, ON)
    state = live.select(*ON, "score").join(last.select(*ON), ON, "left_anti").unionByName(last)
    return state, keyspace.count_of(added, "added")


def increment(live: DataFrame, batch: DataFrame) -> DataFrame:
    """Scores after increments (key, member, seq, incr) applied in order of seq: adding doubles depends on the order."""
    steps = batch.groupBy(*ON).agg(F.sort_array(F.collect_list(F.struct("seq", "incr"))).alias("s"))
    j = steps.join(live.select(*ON, "score"), ON, "left")
    return j.select(*ON, F.aggregate("s", F.coalesce("score", F.lit(0.0)), lambda a, x: a + x["incr"]).alias("score"))


def remove(live: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = keyspace.existing(live, batch, ON)
    return live.join(gone.select(*ON), ON, "left_anti"), keyspace.count_of(gone, "removed")


def score(live: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(live.select(*ON, "score"), ON)


def ranked(live: DataFrame, reverse: bool = False) -> DataFrame:
    """Every member with its rank from 0."""
    return visible(live).withColumn("rank", (F.row_number().over(_order(reverse)) - 1).cast("long"))


def rank(live: DataFrame, wanted: DataFrame, reverse: bool = False) -> DataFrame:
    return wanted.join(ranked(live, reverse).select(*ON, "rank"), ON)


def by_rank(live: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members of a rank range, with pos from 0 in the order asked for."""
    v = visible(live)
    if reverse and 0 <= start <= stop or not reverse and 0 <= start <= stop:
        # no size needed: row_number() <= stop + 1 becomes a group limit before the shuffle
        r = v.withColumn("rn", F.row_number().over(_order(reverse))).where((F.col("rn") <= stop + 1) & (F.col("rn") > start))
    else:
        n = F.count("*").over(Window.partitionBy("key"))
        p = v.withColumns({"rn": F.row_number().over(_order()), "n": n})
        lo, hi = rank_bounds(F.col("n"), start, stop, reverse)
        r = p.where((F.col("rn") - 1 >= lo) & (F.col("rn") - 1 <= hi))
        if reverse:
            r = r.withColumn("rn", F.col("n") - F.col("rn") + 1)
    return r.select(*ON, "score", (F.col("rn") - 1).cast("long").alias("rank"))


def by_score(live: DataFrame, low: float, high: float, low_open: bool = False, high_open: bool = False, offset: int = 0, count: int = -1, reverse: bool = False) -> DataFrame:
    """Members of a score range with pos; of each key `count` (all, if not above 0) after `offset`."""
    inside = live.where(within(F.col("score"), low, high, low_open, high_open))
    p = inside.withColumn("rn", F.row_number().over(_order(reverse)))
    if count > 0:
        p = p.where(F.col("rn") <= offset + count)
    return p.where(F.col("rn") > offset).select(*ON, "score", (F.col("rn") - 1 - offset).cast("long").alias("pos"))


def count(live: DataFrame, low: float, high: float, low_open: bool = False, high_open: bool = False) -> DataFrame:
    return live.groupBy("key").agg(F.count_if(within(F.col("score"), low, high, low_open, high_open)).alias("n"))


def _lex(live: DataFrame, low: str, high: str, low_open: bool, high_open: bool) -> DataFrame:
    """Members in lex bounds, up to the first member in (score, member) order that fails the upper one."""
    lo, hi = lex_bound(low), lex_bound(high)
    v = visible(live)
    if hi is not None:
        bad = F.when(~within(F.col("member"), None, hi, high_open=high_open), 1).otherwise(0)
        v = v.withColumn("__cut", F.sum(bad).over(_order().rowsBetween(Window.unboundedPreceding, 0))).where("__cut = 0").drop("__cut")
    return v.where(within(F.col("member"), lo, hi, low_open, high_open))


def by_lex(live: DataFrame, low: str, high: str, low_open: bool = False, high_open: bool = False, offset: int = 0, count: int = -1) -> DataFrame:
    p = _lex(live, low, high, low_open, high_open).withColumn("rn", F.row_number().over(_order()))
    if count > 0:
        p = p.where(F.col("rn") <= offset + count)
    return p.where(F.col("rn") > offset).select(*ON, "score", (F.col("rn") - 1 - offset).cast("long").alias("pos"))


def lex_count(live: DataFrame, low: str, high: str, low_open: bool = False, high_open: bool = False) -> DataFrame:
    return keyspace.count_of(_lex(live, low, high, low_open, high_open), "n")


def remove_found(live: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state without the members of a range read, and how many went for each key."""
    return live.join(found.select(*ON), ON, "left_anti"), keyspace.count_of(found, "removed")


def remove_by_rank(live: DataFrame, start: int, stop: int) -> tuple[DataFrame, DataFrame]:
    return remove_found(live, by_rank(live, start, stop))


def remove_by_score(live: DataFrame, low: float, high: float, low_open: bool = False, high_open: bool = False) -> tuple[DataFrame, DataFrame]:
    inside = within(F.col("score"), low, high, low_open, high_open)
    return live.where(~inside), keyspace.count_of(live.where(inside), "removed")


def remove_by_lex(live: DataFrame, low: str, high: str, low_open: bool = False, high_open: bool = False) -> tuple[DataFrame, DataFrame]:
    return remove_found(live, _lex(live, low, high, low_open, high_open))


def cardinality(live: DataFrame) -> DataFrame:
    return keyspace.count_of(live, "size")
