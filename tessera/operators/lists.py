"""Lists: rows (key, pos, value); positions order a list and may have any start and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import list_bounds
from . import keyspace


def _placed(live: DataFrame) -> DataFrame:
    w = Window.partitionBy("key")
    return live.withColumns({"idx": F.row_number().over(w.orderBy("pos")) - 1, "n": F.count("*").over(w)})


def push(live: DataFrame, batch: DataFrame, left: bool = False, need_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """The state with values (key, seq, value) pushed one by one, and the new length of each list pushed to."""
    ends = live.groupBy("key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))
    j = batch.join(ends, "key", "inner" if need_key else "left")
    rn = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    pos = F.coalesce("lo", F.lit(0)) - rn if left else F.coalesce("hi", F.lit(-1)) + rn
    added = j.select("key", pos.cast("long").alias("pos"), "value", F.coalesce("n", F.lit(0)).alias("n"))
    lengths = added.groupBy("key").agg((F.max("n") + F.count("*")).alias("length"))
    return live.select("key", "pos", "value").unionByName(added.drop("n")), lengths


def pop(live: DataFrame, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """The end value of each list, and the state without it. One value for each key: aggregated before the shuffle."""
    end = live.groupBy("key").agg((F.min if left else F.max)("pos").alias("pos"))
    pick = live.join(end, ["key", "pos"], "left_semi").select("key", "value")
    return pick, live.join(end, ["key", "pos"], "left_anti")


def index(live: DataFrame, at: int) -> DataFrame:
    """The value at an index of each list; negative ones count from the tail; none where out of range."""
    p = _placed(live)
    return p.where(F.col("idx") == (F.lit(at) if at >= 0 else F.col("n") + at)).select("key", "value")


def put(live: DataFrame, at: int, value: Column) -> DataFrame:
    """The state with the value at an index replaced, and ok: whether the list has that index."""
    p = _placed(live)
    target = F.lit(at) if at >= 0 else F.col("n") + at
    hit = F.col("idx") == target
    return p.select("key", "pos", F.when(hit, value).otherwise(F.col("value")).alias("value"), ((target >= 0) & (target < F.col("n"))).alias("ok"))


def between(live: DataFrame, start: int, stop: int) -> DataFrame:
    """key, idx, value of the items in a range (at most 10,000 of each list)."""
    p = _placed(live)
    lo, hi = list_bounds(F.col("n"), start, stop)
    return p.where((F.col("idx") >= lo) & (F.col("idx") <= hi)).select("key", "idx", "value")


def trim(live: DataFrame, start: int, stop: int) -> DataFrame:
    """The state with the items outside a range gone; lists left empty are gone."""
    p = _placed(live)
    lo, hi = list_bounds(F.col("n"), start, stop, cap=None)
    return p.where((F.col("idx") >= lo) & (F.col("idx") <= hi)).select("key", "pos", "value")


def length(live: DataFrame) -> DataFrame:
    return keyspace.count_of(live, "size")


def replay(ops: DataFrame) -> DataFrame:
    """key, items, popped after interleaved ops (key, seq, op in lpush rpush lpop rpop, value): a fold for each key,
    inside the JVM. A key's ops must fit a row; use push and pop for longer runs of one kind."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "op", "value")))
    empty = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        items, out, n = s["items"], s["popped"], F.size(s["items"])
        state = lambda a, b: F.struct(a.alias("items"), b.alias("popped"))
        return (
            F.when(x["op"] == "lpush", state(F.concat(F.array(x["value"]), items), out))
            .when(x["op"] == "rpush", state(F.concat(items, F.array(x["value"])), out))
            .when(n == 0, state(items, F.concat(out, F.array(F.lit(None).cast("string")))))
            .when(x["op"] == "lpop", state(F.slice(items, F.lit(2), n), F.concat(out, F.array(F.get(items, F.lit(0))))))
            .otherwise(state(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), F.concat(out, F.array(F.get(items, n - 1)))))
        )

    start = F.struct(empty.alias("items"), empty.alias("popped"))
    folded = ops.groupBy("key").agg(ordered.alias("o")).select("key", F.aggregate("o", start, step).alias("s"))
    return folded.select("key", "s.items", "s.popped")
