"""Queries over the driver's tables for every operator, each with SQL that DuckDB answers alike where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import fnv1_32, valid_element, within
from .functions.ranges import segment
from .operators import bitmaps, dk, hashes, keyspace, lists, maintenance, sets, zsets
from .plans import merge
from .schema import DataType, Kind
from .sources import store as stored
from .sources.fixtures import Tables, millis, sql
from .sources.store import Store, scratch

#: A moment inside the orders' and the events' lifetimes.
NOW_ORDERS, NOW_EVENTS = 900_000_000_000, 1_705_000_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(names: str | None = None, oracle: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(names, oracle) if names else oracle
        return f

    return add


def strings(t: Tables) -> DataFrame:
    return merge.strings(t.string_ops())


def live_hashes(t: Tables) -> DataFrame:
    return merge.live(t.hash_ops(), ["key", "field"]).select("key", "field", "value", "seq")


# -- keys --------------------------------------------------------------------------------------------------------------
@query("strings", "SELECT key, value FROM strings")
def string_get_latest(t):
    return strings(t).select("key", "value")


@query("strings", "SELECT key, value, expire_ms FROM strings")
def string_get_with_expireat_overlay(t):
    return strings(t).select("key", "value", "expire_ms")


@query("string_ops", "SELECT key, slot, seq, expire_ms FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM string_ops) WHERE rn = 1 AND kind != 0")
def meta_latest(t):
    return keyspace.meta(t.string_ops()).select("key", "slot", "seq", "expire_ms")


@query("strings", "SELECT key, expire_ms FROM strings")
def get_timestamp(t):
    return strings(t).select("key", "expire_ms")


# Asked for are every user's key and every customer's, most of which have no string.
_ALL_KEYS = "(SELECT CAST(user_id AS VARCHAR) AS key FROM events UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer)"


def _all_keys(t: Tables) -> DataFrame:
    return t.read("events").select(F.col("user_id").cast("string").alias("key")).union(t.read("customer").select(F.col("c_custkey").cast("string"))).distinct()


@query("strings", f"SELECT key, key IN (SELECT key FROM strings) AS found FROM {_ALL_KEYS}")
def exists_batch(t):
    return keyspace.exists(strings(t), _all_keys(t))


@query("strings", f"SELECT key, value, expire_ms FROM strings WHERE key IN (SELECT key FROM {_ALL_KEYS})")
def get_batch(t):
    return keyspace.get(strings(t), _all_keys(t))


@query("strings", f"SELECT k.key, CAST(CASE WHEN s.expire_ms IS NULL OR (s.expire_ms != 0 AND s.expire_ms <= {NOW_EVENTS}) OR (s.expire_ms = 0 AND CAST(k.key AS BIGINT) % 2 = 0) THEN 0 ELSE 1 END AS BIGINT) AS result FROM {_ALL_KEYS} k LEFT JOIN strings s ON s.key = k.key")
def expire_at_result(t):
    wanted = _all_keys(t).withColumn("new_ms", F.when(F.col("key").cast("long") % 2 == 0, 0).otherwise(NOW_EVENTS + 1000))
    return keyspace.expire_at(strings(t), wanted, NOW_EVENTS).select("key", "result")


@query("strings", f"SELECT k.key, CAST(CASE WHEN s.key IS NULL OR (s.expire_ms != 0 AND s.expire_ms <= {NOW_EVENTS}) THEN 0 ELSE 1 END AS BIGINT) AS result FROM {_ALL_KEYS} k LEFT JOIN strings s ON s.key = k.key")
def key_delete_effect(t):
    return keyspace.delete(strings(t), _all_keys(t), NOW_EVENTS)[1].select("key", "result")


@query("strings", f"SELECT key FROM strings WHERE expire_ms = 0 OR expire_ms > {NOW_EVENTS}")
def scan_type_filter_alive(t):
    state = strings(t).withColumns({"data_type": F.lit(1), "slot": F.lit(0)})
    return keyspace.typed(state, DataType.STRING, NOW_EVENTS).where("ok").select("key")


@query("strings", f"SELECT CAST(CAST(key AS BIGINT) % 16 AS INTEGER) AS slot, key FROM strings WHERE (expire_ms = 0 OR expire_ms > {NOW_EVENTS}) AND (CAST(key AS BIGINT) % 16, key) > (3, '') ORDER BY 1, 2 LIMIT 13")
def scan_page_keyset(t):
    state = strings(t).withColumns({"data_type": F.lit(1), "slot": (F.col("key").cast("long") % 16).cast("int")})
    return keyspace.scan(state, NOW_EVENTS, DataType.STRING, after=(3, ""), count=13)


@query(None, "SELECT event_id, user_id FROM events WHERE event_id >= 500 ORDER BY event_id LIMIT 1")
def iterator_seek_ge(t):
    return keyspace.seek(t.read("events").select("event_id", "user_id"), "event_id", 500)


@query(None, "SELECT event_id, user_id FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 1")
def iterator_seek_lt(t):
    return keyspace.seek(t.read("events").select("event_id", "user_id"), "event_id", 500, forward=False)


@query(None, """WITH e AS (SELECT event_id, user_id FROM events WHERE event_id >= 100 AND event_id < 900)
SELECT * FROM (SELECT 'first' AS move, * FROM e ORDER BY event_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'last' AS move, * FROM e ORDER BY event_id DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'next' AS move, * FROM e WHERE event_id > 500 ORDER BY event_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'prev' AS move, * FROM e WHERE event_id < 500 ORDER BY event_id DESC LIMIT 1)""")
def iterator_moves(t):
    rows = keyspace.bounded(t.read("events").select("event_id", "user_id"), "event_id", 100, 900)
    moves = {"first": keyspace.first(rows, "event_id"), "last": keyspace.last(rows, "event_id"), "next": keyspace.following(rows, "event_id", 500), "prev": keyspace.seek(rows, "event_id", 500, forward=False)}
    out = None
    for k, df in moves.items():
        df = df.select(F.lit(k).alias("move"), "*")
        out = df if out is None else out.union(df)
    return out


# -- stored ------------------------------------------------------------------------------------------------------------
def _stored(t: Tables, spark: SparkSession) -> Store:
    """A user's hash and a customer's list in a store: two batches, a base between them."""
    store = Store(spark, scratch(spark))
    h = t.hash_ops().select(F.concat(F.lit("h"), "key").alias("key"), F.col("field").alias("subkey"), "value", "kind", "seq", F.lit(int(DataType.HASH)).alias("data_type"))
    store.append(h.where("seq % 2 = 0"))
    store.compact()
    store.append(h.where("seq % 2 = 1"))
    store.append(t.lists().select(F.concat(F.lit("l"), "key").alias("key"), F.col("pos").cast("string").alias("subkey"), "value", F.lit(1).alias("kind"), F.col("pos").alias("seq"), F.lit(int(DataType.LIST)).alias("data_type")))
    return store


@query("hashes", "SELECT 'h' || key AS key, field, value FROM hashes")
def checkpoint_roundtrip(t):
    target = scratch(t.spark)
    _stored(t, t.spark).checkpoint(target)
    return Store(t.spark, target).elements(DataType.HASH).select("key", F.col("subkey").alias("field"), "value")


@query("hashes lists", """SELECT 'h' || key AS key, 3 AS data_type, CAST(0 AS BIGINT) AS version, count(*) AS size, CAST(NULL AS BIGINT) AS lindex, CAST(NULL AS BIGINT) AS rindex FROM hashes GROUP BY key
UNION ALL SELECT 'l' || key, 4, 0, count(*), min(pos), max(pos) FROM lists GROUP BY key""")
def meta_get(t):
    return _stored(t, t.spark).meta().select("key", "data_type", "version", "size", "lindex", "rindex")


# -- merge -------------------------------------------------------------------------------------------------------------
@query("hash_ops", "SELECT key, field, value, kind FROM (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY seq DESC) AS rn FROM hash_ops) WHERE rn = 1")
def merge_latest_wins(t):
    return merge.latest(t.hash_ops(), ["key", "field"]).select("key", "field", "value", "kind")


@query("hashes", "SELECT key, field, value FROM hashes")
def merge_tombstones(t):
    return live_hashes(t).select("key", "field", "value")


@query("hashes", "SELECT key, field, value FROM hashes WHERE key % 7 != 0")
def merge_prefix_delete(t):
    gone = t.hash_ops().where("key % 7 = 0").select("key")
    return merge.drop_prefix_deleted(live_hashes(t), gone, ["key"]).select("key", "field", "value")


@query("hash_ops", """, v AS (SELECT *, sum(CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS version FROM hash_ops)
SELECT key, CAST(version AS BIGINT) AS version, count(*) AS n FROM v GROUP BY key, version""".replace(", v", ", v", 1))
def merge_incarnations(t):
    v = merge.incarnations(t.hash_ops(), F.col("seq") % 50 == 0, ["key"])
    return v.groupBy("key", "version").agg(F.count("*").alias("n"))


@query("hashes", "SELECT key, field, value FROM hashes")
def merge_tiers(t):
    ops = t.hash_ops()
    base = merge.compact(ops.where("seq < 3000"), ["key", "field"])
    delta = [ops.where("seq >= 3000 AND seq < 6000"), ops.where("seq >= 6000")]
    return merge.live(merge.merge_tiers(base, *delta), ["key", "field"]).select("key", "field", "value")


@query("hashes", "SELECT key, field, value FROM hashes")
def compaction_idempotent(t):
    once = merge.compact(t.hash_ops(), ["key", "field"])
    return merge.compact(once, ["key", "field"]).select("key", "field", "value")


# -- hashes ------------------------------------------------------------------------------------------------------------
@query("hashes", "SELECT key, field, value FROM hashes")
def hash_getall(t):
    return live_hashes(t).select("key", "field", "value")


@query("hashes", "SELECT key, field FROM hashes")
def hash_keys(t):
    return live_hashes(t).select("key", "field")


@query("hashes", "SELECT key, value FROM hashes")
def hash_values(t):
    return live_hashes(t).select("key", "value")


@query("hashes", "SELECT key, field, value FROM hashes")
def hash_get(t):
    wanted = t.hash_ops().select("key").distinct().crossJoin(t.hash_ops().select("field").distinct())
    return hashes.get(live_hashes(t), wanted)


_WANTED = "(SELECT DISTINCT key, f AS field, p AS pos FROM hash_ops, (VALUES ('view', 0), ('nope', 1), ('click', 2)) w(f, p))"


@query("hashes", f"SELECT w.key, w.field, CAST(w.pos AS INTEGER) AS pos, h.value FROM {_WANTED} w LEFT JOIN hashes h USING (key, field)")
def hash_mget(t):
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("pos")) for i, f in enumerate(("view", "nope", "click"))])
    wanted = t.hash_ops().select("key").distinct().select("key", F.explode(fields).alias("w")).select("key", "w.field", "w.pos")
    return hashes.get_many(live_hashes(t), wanted)


def _hash_batch(t: Tables) -> DataFrame:
    return t.read("events").select((F.col("user_id") + 50).alias("key"), F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string")).alias("field"), F.col("props").alias("value"), F.col("event_id").alias("seq")).union(
        t.hash_ops().where("kind = 1").select("key", "field", "value", "seq")
    )


_BATCH = """, batch AS (SELECT user_id + 50 AS key, 'n' || (event_id % 5) AS field FROM events UNION ALL SELECT key, field FROM hash_ops WHERE kind = 1)"""
_ADDED = "SELECT key, count(*) AS added FROM (SELECT DISTINCT key, field FROM batch) b WHERE {also} NOT EXISTS (SELECT 1 FROM hashes h WHERE h.key = b.key AND h.field = b.field) GROUP BY key"


@query("hashes", _BATCH + _ADDED.format(also=""))
def hash_mset_new_count(t):
    return hashes.set_many(live_hashes(t), _hash_batch(t))[1]


@query("hashes", _BATCH + _ADDED.format(also="key IN (SELECT key FROM hashes) AND"))
def hash_msetx(t):
    return hashes.set_many(live_hashes(t), _hash_batch(t), need_key=True)[1]


@query("counters hashes", "SELECT c.key, c.field, CAST(coalesce(CAST(any_value(h.value) AS BIGINT), 0) + sum(incr) AS BIGINT) AS value FROM counters c LEFT JOIN hashes h USING (key, field) GROUP BY c.key, c.field")
def hash_incrby(t):
    return hashes.increment(live_hashes(t), t.counters())


@query("counters", "SELECT key, field, seq, CAST(sum(incr) OVER (PARTITION BY key, field ORDER BY seq) AS BIGINT) AS value FROM counters")
def hash_incrby_running(t):
    return hashes.running(t.counters()).select("key", "field", "seq", "value")


@query("hashes", "SELECT key, count(*) AS removed FROM hashes WHERE field IN ('view', 'click') GROUP BY key")
def hash_del_count(t):
    gone = t.hash_ops().where("field IN ('view', 'click')").select("key", "field")
    return hashes.remove(live_hashes(t), gone)[1]


@query("hashes", "SELECT key, count(*) FILTER (field NOT IN ('view', 'click')) AS size FROM hashes GROUP BY key")
def hash_delx_sizes(t):
    gone = t.hash_ops().where("field IN ('view', 'click')").select("key", "field")
    return hashes.remove(live_hashes(t), gone, keep_empty=True)[2]


@query("hashes", "SELECT key, count(*) AS size FROM hashes GROUP BY key")
def hash_len(t):
    return hashes.length(live_hashes(t))


@query("hashes", "SELECT key, CAST(count(*) AS BIGINT) AS size, true AS agrees FROM hashes GROUP BY key")
def meta_size_check(t):
    added = keyspace.effects(t.hash_ops().withColumn("op", F.when(F.col("kind") == int(Kind.SET), "add").otherwise("del")), "add", "del", ["key", "field"])
    kept = added.groupBy("key").agg(F.sum(F.when(F.col("op") == "add", F.col("result")).otherwise(-F.col("result"))).alias("size"))
    real = hashes.length(live_hashes(t)).withColumnRenamed("size", "real")
    return kept.join(real, "key").select("key", "size", (F.col("size") == F.col("real")).alias("agrees"))


# -- sets --------------------------------------------------------------------------------------------------------------
@query("sets", "SELECT key, member, CAST(row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS INTEGER) AS pos FROM sets")
def set_members(t):
    return sets.members(t.sets())


@query(None, """WITH old AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS member FROM lineitem WHERE l_linenumber <= 3), new AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS member FROM lineitem WHERE l_linenumber > 3)
SELECT key, count(*) AS added FROM (SELECT * FROM new EXCEPT SELECT * FROM old) GROUP BY key""")
def set_add_count(t):
    li = t.read("lineitem")
    part = lambda c: li.where(c).select(F.col("l_suppkey").alias("key"), F.col("l_partkey").cast("string").alias("member"))
    return sets.add(part("l_linenumber <= 3").distinct(), part("l_linenumber > 3"))[1]


@query(None, """WITH old AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS member FROM lineitem WHERE l_linenumber <= 3 AND l_suppkey % 2 = 0), new AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS member FROM lineitem WHERE l_linenumber > 3)
SELECT key, count(*) AS added FROM (SELECT * FROM new WHERE key IN (SELECT key FROM old) EXCEPT SELECT * FROM old) GROUP BY key""")
def set_addx_count(t):
    li = t.read("lineitem")
    part = lambda c: li.where(c).select(F.col("l_suppkey").alias("key"), F.col("l_partkey").cast("string").alias("member"))
    return sets.add(part("l_linenumber <= 3 AND l_suppkey % 2 = 0").distinct(), part("l_linenumber > 3"), need_key=True)[1]


@query("sets", "SELECT key, count(*) FILTER (CAST(member AS BIGINT) % 3 != 0) AS size FROM sets GROUP BY key")
def set_remx_sizes(t):
    return sets.remove(t.sets(), t.set_ops().where("cast(member AS bigint) % 3 = 0"), keep_empty=True)[2]


@query("sets", "SELECT key, count(*) AS removed FROM sets WHERE CAST(member AS BIGINT) % 3 = 0 GROUP BY key")
def set_rem_count(t):
    return sets.remove(t.sets(), t.set_ops().where("cast(member AS bigint) % 3 = 0"))[1]


@query("sets", "SELECT key, member, CAST((key, member) IN (SELECT (key, member) FROM sets) AS BIGINT) AS found FROM (SELECT key, member FROM sets UNION SELECT key, CAST(CAST(member AS BIGINT) + 1 AS VARCHAR) FROM sets)")
def set_ismember(t):
    wanted = t.set_ops().union(t.set_ops().select("key", (F.col("member").cast("long") + 1).cast("string")))
    wanted = merge.spread(wanted, *sets.ON).distinct()
    return sets.contains(t.sets(), wanted)


@query("sets", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS rn FROM sets) WHERE rn <= 10")
def set_pop_first_n(t):
    return sets.pop(t.sets(), 10)[0]


@query("sets", "SELECT key, count(*) AS size FROM sets GROUP BY key")
def set_card(t):
    return sets.cardinality(t.sets())


@query()
def set_randmember(t):
    return sets.random_members(t.sets(), 5, seed=1)


@query()
def set_randmember_repeating(t):
    return sets.random_members(t.sets(), -5, seed=1)


@query(None, """WITH o AS (SELECT event_id AS seq, user_id AS key, event_type AS member, CASE WHEN event_id % 3 = 0 THEN 'rem' ELSE 'add' END AS op FROM events)
SELECT seq, op, CAST(CASE WHEN op = 'add' AND coalesce(prev, 'rem') = 'rem' THEN 1 WHEN op = 'rem' AND prev = 'add' THEN 1 ELSE 0 END AS BIGINT) AS result FROM (SELECT *, lag(op) OVER (PARTITION BY key, member ORDER BY seq) AS prev FROM o)""")
def set_op_effects(t):
    ops = t.read("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.col("event_type").alias("member"), F.when(F.col("event_id") % 3 == 0, "rem").otherwise("add").alias("op"))
    return keyspace.effects(ops, "add", "rem", ["key", "member"]).select("seq", "op", "result")


# -- lists -------------------------------------------------------------------------------------------------------------
def _pushes(t: Tables) -> DataFrame:
    return t.read("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))


_LEN = "SELECT e.user_id AS key, count(*) + coalesce(any_value(l.n), 0) AS length FROM events e LEFT JOIN (SELECT DISTINCT key, n FROM lists) l ON l.key = e.user_id {w} GROUP BY e.user_id"


@query("lists", _LEN.format(w=""))
def list_push_right(t):
    return lists.push(t.lists(), _pushes(t))[1]


@query("lists", _LEN.format(w="WHERE l.key IS NOT NULL"))
def list_pushx_left(t):
    return lists.push(t.lists(), _pushes(t), left=True, need_key=True)[1]


@query("lists", "SELECT key, pos, value FROM lists UNION ALL SELECT user_id, -row_number() OVER (PARTITION BY user_id ORDER BY event_id), event_type FROM events")
def list_push_left(t):
    return lists.push(t.lists(), _pushes(t), left=True)[0]


@query("lists", "SELECT key, value FROM lists WHERE pos = 0")
def list_pop_left(t):
    return lists.pop(t.lists())[0]


@query("lists", "SELECT key, pos, value FROM lists WHERE pos < n - 1")
def list_pop_right(t):
    return lists.pop(t.lists(), left=False)[1]


@query("lists", "SELECT key, value FROM lists WHERE pos = 3")
def list_index(t):
    return lists.index(t.lists(), 3)


@query("lists", "SELECT key, value FROM lists WHERE pos = n - 2")
def list_index_negative(t):
    return lists.index(t.lists(), -2)


@query("lists", "SELECT key, pos, CASE WHEN pos = n - 1 THEN 'new' ELSE value END AS value FROM lists")
def list_set(t):
    return lists.put(t.lists(), -1, F.lit("new")).select("key", "pos", "value")


@query("lists", "SELECT key, CAST(pos AS INTEGER) AS idx, value FROM lists WHERE pos BETWEEN 2 AND 5")
def list_range(t):
    return lists.between(t.lists(), 2, 5)


@query("lists", "SELECT key, CAST(pos AS INTEGER) AS idx, value FROM lists WHERE n - 2 >= 0 AND pos BETWEEN greatest(0, n - 5) AND n - 2")
def list_range_negative(t):
    return lists.between(t.lists(), -5, -2)


@query("lists", "SELECT key, pos, value FROM lists WHERE pos BETWEEN 1 AND n - 2")
def list_trim(t):
    return lists.trim(t.lists(), 1, -2)


@query("lists", "SELECT key, count(*) AS size FROM lists GROUP BY key")
def list_len(t):
    return lists.length(t.lists())


@query()
def list_replay(t):
    kinds = F.element_at(F.array(*map(F.lit, ("lpush", "rpush", "rpush", "lpop", "rpop"))), (F.col("event_id") % 5 + 1).cast("int"))
    ops = t.read("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kinds.alias("op"), F.col("event_id").cast("string").alias("value"))
    return lists.replay(ops)


@query(None, "SELECT conv_id AS key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx, text AS value FROM conversations QUALIFY idx < 2")
def list_range_conversations(t):
    turns = t.read("conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("text").alias("value"))
    return lists.between(turns, 0, 1)


# -- sorted sets -------------------------------------------------------------------------------------------------------
@query("zsets", """, old AS (SELECT * FROM zsets WHERE score < 3000)
SELECT key, count(*) AS added FROM zsets WHERE member NOT IN (SELECT member FROM old) GROUP BY key""")
def zset_add_count(t):
    z = t.zsets()
    return zsets.add(z.where("score < 3000"), z.withColumn("seq", F.lit(1).cast("long")))[1]


@query(None, "SELECT event_type AS key, CAST(user_id AS VARCHAR) AS member, max_by(value, event_id) AS score FROM events GROUP BY ALL")
def zset_add_newest(t):
    e = t.read("events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return zsets.add(e.where("false").select("key", "member", "score"), e)[0]


@query("zsets", "SELECT z.key, z.member, z.score + 3.5 AS score FROM zsets z WHERE score < 0")
def zset_incrby(t):
    z = t.zsets()
    steps = z.where("score < 0").select("key", "member", F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("incr")) for i, x in enumerate((1.5, 2.0))])).alias("s"))
    return zsets.increment(z, steps.select("key", "member", "s.seq", "s.incr"))


@query("zsets", "SELECT key, count(*) AS removed FROM zsets WHERE member LIKE '%7' GROUP BY key")
def zset_rem(t):
    z = t.zsets()
    return zsets.remove(z, z.where("member LIKE '%7'"))[1]


@query("zsets", "SELECT key, member, score FROM zsets")
def zset_score(t):
    return zsets.score(t.zsets(), t.zsets().select("key", "member"))


@query("zranked", "SELECT key, member, score, rank FROM zranked WHERE rank BETWEEN 5 AND 14")
def zset_range(t):
    return zsets.by_rank(t.zsets(), 5, 14)


@query("zranked", "SELECT key, member, score, rank FROM zranked WHERE rank BETWEEN greatest(n - 10, 0) AND n - 3")
def zset_range_negative(t):
    return zsets.by_rank(t.zsets(), -10, -3)


@query("zranked", "SELECT key, member, score, revrank AS rank FROM zranked WHERE revrank <= 9")
def zset_revrange(t):
    return zsets.by_rank(t.zsets(), 0, 9, reverse=True)


@query("zranked", """SELECT key, member, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 4 AS pos FROM zsets WHERE score > 1000 AND score <= 6000) WHERE pos BETWEEN 0 AND 9""")
def zset_range_by_score(t):
    return zsets.by_score(t.zsets(), 1000.0, 6000.0, low_open=True, offset=3, count=10)


@query("zsets", """SELECT key, member, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS pos FROM zsets WHERE score >= 1000 AND score < 6000)""")
def zset_revrange_by_score(t):
    return zsets.by_score(t.zsets(), 1000.0, 6000.0, high_open=True, reverse=True)


@query("zranked", "SELECT key, member, rank FROM zranked")
def zset_rank(t):
    return zsets.rank(t.zsets(), t.zsets().select("key", "member"))


@query("zranked", "SELECT key, member, revrank AS rank FROM zranked")
def zset_revrank(t):
    return zsets.rank(t.zsets(), t.zsets().select("key", "member"), reverse=True)


@query("zsets", "SELECT key, count(*) FILTER (score > 0 AND score < 5000) AS n FROM zsets GROUP BY key")
def zset_count(t):
    return zsets.count(t.zsets(), 0.0, 5000.0, True, True)


@query("lex_zsets", "SELECT key, member, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS pos FROM lex_zsets WHERE member >= 'c' AND member < 'p') WHERE pos < 20")
def zset_range_by_lex(t):
    return zsets.by_lex(t.lex_zsets(), "c", "p", high_open=True, count=20)


_CUT = """, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS rn FROM zsets), c AS (SELECT *, min(CASE WHEN member > 'Customer#000001000' THEN rn END) OVER (PARTITION BY key) AS stop FROM o)"""


@query("zsets", _CUT + "SELECT key, count(*) AS n FROM c WHERE member >= 'Customer#000000100' AND (stop IS NULL OR rn < stop) GROUP BY key")
def zset_lex_count(t):
    return zsets.lex_count(t.zsets(), "Customer#000000100", "Customer#000001000")


@query("zranked", "SELECT key, CAST(least(n, 10) AS BIGINT) AS removed FROM zranked GROUP BY key, n")
def zset_remrange_by_rank(t):
    return zsets.remove_by_rank(t.zsets(), 0, 9)[1]


@query("zsets", "SELECT key, member, score FROM zsets WHERE NOT (score >= 0 AND score <= 2000)")
def zset_remrange_by_score(t):
    return zsets.remove_by_score(t.zsets(), 0.0, 2000.0)[0].select("key", "member", "score")


@query("lex_zsets", "SELECT key, count(*) AS removed FROM lex_zsets WHERE member > 'd' GROUP BY key")
def zset_remrange_by_lex(t):
    return zsets.remove_by_lex(t.lex_zsets(), "d", "+", low_open=True)[1]


@query("zsets", "SELECT key, count(*) AS size FROM zsets GROUP BY key")
def zset_card(t):
    return zsets.cardinality(t.zsets())


# -- bitmaps -----------------------------------------------------------------------------------------------------------
def _bit_writes(t: Tables) -> DataFrame:
    return t.read("events").select(F.col("event_type").alias("key"), F.col("user_id").alias("offset"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("bit"))


_WRITES = "WITH w AS (SELECT event_type AS key, user_id AS \"offset\", event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS bit FROM events) "


@query(None, _WRITES + "SELECT seq, CAST(coalesce(lag(bit) OVER (PARTITION BY key, \"offset\" ORDER BY seq), 0) AS BIGINT) AS prev FROM w")
def bitmap_setbit_prev(t):
    return bitmaps.set_bits(_bit_writes(t))[1].select("seq", "prev")


@query(None, _WRITES + "SELECT key, \"offset\" FROM w GROUP BY ALL HAVING max_by(bit, seq) = 1")
def bitmap_setbit_state(t):
    return bitmaps.set_bits(_bit_writes(t))[0]


@query("user_bits", "SELECT key, o AS \"offset\", CAST((key, o) IN (SELECT (key, \"offset\") FROM user_bits) AS BIGINT) AS bit FROM (SELECT event_type AS key, user_id AS o FROM events UNION SELECT event_type, event_id FROM events)")
def bitmap_getbit(t):
    e = t.read("events")
    wanted = e.select(F.col("event_type").alias("key"), F.col("user_id").alias("offset")).union(e.select("event_type", "event_id")).distinct()
    return bitmaps.get_bits(t.user_bits(), wanted)


@query("bits", "SELECT key, count(DISTINCT \"offset\") AS n FROM bits GROUP BY key")
def bitmap_count(t):
    return bitmaps.count(t.bits())


@query("bits", "SELECT key, count(DISTINCT \"offset\") FILTER (\"offset\" BETWEEN 1000 AND 200000) AS n FROM bits GROUP BY key")
def bitmap_count_range(t):
    return bitmaps.count(t.bits(), 1000, 200_000)


@query("bits", """, s AS (SELECT key, "offset", "offset" - "offset" % 65536 AS seg FROM bits), f AS (SELECT key, min(seg) AS seg FROM s WHERE seg >= 65536 GROUP BY key)
SELECT s.key, coalesce(min(CASE WHEN "offset" >= 100000 AND s.seg = f.seg THEN "offset" END), -1) AS pos FROM s LEFT JOIN f USING (key) GROUP BY s.key""")
def bitmap_pos_one(t):
    return bitmaps.first_set(t.bits(), 100_000, -1)


@query("user_bits", """, g AS (SELECT key, "offset" - row_number() OVER (PARTITION BY key ORDER BY "offset") AS grp, "offset" FROM user_bits)
SELECT k.key, CAST(coalesce(max(g."offset") + 1, 0) AS BIGINT) AS pos FROM (SELECT DISTINCT key FROM user_bits) k LEFT JOIN g ON g.key = k.key AND g.grp = -1 GROUP BY k.key""")
def bitmap_pos_zero(t):
    return bitmaps.first_clear(t.user_bits(), 0, -1)


# -- distributed keys --------------------------------------------------------------------------------------------------
@query(None, "SELECT DISTINCT l_orderkey AS key, CASE WHEN l_orderkey % 11 = 0 THEN 'shard number' WHEN l_orderkey % 2 = 0 THEN 'exists' ELSE 'created' END AS result FROM lineitem")
def dk_create(t):
    keys = t.read("lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    there = keys.where("key % 2 = 0").select("key", F.lit(8).alias("shard_num"), F.lit(0).cast("long").alias("size"))
    return dk.create(there, keys.withColumn("shard_num", F.when(F.col("key") % 11 == 0, 0).otherwise(8)))[1].select("key", "result")


@query(None, "SELECT DISTINCT l_orderkey AS key, 9 AS data_type, CAST(0 AS BIGINT) AS size FROM lineitem")
def dk_create_shard(t):
    keys = t.read("lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return dk.create_shard(keys.where("false").select("key", F.lit(9).alias("data_type"), F.lit(0).cast("long").alias("size")), keys, DataType.DK_HASH)


@query(None, """WITH i AS (SELECT user_id AS key, event_id AS seq, CAST(CASE WHEN event_id % 3 = 0 THEN -60 ELSE 20 END AS BIGINT) AS incr FROM events), r AS (SELECT *, sum(incr) OVER (PARTITION BY key ORDER BY seq) AS run FROM i)
SELECT key, CAST(max_by(run, seq) - least(min(run), 0) AS BIGINT) AS size FROM r GROUP BY key""")
def dk_incr_size(t):
    e = t.read("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, -60).otherwise(20).cast("long").alias("incr"))
    return dk.change_size(e.select("key", F.lit(0).cast("long").alias("size")).distinct(), e)


# -- upkeep ------------------------------------------------------------------------------------------------------------
@query("orders_ttl", "SELECT ((expire_ms + 999) // 1000 // 300 + 1) * 300 AS bucket_sec, count(*) AS n FROM orders_ttl GROUP BY 1")
def ttl_bucket_index(t):
    return maintenance.expiry_index(t.orders_ttl()).groupBy("bucket_sec").agg(F.count("*").alias("n"))


@query("orders_ttl", f"SELECT key FROM orders_ttl WHERE ((expire_ms + 999) // 1000 // 300 + 1) * 300 > 800000000 AND ((expire_ms + 999) // 1000 // 300 + 1) * 300 <= {NOW_ORDERS // 1000}")
def ttl_sweep(t):
    return maintenance.sweep(maintenance.expiry_index(t.orders_ttl()), 800_000_000, NOW_ORDERS // 1000).select("key")


@query("orders_ttl", f"""SELECT CAST(CASE WHEN expire_ms <= {NOW_ORDERS} THEN -1 WHEN (expire_ms - {NOW_ORDERS}) // 7200000 >= 1080 THEN 1080 ELSE (expire_ms - {NOW_ORDERS}) // 7200000 END AS BIGINT) AS bucket, count(*) AS n, CAST(sum(8) AS BIGINT) AS bytes FROM orders_ttl GROUP BY 1""")
def ttl_histogram(t):
    return maintenance.expiry_histogram(t.orders_ttl(), NOW_ORDERS, F.lit(8).cast("long"))


@query("orders_ttl", f"SELECT key FROM orders_ttl WHERE expire_ms <= {NOW_ORDERS}")
def gc_candidates(t):
    return maintenance.garbage(t.orders_ttl(), NOW_ORDERS).select("key")


@query("string_ops", "SELECT slot, count(*) AS records, count(*) FILTER (kind = 0) AS deletes, CAST(sum(coalesce(length(value), 0)) AS BIGINT) AS value_bytes FROM string_ops GROUP BY slot")
def slot_stats(t):
    return maintenance.slot_stats(t.string_ops())


@query("hashes", "SELECT o.key, o.field, o.seq FROM hash_ops o JOIN hashes h USING (key, field, seq)")
def valuelog_live_semi(t):
    return maintenance.live_values(t.hash_ops(), live_hashes(t), ["key", "field", "seq"]).select("key", "field", "seq")


@query("hashes", """SELECT o.seq // 500 AS file, count(*) AS total, count(*) FILTER (h.key IS NULL) AS dead FROM hash_ops o LEFT JOIN hashes h USING (key, field, seq) GROUP BY 1 HAVING count(*) FILTER (h.key IS NULL) >= count(*) * 0.9""")
def valuelog_files_to_compact(t):
    values = t.hash_ops().withColumn("file", F.floor(F.col("seq") / 500).cast("long"))
    return maintenance.files_to_compact(values, live_hashes(t), ["key", "field", "seq"], 0.9)


@query(None, "SELECT (epoch_us(ts) // 1000) // 86400000 AS day, avg(user_id) AS mean_ms, max_by(user_id, epoch_us(ts)) AS last_ms, count(*) AS n FROM events GROUP BY 1")
def flush_costs(t):
    return maintenance.flush_costs(t.read("events").select(millis(F.col("ts")).alias("ts_ms"), F.col("user_id").alias("cost_ms")))


@query(None, "SELECT event_id, event_id * 37 - (event_id * 37) % 65536 AS segment FROM events")
def bitmap_segments(t):
    return t.read("events").select("event_id", segment(F.col("event_id") * 37).alias("segment"))


@query(None, "SELECT c_name, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, b: xor((h * 16777619) % 4294967296, b)) AS hash FROM customer")
def slot_hash_fnv(t):
    return t.read("customer").select("c_name", fnv1_32(F.col("c_name")).alias("hash"))


@query(None, "SELECT p_partkey FROM part WHERE length(p_name) BETWEEN 1 AND 10240 AND p_retailprice > 905 AND p_retailprice <= 915")
def bounds_and_validity(t):
    return t.read("part").where(valid_element(F.col("p_name")) & within(F.col("p_retailprice"), 905, 915, low_open=True)).select("p_partkey")


@query("orders_ttl", f"SELECT key FROM orders_ttl WHERE ((expire_ms + 999) // 1000 // 300 + 1) * 300 > {NOW_ORDERS // 1000}")
def ttl_swept(t):
    state = t.orders_ttl()
    return maintenance.swept(state, maintenance.sweep(maintenance.expiry_index(state), 0, NOW_ORDERS // 1000), ["key"]).select("key")


@query("orders_ttl", f"SELECT key FROM orders_ttl WHERE expire_ms > {NOW_ORDERS}")
def gc_collected(t):
    return maintenance.collect_garbage(t.orders_ttl(), NOW_ORDERS).select("key")


@query("hashes", """, m AS (SELECT o.key % 16 AS slot, h.key IS NULL AS dead FROM hash_ops o LEFT JOIN hashes h USING (key, field, seq))
SELECT CAST(slot AS INTEGER) AS slot, count(*) AS total, count(*) FILTER (dead) AS dead FROM m GROUP BY slot HAVING count(*) FILTER (dead) >= 0.9 * count(*)""")
def gc_slots(t):
    slot = (F.col("key") % 16).cast("int").alias("slot")
    return maintenance.slots_to_collect(t.hash_ops().select("*", slot), live_hashes(t), ["key", "field", "seq"], 0.9)


@query("hash_ops", "SELECT seq // 500 AS file, CAST(sum(length(value)) AS BIGINT) AS bytes, row_number() OVER (ORDER BY sum(length(value)) DESC, seq // 500) AS place FROM hash_ops GROUP BY 1 HAVING sum(length(value)) < 2000")
def small_files(t):
    files = t.hash_ops().groupBy(F.floor(F.col("seq") / 500).cast("long").alias("file")).agg(F.sum(F.octet_length("value")).cast("long").alias("bytes"))
    return maintenance.by_size(maintenance.small_files(files, 2000))


@query(None, "SELECT CAST(range AS INTEGER) AS page, true AS even, true AS apart FROM range(4), (SELECT count(*) AS n FROM events) WHERE n > 0")
def page_split(t):
    pages = maintenance.split(t.read("events").select("event_id"), "event_id", 4)
    sizes = pages.groupBy("page").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    w = Window.orderBy("page")  # a row for each page
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return sizes.select("page", share.between(0.24, 0.26).alias("even"), (F.col("lo") > F.lag("hi", 1, -1).over(w)).alias("apart"))


@query("hash_ops", "SELECT key % 16 AS slot, count(*) AS records, CAST(sum(length(field) + length(value)) AS BIGINT) AS bytes FROM hash_ops GROUP BY 1")
def flush_size(t):
    return maintenance.flush_size(t.hash_ops().withColumn("slot", F.col("key") % 16), ["field", "value"])


# -- headers, shards, statistics of a store ----------------------------------------------------------------------------
@query(None, """SELECT c_name AS key, CAST(CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 3 END AS INTEGER) AS data_type, c_custkey AS expire_ms, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size, c_custkey % 2 = 0 AS renewed FROM customer""")
def meta_set(t):
    """Headers of hashes; those of even customers get an element and then begin anew as sets, with another element."""
    c = t.read("customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("expire_ms"))
    even, store = c.where("expire_ms % 2 = 0"), Store(t.spark, scratch(t.spark))
    store.set_meta(c, DataType.HASH, now_ms=0)
    store.set_elements(even.select("key", F.lit("old").alias("subkey")), DataType.HASH, now_ms=0)
    store.set_meta(even, DataType.SET, now_ms=0, fresh=True)
    store.set_elements(even.select("key", F.lit("new").alias("subkey")), DataType.SET, now_ms=0)
    return store.meta().select("key", "data_type", "expire_ms", "size", (F.col("version") > 0).alias("renewed"))


@query("hashes", "SELECT 'h' || key AS key, field, value, true AS dealt FROM hashes")
def rehash_roundtrip(t):
    store = _stored(t, t.spark)
    store.compact()
    dealt = store.rehash(3) == 3
    least = -(-store.base_bytes() // stored.BASE_FILE_BYTES)  # files that its bytes call for
    dealt = dealt and store.rehash() == max(1, least)
    return store.elements(DataType.HASH).select("key", F.col("subkey").alias("field"), "value", F.lit(dealt).alias("dealt"))


@query(None, """SELECT count(*) AS n, CAST(sum(length(CAST(event_id AS VARCHAR)) + length(event_type) + coalesce(length(props), 0)) AS BIGINT) AS bytes,
CAST(count(*) FILTER (props IS NULL) AS BIGINT) AS nulls FROM events""")
def iterator_stats(t):
    rows, seen = keyspace.observed(t.read("events"), "events", ["event_id", "event_type", "props"])
    rows.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([(seen.get["n"], seen.get["bytes"], seen.get["nulls"])], "n long, bytes long, nulls long")


@query(None, "SELECT c_name AS key, 'v' AS value, true AS folded FROM customer WHERE c_custkey % 2 = 0")
def read_amplification_flush(t):
    """Two batches beside no base: an hour later at the latest a flush is due, once."""
    c, store = t.read("customer").select(F.col("c_name").alias("key"), F.lit("v").alias("value"), "c_custkey"), Store(t.spark, scratch(t.spark))
    store.set(c, now_ms=0)
    store.delete(c.where("c_custkey % 2 = 1"), now_ms=0)
    folded = (store.flush(1) or store.flush(3_600_000)) and not store.flush(9_000_000)
    return store.strings().select("key", "value", F.lit(folded).alias("folded"))
