"""The star-schema tables read as keyed collections, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.merge import spread
from ..schema import DataType, Kind

TTL_MS, MONTH_MS = 7 * 86_400_000, 30 * 86_400_000


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a time without zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1000).cast("long")


class Tables:
    """Collections over the tables of a folder; columns are pruned at the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def string_ops(self) -> DataFrame:
        """Errors delete a user's string, sign-ups set a new expiry, other events set it; clicks never expire."""
        e = self.read("events")
        kind = F.when(F.col("event_type") == "error", int(Kind.DELETE)).when(F.col("event_type") == "signup", int(Kind.EXPIRE_AT)).otherwise(int(Kind.SET))
        expire = F.when(F.col("event_type").isin("click", "error"), 0).otherwise(millis(F.col("ts")) + TTL_MS)
        return e.select(
            F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), kind.alias("kind"), F.lit(int(DataType.STRING)).alias("data_type"),
            F.when(kind == int(Kind.SET), F.concat_ws(":", "event_type", "event_id")).alias("value"), expire.alias("expire_ms"), (F.col("user_id") % 16).cast("int").alias("slot"),
        )

    def hash_ops(self) -> DataFrame:
        """A user's hash of event types; every seventh event deletes its field instead."""
        e = self.read("events")
        return e.select(
            F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("value"),
            F.when(F.col("event_id") % 7 == 0, int(Kind.DELETE)).otherwise(int(Kind.SET)).alias("kind"),
        )

    def counters(self) -> DataFrame:
        e = self.read("events")
        return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.get_json_object("props", "$.k").try_cast("bigint").alias("incr")).where("incr IS NOT NULL")

    def set_ops(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").cast("string").alias("member"))

    def sets(self) -> DataFrame:
        return spread(self.set_ops(), "key", "member").distinct()

    def lists(self) -> DataFrame:
        from pyspark.sql import Window

        o = self.read("orders").select("o_custkey", "o_orderkey", "o_orderdate")
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return o.select(F.col("o_custkey").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("o_orderkey").cast("string").alias("value"))

    def zsets(self) -> DataFrame:
        """Customers of a nation by balance, in steps of 100: with ties."""
        return self.read("customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("member"), (F.floor(F.col("c_acctbal") / 100) * 100).cast("double").alias("score"))

    def lex_zsets(self) -> DataFrame:
        return self.read("part").select(F.col("p_brand").alias("key"), F.concat_ws("#", "p_name", "p_partkey").alias("member"), F.lit(0.0).alias("score"))

    def bits(self) -> DataFrame:
        """Event ids of each type, spread over many segments."""
        return self.read("events").select(F.col("event_type").alias("key"), (F.col("event_id") * 37).alias("offset"))

    def user_bits(self) -> DataFrame:
        return self.read("events").select(F.col("event_type").alias("key"), F.col("user_id").alias("offset")).distinct()

    def orders_ttl(self) -> DataFrame:
        return self.read("orders").select(F.col("o_orderkey").alias("key"), (millis(F.col("o_orderdate")) + MONTH_MS).alias("expire_ms"))


#: The collections in SQL, by the names that oracle queries use.
SQL = {
    "string_ops": f"""SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 5 ELSE 1 END AS kind,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN event_type || ':' || event_id END AS value,
        CASE WHEN event_type IN ('click', 'error') THEN 0 ELSE (epoch_us(ts) // 1000) + {TTL_MS} END AS expire_ms, CAST(user_id % 16 AS INTEGER) AS slot FROM events""",
    "strings": """SELECT st.key, st.value, st.seq, tt.expire_ms FROM
        (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM kept WHERE kind = 1) WHERE rn = 1) st
        JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM kept) WHERE rn = 1) tt USING (key)""",
    "kept": "SELECT o.* FROM string_ops o JOIN (SELECT key, max(CASE WHEN kind = 0 THEN seq ELSE -1 END) AS del FROM string_ops GROUP BY key) b USING (key) WHERE o.seq > b.del",
    "hash_ops": "SELECT event_id AS seq, user_id AS key, event_type AS field, CAST(event_id AS VARCHAR) AS value, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS kind FROM events",
    "hashes": "SELECT key, field, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY seq DESC) AS rn FROM hash_ops) WHERE rn = 1 AND kind = 1",
    "counters": "SELECT event_id AS seq, user_id AS key, event_type AS field, CAST(json_extract_string(props, '$.k') AS BIGINT) AS incr FROM events",
    "set_ops": "SELECT l_suppkey AS key, CAST(l_partkey AS VARCHAR) AS member FROM lineitem",
    "sets": "SELECT DISTINCT * FROM set_ops",
    "lists": "SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, CAST(o_orderkey AS VARCHAR) AS value, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "zsets": "SELECT c_nationkey AS key, c_name AS member, floor(c_acctbal / 100) * 100 AS score FROM customer",
    "zranked": "SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS revrank, count(*) OVER (PARTITION BY key) AS n FROM zsets",
    "lex_zsets": "SELECT p_brand AS key, p_name || '#' || p_partkey AS member, CAST(0 AS DOUBLE) AS score FROM part",
    "bits": "SELECT event_type AS key, event_id * 37 AS \"offset\" FROM events",
    "user_bits": "SELECT DISTINCT event_type AS key, user_id AS \"offset\" FROM events",
    "orders_ttl": f"SELECT o_orderkey AS key, (epoch_us(o_orderdate) // 1000) + {MONTH_MS} AS expire_ms FROM orders",
}
_NEEDS = {"strings": ["string_ops", "kept"], "kept": ["string_ops"], "hashes": ["hash_ops"], "sets": ["set_ops"], "zranked": ["zsets"]}


def sql(names: str, query: str) -> str:
    """query over the named collections."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + query
