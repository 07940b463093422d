"""Operators on small collections, store and stream through all tiers, and every query against DuckDB."""

import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import fnv1_32, score_key
from tessera.operators import bitmaps, dk, hashes, keyspace, lists, sets, zsets
from tessera.plans import merge
from tessera.queries import ORACLES, QUERIES
from tessera.schema import DataType, Kind, NotFound, WrongType
from tessera.sources import store as stored
from tessera.sources.store import Store
from tessera.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df, *sorted(df.columns))
    if name in ORACLES:
        r = con.sql(ORACLES[name])
        assert sorted(r.columns) == sorted(df.columns)
        names = ", ".join(f'"{c}"' for c in sorted(r.columns))
        assert got == sorted(con.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall(), key=repr)
    else:
        assert got


def test_bit_positions(spark):
    bits = spark.createDataFrame([("k", i) for i in [*range(110, 121), 125]], "key string, offset long")
    for start, end, one, zero in [(0, -1, 110, 0), (109, 130, 110, 109), (109, 113, 110, 109), (110, 113, 110, -1), (110, 130, 110, 121), (119, 130, 119, 121), (129, 140, -1, -1), (119, -2, 119, 121), (-10, -1, -1, -1), (-1, -10, -1, -1)]:
        assert bitmaps.first_set(bits, start, end).first()["pos"] == one, (start, end)
        assert bitmaps.first_clear(bits, start, end).first()["pos"] == zero, (start, end)
    far = spark.createDataFrame([("k", i) for i in (10, 20, 65536, 131072)], "key string, offset long")
    assert bitmaps.first_set(far, 30, 200_000).first()["pos"] == -1 and bitmaps.first_set(far, 30, 200_000, strict=False).first()["pos"] == 65536
    assert bitmaps.first_clear(far, 10, 200_000, strict=False).first()["pos"] == 11


def test_bit_counts(spark):
    bits = spark.createDataFrame([("k", s * 65536 + o) for s in range(1, 6) for o in (0, 1, 100, 32768, 65535)], "key string, offset long")
    want = [s * 65536 + o for s in range(1, 6) for o in (0, 1, 100, 32768, 65535)]
    for a, b in [(0, -1), (65536, 65536), (65537, 131071), (0, 65535), (200_000, 300_000), (5, 4)]:
        hi = b if b >= 0 else 2**63 - 1
        assert bitmaps.count(bits, a, b).first()["n"] == sum(a <= x <= hi for x in want)


def test_lex_stops_at_first_failure(spark):
    z = spark.createDataFrame([("k", "b", 1.0), ("k", "a", 2.0), ("k", "z", 3.0), ("k", "c", 4.0)], "key string, member string, score double")
    assert rows(zsets.by_lex(z, "b", "d"), "member") == [("b",)]
    assert rows(zsets.by_lex(z, "-", "+"), "member") == [("a",), ("b",), ("c",), ("z",)]


def test_scores(spark):
    z = spark.createDataFrame([("k", f"m{i:03}", 100 + i / 2) for i in range(100)] + [("k", "top", float("inf"))], "key string, member string, score double")
    for lo, hi, lo_open, hi_open, n in [(101, 110, False, False, 19), (110, 115, True, False, 10), (110, 115, False, True, 10), (110, 115, True, True, 9)]:
        assert zsets.count(z, lo, hi, lo_open, hi_open).first()["n"] == n
        assert zsets.remove_by_score(z, lo, hi, lo_open, hi_open)[1].first()["removed"] == n
    assert zsets.by_rank(z, 0, -1).count() == 100 and zsets.by_score(z, 0, float("inf")).count() == 101
    assert rows(zsets.by_rank(z, -2, -1, reverse=True), "member", "rank") == [("m000", 99), ("m001", 98)]


def test_score_keys_sort_as_scores(spark):
    xs = [0.0, -0.0, 1.0, -1.0, 1.5, 3.14, -2.75, 1e300, -1e300, 5e-324, 2.2250738585072014e-308, 0.1, 123456.789, 2.0**52 + 1]
    got = dict(spark.createDataFrame([(repr(x), x) for x in xs], "name string, x double").select("name", score_key(F.col("x"))).collect())

    def key(x):
        b = struct.unpack(">Q", struct.pack(">d", x))[0]
        return f"{b ^ (0xFFFFFFFFFFFFFFFF if b >> 63 else 1 << 63):016x}"

    assert got == {repr(x): key(x) for x in xs}


def test_hashes_as_rows_of_fields(spark):
    df = spark.createDataFrame([("h", "b", "1"), ("h", "a", "2"), ("g", "x", "3")], "key string, field string, value string")
    assert rows(hashes.get_all(df), "key", "fields", "values") == [("g", ["x"], ["3"]), ("h", ["a", "b"], ["2", "1"])]


def test_fnv(spark):
    def fnv(s):
        h = 0x811C9DC5
        for b in s.encode():
            h = h * 16777619 % 2**32 ^ b
        return h

    words = ["", "a", "key", "schlüssel"]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(fnv1_32(F.col("w"))).collect()] == [fnv(w) for w in words]


def test_list_replay_against_python(spark):
    r, want, ops = random.Random(1), {}, []
    for seq in range(400):
        key, op = r.choice("ab"), r.choice(["lpush", "rpush", "rpush", "lpop", "rpop"])
        items, popped = want.setdefault(key, ([], []))
        if op == "lpush":
            items.insert(0, str(seq))
        elif op == "rpush":
            items.append(str(seq))
        else:
            popped.append((items.pop(0) if op == "lpop" else items.pop()) if items else None)
        ops.append((key, seq, op, str(seq)))
    got = {x["key"]: (x["items"], x["popped"]) for x in lists.replay(spark.createDataFrame(ops, "key string, seq long, op string, value string")).collect()}
    assert got == want


def test_clamped_sizes(spark):
    r, ops, want = random.Random(2), [], {"a": 5, "b": 0}
    heads = spark.createDataFrame([("a", 5), ("b", 0)], "key string, size long")
    for seq in range(200):
        k, n = r.choice("ab"), r.randint(-30, 20)
        ops.append((k, seq, n))
        want[k] = max(0, want[k] + n)
    assert dict(dk.change_size(heads, spark.createDataFrame(ops, "key string, seq long, incr long")).collect()) == want


def test_sets_and_effects(spark):
    s = spark.createDataFrame([("k", f"m{i:03}") for i in range(100)], "key string, member string")
    popped, left = sets.pop(s, 10)
    assert rows(popped, "member") == [(f"m{i:03}",) for i in range(10)] and left.count() == 90
    assert sets.random_members(s, 7).distinct().count() == 7 and sets.random_members(s, -150).count() == 150 and sets.random_members(s, 0).count() == 0
    gone = s.select("key", "member")
    assert sets.remove(s, gone)[2].count() == 0 and sets.remove(s, gone, keep_empty=True)[2].first()["size"] == 0
    ops = spark.createDataFrame([(1, "s", "add", "a"), (2, "s", "add", "a"), (3, "s", "rem", "a"), (4, "s", "rem", "a"), (5, "s", "add", "a"), (6, "s", "add", "b")], "seq long, key string, op string, member string")
    assert [x["result"] for x in keyspace.effects(ops, "add", "rem", ["key", "member"]).orderBy("seq").collect()] == [1, 0, 1, 0, 1, 1]


def test_expiry_overlay(spark):
    S, E, D = int(Kind.SET), int(Kind.EXPIRE_AT), int(Kind.DELETE)
    ops = [(1, "a", S, "v1", 100), (2, "a", E, None, 200), (3, "a", E, None, 300), (4, "b", S, "w1", 0), (5, "b", D, None, 0), (6, "b", E, None, 500), (7, "c", S, "z1", 50), (8, "c", D, None, 0), (9, "c", S, "z2", 0), (10, "c", E, None, 900)]
    df = spark.createDataFrame(ops, "seq long, key string, kind int, value string, expire_ms long")
    assert rows(merge.strings(df), "key", "value", "expire_ms") == [("a", "v1", 300), ("c", "z2", 900)]


H = int(DataType.HASH)
COLUMNS = "seq long, key string, kind int, data_type int, subkey string, value string, expire_ms long, slot int"


def parts():
    r, ops = random.Random(3), []
    for seq in range(1, 301):
        k = f"h{r.randint(0, 5)}"
        if r.random() < 0.03:
            ops.append((seq, k, 0, H, None, None, None, int(k[1:]) % 3))
        else:
            ops.append((seq, k, 0 if r.random() < 0.2 else 1, H, f"f{r.randint(0, 9)}", str(seq), None, int(k[1:]) % 3))
    return [ops[:100], ops[100:200], ops[200:]]


def model(ops):
    state: dict = {}
    for _, k, kind, _, f, v, *_ in ops:
        if f is None:
            state.pop(k, None)
        elif kind:
            state.setdefault(k, {})[f] = v
        else:
            state.get(k, {}).pop(f, None)
    return sorted((k, f, v) for k, d in state.items() for f, v in d.items())


def test_store_through_all_tiers(spark, tmp_path):
    a, b, c = parts()
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.elements(DataType.HASH).count() == 0
    seen = []
    for i, part in enumerate((a, b, c)):
        store.append(spark.createDataFrame(part, COLUMNS))
        seen += part
        assert rows(store.elements(DataType.HASH), "key", "subkey", "value") == model(seen)
        if i < 2:
            store.compact()
            assert rows(store.elements(DataType.HASH), "key", "subkey", "value") == model(seen)
    again = Store(spark, f"file://{tmp_path}/s")
    assert rows(again.elements(DataType.HASH), "key", "subkey", "value") == model(seen)
    again.checkpoint(f"file://{tmp_path}/copy")
    assert rows(Store(spark, f"file://{tmp_path}/copy").elements(DataType.HASH), "key", "subkey", "value") == model(seen)
    with pytest.raises(FileExistsError):
        again.checkpoint(f"file://{tmp_path}/copy")
    with pytest.raises(NotFound):
        again.check_type("nope", DataType.HASH)
    with pytest.raises(WrongType):
        again.check_type(model(seen)[0][0], DataType.SET)
    assert again.vacuum() == 1 and again.disk_bytes() > 0 and again.stats().count() == 3
    again.drop_slot(1)
    assert rows(again.elements(DataType.HASH), "key", "subkey", "value") == [x for x in model(seen) if int(x[0][1:]) % 3 != 1]


def op(seq, key, value="v", kind=1, subkey=None, expire=0, slot=0, data_type=1):
    return (seq, key, kind, data_type, subkey, value, expire, slot)


def values(store):
    return sorted((r["key"], r["value"]) for r in store.strings().collect())


def test_store_loses_no_write(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    frame = lambda *ops: spark.createDataFrame(list(ops), COLUMNS)
    store, other = Store(spark, root), Store(spark, root)
    store.append(frame(op(10, "a"), op(11, "b"), op(12, "b", None, 0)))

    class Slow(Store):
        def ops(self, entry=None):
            out = super().ops(entry)
            other.append(frame(op(13, "between")), batch="between")
            return out

    Slow(spark, root).compact()
    assert values(store) == [("a", "v"), ("between", "v")]
    store.append(frame(op(5, "late"), op(6, "b", "older than its delete"), op(7, "a", "old")))
    assert values(store) == [("a", "v"), ("between", "v"), ("late", "v")]
    store.append(frame(op(99, "x")), batch="between")  # a replay of a named batch
    store.compact()
    store.append(frame(op(99, "x")), batch="between")
    assert values(store) == [("a", "v"), ("between", "v"), ("late", "v")]
    assert store.vacuum() == 1 and store._names("log") == []
    store.append(frame(op(99, "x")), batch="between")
    assert values(store) == [("a", "v"), ("between", "v"), ("late", "v")]


def test_failed_commits_change_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([op(1, "a"), op(2, "c", slot=3)], COLUMNS))

    def fail(*_, **__):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", fail)
        with pytest.raises(OSError):
            store.compact()
        with pytest.raises(OSError):
            store.checkpoint(f"file://{tmp_path}/copy")
    assert values(store) == [("a", "v"), ("c", "v")] and values(Store(spark, f"file://{tmp_path}/copy")) == []
    store.checkpoint(f"file://{tmp_path}/copy")
    assert values(Store(spark, f"file://{tmp_path}/copy")) == [("a", "v"), ("c", "v")]
    assert store.vacuum() == 1
    store.drop_slot(3)
    (tmp_path / "s" / "manifest" / "000000000009.json").write_text("{")  # a writer that died while it committed
    store.append(spark.createDataFrame([op(3, "d")], COLUMNS))
    assert values(store) == [("a", "v"), ("d", "v")]
    store.compact()
    assert values(Store(spark, f"file://{tmp_path}/s")) == [("a", "v"), ("d", "v")]
    assert [r["key"] for r in store.export(0).collect()].count("a") == 1 and store.export(3).count() == 0


def test_typed_writes_and_meta(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    store.set(frame([("s", "1", 0), ("t", "2", 500)], "key string, value string, expire_ms long"), now_ms=100)
    store.set_elements(frame([("h", "f", "1"), ("h", "g", "2"), ("h", "", "empty names stay out")], "key string, subkey string, value string"), DataType.HASH, now_ms=100)
    store.set_elements(frame([("z", "m", 1.5), ("z", "n", -2.0)], "key string, subkey string, score double"), DataType.ZSET, now_ms=100)
    store.set_elements(frame([("b", 7), ("b", 70_000)], "key string, subkey long"), DataType.BITMAP, now_ms=100)
    store.push(frame([("l", "x", 1), ("l", "y", 2)], "key string, value string, seq long"), now_ms=100)
    store.push(frame([("l", "w", 1), ("l", "v", 2)], "key string, value string, seq long"), left=True, now_ms=100)
    with pytest.raises(WrongType):
        store.set_elements(frame([("s", "f")], "key string, subkey string"), DataType.SET, now_ms=100)

    def metas():
        return {r["key"]: (r["data_type"], r["expire_ms"], r["size"], r["lindex"], r["rindex"]) for r in store.meta().collect()}

    want = {"s": (1, 0, None, None, None), "t": (1, 500, None, None, None), "h": (3, 0, 2, None, None), "z": (6, 0, 2, None, None), "b": (2, 0, 2, None, None), "l": (4, 0, 4, -2, 1)}
    assert metas() == want
    assert [r["value"] for r in sorted(store.elements(DataType.LIST).collect(), key=lambda r: int(r["subkey"]))] == ["v", "w", "x", "y"]
    results = store.expire_at(frame([("h", 300), ("nope", 300), ("s", 0)], "key string, expire_ms long"), now_ms=200)
    assert {r["key"]: r["result"] for r in results.collect()} == {"h": 1, "nope": 0, "s": 0}
    want["h"] = (3, 300, 2, None, None)
    assert metas() == want
    store.compact()
    assert metas() == want
    # a collection that expired begins anew: its old elements are gone, its version is another
    before = {r["key"]: r["version"] for r in store.meta().collect()}
    store.set_elements(frame([("h", "n", "3")], "key string, subkey string, value string"), DataType.HASH, now_ms=400)
    assert [(r["subkey"], r["value"]) for r in store.elements(DataType.HASH).collect()] == [("n", "3")]
    after = {r["key"]: r["version"] for r in store.meta().collect()}
    assert after["h"] > before["h"] == 0 and metas()["h"] == (3, 0, 1, None, None)
    store.delete(frame([("z",), ("s",)], "key string"))
    store.delete_elements(frame([("b", 7)], "key string, subkey long"), DataType.BITMAP)
    assert set(metas()) == {"t", "h", "b", "l"} and metas()["b"][2] == 1


def test_headers_and_flushes(spark, tmp_path):
    store, again = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    metas = lambda: {r["key"]: (r["data_type"], r["expire_ms"], r["size"]) for r in again.meta().collect()}
    keys = spark.createDataFrame([("h", 500), ("i", 0)], "key string, expire_ms long")
    store.set_meta(keys, DataType.HASH, now_ms=1)
    assert metas() == {"h": (3, 500, 0), "i": (3, 0, 0)} and store.rehash() == 0
    store.set_elements(spark.createDataFrame([("h", "f", "1")], "key string, subkey string, value string"), DataType.HASH, now_ms=1)
    with pytest.raises(WrongType):
        store.set_meta(keys, DataType.SET, now_ms=1)
    assert not store.flush(2) and store.flush(3_600_002) and not store.flush(3_600_002)
    assert store.rehash(2) == 2 and store.vacuum() == 1
    assert metas()["i"] == (3, 0, 0) and metas()["h"][0::2] == (3, 1)
    store.set_meta(keys.where("key = 'h'"), DataType.SET, now_ms=1, fresh=True)
    assert metas()["h"] == (5, 500, 0) and store.elements(DataType.HASH).count() == 0
    many = spark.range(1000).select(F.lit("z").alias("key"), F.col("id").cast("string").alias("subkey"))
    store.delete_elements(many, DataType.ZSET, now_ms=3)
    assert store.flush(4)  # nearly all of it deletes


def test_bases_of_many_pieces(spark, con, tmp_path, monkeypatch):
    """A file is sorted piece by piece, so a task holds no more than a piece; a base of more than one file is dealt as such."""
    monkeypatch.setattr(stored, "PIECE_BYTES", 4096)
    monkeypatch.setattr(stored, "BASE_FILE_BYTES", 20_000)
    store = Store(spark, f"file://{tmp_path}/s")
    store.set(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").alias("value")), now_ms=1)
    store.compact()
    want = rows(store.strings(), "key", "value")
    for files in (2, 3):
        assert store.rehash(files) == files
        base = spark.read.parquet(store._current()["base"])
        dealt = base.groupBy("_metadata.file_name").agg(F.min(F.struct("slot", "key")).alias("lo"), F.max(F.struct("slot", "key")).alias("hi"), F.count("*").alias("n"))
        ranges = sorted((r["lo"], r["hi"], r["n"]) for r in dealt.collect())
        assert len(ranges) == files and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and min(r[2] for r in ranges) > 4000
        for path in tmp_path.glob(f"s/{store._current()['base'].rpartition('/')[2]}/*.parquet"):
            keys = [tuple(r) for r in duckdb.sql(f"SELECT slot, key FROM read_parquet('{path}', file_row_number = true) ORDER BY file_row_number").fetchall()]
            falls = sum(b < a for a, b in zip(keys, keys[1:], strict=False))
            assert falls <= store.base_bytes() // 4096 + 1  # pieces are sorted, whatever their order in the file
        assert rows(store.strings(), "key", "value") == want
    df = QUERIES["rehash_roundtrip"](spark, SF)
    assert rows(df, "dealt", "field", "key", "value") == sorted(con.sql(f"SELECT dealt, field, key, value FROM ({ORACLES['rehash_roundtrip']})").fetchall(), key=repr)


def test_sets_are_spread_by_bytes(spark, con, monkeypatch):
    """Partitions grow with the tables, in the distinct members as in the join."""
    monkeypatch.setattr(merge, "PART_BYTES", 8192, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES["set_ismember"](spark, SF)
        assert df.rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert rows(df, "key", "member", "found") == sorted(con.sql(f"SELECT key, member, found FROM ({ORACLES['set_ismember']})").fetchall(), key=repr)
    assert merge.spread(spark.createDataFrame([("k", "m")], "key string, member string"), "key").count() == 1


def test_batches_are_few_files(spark, tmp_path):
    """Not one for each slot and task; batches that were dealt into a folder for each slot are read beside them."""
    store = Store(spark, f"file://{tmp_path}/s")
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(0).cast("long").alias("expire_ms")).repartition(16)
    store.set_meta(keys, DataType.HASH, now_ms=1)
    store.set_elements(keys.select("key", F.lit("f").alias("subkey")), DataType.HASH, now_ms=1)
    assert len(list(tmp_path.rglob("batch=*/**/*.parquet"))) <= 16
    old = Store(spark, f"file://{tmp_path}/old")
    store._log(store._logged()).write.partitionBy("slot").parquet(f"file://{tmp_path}/old/log/batch=old")
    assert {(r["key"], r["data_type"], r["size"]) for r in old.meta().collect()} == {(f"k{i}", 3, 1) for i in range(4000)}
    old.set_elements(keys.where("key = 'k7'").select("key", F.lit("g").alias("subkey")), DataType.HASH, now_ms=1)
    assert old.meta().agg(F.sum("size")).first()[0] == 4001


def test_sweeps_catch_up(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([op(i, f"k{i}", expire=0 if i == 7 else i * 1_000_000) for i in range(1, 8)], COLUMNS))
    swept = lambda now: sorted(r["key"] for r in store.sweep(now).collect())
    assert swept(1_300_000) == ["k1"] and swept(1_300_001) == []
    assert swept(4_300_000) == ["k2", "k3", "k4"]  # two sweeps were missed
    assert [k for k, _ in values(store)] == ["k5", "k6", "k7"]
    assert not store.gc(0, 4_300_000, ratio=0.9) and store.gc(0, 4_300_000, ratio=0.3)
    assert [k for k, _ in values(store)] == ["k5", "k6", "k7"] and Store(spark, store.root)._current()["scanned_sec"] == 4300


def test_strings_and_current_need_no_window(spark):
    ops = spark.createDataFrame([op(1, "a")], COLUMNS)
    for df in (merge.strings(ops), merge.current(ops, F.col("kind") == 0, ["slot", "key"])):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_scan_pages_cover_all_keys(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    keys = [(i, f"k{i:03}", 1, 1, None, "v", 0 if i % 4 else 50, i % 10) for i in range(1, 101)]
    store.append(spark.createDataFrame(keys, COLUMNS))
    got, after = [], None
    while page := store.scan(100, data_type=DataType.STRING, after=after, count=30).collect():
        got += [r["key"] for r in page]
        after = (page[-1]["slot"], page[-1]["key"])
    assert sorted(got) == sorted(k[1] for k in keys if k[6] != 50)
    store.compact(now_ms=100)
    assert store.strings().count() == 75


def test_stream_into_store(spark, tmp_path):
    a, b, _ = parts()
    src, store = f"file://{tmp_path}/src", Store(spark, f"file://{tmp_path}/s")
    for part in (a, b):
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        ingest.into_store(stream, store, f"file://{tmp_path}/ck", compact_every=2).awaitTermination()
    store.append(spark.createDataFrame(a, COLUMNS))  # a batch that comes twice changes nothing
    assert rows(store.elements(DataType.HASH), "key", "subkey", "value") == model(a + b)


def test_stream_flushes_when_due(spark, tmp_path):
    src, store = f"file://{tmp_path}/src", Store(spark, f"file://{tmp_path}/s")
    spark.createDataFrame([op(i, f"k{i}", None, 0) for i in range(1, 1001)], COLUMNS).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    ingest.into_store(stream, store, f"file://{tmp_path}/ck", flush=True).awaitTermination()
    assert store._current()["base"] and store._batches(store._current()) == [] and store.strings().count() == 0


def test_expiry_stream(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) AS ts, IF(id % 2 = 0, 0, 1704067200000 + id * 1000) AS expire_ms FROM range(60)").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = ingest.expired(stream, "ts").writeStream.format("memory").queryName("expired").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # the last key that expires comes at minute 59, so the watermark stands at 49 and has passed the windows up to 45
    assert spark.sql("SELECT sum(n) FROM expired").first()[0] == sum(i % 2 for i in range(45))


def test_whole_tables_are_asked_for(spark):
    users = {str(r[0]) for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").collect()}
    customers = {str(r[0]) for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    for name in ("exists_batch", "expire_at_result", "key_delete_effect"):
        assert {r["key"] for r in QUERIES[name](spark, SF).collect()} == users | customers, name
    assert {r["offset"] for r in QUERIES["bitmap_getbit"](spark, SF).collect()} >= {int(x) for x in users}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_has_rows(con, name):
    """A comparison of nothing with nothing would prove nothing."""
    assert con.sql(ORACLES[name]).limit(1).fetchall()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
