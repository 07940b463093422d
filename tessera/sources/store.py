"""A keyed store on Parquet folders: a log of operations, a compacted base, snapshots.

Layout below the root: `log/batch=<name>/` (appended operations), `base-<id>/` (compacted operations) and `manifest/`
(a JSON file for each commit, named by its number: its base and the log batches that the base covers). A batch is written
aside and renamed, a base is written aside and becomes current by its manifest file alone, so what fails halfway changes
nothing and readers of an older commit aren't disturbed until vacuum(). A read takes the base and the batches it doesn't
cover, whatever their sequence numbers: an operation that comes late or twice counts as it would have in time, for a
base keeps the newest tombstones and barriers. Log files are as many as their bytes call for, dealt and sorted by slot, and
base files dealt by range of slot and key, so reads of few slots or keys touch few files or few pages of them.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import alive, slot_of, valid_element
from ..operators import keyspace, maintenance
from ..plans import merge
from ..schema import OPS, DataType, Kind, NotFound, WrongType

#: What rehash() aims at for a file of the base.
BASE_FILE_BYTES = 256 * 1024 * 1024
#: Stored bytes that a task sorts; in memory they are some twenty times as many.
PIECE_BYTES = 16 * 1024 * 1024


def _barrier() -> Column:
    """Deletes of a whole key name no subkey."""
    return ((F.col("kind") == int(Kind.DELETE)) & F.col("subkey").isNull()) | (F.col("kind") == int(Kind.PREFIX_DELETE))


def scratch(spark: SparkSession) -> str:
    """A new folder for a store below spark.checkpoint.dir, deleted at exit; only a session of one machine may leave that
    unset (then below /tmp)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: a store needs a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
    path = f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"
    _scratch.append(Store(spark, path))
    return path


_scratch: list[Store] = []


@atexit.register
def _clean() -> None:
    for store in _scratch:
        with contextlib.suppress(Exception):  # the application may be gone already
            store._delete(store.root)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files ---------------------------------------------------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _rename(self, source: str, target: str) -> None:
        fs, p = self._fs(source)
        to = self._fs(target)[1]
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(p, to):
            raise FileExistsError(target)

    def _current(self) -> dict:
        """The newest commit: its number, base folder, and the log batches that the base covers."""
        for name in sorted((n for n in self._names("manifest") if re.fullmatch(r"\d+\.json", n)), reverse=True):
            fs, p = self._fs(f"{self.root}/manifest/{name}")
            file = fs.open(p)
            try:
                return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")) | {"commit": int(name[:-5])}
            except ValueError:  # a writer died in the middle of it
                continue
            finally:
                file.close()
        return {"commit": 0, "base": None, "covers": [], "scanned_sec": 0}

    def _commit(self, after: dict, **changes) -> None:
        """A manifest file after the commit that the change was made from; of two writers at once one fails."""
        entry = {k: v for k, v in (after | changes).items() if k != "commit"}
        broken = [int(n[:-5]) for n in self._names("manifest") if re.fullmatch(r"\d+\.json", n) and int(n[:-5]) > after["commit"]]
        if broken and self._current()["commit"] != after["commit"]:
            raise RuntimeError("another writer has committed meanwhile")
        fs, p = self._fs(f"{self.root}/manifest/{max([after['commit'], *broken]) + 1:012}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    def _logged(self) -> list[str]:
        return [n[6:] for n in self._names("log") if n.startswith("batch=")]

    def _batches(self, entry: dict) -> list[str]:
        covered = set(entry["covers"])
        return [n for n in self._logged() if n not in covered]

    def _log(self, names: list[str]) -> DataFrame:
        by_slot = [n for n in names if any(x.startswith("slot=") for x in self._names(f"log/batch={n}"))]  # as batches were once written
        tiers = []
        if by_slot:
            tiers.append(self.spark.read.schema(OPS).option("basePath", f"{self.root}/log").parquet(*(f"{self.root}/log/batch={n}" for n in by_slot)).select(*OPS.names))
        if plain := [n for n in names if n not in by_slot]:
            tiers.append(self.spark.read.schema(OPS).parquet(*(f"{self.root}/log/batch={n}" for n in plain)).select(*OPS.names))
        return merge.merge_tiers(*tiers)

    def _bytes(self, *paths: str) -> int:
        return sum(fs.getContentSummary(p).getLength() for fs, p in map(self._fs, paths) if fs.exists(p))

    def _held_bytes(self, entry: dict) -> int:
        """What ops() reads."""
        return self._bytes(*([entry["base"]] if entry["base"] else []), *(f"{self.root}/log/batch={n}" for n in self._batches(entry)))

    def _deal(self, ops: DataFrame, files: int, size: int, folder: str) -> None:
        """ops, of this many bytes as stored, as so many files, dealt by range of slot and key and sorted. A file that is more
        than a task is to sort is put together from neighbouring pieces, each sorted, in whatever order."""
        pieces, order = -(-size // PIECE_BYTES), ["slot", "key", "subkey"]
        if pieces <= files:
            dealt = ops.repartitionByRange(files, "slot", "key").sortWithinPartitions(*order)
        else:
            runs = ops.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
            at = F.floor(F.spark_partition_id() * files / pieces).cast("int")
            dealt = runs.withColumn("__file", at).repartitionById(files, "__file").drop("__file")
        dealt.write.parquet(folder)

    @contextlib.contextmanager
    def _spread(self, size: int):
        """Meanwhile shuffles have as many partitions as this many stored bytes call for, never fewer than before."""
        name = "spark.sql.shuffle.partitions"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(max(int(before), -(-size // PIECE_BYTES))))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    # -- writes --------------------------------------------------------------------------------------------------------
    def append(self, ops: DataFrame, batch: str | None = None) -> None:
        """Add operations; missing columns are null, a missing slot comes from the key. A batch with a name that was
        appended before (a replay) changes nothing."""
        name = batch or uuid.uuid4().hex
        if self._exists(f"{self.root}/log/batch={name}") or name in self._current()["covers"]:
            return
        for f in OPS.fields:
            if f.name not in ops.columns:
                ops = ops.withColumn(f.name, F.lit(None).cast(f.dataType))
        ops = ops.select(*[F.col(f.name).cast(f.dataType) for f in OPS.fields]).withColumn("slot", F.coalesce("slot", slot_of(F.col("key"))))
        aside = f"{self.root}/log/.{name}-{uuid.uuid4().hex}"
        ops.hint("rebalance", F.col("slot")).sortWithinPartitions("slot").write.parquet(aside)
        self._rename(aside, f"{self.root}/log/batch={name}")

    def write(self, rows: DataFrame, kind: Kind, data_type: DataType = DataType.NONE, now_ms: int | None = None, check: bool = True, fresh: bool = False) -> None:
        """Rows (key, and what the kind uses of subkey, value, score, expire_ms) as operations after all there are, in
        order of their seq if they have one. An element that may not be stored is left out. With check, a living key of
        another type raises WrongType, and a key that has expired at now_ms begins anew; fresh: every key does, whatever
        its type was."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        rows = rows.where(valid_element(F.col("subkey"), F.col("value") if "value" in rows.columns else None)) if "subkey" in rows.columns else rows
        last = self.ops().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
        extra = [c for c in ("slot", "subkey", "value", "score", "expire_ms") if c in rows.columns]
        typed = F.lit(int(data_type)) if data_type != DataType.NONE else F.lit(None).cast("int")
        order = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
        ops = rows.select("key", *extra, F.lit(int(kind)).alias("kind"), typed.alias("data_type"), F.lit(now).alias("op_ms"), (order + F.lit(last + 2)).alias("seq"))
        if check or fresh:
            held = self.heads().join(rows.select("key").distinct(), "key", "left_semi")
            living = alive(F.col("expire_ms"), now)
            anew = fresh
            if not fresh:  # one look for both, as few batches have a key that begins anew
                other = F.lit(False) if data_type == DataType.NONE else F.coalesce(living & (F.col("data_type") != int(data_type)), F.lit(False))
                found = held.agg(F.max(other).alias("wrong"), F.max(~living).alias("anew")).first()
                anew = bool(found["anew"])
                if found["wrong"]:
                    raise WrongType
            if anew:
                dead = held.where(F.lit(fresh) | ~living).select("slot", "key", F.lit(int(Kind.PREFIX_DELETE)).alias("kind"), F.lit(now).alias("op_ms"), F.lit(last + 1).alias("seq"))
                ops = dead.unionByName(ops, allowMissingColumns=True)
        self.append(ops)

    def set(self, rows: DataFrame, data_type: DataType = DataType.STRING, **options) -> None:
        """Strings: key, value, and expire_ms (0: never) if they expire."""
        self.write(rows if "expire_ms" in rows.columns else rows.withColumn("expire_ms", F.lit(0).cast("long")), Kind.SET, data_type, **options)

    def set_meta(self, rows: DataFrame, data_type: DataType, **options) -> None:
        """Headers of collections: key, and expire_ms (0: never) if they expire. The key is there with this type even while
        it has no element; sizes and bounds are counted from the elements. With fresh=True it begins a new version."""
        self.set(rows.select("key", *(["expire_ms"] if "expire_ms" in rows.columns else [])), data_type=data_type, **options)

    def set_elements(self, rows: DataFrame, data_type: DataType, **options) -> None:
        """Elements of hashes (key, subkey, value), sets (key, subkey), sorted sets (key, subkey, score), lists (key,
        subkey as position, value) and bitmaps (key, subkey as offset)."""
        self.write(rows.withColumn("subkey", F.col("subkey").cast("string")), Kind.SET, data_type, **options)

    def delete_elements(self, rows: DataFrame, data_type: DataType, **options) -> None:
        self.write(rows.withColumn("subkey", F.col("subkey").cast("string")), Kind.DELETE, data_type, **options)

    def push(self, rows: DataFrame, left: bool = False, **options) -> None:
        """Values (key, value, seq: their order) at an end of lists."""
        ends = self.elements(DataType.LIST).groupBy("key").agg(F.min(F.col("subkey").cast("long")).alias("first"), F.max(F.col("subkey").cast("long")).alias("last"))
        nth = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
        at = F.coalesce(F.col("first"), F.lit(0)) - nth if left else F.coalesce(F.col("last"), F.lit(-1)) + nth
        placed = rows.join(ends, "key", "left").select("key", "value", "seq", at.cast("string").alias("subkey"))
        self.write(placed, Kind.SET, DataType.LIST, **options)

    def delete(self, keys: DataFrame, **options) -> None:
        """Whole keys of whatever type."""
        self.write(keys.select("key").distinct(), Kind.DELETE, check=False, **options)

    def expire_at(self, rows: DataFrame, now_ms: int) -> DataFrame:
        """rows (key, expire_ms) with result; 1 where the expiry was set (missing and expired keys, and no expiry where
        there is none, give 0)."""
        result = keyspace.expire_at(self.heads(), rows.withColumnRenamed("expire_ms", "new_ms"), now_ms).withColumnRenamed("new_ms", "expire_ms")
        self.write(result.where("result = 1").select("key", "expire_ms"), Kind.EXPIRE_AT, now_ms=now_ms, check=False)
        return result

    # -- reads ---------------------------------------------------------------------------------------------------------
    def ops(self, entry: dict | None = None) -> DataFrame:
        """Base and the log it doesn't cover, as one log."""
        entry = entry or self._current()
        tiers = [self.spark.read.schema(OPS).parquet(entry["base"])] if entry["base"] else []
        tiers += [self._log(names)] if (names := self._batches(entry)) else []
        return merge.merge_tiers(*tiers).select(*OPS.names) if tiers else self.spark.createDataFrame([], OPS)

    def strings(self) -> DataFrame:
        string = F.col("data_type").isNull() | (F.col("data_type") == int(DataType.STRING)) | _barrier()
        return merge.strings(self.ops().where(string & (F.col("subkey").isNull() | _barrier())), ["slot", "key"])

    def elements(self, data_type: DataType) -> DataFrame:
        """Live elements (slot, key, subkey, value, score) of all collections of a type."""
        ops = self.ops().where(((F.col("data_type") == int(data_type)) & F.col("subkey").isNotNull()) | _barrier())
        rows = merge.current(ops, _barrier(), ["slot", "key"])
        return merge.live(rows, ["slot", "key", "subkey"]).select("slot", "key", "subkey", "value", "score", "seq")

    def _of_current(self, which: Column, entry: dict | None = None) -> DataFrame:
        """Operations after the last delete of their key."""
        return merge.current(self.ops(entry), _barrier(), ["slot", "key"]).where(which)

    def heads(self) -> DataFrame:
        """slot, key, data_type, expire_ms (0: never) of every key that isn't deleted."""
        return self._keys().select("slot", "key", "data_type", "expire_ms")

    def meta(self) -> DataFrame:
        """slot, key, data_type, expire_ms, version (that of the incarnation: the seq of the delete before it, or 0), size
        (elements; null for strings), lindex, rindex (first and last position of a list) of every key, in one read."""
        size = F.when(F.col("data_type") != int(DataType.STRING), F.col("size"))
        return self._keys().select("slot", "key", "data_type", "expire_ms", F.coalesce("version", F.lit(0)).alias("version"), size.alias("size"), "lindex", "rindex")

    def _keys(self) -> DataFrame:
        """Every key that isn't deleted: one aggregate of its living rows beside one of its expiries. What isn't asked for is
        pruned."""
        state = merge.current(self.ops(), _barrier(), ["slot", "key"], version="version")
        living = merge.live(state.where(F.col("kind") != int(Kind.EXPIRE_AT)), ["slot", "key", "subkey"])
        at = F.when(F.col("data_type") == int(DataType.LIST), F.col("subkey").cast("long"))
        types = living.groupBy("slot", "key").agg(F.max_by("data_type", "seq").alias("data_type"), F.max("version").alias("version"), F.count("subkey").alias("size"), F.min(at).alias("lindex"), F.max(at).alias("rindex"))
        expiry = state.where("expire_ms IS NOT NULL").groupBy("slot", "key").agg(F.max_by("expire_ms", "seq").alias("expire_ms"))
        return types.join(expiry, ["slot", "key"], "left").withColumn("expire_ms", F.coalesce("expire_ms", F.lit(0).cast("long")))

    def check_type(self, key: str, data_type: DataType) -> None:
        """Raises NotFound or WrongType as point operations do."""
        r = self._of_current(F.col("key") == key).orderBy(F.desc("seq")).select("data_type").first()
        if r is None:
            raise NotFound(key)
        if data_type != DataType.NONE and r["data_type"] not in (None, int(data_type)):
            raise WrongType

    def scan(self, now_ms: int, **options) -> DataFrame:
        return keyspace.scan(self.heads(), now_ms, **options)

    def export(self, slot: int) -> DataFrame:
        """The operations of one slot; of each file only the pages that its statistics don't rule out are read."""
        return self.ops().where(F.col("slot") == slot)

    # -- upkeep --------------------------------------------------------------------------------------------------------
    def compact(self, now_ms: int | None = None, files: int | None = None, without_slot: int | None = None, settled_seq: int = -1) -> None:
        """Write a new base of all operations that one listing finds: for each key its newest barrier, its newest expiry
        and of each element the newest operation, less keys that have expired at now_ms. Tombstones and barriers up to
        settled_seq go too: the caller knows that no operation so old comes any more."""
        entry = self._current()
        covers = self._batches(entry)
        if not covers and not entry["base"]:
            return
        ops = self.ops(entry) if without_slot is None else self.ops(entry).where(F.col("slot") != without_slot)
        rows = merge.current(ops, _barrier(), ["slot", "key"])
        expiry = rows.where(F.col("kind") == int(Kind.EXPIRE_AT)).groupBy("slot", "key").agg(F.max(F.struct("seq", "expire_ms"))["expire_ms"].alias("__e"), F.max("seq").alias("__s"))
        kept = merge.latest(rows.where(F.col("kind") != int(Kind.EXPIRE_AT)), ["slot", "key", "subkey"])
        kept = kept.join(expiry, ["slot", "key"], "left")
        newer = F.col("__s").isNotNull() & (F.col("__s") > F.col("seq"))
        kept = kept.withColumn("expire_ms", F.when(newer, F.col("__e")).otherwise(F.col("expire_ms"))).drop("__e", "__s")
        if now_ms is not None:
            kept = kept.where((F.coalesce("expire_ms", F.lit(0)) == 0) | (F.col("expire_ms") > now_ms))
        newest_expiry = merge.latest(rows.where(F.col("kind") == int(Kind.EXPIRE_AT)), ["slot", "key"])
        barriers = merge.latest(ops.where(_barrier()), ["slot", "key"])
        everything = kept.unionByName(barriers).unionByName(newest_expiry.where(alive(F.col("expire_ms"), now_ms)) if now_ms is not None else newest_expiry)
        gone = F.col("kind").isin(int(Kind.DELETE), int(Kind.PREFIX_DELETE)) & (F.col("seq") <= settled_seq)
        folder = f"{self.root}/base-{uuid.uuid4().hex}"
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        size = self._held_bytes(entry)
        with self._spread(size):
            self._deal(everything.where(~gone).select(*OPS.names), n, size, folder)
        there = self._logged()
        known = [n for n in entry["covers"] if n in there or not re.fullmatch(r"[0-9a-f]{32}", n)]  # a named batch may come again
        self._commit(entry, base=folder, covers=sorted({*known, *covers}))

    def flush_due(self, now_ms: int) -> bool:
        """Whether reads have come to touch too much log beside the base: many records, many deletes (one of a whole
        collection counts ten times) or several batches of which the oldest operation is an hour old."""
        names = self._batches(self._current())
        if not names:
            return False
        deletes = F.count_if(F.col("kind") == int(Kind.DELETE)) + 10 * F.count_if(F.col("kind") == int(Kind.PREFIX_DELETE))
        r = self._log(names).agg(F.count("*").alias("n"), deletes.alias("deletes"), F.min("op_ms").alias("oldest")).first()
        age = 0 if r["oldest"] is None else (now_ms - r["oldest"]) // 1000
        return maintenance.needs_flush(r["n"], r["deletes"], age, len(names))

    def flush(self, now_ms: int) -> bool:
        """Fold the log into a new base if that is due; whether it was."""
        due = self.flush_due(now_ms)
        if due:
            self.compact()
        return due

    def rehash(self, files: int | None = None) -> int:
        """Deal the base anew over so many files, or one for each BASE_FILE_BYTES of it; nothing that a read returns changes.
        How many there are now (0: there is no base)."""
        entry = self._current()
        if not entry["base"]:
            return 0
        size = self.base_bytes()
        n = files or max(1, -(-size // BASE_FILE_BYTES))
        folder = f"{self.root}/base-{uuid.uuid4().hex}"
        base = self.spark.read.schema(OPS).parquet(entry["base"])
        self._deal(base, n, size, folder)
        self._commit(entry, base=folder)
        return n

    def sweep(self, now_ms: int) -> DataFrame:
        """Delete keys whose sweep bucket has passed since the sweep before, whenever that was, and note how far it came; the
        keys that went."""
        entry, upto = self._current(), now_ms // 1000
        due = maintenance.sweep(maintenance.expiry_index(self.heads()), entry.get("scanned_sec", 0), upto)
        due = due.where(~alive(F.col("expire_ms"), now_ms)).select("slot", "key", "expire_ms")
        name = f"sweep-{uuid.uuid4().hex}"
        last = self.ops(entry).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
        self.append(due.withColumns({"kind": F.lit(int(Kind.PREFIX_DELETE)), "seq": F.lit(last + 1), "value": F.col("expire_ms").cast("string")}).drop("expire_ms"), batch=name)
        self._commit(entry, scanned_sec=upto)
        return self._log([name]).select("slot", "key")

    def gc(self, slot: int, now_ms: int, ratio: float = 0.3) -> bool:
        """Compact if at least this share of a slot's operations is dead at now_ms; whether it did."""
        rows = self.export(slot)
        living = merge.live(merge.current(rows, _barrier(), ["slot", "key"]).where(F.col("kind") != int(Kind.EXPIRE_AT)), ["slot", "key", "subkey"])
        heads = self.heads().where((F.col("slot") == slot) & alive(F.col("expire_ms"), now_ms)).select("key")
        total, there = rows.count(), living.join(heads, "key", "left_semi").count()
        if not total or total - there < ratio * total:
            return False
        self.compact(now_ms)
        return True

    def checkpoint(self, target: str) -> None:
        """A copy of everything readable, as a store of its own; fails if the target holds one. It is one only by the
        manifest file that is written last."""
        other = Store(self.spark, target)
        if other._names("manifest") or other._names("log"):
            raise FileExistsError(target)
        folder = f"{other.root}/base-{uuid.uuid4().hex}"
        entry = self._current()
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._deal(self.ops(entry), n, self._held_bytes(entry), folder)
        other._commit({"commit": 0}, base=folder, covers=[], scanned_sec=entry.get("scanned_sec", 0))

    def drop_slot(self, slot: int) -> None:
        """Remove a partition of keys, by one commit."""
        self.compact(without_slot=slot)

    def vacuum(self) -> int:
        """Delete what no reader of the current commit needs: bases that aren't current (how many there were), covered log
        batches, batches left by writers that died, older manifest files."""
        entry, n = self._current(), 0
        for name in self._names(""):
            if re.fullmatch(r"base-\w+", name) and not (entry["base"] or "").endswith(name):
                self._delete(f"{self.root}/{name}")
                n += 1
        for name in self._names("log"):
            if name.removeprefix("batch=") in entry["covers"] or name.startswith("."):
                self._delete(f"{self.root}/log/{name}")
        for name in self._names("manifest"):
            if name < f"{entry['commit']:012}.json":
                self._delete(f"{self.root}/manifest/{name}")
        return n

    def close(self) -> None:
        """Nothing is held open: every read and write stands for itself."""

    def stats(self) -> DataFrame:
        """Records, deletes and value bytes by slot."""
        return maintenance.slot_stats(self.ops())

    def disk_bytes(self) -> int:
        return self._bytes(self.root)

    def base_bytes(self) -> int:
        base = self._current()["base"]
        return self._bytes(base) if base else 0
