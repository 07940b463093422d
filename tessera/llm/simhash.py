"""Near-duplicate classes by SimHash fingerprints and anchor-point covering.

Two 64-bit fingerprints within 3 bits agree to 1 bit in one of their 32-bit halves. Of each half, 31 bits are
covered by the codewords of the perfect (31, 26) Hamming code: radius 1, so a fingerprint and a neighbour (1 bit
away) both lie within 1 + 1 = 2 bits of one codeword. Each distinct fingerprint goes to every codeword within 2 bits
(1 or 16 for each half) and is compared there alone. Links found at an anchor are thinned to a spanning forest
before they leave the task; connected components are then found by alternating large and small stars on tables.

Defined results: a null or blank text has the fingerprint zero and is linked like any other; fewer than three words
make one shingle; rows with equal ids each get a row; an empty table gives an empty result; a null doc_id is
fingerprinted, and never names a component unless every member's id is null (then null). Other columns are ignored.

The pipeline's stage (keep_dissimilar) has a definition of its own: texts whose sets of 5-word shingles have Jaccard 0.8 or
more are linked. Such pairs differ in up to a dozen bits, too many for a covering, so fingerprints of these shingles and
their anchors only propose the first pairs; the rest come from prefixes: of its n shingles, rarest first, a text posts the
first n - ceil(0.8 n) + 1, and no pair at 0.8 can do without a common one. Texts that share a posted shingle are first
linked through a hub, the one of them that shares most, so a group of near copies costs a pair for each text and not for
each two; only pairs of texts still in different classes are then listed. Every link is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import common

RADIUS = 3
SEED = 42
#: Groups above this size are searched breadth first instead of by listing their pairs.
SMALL_GROUP = 32
#: Words of a shingle in the pipeline's stage.
STAGE_WORDS = 5
#: Texts are counted by so many buckets of shingle hashes, added up in so many slices.
COUNT_BUCKETS, COUNT_SLICES = 1 << 20, 64
#: Keys (8 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_KEYS = 20_000
#: Rounds in which a group of texts is linked through one of them before pairs still apart are listed.
HUB_ROUNDS = 1

_PAIRS = np.zeros((32, 15), np.int64)  # for each syndrome, the 15 two-bit masks that lead to a codeword
for _s in range(1, 32):
    _PAIRS[_s] = [(1 << (i - 1)) | (1 << ((i ^ _s) - 1)) for i in range(1, 32) if (i ^ _s) > i]


def text_fingerprint(text: str | None, k: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < k:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - k])).tolist()
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), n - k + 1
    stops = (ends[k - 1 :] - 1).tolist()
    for at in range(0, total, 1 << 16):  # bounded memory for very long texts
        h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([text_fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints, the (row, anchor) pairs within 2 bits in either half."""
    rows, keys = [], []
    at = np.arange(len(fp))
    for half in (0, 1):
        part = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0x7FFFFFFF
        syndrome = np.zeros(len(fp), np.int64)
        for i in range(31):
            syndrome ^= ((part >> i) & 1) * (i + 1)
        near = part ^ np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
        rows.append(at)
        keys.append(near | (half << 32))
        off = syndrome > 0
        rows.append(np.repeat(at[off], 15))
        keys.append((part[off][:, None] ^ _PAIRS[syndrome[off]]).ravel() | (half << 32))
    return np.concatenate(rows), np.concatenate(keys)


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the same components as all pairs of fp within the radius; breadth first, quadratic only in
    vector operations, in memory proportional to len(fp). Distinct fingerprints of one anchor bound len(fp)."""
    left, out = fp.copy(), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = np.bitwise_count(left ^ x) <= RADIUS
            if hit.any():
                found = left[hit]
                left = left[~hit]
                out += [(int(x), int(y)) for y in found]
                front += list(found)
    return out


def _anchor_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a group may run over batches."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        a, b = [], []
        for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL_GROUP)]):
            group = fp[starts[sizes == n][:, None] + np.arange(n)]
            for i in range(n - 1):
                d = np.bitwise_count(group[:, i : i + 1] ^ group[:, i + 1 :]) <= RADIUS
                g, j = np.nonzero(d)
                a.append(group[g, i])
                b.append(group[g, i + 1 + j])
        found = [(x, y) for s, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]) for x, y in _forest(fp[s : s + n])]
        if found:
            f = np.array(found, np.uint64)
            a.append(f[:, 0])
            b.append(f[:, 1])
        x = np.concatenate(a) if a else np.zeros(0, np.uint64)
        y = np.concatenate(b) if b else np.zeros(0, np.uint64)
        x, y = x.view(np.int64), y.view(np.int64)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 0].copy())], names=["u", "v"])

    held_k, held_f = [], []
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            held_k.append(k[:cut])
            held_f.append(f[:cut])
            yield links(np.concatenate(held_k), np.concatenate(held_f))
            held_k, held_f = [], []
        held_k.append(k[cut:])
        held_f.append(f[cut:])
    if held_k:
        yield links(np.concatenate(held_k), np.concatenate(held_f))


def links(distinct_fp: DataFrame) -> DataFrame:
    """u, v: links that connect exactly the fingerprints (column fp, distinct) within 3 bits; u > v."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            row, key = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["anchor", "fp"])

    spread = distinct_fp.select("fp").mapInArrow(replicate, "anchor long, fp long")
    n = int(distinct_fp.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = spread.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_anchor_links, "u long, v long")
    return found.distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component) for every node of edges (u, v), by alternating stars.

    Each round is written to the shared folder; the number of edges never grows. Stops when a round changes nothing;
    raises if most_rounds do not suffice (they are logarithmic in the size, so that would be a fault).
    """

    def written(df: DataFrame) -> tuple[DataFrame, dict]:
        """The table and its mark, which the write itself yields."""
        seen = Observation()
        marked = df.select("u", "v").observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        return common.write_table(marked, "edges"), seen.get

    e, last = written(edges)
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u != v")
            .distinct()
        )
        new, now = written(small)
        common.drop_table(e)
        e = new
        if now == last:
            leaves = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            return leaves.union(e.select("v", "v").distinct())
        last = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), component_id of every row of docs."""
    fps = common.write_table(fingerprints(docs), "fp")
    classes = common.write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # a table of its own: the join's two sides are then dealt anew, and a component with very many fingerprints can be split
    firsts = common.write_table(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "firsts")
    label = named.join(firsts, "root").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, k: int = STAGE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's runs of k words, sorted; fewer than k words make one run."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    word = np.fromiter([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64, n)
    h = word[: n - k + 1].copy()
    for i in range(1, k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[i : n - k + 1 + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles have Jaccard 4/5 or more, in whole numbers: 9 |x & y| >= 4 (|x| + |y|)."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def text_key(text: Column) -> Column:
    """Equal for texts of equal words: hash of the text in lower case (A-Z) with single spaces."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.trim(F.regexp_replace(lower, common.SPACE, " ")))


def _buckets(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of h, as a signed long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.add.reduce(np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def _signatures(keyed: DataFrame) -> DataFrame:
    """key, fp (SimHash of the shingles) of every text, and at the end of each task slice, n: in how many of its texts
    the shingles of each bucket are. A task holds the numbers of all buckets and one batch."""
    width = COUNT_BUCKETS // COUNT_SLICES
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(COUNT_BUCKETS, np.uint32), {}
        batch = lambda *cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "fp", "slice", "n"])
        for b in batches:
            keys = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k not in seen:
                    s = shingles(t)
                    seen[k] = _majority(s)
                    total[_buckets(s)] += 1  # a text's shingles that share a bucket count once
                    keys.append(k)
            yield batch(keys, [seen[k] for k in keys], [None] * len(keys), [None] * len(keys))
        yield batch([None] * COUNT_SLICES, [None] * COUNT_SLICES, range(COUNT_SLICES), [x.tobytes() for x in total.reshape(-1, width)])

    return keyed.select("key", "text").mapInArrow(common.lean(run), "key long, fp long, slice int, n binary")


def _shingle_counts(signed: DataFrame) -> np.ndarray:
    """The sums of the tasks' numbers. They only order shingles: a collision costs no pair."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[s] = sums.get(s, 0) + np.frombuffer(n, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "n"])

    out = np.zeros((COUNT_SLICES, COUNT_BUCKETS // COUNT_SLICES), np.int64)
    for s, n in signed.where("slice IS NOT NULL").select("slice", "n").repartition(COUNT_SLICES, "slice").mapInArrow(add, "slice int, n binary").collect():
        out[s] = np.frombuffer(n, np.int64)
    return out.ravel()


def _near_in_length(n1: Column, n2: Column) -> Column:
    return 5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)


def _may(x: Column, y: Column) -> Column:
    """Whether two postings (structs with n, pos) of a shingle may belong to a similar pair that has none before it in common."""
    room = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return _near_in_length(x["n"], y["n"]) & (9 * room >= 4 * (x["n"] + y["n"]))


def postings(keyed: DataFrame, counts: np.ndarray) -> DataFrame:
    """shingle, key, n, pos: the prefix of each text of keyed (key, text), of shingles that a text of near length posts too."""
    spark = keyed.sparkSession
    held = spark.sparkContext.broadcast(counts)  # COUNT_BUCKETS numbers

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k in seen:
                    continue
                seen.add(k)
                s = shingles(t)
                n = len(s)
                first = s[np.lexsort((s, held.value[_buckets(s)]))][: n - (4 * n + 4) // 5 + 1]
                m = len(first)
                found.append((first.view(np.int64), np.full(m, k, np.int64), np.full(m, n, np.int32), np.arange(m, dtype=np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["shingle", "key", "n", "pos"])

    posts = keyed.select("key", "text").mapInArrow(common.lean(spread), "shingle long, key long, n int, pos int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posts = posts.repartition(parts, "shingle").dropDuplicates(["shingle", "key"])  # equal texts in several tasks
    w = Window.partitionBy("shingle").orderBy("n", "key")
    near = lambda c: c.isNotNull() & _near_in_length(F.col("n"), c)
    company = posts.withColumn("near", near(F.lag("n").over(w)) | near(F.lead("n").over(w)))
    return company.where("near").drop("near")


def _proposed(signed: DataFrame) -> DataFrame:
    """a, b (keys): pairs that connect the texts whose fingerprints lie within RADIUS bits, by the anchors."""
    fps = common.write_table(signed.where("key IS NOT NULL").select("key", "fp").distinct(), "stage_fp")
    classes = common.write_table(fps.groupBy("fp").agg(F.min("key").alias("first")), "stage_classes")
    same = fps.join(classes, "fp").where("key != first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    side = lambda c, as_: classes.select(F.col("fp").alias(c), F.col("first").alias(as_))
    return same.union(links(classes).join(side("u", "a"), "u").join(side("v", "b"), "v").select("a", "b"))


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (key, ...) whose key is in keys (key), a written table. Only few keys are broadcast, and counted first."""
    return rows.join(F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys, "key", "left_semi")


def _sets(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """key, s (its shingles, as bytes) for the texts of keyed with these keys, each once."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = [k not in seen and not seen.add(k) for k in b.column(0).to_pylist()]
            yield b.filter(pa.array(new))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["key", "s"])

    few = keyed.select("key", "text").mapInArrow(once, "key long, text string")  # a task sends each text once
    return _with_keys(few, keys).dropDuplicates(["key"]).mapInArrow(common.lean(cut), "key long, s binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, whose sets are similar, as links u, v."""
    keys = common.write_table(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "asked")
    sets = _with_keys(sets, keys)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b, sa, sb = (c.to_pylist() for c in x.columns)
            hit = [i for i in range(len(a)) if similar(np.frombuffer(sa[i], np.uint64), np.frombuffer(sb[i], np.uint64))]
            yield pa.RecordBatch.from_arrays([pa.array([b[i] for i in hit], pa.int64()), pa.array([a[i] for i in hit], pa.int64())], names=["u", "v"])

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(common.lean(check), "u long, v long")


def similar_components(keyed: DataFrame) -> DataFrame:
    """node (key), root of every text of keyed (key, text) that is linked to another by Jaccard 0.8 or more."""
    common.ship(keyed.sparkSession)
    signed = common.write_table(_signatures(keyed), "signatures")
    pairs = common.write_table(_proposed(signed), "proposed")
    posted = common.write_table(postings(keyed, _shingle_counts(signed)), "postings")
    weight = posted.groupBy("key").agg(F.count("*").alias("w"))
    shared = common.write_table(posted.join(weight, "key"), "shared")
    keys = common.write_table(weight.select("key").union(pairs.select("a")).union(pairs.select("b")).distinct(), "keys")
    sets = common.write_table(_sets(keyed, keys), "sets")
    member = F.struct("key", "n", "pos", "root")
    roots = None
    for turn in range(HUB_ROUNDS + 1):
        rooted = shared.withColumn("root", F.col("key")) if roots is None else shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        # a hub for all: first the text that shares most, then any; its hash is the same in every group that it is in
        rank = F.col("w") if turn == 0 else F.xxhash64("key", F.lit(turn))
        apart = rooted.groupBy("shingle").agg(F.max(F.struct(rank.alias("rank"), member.alias("m")))["m"].alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
        mine = rooted.select("shingle", member.alias("x"))
        if turn < HUB_ROUNDS:
            other, apart = apart.select("shingle", F.col("hub").alias("y")), F.lit(True)
        else:
            mine = mine.join(apart.select("shingle"), "shingle", "left_semi")
            other, apart = mine.withColumnRenamed("x", "y"), F.col("x.key") < F.col("y.key")
        met = mine.join(other.withColumnRenamed("shingle", "s"), (F.col("shingle") == F.col("s")) & apart & (F.col("x.root") != F.col("y.root")) & _may(F.col("x"), F.col("y")))
        met = met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
        met = common.write_table((met if turn else met.union(pairs)).distinct(), "met")
        found = _verified(met, sets)
        # what is linked so far is as many links as it has texts: each with its root
        links = found if roots is None else found.union(roots.where("node != root").select("node", "root"))
        roots = common.write_table(components(links), "roots")
        common.drop_tables(met)
    common.drop_tables(signed, pairs, posted, shared, keys, sets)
    return roots


def _first_rows(docs: DataFrame, classes) -> DataFrame:
    """One row of docs for each class: the smallest by id (null last), then by text, then by its other columns as JSON.
    classes gives node, root for the keys of a table (key, text); a key it leaves out is a class of its own."""
    keyed = docs.select(common.row_of(docs), text_key(F.col("text")).alias("key"))
    roots = classes(keyed.select("key", F.col("row.text").cast("string").alias("text")))
    rest = [F.col("row")[c] for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(rest)])) if rest else F.lit("")
    order = Window.partitionBy("class").orderBy(F.col("row.doc_id").asc_nulls_last(), F.col("row.text"), tie)
    rows = keyed.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("root", "key"))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("row.*")


def keep_dissimilar(docs: DataFrame) -> DataFrame:
    """The rows of docs, one for each class of texts linked by Jaccard 0.8 or more of their 5-word shingles."""
    return _first_rows(docs, similar_components)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, one for each class of near-duplicates (the one with the smallest id; of rows with equal ids
    the first by text); rows with a null id stay only if nothing else is in their class."""

    def classes(keyed: DataFrame) -> DataFrame:
        found = near_duplicates(keyed.withColumnRenamed("key", "doc_id"))
        return found.select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")).distinct()

    return _first_rows(docs, classes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
