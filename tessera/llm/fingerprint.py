"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A paragraph is a line; its digest is a 64-bit hash of the line and of how often the text has it, so a text is a set of
digests. A sketch has three groups of cells; each digest falls into one cell of each group and adds to its count, its
xor of digests and its xor of check sums. Two sketches are subtracted cell by cell; cells that then hold one digest give
it up, and taking it out of its other cells may free more (peeling), until nothing is left: the digests that differ.
If something is left, the pair is tried again with a larger sketch: as many times the cells as digests call for, in
shards by digest, and again larger for the shards that fail. Likeness is |A and B| / |A or B| over digests.

DataFrame functions only. Neighbours in descending order of ids come from a window in each range of ids; a copy of the
first row of each range goes to the range before it (of the first range: to the last), so no task sees all rows; the
number of ranges grows with the bytes of text.

Defined results: a null text counts as empty, and an empty text has one empty paragraph; of rows with equal ids the next
one by text follows, null ids come last; one document is its own next; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

GROUPS, GROUP_CELLS = 3, 16
CELLS = GROUPS * GROUP_CELLS
#: Peeling rounds at most; digests of both sides that a shard of a retry should hold; retries before plain set difference.
ROUNDS, SHARD_KEYS, RETRIES = 16, 8, 6
_CHECK_SALT = 77
#: Bytes of text in a range of ids; the driver holds a bound and a row for each range.
RANGE_BYTES = 128 * 1024 * 1024


def digests(text: Column) -> Column:
    """The set of paragraph digests of a text, sorted by paragraph hash; linear but for one sort of numbers."""
    hashes = F.sort_array(F.transform(F.split(text, "\n"), lambda x: F.xxhash64(x)))

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j) != F.get(s, j - 1)))
        return common.let(starts, lambda p: F.transform(p, lambda j, i: F.xxhash64(F.get(s, j), F.coalesce(F.get(p, i + 1), F.size(s)) - j)))

    return common.let(hashes, counted)


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(_CHECK_SALT)).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(key: Column, group: int) -> Column:
    """The cell of a digest in a group, numbered through all groups."""
    return (F.pmod(F.shiftright(key, 21 * group), F.lit(GROUP_CELLS)) + group * GROUP_CELLS).cast("int")


def _make(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def _empty() -> Column:
    return _make(F.lit(0), F.lit(0), F.lit(0))


def _add(cell: Column, entry: Column) -> Column:
    return _make(cell["n"] + entry["n"], cell["k"].bitwiseXOR(entry["k"]), cell["c"].bitwiseXOR(entry["c"]))


def sketch(keys: Column) -> Column:
    """The cells of a set of digests."""

    def group(entries: Column, g: int) -> Column:
        numbers = F.array(*[F.lit(g * GROUP_CELLS + i) for i in range(GROUP_CELLS)])
        placed = F.transform(entries, lambda e: F.struct(_cell(e["k"], g).alias("at"), e.alias("e")))
        return common.let(placed, lambda p: F.transform(numbers, lambda i: F.aggregate(F.filter(p, lambda x: x["at"] == i), _empty(), lambda a, x: _add(a, x["e"]))))

    entries = F.transform(keys, lambda k: _make(F.lit(1), k, _check(k)))
    return common.let(entries, lambda e: F.concat(*[group(e, g) for g in range(GROUPS)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _make(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column) -> Column:
    """Struct of left (cells not emptied), plus and minus (the digests found to be only in the first, the second set)."""
    single = lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["c"])
    start = F.struct(cells.alias("cells"), F.lit(False).alias("done"), *[F.array().cast("array<bigint>").alias(k) for k in ("plus", "minus")])

    def taken(state: Column, out: Column) -> Column:
        def without(x: Column, i: Column) -> Column:
            mine = F.filter(out, lambda e: F.when(i < GROUP_CELLS, _cell(e["k"], 0)).when(i < 2 * GROUP_CELLS, _cell(e["k"], 1)).otherwise(_cell(e["k"], 2)) == i)
            return F.aggregate(mine, x, lambda a, e: _make(a["n"] - e["n"], a["k"].bitwiseXOR(e["k"]), a["c"].bitwiseXOR(e["c"])))

        return F.struct(
            F.transform(state["cells"], without).alias("cells"),
            (F.size(out) == 0).alias("done"),
            F.concat(state["plus"], F.transform(F.filter(out, lambda e: e["n"] == 1), lambda e: e["k"])).alias("plus"),
            F.concat(state["minus"], F.transform(F.filter(out, lambda e: e["n"] == -1), lambda e: e["k"])).alias("minus"),
        )

    def step(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(common.let(F.array_distinct(F.filter(state["cells"], single)), lambda out: taken(state, out)))

    def result(s: Column) -> Column:
        left = F.size(F.filter(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0)))
        return F.struct(left.alias("left"), s["plus"].alias("plus"), s["minus"].alias("minus"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, result)


def text_form(cells: Column) -> Column:
    """A sketch as base64: of each cell the count's last byte, the digests' xor and the check sums' xor."""
    width = lambda x, n: F.substring(F.lpad(F.hex(x), n, "0"), -n, n)
    return F.base64(F.unhex(F.array_join(F.transform(cells, lambda x: F.concat(width(x["n"], 2), width(x["k"], 16), width(x["c"], 8))), "")))


def _above(x: Column, bounds: list[int]) -> Column:
    """How many of the bounds, which ascend, are above x: by bisection in one constant array."""
    held = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        above = F.get(held, mid) > x
        halved = F.struct(F.when(above, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(above, mid).otherwise(s["hi"]).alias("hi"))
        return F.when(s["lo"] < s["hi"], halved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, step, lambda s: F.lit(len(bounds)) - s["lo"])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys of every row, and next_text, next_keys of the row after it in descending order of ids."""
    spark = docs.sparkSession
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    few = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(few, -(-(t.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    bounds = sorted(set(t.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)))
    part = _above(F.col("doc_id"), [int(b) for b in bounds])
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(part)
    t = t.withColumn("part", part)
    tops = [(r["part"], r["top"]) for r in t.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()]  # a row for each range
    ghosts = [(tops[i - 1][0], top) for i, (_, top) in enumerate(tops)]
    after = F.broadcast(spark.createDataFrame(ghosts, "before int, top long"))
    copies = t.join(after, F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "text", F.col("before").alias("part"), F.lit(1).alias("ghost"))
    rows = t.select("doc_id", "text", "part", F.lit(0).alias("ghost")).union(copies).withColumn("keys", digests(F.col("text")))
    if n > few:
        rows = rows.repartition(n, "part")  # as many tasks as ranges, however few partitions the session has
    w = Window.partitionBy("part").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    led = rows.withColumns({"next_text": F.lead("text").over(w), "next_keys": F.lead("keys").over(w)})
    return led.where("ghost = 0").select("doc_id", "text", "keys", "next_text", "next_keys")


def _retry(pairs: DataFrame) -> DataFrame:
    """rid, kind, plus, minus (the differing digests) for pairs (rid, kind, a, b: their digests) by larger sketches. Only
    digests that RETRIES deals of finer and finer shards leave together, which takes equal check sums, are compared as
    they are."""
    spark = pairs.sparkSession
    sized = pairs.withColumn("shards", F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2((F.size("a") + F.size("b")) / F.lit(SHARD_KEYS)))).cast("long")))
    keyed = sized.select(
        "rid", "kind", "shards", F.explode(F.concat(F.transform("a", lambda k: F.struct(k.alias("k"), F.lit(1).alias("s"))), F.transform("b", lambda k: F.struct(k.alias("k"), F.lit(-1).alias("s"))))).alias("e")
    ).select("rid", "kind", "shards", F.col("e.k").alias("k"), F.col("e.s").alias("s"))
    done: list[DataFrame] = []
    schema = "rid long, kind int, plus array<bigint>, minus array<bigint>"
    for attempt in range(RETRIES + 1):
        shard = F.pmod(F.xxhash64("k", F.lit(attempt)), F.col("shards") * (4**attempt))
        split = keyed.groupBy("rid", "kind", "shards", shard.alias("shard")).agg(
            F.collect_list(F.when(F.col("s") == 1, F.col("k"))).alias("a"), F.collect_list(F.when(F.col("s") == -1, F.col("k"))).alias("b")
        )
        if attempt == RETRIES:
            done.append(split.select("rid", "kind", F.array_except("a", "b").alias("plus"), F.array_except("b", "a").alias("minus")))
            break
        tried = common.write_table(split.withColumn("p", peel(subtract(sketch(F.col("a")), sketch(F.col("b"))))), "retry")
        done.append(tried.where("p.left = 0").select("rid", "kind", "p.plus", "p.minus"))
        failed = tried.where("p.left > 0")
        if not failed.limit(1).count():
            break
        signed = lambda c, s: F.transform(c, lambda k: F.struct(k.alias("k"), F.lit(s).alias("s")))
        keyed = failed.select("rid", "kind", "shards", F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("e")).select("rid", "kind", "shards", F.col("e.k").alias("k"), F.col("e.s").alias("s"))
    out = spark.createDataFrame([], schema)
    for d in done:
        out = out.union(d)
    return out.groupBy("rid", "kind").agg(F.flatten(F.collect_list("plus")).alias("plus"), F.flatten(F.collect_list("minus")).alias("minus"))


def differences(pairs: DataFrame) -> DataFrame:
    """For pairs (rid long, a, b: two versions of a text, null as empty): rid, plus and minus, the digests of the paragraphs
    that only a, only b has, recovered from the difference of their sketches."""
    keyed = pairs.select("rid", F.lit(0).alias("kind"), *[digests(F.coalesce(F.col(k), F.lit(""))).alias(k) for k in ("a", "b")])
    tried = common.write_table(keyed.withColumn("p", peel(subtract(sketch(F.col("a")), sketch(F.col("b"))))), "differences")
    again = _retry(tried.where("p.left > 0").select("rid", "kind", "a", "b"))
    return tried.where("p.left = 0").select("rid", "p.plus", "p.minus").union(again.select("rid", "plus", "minus"))


def _likeness(na: Column, plus: Column, minus: Column) -> Column:
    """|A and B| / |A or B|; texts have at least one paragraph each."""
    return (na - plus) / (na + minus)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    d = with_next(docs)
    d = d.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", "next_keys", digests(F.col("edited")).alias("edited_keys"))
    d = d.select("*", sketch(F.col("keys")).alias("s"), sketch(F.col("edited_keys")).alias("es"), sketch(F.col("next_keys")).alias("ns"))
    d = d.select("*", peel(subtract(F.col("s"), F.col("es"))).alias("pe"), peel(subtract(F.col("s"), F.col("ns"))).alias("pn"))
    sizes = lambda p: F.struct(F.col(f"{p}.left"), F.size(f"{p}.plus").alias("plus"), F.size(f"{p}.minus").alias("minus")).alias(p)
    again = (F.col("pe.left") > 0) | (F.col("pn.left") > 0)
    stored = common.write_table(
        d.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", "edited_sha256", text_form(F.col("s")).alias("fingerprint"), text_form(F.col("es")).alias("edited_fingerprint"),
            F.size("keys").alias("na"), sizes("pe"), sizes("pn"), *[F.when(again, F.col(k)).alias(k) for k in ("keys", "edited_keys", "next_keys")],
        ),
        "sketches",
    )
    pairs = stored.where("pe.left > 0").select("rid", F.lit(0).alias("kind"), F.col("keys").alias("a"), F.col("edited_keys").alias("b")).union(
        stored.where("pn.left > 0").select("rid", F.lit(1).alias("kind"), F.col("keys").alias("a"), F.col("next_keys").alias("b"))
    )
    found = _retry(pairs)
    found = found.groupBy("rid").agg(*[F.max(F.when(F.col("kind") == k, F.size(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("plus", "minus")])
    out = stored.drop("keys", "edited_keys", "next_keys").join(found, "rid", "left")

    def near(p: str, kind: int) -> Column:
        return F.when(F.col(f"{p}.left") == 0, _likeness(F.col("na"), F.col(f"{p}.plus"), F.col(f"{p}.minus"))).otherwise(_likeness(F.col("na"), F.col(f"plus{kind}"), F.col(f"minus{kind}")))

    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("pe", 0).alias("near_edited"), near("pn", 1).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))
