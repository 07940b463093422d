"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources has a weight at each node. A budget of tokens goes down from the root: children
share their parent's budget by weight, but none gets more than its subtree can give (its tokens times the most epochs).
What one can't take its siblings share first, level by level, so a shortage reaches an ancestor's siblings only when the
whole subtree is used up. A source (leaf) then yields whole epochs while they fit, and of the next epoch, in an order
seeded by document and epoch, the longest prefix of documents whose tokens fit what is left.

A leaf may hold any share of all rows: prefix sums are taken over 4096 slices of the seeded order, and only the slice in
which the budget ends is ordered row by row. All arithmetic is in whole numbers.

Defined results: a null domain, language or source is a node of its own (named ""); documents without words are never
chosen; rows with equal ids are chosen each for itself, and where an epoch ends among rows of equal id and length, those
whose columns come first as JSON; with an empty table the result is empty; other columns are carried (select, mix) or
ignored (the query).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
#: The production mixture: weights by name for each level (others: 1), share of all tokens to choose, epochs, seed.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 2}}
SHARE_PERCENT, EPOCHS, SEED = 50, 4, 42
#: Leaves that may be broadcast (each a few dozen bytes); more are joined by shuffle.
BROADCAST_LEAVES = 100_000
_SLICE_DIGITS = 3
_P = "__mix_"


def domain_of(source: Column) -> Column:
    """The domain of a source: by its number, of four."""
    number = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number == "", F.lit("domain_other")).otherwise(F.concat(F.lit("domain"), (F.try_to_number(number, F.lit("999999999")).cast("long") % 4).cast("string")))


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), common.SPACE), lambda w: w != "")).cast("long")


def _weight(level: str, name: Column, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for k, w in weights.get(level, {}).items():
        out = F.when(name == k, w).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents, name, weight, room, budget of the parent) with given: their part of that budget.

    In order of room by weight the nodes that are filled come first: one is if its room is at most its share of what is
    left to it and those after it.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("room") / F.col("weight"), name)
    n = nodes.withColumns({
        "before": F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    n = n.withColumn("full", F.col("room") * F.col("rest") <= (F.col("budget") - F.col("before")) * F.col("weight"))
    n = n.withColumns({
        "taken": F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(by),
        "open": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(by),
    })
    return n.withColumn("given", F.expr("CASE WHEN full THEN room ELSE ((budget - taken) * weight) div open END")).drop("before", "rest", "full", "taken", "open")


def budgets(supply: DataFrame, total: int, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """domain, lang, source, supply of every leaf, and given: its budget in tokens."""
    given = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = supply.groupBy(*keys).agg((F.sum("supply") * epochs).alias("room")).withColumn("weight", _weight(level, F.col(level), weights))
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(total).cast("long"))
        else:
            nodes = nodes.join(given, keys[:-1])
        filled = _fill(nodes, keys[:-1], level)
        given = filled.select(*keys, F.col("given").alias("budget"))
    return supply.join(given.withColumnRenamed("budget", "given"), list(LEVELS))


def _chosen(docs: DataFrame, weights: dict, share_percent: int, epochs: int, seed: int, domain: Column | None, carry_text: bool) -> DataFrame:
    """row (a struct of docs' columns) and the four columns of select()."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    carried = [c for c in docs.columns if carry_text or c != "text"]
    base = docs.select(
        F.struct(*[common.named(c).alias(c) for c in carried]).alias("row"), (domain_of(F.col("source")) if domain is None else domain).alias(f"{_P}domain"),
        name("lang").alias(f"{_P}lang"), name("source").alias(f"{_P}source"), name("doc_id").alias(f"{_P}id"), n_tokens(F.col("text")).alias(f"{_P}tokens"),
    ).where(F.col(f"{_P}tokens") > 0)
    base = common.write_table(base, "mixing")
    supply = common.write_table(base.groupBy(*[F.col(f"{_P}{k}").alias(k) for k in LEVELS]).agg(F.sum(f"{_P}tokens").alias("supply")), "supply")
    size = supply.agg(F.count("*").alias("n"), F.coalesce(F.sum("supply"), F.lit(0)).alias("t")).first()
    leaves = budgets(supply, size["t"] * share_percent // 100, weights, epochs)
    leaves = common.write_table(
        leaves.select(*[F.col(k).alias(f"{_P}{k}") for k in LEVELS], F.expr("given div supply").cast("int").alias(f"{_P}whole"), F.expr("given % supply").alias(f"{_P}left")), "leaves"
    )
    small = size["n"] <= BROADCAST_LEAVES
    near = F.broadcast if small else (lambda x: x)
    keys = [f"{_P}{k}" for k in LEVELS]
    rows = base.join(near(leaves), keys)

    whole = rows.where(f"{_P}whole > 0").withColumn(f"{_P}epoch", F.explode(F.sequence(F.lit(0), F.col(f"{_P}whole") - 1)))
    part = rows.where(f"{_P}left > 0").withColumn(f"{_P}epoch", F.col(f"{_P}whole"))
    part = part.withColumn(f"{_P}order", F.md5(F.concat_ws(":", f"{_P}id", F.col(f"{_P}epoch").cast("string"), F.lit(str(seed)))))
    part = part.withColumn(f"{_P}slice", F.substring(f"{_P}order", 1, _SLICE_DIGITS))
    sums = part.groupBy(*keys, f"{_P}slice").agg(F.sum(f"{_P}tokens").alias("n"), F.first(f"{_P}left").alias("left"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(f"{_P}slice").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", upto).where("upto > left")
    last = sums.groupBy(*keys).agg(F.min(f"{_P}slice").alias(f"{_P}last"), F.min(F.struct(f"{_P}slice", (F.col("upto") - F.col("n")).alias("b")))["b"].alias(f"{_P}before"))
    part = part.join(near(last), keys, "left")
    inside = part.where(f"{_P}last IS NULL OR {_P}slice < {_P}last")
    w = Window.partitionBy(*keys).orderBy(f"{_P}order", f"{_P}tokens", F.to_json("row")).rowsBetween(Window.unboundedPreceding, 0)
    edge = part.where(f"{_P}slice = {_P}last").withColumn(f"{_P}run", F.sum(f"{_P}tokens").over(w)).where(f"{_P}before + {_P}run <= {_P}left")
    kept = ["row", f"{_P}domain", f"{_P}tokens", f"{_P}epoch", f"{_P}id"]
    return whole.select(kept).union(inside.select(kept)).union(edge.select(kept))


def select(docs: DataFrame, weights: dict = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED, domain: Column | None = None, carry_text: bool = True) -> DataFrame:
    """The chosen rows of docs, once for each epoch that has them, with four more columns: __mix_domain,
    __mix_tokens, __mix_epoch, and __mix_id (the text of the id); columns of docs that have these names are left out, and
    the text unless carry_text."""
    own = [f"{_P}domain", f"{_P}tokens", f"{_P}epoch", f"{_P}id"]
    return _chosen(docs.drop(*own), weights, share_percent, epochs, seed, domain, carry_text).select("row.*", *own)


def mix(docs: DataFrame, weights: dict = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED, domain: Column | None = None) -> DataFrame:
    """The chosen rows of docs with their own columns alone, whatever their names."""
    return _chosen(docs, weights, share_percent, epochs, seed, domain, True).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select(common.read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), carry_text=False)
    return chosen.select(
        "doc_id", F.col(f"{_P}domain").alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col(f"{_P}epoch").alias("epoch"), F.col(f"{_P}tokens").alias("n_tokens")
    )


def oracle(weights: dict = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """The query in SQL, each leaf's prefix taken by one window over all its rows."""
    case = lambda level: "CASE " + "".join(f"WHEN {level} = '{k}' THEN {w} " for k, w in weights.get(level, {}).items()) + "ELSE 1 END"
    parts = [
        r"""d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        CASE WHEN regexp_extract(coalesce(source, ''), '(\d{1,9})$', 1) = '' THEN 'domain_other' ELSE 'domain' || CAST(CAST(regexp_extract(source, '(\d{1,9})$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents)""",
        "s AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM d WHERE n_tokens > 0 GROUP BY ALL)",
    ]
    for i, level in enumerate(LEVELS):
        keys, up = ", ".join(LEVELS[: i + 1]), ", ".join(LEVELS[:i])
        by = f"PARTITION BY {up}" if up else ""
        budget = f"(SELECT CAST(sum(supply) AS BIGINT) * {share_percent} // 100 FROM s)" if not up else "g.given"
        join = f"JOIN g{i - 1} g USING ({up})" if up else ""
        parts += [
            f"a{i} AS (SELECT n.*, {budget} AS budget FROM (SELECT {keys}, CAST(sum(supply) AS BIGINT) * {epochs} AS room, {case(level)} AS weight FROM s GROUP BY {keys}) n {join})",
            f"b{i} AS (SELECT *, coalesce(sum(room) OVER ({by} ORDER BY room / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER ({by} ORDER BY room / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM a{i})",
            f"c{i} AS (SELECT *, room * rest <= (budget - before) * weight AS filled FROM b{i})",
            f"e{i} AS (SELECT *, sum(CASE WHEN filled THEN room ELSE 0 END) OVER ({by}) AS taken, sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}) AS open FROM c{i})",
            f"g{i} AS (SELECT {keys}, CAST(CASE WHEN filled THEN room ELSE ((budget - taken) * weight) // open END AS BIGINT) AS given FROM e{i})",
        ]
    parts += [
        "r AS (SELECT d.*, given // supply AS whole, given % supply AS remain FROM d JOIN s USING (domain, lang, source) JOIN g2 USING (domain, lang, source) WHERE n_tokens > 0)",
        f"p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(id || ':' || CAST(whole AS VARCHAR) || ':{seed}'), n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM r)",
    ]
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens FROM (
  SELECT doc_id, domain, lang, source, unnest(range(0, whole)) AS epoch, n_tokens FROM r WHERE whole > 0
  UNION ALL SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens FROM p WHERE run <= remain)"""
