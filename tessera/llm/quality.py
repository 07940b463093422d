"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates each rule's accuracy,
and the posterior probability of good quality decides, instead of demanding that a text pass every rule.

DataFrame functions only. One pass over the whole texts yields base counts and votes; the votes' patterns (at most
3 to the number of rules, whatever the input) are counted, and the model is fitted on those counts.

Defined results: a null text counts as empty (no words: base_failed); ties of the posterior (exactly 0.5) are kept;
rows with equal ids are judged each for itself; an empty table gives an empty result; other columns are carried by
keep_good whatever their names (judged leaves out those it names itself).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 5
LEAST_WORDS = 10
BAD, GOOD = -1, 1
#: Rounds of expectation-maximisation at most, and the change of the prior that ends them.
ROUNDS, SETTLED = 25, 1e-5
_BLANK = r"[^\x20\x09-\x0D]"


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur at least twice, from the array of word hashes."""
    size = F.size(hashes)
    at = lambda i: F.get(hashes, i)
    windows = F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = common.let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"]), x["i"])),
                        lambda i: i.isNotNull(),
                    ),
                    lambda i: i,
                )
            ),
        )
        spans = common.let(starts, lambda q: F.transform(q, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - p, F.lit(WINDOW)))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    return F.when(size < WINDOW, 0).otherwise(common.let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))


def measure(docs: DataFrame, out: str = "__q") -> DataFrame:
    """docs with one more column, a struct of the counts that rules look at."""
    t = docs.withColumn("__t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    t = t.withColumn("__w", F.filter(F.split("__t", common.SPACE), lambda w: w != ""))
    t = t.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(_BLANK)))
    hashes = F.transform("__w", lambda w: F.xxhash64(w))
    counts = {
        "n_chars": F.char_length("__t"),
        "n_words": F.size("__w"),
        "word_chars": F.char_length(F.array_join("__w", "")),
        "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_distinct": F.size(F.array_distinct("__w")),
        "n_upper": F.regexp_count("__t", F.lit(r"\p{Lu}")),
        "n_marks": F.regexp_count("__t", F.lit(r"[^\p{L}\p{N}\s]")),
        "n_repeat_words": common.let(hashes, _repeat_words),
    }
    t = t.withColumn(out, F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]))
    return t.drop("__t", "__w", "__l")


def rules(q: str = "__q") -> dict[str, tuple[Column, Column]]:
    """For each rule, when it votes bad and when it votes good; else it abstains. All hold for a text with words."""
    c = lambda k: F.col(f"{q}.{k}")
    words, chars, lines = c("n_words"), c("n_chars"), c("n_lines")
    return {
        "symbols": (c("n_symbols") * 10 >= words, c("n_symbols") * 50 <= words),
        "shouting": (c("n_upper") * 10 >= chars * 3, c("n_upper") * 10 <= chars),
        "marks": (c("n_marks") * 100 >= chars * 10, (c("n_marks") * 100 <= chars * 6) & (c("n_marks") * 200 >= chars)),
        "variety": ((words >= 30) & (c("n_distinct") * 4 <= words), (words < 30) | (c("n_distinct") * 20 >= words * 9)),
        "repeats": (c("n_repeat_words") * 5 > words, c("n_repeat_words") * 20 <= words),
        "twin_lines": ((lines >= 2) & (c("n_dup_lines") * 10 >= lines * 3), c("n_dup_lines") * 20 <= lines),
        "line_length": (words > lines * 300, (words >= lines * 4) & (words <= lines * 150)),
        "word_length": ((c("word_chars") > words * 12) | (c("word_chars") * 2 < words * 5), (c("word_chars") <= words * 9) & (c("word_chars") >= words * 3)),
    }


def votes(q: str = "__q") -> dict[str, Column]:
    return {k: F.when(bad, BAD).when(good, GOOD).otherwise(0).cast("int") for k, (bad, good) in rules(q).items()}


class Model:
    """Prior of good quality, and for each rule the probabilities of its votes under good and under bad."""

    def __init__(self, prior: float, given: dict[str, dict[int, tuple[float, float]]]):
        self.prior, self.given = prior, given

    def posterior(self, vote: dict[str, Column]) -> Column:
        """Probability of good quality given the votes."""
        parts = [F.lit(math.log(self.prior / (1 - self.prior)))]
        for k, v in vote.items():
            odds = {x: math.log(g / b) for x, (g, b) in self.given[k].items()}
            parts.append(F.when(v == BAD, odds[BAD]).when(v == GOOD, odds[GOOD]).otherwise(odds[0]))
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts)))


def _rounds(found: Column, k: int) -> Column:
    """Expectation-maximisation on found, an array of structs v (k votes, each plus one) and n: a struct of the rounds' last
    sums (all, good, by rule and vote the rows `hits` and of them the good ones `hits_good`)."""
    each = F.sequence(F.lit(0), F.lit(3 * k - 1))  # by rule and vote
    by_vote = lambda rows, n, zero: F.transform(each, lambda j: F.aggregate(rows, zero, lambda a, x: a + F.when(F.get(x["v"], F.floor(j / 3).cast("int")) == j % 3, x[n]).otherwise(zero)))
    against = lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + F.when(x == BAD + 1, 1).otherwise(0))
    start = F.transform(found, lambda x: 1 / (1 + F.exp((4 * against(x["v"]) - 2).cast("double"))))

    def likelier(prior: Column, odds: Column) -> Column:
        own = lambda v: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.log(prior / (1 - prior)), lambda a, i: a + F.get(odds, 3 * i + F.get(v, i)))
        return F.transform(found, lambda x: 1 / (1 + F.exp(-own(x["v"]))))

    def turn(s: Column, total: Column, hits: Column) -> Column:
        def done(rows: Column, g: Column, hg: Column) -> Column:
            prior = (g + 1) / (total + 2)
            odds = F.zip_with(hits, hg, lambda a, x: F.log(((x + 1) / (g + 3)) / ((F.greatest(a - x, F.lit(0.0)) + 1) / (total - g + 3))))
            good = common.let(odds, lambda o: likelier(prior, o))
            settled = F.coalesce(F.abs(prior - s["prior"]) < SETTLED, F.lit(False))
            return F.struct(good.alias("good"), prior.alias("prior"), g.alias("g"), hg.alias("hg"), settled.alias("settled"))

        rows = F.zip_with(found, s["good"], lambda x, p: F.struct(x["v"].alias("v"), (x["n"] * p).alias("w")))
        whole = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x["w"])
        return F.when(s["settled"], s).otherwise(common.let(rows, lambda r: common.let(whole(r), lambda g: common.let(by_vote(r, "w", F.lit(0.0)), lambda hg: done(r, g, hg)))))

    def all_(total: Column, hits: Column) -> Column:
        none = F.struct(start.alias("good"), F.lit(None).cast("double").alias("prior"), F.lit(0.0).alias("g"), F.array().cast("array<double>").alias("hg"), F.lit(False).alias("settled"))
        s = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), none, lambda s, _: turn(s, total, hits))
        return common.let(s, lambda s: F.struct(total.alias("all"), s["g"].alias("good"), hits.alias("hits"), s["hg"].alias("hits_good")))

    total = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return common.let(total, lambda t: common.let(by_vote(found, "n", F.lit(0).cast("long")), lambda h: all_(t, h)))


def fit(patterns: DataFrame, names: list[str]) -> Model:
    """Expectation-maximisation on vote patterns (columns names, n). Starts from the number of rules against, which
    also fixes which class is the good one. All rounds are one expression over the gathered patterns: a plan of its own
    for each would cost the driver far more memory and time than the sums do."""
    found = F.struct(F.array(*[(F.col(k) + 1).cast("int") for k in names]).alias("v"), F.col("n").cast("long").alias("n"))
    one = patterns.coalesce(1).agg(F.sort_array(F.collect_list(found)).alias("found"))
    s = one.select(_rounds(F.col("found"), len(names)).alias("s")).first()["s"]
    total, g = s["all"], s["good"]
    given = {}
    for i, k in enumerate(names):
        own = list(zip((BAD, 0, GOOD), s["hits"][3 * i :], s["hits_good"][3 * i :]))
        given[k] = {x: ((hg + 1) / (g + 3), (max(ha - hg, 0.0) + 1) / (total - g + 3)) for x, ha, hg in own}
    return Model((g + 1) / (total + 2), given)


def _judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row (a struct of the columns to carry), __q (counts), __failed (base_failed), __p (quality posterior), __kept."""
    vote = votes()
    rows = docs.select(F.struct(*[common.named(c).alias(c) for c in carry]).alias("row"), F.col("text"))
    measured = measure(rows).select("row", "__q", F.struct(*[v.alias(k) for k, v in vote.items()]).alias("__v"))
    m = common.write_table(measured, "quality")  # read twice: measuring costs more than the disk
    stored = {k: F.col(f"__v.{k}") for k in vote}
    has_words = m.where("__q.n_words > 0")
    patterns = common.write_table(has_words.groupBy(*[v.alias(k) for k, v in stored.items()]).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    model = fit(patterns, list(vote))
    common.drop_tables(patterns)
    q = lambda k: F.col(f"__q.{k}")
    failed = (q("n_words") < LEAST_WORDS) | (q("n_repeat_words") * 100 > q("n_words") * 20)
    m = m.withColumn("__failed", failed).withColumn("__p", model.posterior(stored))
    return m.withColumn("__kept", ~F.col("__failed") & (F.col("__p") >= 0.5))


def judged(docs: DataFrame) -> DataFrame:
    """docs with a struct column __q (counts), base_failed in __failed, quality posterior in __p, verdict in __kept."""
    own = ["__q", "__failed", "__p", "__kept"]
    return _judged(docs, [c for c in docs.columns if c not in own]).select("row.*", *own)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    return _judged(docs, docs.columns).where("__kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(common.read_table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    return j.select(
        "row.doc_id",
        *[F.col(f"__q.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
        F.col("__p").alias("quality_probability"),
    )
