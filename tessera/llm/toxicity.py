"""Toxicity by weak supervision.

Labelled training texts (a bounded sample) yield lexicons: words, word beginnings and word endings that are much
commoner in toxic texts. Each kind is mined from each half of the sample, so a voter's lexicon is blind to half of the
texts it votes on; a small fixed lexicon, patterns (masked words, shouted insults) and the given label vote too. A voter
says toxic, clean or nothing; lexicons and patterns say nothing where they find nothing. A generative label model learns the voters' accuracies by expectation-maximisation from their votes
alone, and their correlations given the class, by which voters that repeat each other share their weight. Its posterior
labels train a linear classifier over the lexicon entries a text holds, which scores every whole text.

Defined results: a null or empty text has the score of a text without entries; a document labelled both ways counts as
toxic; without toxic training rows every score is 0; without mined entries the fixed lexicon is all that texts are scored
by; rows with equal ids are scored each for itself; an empty table gives an empty result; other columns are ignored, and
carried by keep_clean, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FOLDS, HELD_OUT = 5, 0
#: Labelled training documents used at most, half of them of either class (smallest hashes of their ids), and rows of
#: them (smallest hashes of id and text; only tables that repeat ids have more); entries kept of each kind and half, those
#: in most toxic texts; times commoner in toxic texts that an entry must be.
TRAIN_TEXTS, TRAIN_ROWS, ENTRIES, ODDS = 12_000, 48_000, 4000, 20.0
KINDS = {"word": lambda w: w, "begin4": lambda w: w[:4], "begin5": lambda w: w[:5], "begin6": lambda w: w[:6], "begin8": lambda w: w[:8], "begin9": lambda w: w[:9], "end5": lambda w: "$" + w[-5:]}
_LEAST = {"word": 1, "begin4": 5, "begin5": 6, "begin6": 7, "begin8": 9, "begin9": 10, "end5": 6}
SEED_LEXICON = frozenset("idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting dumb trash clown filth imbecile retard bastard jerk".split())
_MASKED = re.compile(r"\b[a-zA-Z]+[*@#$]{2,}[a-zA-Z]+\b")
REMEMBER = 600_000
ROUNDS, L2, EPOCHS = 30, 2e-5, 120


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words, marks around them stripped."""
    return set(map(_bare, set((text or "").split())))


_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”’…"


def _bare(word: str) -> str:
    return word.strip(_EDGE).lower()


def entries(word: str) -> list[tuple[str, str]]:
    """(kind, entry) pairs of a word."""
    return [(k, f(word)) for k, f in KINDS.items() if len(word) >= _LEAST[k]]


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the bounded sample: half of it, where there are so many, toxic."""
    known = labels.where((common.fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pick = lambda c: known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_TEXTS // 2)
    ids = F.broadcast(pick("toxic = 1").union(pick("toxic != 1")))  # TRAIN_TEXTS rows of 12 bytes
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id")


def _mine(sample: DataFrame) -> list[tuple[int, str, str, int, int]]:
    """(half, kind, entry, toxic texts, clean texts) of the entries that are ODDS times commoner in toxic texts, at
    most ENTRIES of each kind and half, from counts over the whole sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for half, text, toxic in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = {e for w in words_of(text) if w for e in entries(w)}
                n.update((half, toxic, *e) for e in found)
        rows = list(zip(*((*k, v) for k, v in n.items()))) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=["half", "toxic", "kind", "entry", "n"])

    halves = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    sizes = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy(halves, "toxic").agg(F.count("*").alias("n")).collect()}
    sums = sample.select(halves, "text", "toxic").mapInArrow(common.lean(run), "half int, toxic int, kind string, entry string, n long")
    sums = sums.groupBy("half", "kind", "entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("c"))
    sums = common.write_table(sums.where("t >= 2"), "entries")
    out = []
    for half in (0, 1):
        nt, nc = sizes.get((half, 1), 0), sizes.get((half, 0), 0)
        least = max(2, nt // 100)
        odds = (F.col("t") / F.lit(max(nt, 1))) / ((F.col("c") + 0.5) / F.lit(nc + 1))
        for kind in KINDS:
            best = sums.where((F.col("half") == half) & (F.col("kind") == kind) & (F.col("t") >= least) & (odds >= ODDS))
            out += [(half, kind, r["entry"], r["t"], r["c"]) for r in best.orderBy(F.desc("t"), "entry").limit(ENTRIES).collect()]
    return out


class Features:
    """Lexicon entries a text holds, as numbers; words are looked up once for each task and remembered."""

    def __init__(self, number: dict[tuple[str, str], int]):
        self.number, self.known = number, {}

    def __getstate__(self):
        return self.number

    def __setstate__(self, number):
        self.__init__(number)

    def of(self, text: str | None) -> list[int]:
        if len(self.known) > REMEMBER:
            self.known = {}
        known, found = self.known, set()
        for w in set((text or "").split()):
            got = known.get(w, 0)
            if got is None:
                continue
            if got == 0:
                bare = _bare(w)
                got = known[w] = tuple(n for e in entries(bare) if (n := self.number.get(e)) is not None) or None
            if got:
                found.update(got)
        return sorted(found)


def votes(text: str | None, found: list[int], label: int, lexicons: list[frozenset[int]]) -> list[int]:
    """1 toxic, -1 clean, 0 nothing: of the label, each mined lexicon, the fixed one and the patterns."""
    held, words = set(found), words_of(text)
    out = [1 if label == 1 else -1, *(1 if held & x else 0 for x in lexicons)]
    out.append(1 if words & SEED_LEXICON else 0)
    out.append(1 if _MASKED.search(text or "") else 0)
    out.append(1 if any(w.isupper() and _bare(w) in SEED_LEXICON for w in (text or "").split()) else 0)
    return out


def label_model(v: np.ndarray, first: int | None = None) -> np.ndarray:
    """Posterior probability of toxic for rows of votes (1, 0, -1). EM starts from the votes of the voter `first`, if one
    is named (it has nothing in common with the others' making and keeps its whole weight), else from all.

    EM over class-conditional vote tables; a voter's evidence is divided by one plus its correlations, given the class,
    with the others, so that copies of one voter count about once.
    """
    n = len(v)
    # at first, votes weigh by how much they repeat each other at all
    sd = v.std(0) + 1e-9
    alike = np.abs((v - v.mean(0)).T @ (v - v.mean(0)) / n / sd[:, None] / sd[None])
    w = 1 / alike.sum(1).clip(1)
    p = 1 / (1 + np.exp(1 - 2.0 * v.shape[1] * (v @ w) / w.sum())) if first is None else 0.5 + 0.4 * v[:, first]
    for _ in range(ROUNDS):
        q = np.stack([1 - p, p])
        prior = (q.sum(1) + 1) / (n + 2)
        given = np.stack([(q @ (v == x) + 0.5) / (q.sum(1)[:, None] + 1.5) for x in (-1, 0, 1)])  # vote, class, voter
        rest = v - (p[:, None] * (q[1] @ v / max(q[1].sum(), 1e-9)) + (1 - p)[:, None] * (q[0] @ v / max(q[0].sum(), 1e-9)))
        sd = np.sqrt((rest**2).mean(0)) + 1e-9
        correlation = np.abs(rest.T @ rest / n / sd[:, None] / sd[None])
        weight = 1 / correlation.sum(1).clip(1)
        if first is not None:
            weight[first] = 1
        odds = np.log(given[:, 1]) - np.log(given[:, 0])  # vote, voter
        z = np.log(prior[1] / prior[0]) + (weight * np.where(v == 1, odds[2], np.where(v == -1, odds[0], odds[1]))).sum(1)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    return p


def train_linear(x: list[list[int]], target: np.ndarray, size: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of entries, by Adagrad over shuffled batches."""
    w, g2, b, gb = np.zeros(size), np.full(size, 1e-6), 0.0, 1e-6
    r = np.random.default_rng(seed)
    lengths = np.array([len(i) for i in x])
    flat, first = np.array([i for row in x for i in row], np.int64), np.concatenate(([0], np.cumsum(lengths)))
    for _ in range(EPOCHS):
        order = r.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            k = np.concatenate([flat[first[i] : first[i + 1]] for i in rows])
            owner = np.repeat(np.arange(len(rows)), lengths[rows])
            z = np.bincount(owner, w[k], len(rows)) + b
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[rows]) / len(rows)
            g = np.bincount(k, d[owner], size) + L2 * w
            g2 += g * g
            w -= 0.3 * g / np.sqrt(g2)
            gb += d.sum() ** 2
            b -= 0.3 * d.sum() / np.sqrt(gb)
    return w, b


class Scorer:
    def __init__(self, features: Features, w: np.ndarray, b: float):
        self.features, self.w, self.b = features, w, b

    def score(self, text: str | None) -> float:
        z = self.b + float(self.w[self.features.of(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """The classifier, or None without toxic training rows."""
    common.ship(docs.sparkSession)
    sample = common.write_table(training(docs, labels), "sample")
    if not sample.where("toxic = 1").limit(1).count():
        return None
    mined = _mine(sample)
    number: dict[tuple[str, str], int] = {}
    lexicon: dict[tuple[int, str], set[int]] = {}
    for half, kind, entry, _, _ in mined:
        n = number.setdefault((kind, entry), len(number))
        lexicon.setdefault((half, kind), set()).add(n)
    for w in sorted(SEED_LEXICON):
        number.setdefault(("word", w), len(number))
    lexicons = [frozenset(x) for _, x in sorted(lexicon.items())]
    features = Features(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [features.of(t) for t in texts]
            given = [votes(t, f, y, lexicons) for t, f, y in zip(texts, found, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(given, pa.list_(pa.int8()))], names=["h", "x", "v"])

    rows = sample.select(F.xxhash64("doc_id", "text").alias("h"), "text", "toxic").mapInArrow(common.lean(run), "h long, x array<int>, v array<tinyint>").orderBy("h").limit(TRAIN_ROWS).toArrow()
    posterior = label_model(np.array(rows.column("v").to_pylist(), float), 0)
    return Scorer(features, *train_linear(rows.column("x").to_pylist(), posterior, len(number)))


def _scored(docs: DataFrame, scorer: Scorer | None, row: Column) -> DataFrame:
    """row (a struct of docs' columns), score of every row. A text that row holds isn't sent twice."""
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    inside = "text" in rows.schema["row"].dataType.names and rows.schema["row"].dataType["text"].dataType.simpleString() == "string"
    rows = rows.drop("text") if inside else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).field("text") if inside else b.column(1)
            s = np.array([scorer.score(t) if scorer else 0.0 for t in texts.to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["row", "score"])

    common.ship(docs.sparkSession)
    return rows.mapInArrow(common.lean(run), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def scores(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    keys = F.struct(F.col("doc_id").cast("long").alias("doc_id"), (common.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return _scored(docs, scorer, keys).select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, with their own columns."""
    return _scored(docs, fit(docs, labels), common.row_of(docs)).where("score < 0.5").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return scores(docs, fit(docs, common.read_table(spark, sf_dir, "labels", "doc_id", "toxic")))
