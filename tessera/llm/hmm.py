"""Language-model scores by a hidden Markov model, beside a smoothed unigram base.

Texts become words once and are stored as chunks: a bounded number of words with their own vocabulary, so later passes
handle a chunk's distinct words, not its tokens. Word counts are summed over all chunks and joined back to them.

Model. Every token belongs to a class: the end, one of the most frequent words, or else a bucket by the word's last
bytes. Latent states emit classes and follow each other; within a bucket a word has (c + 1) / (N' + V' + 1), with the
bucket's own tokens and distinct words, so a text's probability is the exact one of a model of all its words. Baum-Welch
counts come from every training text, summed across partitions; there a text's chain is cut every SPAN tokens, so that
lanes have equal lengths. Scores use the scaled forward recursion over each whole text, uncut.

Defined results: a null or blank text is only its end; without training texts all counts are 0 and the base is
log10(1 / 1) a token; rows with equal ids are scored (and counted) each for itself; a null id is hashed as the empty
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 7, 2
STATES, FREQUENT, BUCKETS, ROUNDS, SPAN = 8, 2000, 1024, 4, 256
CHUNK_WORDS = 2_000_000
SUFFIX = 3
_CHUNKS = "chunk long, doc_ids array<bigint>, held array<boolean>, lengths array<int>, ids binary, words array<binary>, counts array<bigint>, n_train long"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null: none), A-Z in lower case, as bytes, and where each text's begin and the last one's end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words = lists.flatten().cast(pa.large_binary())
    there = pc.greater(pc.binary_length(words), 0)
    offsets = lists.offsets.to_numpy()
    before = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    return words.filter(there), before[offsets - offsets[0]]


def chunks(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """docs as rows of whole documents with a common vocabulary; counts are of training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        open_: list[tuple] = []  # doc_ids, held, lengths, words of consecutive documents

        def flush() -> pa.RecordBatch:
            nonlocal number, size, open_
            doc_ids, held, lengths, words = zip(*open_)
            coded = pa.concat_arrays(words).dictionary_encode()
            held, lengths = np.concatenate(held), np.concatenate(lengths)
            ids = coded.indices.to_numpy()
            counts = np.bincount(ids[np.repeat(~held, lengths)], minlength=len(coded.dictionary))
            row = [(part << 32) + number], [sum(map(pa.Array.to_pylist, doc_ids), [])], [held], [lengths], [ids.astype("<u4").tobytes()], [coded.dictionary.to_pylist()], [counts], [int((~held).sum())]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64()]
            number, size, open_ = number + 1, 0, []
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds)], names=[x.split(" ")[0] for x in _CHUNKS.split(", ")])

        for b in batches:
            words, stops = words_of(b.column(1))
            held = b.column(2).to_numpy() == held_out
            at = 0
            while at < b.num_rows:
                stop = int(np.searchsorted(stops, stops[at] + CHUNK_WORDS - size, side="right")) - 1
                if stop <= at and not open_:
                    stop = at + 1  # a document above CHUNK_WORDS is a chunk of its own
                if stop > at:
                    open_.append((b.column(0).slice(at, stop - at), held[at:stop], np.diff(stops[at : stop + 1]).astype(np.int32), words.slice(stops[at], stops[stop] - stops[at])))
                    size += int(stops[stop] - stops[at])
                    at = stop
                if at < b.num_rows:
                    yield flush()
        if open_:
            yield flush()

    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), common.fold(F.col("doc_id"), folds).alias("f"))
    return rows.mapInArrow(run, _CHUNKS)


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % BUCKETS


def _bucket(word: str) -> str:
    """bucket() in SQL."""
    return f"CAST(crc32(CASE WHEN length({word}) <= {SUFFIX} THEN {word} ELSE substring({word}, length({word}) - {SUFFIX - 1}, {SUFFIX}) END) % {BUCKETS} AS INT)"


def _classes(words: list[bytes], frequent: dict[bytes, int]) -> np.ndarray:
    """Class of each word; the end is class 0."""
    return np.fromiter((frequent.get(w) or 1 + FREQUENT + bucket(w) for w in words), np.int64, len(words))


def start_model(freq: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First state, transitions and emissions (states x classes): frequencies, shaken so that states differ."""
    rng = np.random.default_rng(seed)
    b = (freq + 0.5) * np.exp(rng.normal(0, 0.7, (STATES, len(freq))))
    a = 0.1 + rng.random((STATES, STATES)) * 0.1 + np.eye(STATES)
    return np.full(STATES, 1 / STATES), a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True)


def expect(obs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (first states, transitions, emissions) and log likelihood of spans of obs.

    Spans lie at starts with lengths above 0; `first` marks those that open a text (the others leave the first-state
    counts alone). All spans run in lockstep, each step normalised.
    """
    pi, a, b = model
    bt = np.ascontiguousarray(b.T)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, first = starts[order], lengths[order], first[order]
    open_ = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")  # spans longer than t
    steps = [(t, int(m)) for t, m in enumerate(open_)]
    alphas, scales, loglik = [], [], 0.0
    for t, m in steps:
        x = (pi if t == 0 else alphas[-1][:m] @ a) * bt[obs[starts[:m] + t]]
        c = x.sum(1, keepdims=True)
        x /= c
        alphas.append(x)
        scales.append(c)
        loglik += float(np.log(c).sum())
    trans, emit = np.zeros_like(a), np.zeros_like(b)
    beta = np.ones((0, len(pi)))
    for t, m in reversed(steps):
        full = np.ones((m, len(pi)))
        if t + 1 < len(steps) and len(beta):
            n = len(beta)
            nxt = bt[obs[starts[:n] + t + 1]] * beta / scales[t + 1]
            trans += alphas[t][:n].T @ nxt
            full[:n] = nxt @ a.T
        gamma = alphas[t] * full
        o = obs[starts[:m] + t]
        for k in range(len(pi)):
            emit[k] += np.bincount(o, gamma[:, k], b.shape[1])
        if t == 0:
            opening = gamma[first].sum(0)
        beta = full
    return opening, trans * a, emit, loglik


def forward(obs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: tuple) -> np.ndarray:
    """Natural log likelihood of each whole sequence, in lockstep over all."""
    pi, a, b = model
    bt = np.ascontiguousarray(b.T)
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    out = np.zeros(len(s))
    x = np.zeros((0, 0))
    open_ = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for t, m in enumerate(open_.tolist()):
        x = (pi if t == 0 else x[:m] @ a) * bt[obs[s[:m] + t]]
        c = x.sum(1)
        x /= c[:, None]
        out[:m] += np.log(c)
    result = np.zeros(len(s))
    result[order] = out
    return result


def _with_ends(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class sequences with class 0 after each text: all of them, starts, lengths."""
    lengths = np.asarray(lengths, np.int64)
    stops = np.cumsum(lengths + 1)
    obs = np.zeros(int(stops[-1]) if len(stops) else 0, np.int64)
    inner = np.ones(len(obs), bool)
    inner[stops - 1] = False
    obs[inner] = classes
    return obs, stops - lengths - 1, lengths + 1


def train(stored: DataFrame, frequent: dict[bytes, int], freq: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounds of Baum-Welch over all training documents of the chunks. A task sends one row of counts for each state
    (bounded by states and classes), summed on the executors; the driver gets the sums."""
    n_classes = 1 + FREQUENT + BUCKETS
    model = start_model(freq)

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((STATES, n_classes + STATES + 1))
            for b in batches:
                for i in range(b.num_rows):  # one chunk at a time in memory
                    held, lengths, ids, words = (b.column(k)[i].as_py() for k in range(4))
                    classes = _classes(words, frequent)[np.frombuffer(ids, "<u4")]
                    obs, starts, n = _with_ends(classes, np.array(lengths))
                    keep = ~np.array(held, bool)
                    starts, n = starts[keep], n[keep]
                    spans = -(-n // SPAN)
                    nth = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
                    at = np.repeat(starts, spans) + nth * SPAN
                    long = np.minimum(SPAN, np.repeat(n, spans) - nth * SPAN)
                    for k in range(0, len(at), 2048):
                        opening, trans, emit, _ = expect(obs, at[k : k + 2048], long[k : k + 2048], nth[k : k + 2048] == 0, model)
                        total[:, :n_classes] += emit
                        total[:, n_classes:-1] += trans
                        total[:, -1] += opening
            yield pa.RecordBatch.from_arrays([pa.array(range(STATES), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["state", "counts"])

        sums = (
            stored.select("held", "lengths", "ids", "words")
            .mapInArrow(run, "state int, counts array<double>")
            .select("state", F.posexplode("counts"))
            .groupBy("state", "pos")
            .agg(F.sum("col").alias("n"))
            .collect()
        )
        total = np.zeros((STATES, n_classes + STATES + 1))
        for r in sums:
            total[r["state"], r["pos"]] = r["n"]
        pi, a, b = total[:, -1] + 0.1, total[:, n_classes:-1] + 0.1, total[:, :n_classes] + 0.01
        model = pi / pi.sum(), a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True)
    return model


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    stored = common.write_table(chunks(docs), "chunks")
    listed = stored.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("chunk", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    vocabulary = common.write_table(listed.groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"), "vocabulary")
    n_train = stored.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n")).first()["n"]
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_words = sums["n"] + n_train, sums["v"] + (n_train > 0)

    top = vocabulary.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()  # bounded by FREQUENT
    frequent = {bytes(r["word"]): 1 + i for i, r in enumerate(top)}
    named = F.broadcast(spark.createDataFrame([(bytearray(r["word"]), 1 + i, r["c"]) for i, r in enumerate(top)], "word binary, class int, c long"))  # FREQUENT rows
    sized = vocabulary.join(named, "word", "left_anti").groupBy(F.expr(_bucket("word")).alias("bucket")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    freq, room = np.zeros(1 + FREQUENT + BUCKETS), np.ones(1 + FREQUENT + BUCKETS)
    freq[0] = n_train
    for i, r in enumerate(top):
        freq[1 + i] = r["c"]
    for r in sized:
        freq[1 + FREQUENT + r["bucket"]] = r["n"]
        room[1 + FREQUENT + r["bucket"]] = r["n"] + r["v"] + 1
    model = train(stored, frequent, freq)

    # a frequent word is in every chunk: those are looked up in place, only rare words are dealt by word
    words = listed.select(F.col("chunk").alias("of_chunk"), "at", "word")
    common_words = words.join(named, "word").select("of_chunk", "at", "c", "class")
    rare = words.join(named, "word", "left_anti").join(vocabulary, "word", "left")
    looked = common_words.union(rare.select("of_chunk", "at", F.coalesce("c", F.lit(0)).alias("c"), F.expr(f"{1 + FREQUENT} + {_bucket('word')}").alias("class")))

    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        c, cls = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        at = found["at"].to_numpy()
        c[at], cls[at] = found["c"].to_numpy(), found["class"].to_numpy()
        base_word = np.log10(c + 1.0) - np.log10(n_all + n_words + 1)
        in_class = np.where(cls > FREQUENT, np.log10(c + 1.0) - np.log10(room[cls]), 0.0)
        for _, row in texts.iterrows():
            ids = np.frombuffer(row["ids"], "<u4").astype(np.int64)
            lengths = np.asarray(row["lengths"], np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            add = lambda v: np.bincount(owner, v[ids], len(lengths))
            obs, starts, n = _with_ends(cls[ids], lengths)
            end = np.log10(n_train + 1.0) - np.log10(n_all + n_words + 1)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(row["doc_ids"], "Int64"),
                        "held_out": np.asarray(row["held"], bool),
                        "n_tokens": n,
                        "n_known": add((c > 0).astype(float)).astype(np.int64) + (n_train > 0),
                        "train_tokens": n_all,
                        "base_score": add(base_word) + end,
                        "score": forward(obs, starts, n, model) / np.log(10) + add(in_class),
                    }
                )
            )
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    texts = stored.select("chunk", "doc_ids", "held", "lengths", "ids")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(looked.groupBy("of_chunk")).applyInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))
