"""Language identification by a byte-level convolutional network, trained here in numpy.

Bytes of a window of fixed length are embedded, convolved with filters of several widths, rectified, max-pooled over the
window and classified by softmax. Training takes a bounded sample of labelled texts (TRAIN_TEXTS, smallest hashes of
their ids; WINDOWS_EACH windows spread over each whole text); prediction reads every window of every whole text and
averages log probabilities by the bytes that windows hold. A byte's share of a filter depends only on the byte and its
place in the filter, so convolution sums rows of a 256-row table.

Defined results: a null text or one without a letter is `und` with score 0; without training texts all are `und`; rows
with equal ids are predicted each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 5, 0
WINDOW = 192
#: Labelled texts and windows of each that training takes; windows in all (smallest hashes; only tables that repeat ids
#: have more).
TRAIN_TEXTS, WINDOWS_EACH, TRAIN_WINDOWS = 6000, 4, 96_000
EMBED, FILTERS, WIDTHS = 8, 12, (2, 3, 4)
BATCHES, BATCH, RATE = 900, 64, 0.004
UNKNOWN = "und"
#: Bytes convolved at once: the sums then stay in a core's cache.
_AT_ONCE = 24


def windows(text: str, most: int | None = None) -> np.ndarray:
    """All windows of a text (the last one filled with zeros), or at most so many, evenly spread."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // WINDOW))
    w = np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)
    return w if most is None or n <= most else w[np.linspace(0, n - 1, most).astype(int)]


class Network:
    """Embedding (256 x EMBED), a filter bank for each width, and the softmax layer."""

    def __init__(self, classes: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (256, EMBED)), "w": r.normal(0, 0.05, (FILTERS * len(WIDTHS), classes)), "c": np.zeros(classes)}
        for k in WIDTHS:
            self.p[f"f{k}"] = r.normal(0, 1 / np.sqrt(k * EMBED), (k, EMBED, FILTERS))
            self.p[f"b{k}"] = np.zeros(FILTERS)

    def _bank(self, x: np.ndarray, k: int) -> np.ndarray:
        n = x.shape[1] - k + 1
        return sum(x[:, j : j + n] @ self.p[f"f{k}"][j] for j in range(k)) + self.p[f"b{k}"]

    def gradients(self, w: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        x = self.p["e"][w]
        peaks, tops = [], []
        for k in WIDTHS:
            h = self._bank(x, k)
            at = h.argmax(1)
            peaks.append(at)
            tops.append(np.take_along_axis(h, at[:, None, :], 1)[:, 0])
        top = np.concatenate(tops, 1)
        pooled = np.maximum(top, 0)
        z = pooled @ self.p["w"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d *= (weight / len(y))[:, None]
        g = {"w": pooled.T @ d, "c": d.sum(0), "e": np.zeros_like(self.p["e"])}
        up = (d @ self.p["w"].T) * (top > 0)
        rows = np.arange(len(w))[:, None]
        for i, k in enumerate(WIDTHS):
            u = up[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{k}"] = u.sum(0)
            gf = np.zeros_like(self.p[f"f{k}"])
            for j in range(k):
                b = w[rows, peaks[i] + j]  # the byte under this place of the filter where its maximum was
                gf[j] = np.einsum("nf,nfe->ef", u, self.p["e"][b])
                np.add.at(g["e"], b, u[:, :, None] * self.p[f"f{k}"][j].T[None])
            g[f"f{k}"] = gf
        return g

    def train(self, w: np.ndarray, y: np.ndarray, seed: int = 2) -> None:
        """Adam over random batches; classes weigh the same however many windows they have."""
        r = np.random.default_rng(seed)
        weight = len(y) / (np.bincount(y, minlength=len(self.p["c"])) * len(set(y.tolist())) + 1e-9)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, BATCHES + 1):
            at = r.integers(0, len(y), BATCH)
            rate = RATE * (1 - t / (BATCHES + 1))
            for k, g in self.gradients(w[at], y[at], weight[y[at]]).items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)

    def tables(self) -> list[tuple[int, list[np.ndarray], np.ndarray]]:
        """For each width, what each byte adds at each place of its filters (256 x FILTERS each), and the biases."""
        return [(k, [(self.p["e"] @ self.p[f"f{k}"][j]).astype(np.float32) for j in range(k)], self.p[f"b{k}"].astype(np.float32)) for k in WIDTHS]

    def log_probabilities(self, w: np.ndarray) -> np.ndarray:
        """For windows, the log probability of each class."""
        out, tables = np.empty((len(w), len(self.p["c"]))), self.tables()
        for at in range(0, len(w), _AT_ONCE):
            part = w[at : at + _AT_ONCE]
            pooled = []
            for k, places, bias in tables:
                n = WINDOW - k + 1
                h = places[0].take(part[:, :n], axis=0)
                for j in range(1, k):
                    h += places[j].take(part[:, j : j + n], axis=0)
                pooled.append(np.maximum(h.max(1) + bias, 0))
            z = np.concatenate(pooled, 1) @ self.p["w"] + self.p["c"]
            z -= z.max(1, keepdims=True)
            out[at : at + _AT_ONCE] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def sample(docs: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Windows and languages of the bounded training sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(x.tobytes(), lang) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in windows(t, WINDOWS_EACH)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["w", "lang"])

    known = docs.where((common.fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = known.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_TEXTS)
    few = known.join(F.broadcast(ids), "doc_id", "left_semi")  # TRAIN_TEXTS ids of 8 bytes
    rows = few.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "w binary, lang string").orderBy(F.xxhash64("w"), "w", "lang").limit(TRAIN_WINDOWS).toArrow()
    w = np.frombuffer(b"".join(rows.column("w").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return w, rows.column("lang").to_pylist()


def fit(docs: DataFrame) -> tuple[Network | None, list[str]]:
    common.ship(docs.sparkSession)
    w, langs = sample(docs)
    names = sorted(set(langs))
    if not names:
        return None, names
    net = Network(len(names))
    if len(names) > 1:
        net.train(w, np.searchsorted(names, langs))
    return net, names


def predict(docs: DataFrame, net: Network | None, names: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if net is not None and t and any(c.isalpha() for c in t)]
            for at in range(0, len(some), 256):
                part = some[at : at + 256]
                w = [windows(texts[i]) for i in part]
                logs = net.log_probabilities(np.concatenate(w))
                weight = np.concatenate([np.append(np.full(len(x) - 1, WINDOW), np.count_nonzero(x[-1])) for x in w])
                first = np.cumsum([0] + [len(x) for x in w[:-1]])
                mean = np.add.reduceat(logs * weight[:, None], first) / np.maximum(np.add.reduceat(weight, first), 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, q in zip(part, p):
                    lang[i], score[i] = names[int(q.argmax())], q.max()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (common.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, *fit(docs))
