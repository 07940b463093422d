"""Numbers of greedy word pieces by a linear longest-match automaton.

The vocabulary becomes a trie over bytes. Where a walk can't go on, a node's failure link leads to the node of what is
left after the longest-match pieces so far are popped, and the node holds how many those are. A word is then counted in
one pass over its bytes: pieces are never built. Words are counted once for each worker and remembered, in bounded
memory. The pieces of a word are those of a blank followed by the word.

Defined results: a null or blank text has 0 words and pieces; a byte that no piece starts with counts as one piece; rows
with equal ids are counted each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REMEMBER = 1_000_000
ROOT = 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones by themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file, as bytes; special tokens left out."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    of, special = _byte_of_char(), {t["content"] for t in data.get("added_tokens", [])}
    return [bytes(of[c] for c in w) for w in data["model"]["vocab"] if w not in special and all(c in of for c in w)]


class Automaton:
    """Trie with failure links (fail) and numbers of popped pieces (pops), made breadth first."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        final: set[int] = set()
        for p in pieces:
            node = ROOT
            for b in p:
                node = self.next[node].get(b) or self._add(node, b)
            if p:
                final.add(node)
        self.fail: list[int] = [-1] * len(self.next)
        self.pops: list[int] = [0] * len(self.next)
        queue = [(ROOT, b, v) for b, v in self.next[ROOT].items()]
        for parent, b, v in queue:
            if v in final:
                self.fail[v], self.pops[v] = ROOT, 1
            else:
                z, pops = self.fail[parent], self.pops[parent]
                while z >= 0 and b not in self.next[z]:
                    pops += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][b], pops
            queue += [(v, c, w) for c, w in self.next[v].items()]
        self.known: dict[bytes, int] = {}

    def _add(self, node: int, b: int) -> int:
        self.next[node][b] = len(self.next)
        self.next.append({})
        return len(self.next) - 1

    def count(self, text: bytes) -> int:
        """Pieces of text by greedy longest match."""
        nxt, fail, pops, node, n, at = self.next, self.fail, self.pops, ROOT, 0, 0
        while at < len(text):
            to = nxt[node].get(text[at])
            if to is not None:
                node = to
                at += 1
            elif node == ROOT:  # no piece starts with this byte
                n, at = n + 1, at + 1
            elif fail[node] >= 0:
                n, node = n + pops[node], fail[node]
            else:
                return n + self._plain(text, at - self._depth(text, at, node))
        while node != ROOT:
            if fail[node] < 0:
                return n + self._plain(text, at - self._depth(text, at, node))
            n, node = n + pops[node], fail[node]
        return n

    def _depth(self, text: bytes, at: int, node: int) -> int:
        """Bytes before `at` that lead from the root to node."""
        for k in range(at, 0, -1):
            v = ROOT
            for b in text[at - k : at]:
                v = self.next[v].get(b, -1)
                if v < 0:
                    break
            if v == node:
                return k
        return 0

    def _plain(self, text: bytes, at: int) -> int:
        """Longest match without links, for vocabularies that lack single bytes."""
        n = 0
        while at < len(text):
            v, best, k = ROOT, 0, at
            while k < len(text) and (v := self.next[v].get(text[k], -1)) >= 0:
                k += 1
                if self.fail[v] == ROOT and self.pops[v] == 1:
                    best = k
            at, n = best or at + 1, n + 1
        return n

    def count_words(self, words: list[bytes]) -> int:
        if len(self.known) > REMEMBER:
            self.known.clear()
        known, n = self.known, 0
        got = list(map(known.get, words))
        if None in got:
            for i, (w, c) in enumerate(zip(words, got)):
                if c is None:
                    known[w] = got[i] = self.count(b" " + w)
        return sum(got)


_automata: dict[str, Automaton] = {}


def automaton(path: str | None = None) -> Automaton:
    """This process's automaton for a vocabulary file."""
    path = path or default_path()
    if path not in _automata:
        _automata[path] = Automaton(read_vocabulary(path))
    return _automata[path]


def counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_pieces of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in batches:
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column(1).to_pylist()]
            n = np.array([len(w) for w in words], np.int64), np.array([a.count_words(w) for w in words], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n[0]), pa.array(n[1])], names=["doc_id", "n_words", "n_pieces"])

    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_pieces long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))
