"""Sum-of-squares packing of token sequences.

A document's ids and an end id make its tokens; only documents above the capacity are cut, into full pieces and a last
one. Each piece goes where the sum, over residual gaps, of the squared number of open sequences with that gap becomes
smallest: into an open sequence or a new one. Full pieces are sequences by themselves.

Pieces are dealt by hash to tasks of a bounded number of pieces and each task packs its own,
so a task leaves a few open sequences, however large the input. Within a task pieces come in hashed order, but for the
shortest tenth, which come last from longest to shortest and fill what gaps are left. Only lengths matter here: no ids travel.

Defined results: a null or empty text is one piece that holds the end id; rows with equal ids are packed each for
itself; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
END_ID = 0
#: Share of the pieces, the shortest, that are placed last.
FILLERS = 0.1
#: Pieces that one task packs.
TASK_PIECES = 100_000


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For pieces in this order: sequence (from 0) and offset of each. Lengths are 1 to capacity.

    With N(g) open sequences of gap g, putting s into gap g changes the sum of squares by 2 (N(g - s) - N(g)) + 2, or
    by 1 - 2 N(s) if that fills it (gap 0 doesn't count), and a new sequence changes it by 2 N(capacity - s) + 1.
    The smallest change wins; of equal ones the smallest gap left, a new sequence last.
    """
    n = np.zeros(capacity + 1, np.int64)  # n[0] stays 0
    some = np.full(capacity + 1, 1 << 40, np.int64)  # 0 where n > 0, else too much to win
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            sequence[i] = len(used)
            used.append(s)
            continue
        change = 2 * (n[: capacity - s] - n[s:capacity]) + some[s:capacity]
        change += 2
        change[0] -= 1
        k = int(change.argmin())
        if change[k] <= 2 * n[capacity - s] + 1:
            g = k + s
            b = open_[g].pop()
            n[g] -= 1
            if not n[g]:
                some[g] = 1 << 40
        else:
            b, g = len(used), capacity
            used.append(0)
        sequence[i], offset[i] = b, used[b]
        used[b] += s
        if g > s:
            open_[g - s].append(b)
            n[g - s] += 1
            some[g - s] = 0
    return sequence, offset


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids as little-endian uint32 if asked for."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in tokens.grouped(batches):
            rows: list[tuple] = []
            doc_ids = b.column(0).to_pylist()
            for first, found, cuts in enc.encode_array(b.column(1)):
                for d, x, y in zip(doc_ids[first:], cuts[:-1].tolist(), cuts[1:].tolist()):
                    wide = np.append(found[x:y], end_id).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, len(wide), 4 * capacity)):
                        part = wide[at : at + 4 * capacity]
                        rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if ids else ())))
            cols = list(zip(*rows)) if rows else [()] * (5 + ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), schema)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (pieces) with sequence_id and offset. Reads found twice: give it a written table."""
    total = found.count()
    tasks = max(1, -(-total // TASK_PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        length, crc = t.column("length").to_numpy(), t.column("ids_crc32").to_numpy()
        short = length <= np.quantile(length, FILLERS, method="lower")
        hashed = np.where(short, 0, crc * 2654435761 & 0xFFFFFFFF)
        doc = t.column("doc_id").fill_null(-1).to_numpy()
        order = np.lexsort((t.column("piece").to_numpy(), doc, crc, -length * short, hashed, short))
        t = t.take(pa.array(order))
        sequence, offset = place(length[order], capacity)
        sequence += TaskContext.get().partitionId() << 40
        t = t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from t.to_batches(max_chunksize=20_000)

    common.ship(found.sparkSession)
    dealt = found.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32", "length"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return dealt.mapInArrow(common.lean(run), f"{names}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Every piece of docs with its place; with ids, sorting by sequence_id and offset yields the sequences."""
    return pack(common.write_table(pieces(docs, path, capacity, end_id, ids), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))
