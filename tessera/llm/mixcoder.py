"""Token ids as binary: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Model. Each block of ids starts from nothing. An id gets its probability from three predictions: order 2 (what
followed the last two ids before), order 1 (what followed the last id) and order 0 (how often each id came). Orders 1
and 2 each name one id, with a confidence; how much of the probability each gets is learned, block by block, from how
often that order was right at that confidence (order 1 also by order 2's). Order 0 is the sorted history of the block
at the last of a growing series of marks, so an id's interval is its run in that history, with a share for ids not seen
yet, which a fixed prior by rank codes. The mixture drives a 64-bit range coder that emits 32-bit words with carries.

Speed. All blocks of a flush are coded in lockstep by numpy, a step for each position, blocks as lanes; the coder and
the decoder share the model's code and so stay in step. A block carries the crc32 of its ids, which reading verifies.

Files. Parquet with a row for each segment: whole consecutive documents, their ids and numbers of tokens, the segment's
first token within its partition, and the coded blocks. Partitions are ranges of doc_id in ascending order.

Defined results: a null or empty text has only the end id; rows with equal ids follow each other by text, null ids come
first; an empty table gives no segments and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 2048
END_ID = 2
#: Tokens of a segment, and segments coded in lockstep, at most (a longer document is a segment of its own).
SEGMENT_TOKENS, FLUSH_TOKENS = 1 << 20, 1 << 23
_MAGIC = b"TMX1"
_BITS = 22
_T = 1 << _BITS
_TOP = _T - (1 << 15)  # the most that orders 1 and 2 may take together: order 0 keeps room for a block's history
_ID_BITS = 24
_ID = (1 << _ID_BITS) - 1
_T1, _T2 = 9, 11  # log2 of the slots of each block's tables
_MARKS = [16, 32, 64, 128, 256, 384, 512, 768, 1024, 1536, 2048, 3072]
_MIX1, _MIX2, _MIX3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SHIFT1, _SHIFT2 = np.uint32(32 - _T1), np.uint32(32 - _T2)
_LOW32, _ONE, _LAST = np.uint64(1 << 32), np.uint64(1), np.uint64(_T - 1)
_U32 = np.uint64(32)
#: By confidence of a prediction that was wrong (16: right): the change of its slot (one more, or half; below 2 it is
#: replaced) and the weight that its order's share moves to; first of all the weights a block starts with.
_START = np.array([0, 20000, 36000, 45000, 50000, 54000, 57000, 59000, 60000, 61000, 62000, 62500, 63000, 63500, 64000, 64500])
_MOVE = np.array([-(k - k // 2) << _ID_BITS for k in range(16)] + [1 << _ID_BITS] * 15 + [0], np.int32)
_AIM = np.array([0] + [400] * 15 + [65000] * 16, np.int32)


class ChecksumError(ValueError):
    """A block's ids don't have the crc32 that was stored with it."""


def _prior(vocab: int) -> np.ndarray:
    """Cumulative weights of ids never seen: earlier merges are likelier."""
    w = 1 / (np.arange(vocab) + 256.0)
    f = np.maximum(1, np.floor(w / w.sum() * (_T - vocab))).astype(np.int64)
    f[0] += _T - f.sum()
    return np.concatenate(([0], np.cumsum(f)))


class _Model:
    """The predictions of all lanes; lanes stand in order of falling length, so the open ones are a prefix."""

    def __init__(self, lanes: int, vocab: int):
        self.lanes = lanes
        self.prior = _prior(vocab)
        self.half = 16 if vocab <= 1 << 16 else 32
        self.wide = np.uint32 if self.half == 16 else np.uint64
        self.table = np.zeros((lanes << _T1) + (lanes << _T2), np.int32)  # order 1, then order 2
        lane = np.arange(lanes, dtype=np.int32)
        self.base = np.stack([lane << _T1, (lane << _T2) + (lanes << _T1)])
        self.q = np.concatenate([np.tile(_START // 2, 4 * lanes), np.tile(_START, lanes)]).astype(np.int32)
        self.baseq = np.stack([lane << 6, (lane << 4) + (lanes << 6)])
        self.p1 = np.zeros(lanes, np.uint32)
        self.p2 = np.zeros(lanes, np.uint32)
        self.n = 0

    def mark(self, history: np.ndarray) -> None:
        """Order 0 from now on, for the decoder: history has a row of n ids for each lane that is still open. An id's run
        in the sorted history is found from any place in it by the number of runs that began up to there."""
        m, n = history.shape
        ids = np.sort(history, axis=1)
        begins = np.ones((m, n), bool)
        np.not_equal(ids[:, 1:], ids[:, :-1], out=begins[:, 1:])
        self.seen = np.cumsum(begins, axis=1, dtype=self.wide)  # the run's number in its lane, above the id: one look finds both
        new = self.seen[:, -1].astype(np.int64)
        self.seen <<= self.half
        self.seen |= ids
        self.begin = np.append(np.flatnonzero(begins), m * n).astype(np.int32)
        self.base0 = np.arange(m, dtype=np.int64) * n
        self.before = np.cumsum(new) - new - 1
        self.count(n, new)

    def count(self, n: int, new: np.ndarray) -> None:
        """Order 0 holds n ids, `new` distinct ones: as much weight have ids not seen."""
        self.n, self.new, self.total = n, new, (new + n).astype(np.float64)

    def share(self, lo: np.ndarray, hi: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Their part of order 0's room. Exact: the products stay below 2^36, far from where doubles round a floor."""
        x = np.empty((2, m))
        np.multiply(lo, self.a0, out=x[0])
        np.multiply(hi, self.a0, out=x[1])
        x /= self.total[:m]
        return x.astype(np.int64)

    def predict(self, m: int) -> None:
        """Tables hold id + 1 (0: nothing yet), so an empty slot never names an id, and its confidence 0 has weight 0."""
        p1 = self.p1[:m]
        h = np.empty((2, m), np.uint32)
        np.multiply(p1, _MIX1, out=h[0])
        h[0] >>= _SHIFT1
        np.multiply(p1, _MIX2, out=h[1])
        h[1] += self.p2[:m] * _MIX3
        h[1] >>= _SHIFT2
        self.i = np.add(h.view(np.int32), self.base[:, :m], dtype=np.int64)
        self.e = self.table.take(self.i)
        self.c, self.k = (self.e & _ID) - 1, self.e >> _ID_BITS
        j = self.k + self.baseq[:, :m]
        j[0] += np.minimum(self.k[1], 3) << 4
        self.j = j.astype(np.int64)
        self.w = self.q.take(self.j)
        self.c1, self.c2 = self.c
        self.a2 = self.w[1].astype(np.int64)
        self.a2 *= _TOP
        self.a2 >>= 16
        self.a1 = _TOP - self.a2
        self.a1 *= self.w[0]
        self.a1 >>= 16
        self.a1 *= self.c1 != self.c2
        self.rest = self.a1 + self.a2
        self.a0 = _T - self.rest

    def update(self, s: np.ndarray, m: int) -> None:
        hit = self.c == s
        kind = self.k + (hit * np.int32(16))
        move = _AIM.take(kind)
        move -= self.w
        move >>= 4
        move[0] *= ~hit[1]  # order 1 learns where order 2 was wrong
        move += self.w
        self.q[self.j] = move
        new = self.e + _MOVE.take(kind)
        np.copyto(new, s + np.int32(1 + (1 << _ID_BITS)), where=kind < 2, casting="unsafe")
        self.table[self.i] = new
        self.p2[:m] = self.p1[:m]
        self.p1[:m] = s


def _runs(ids: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the encoder, which knows the ids to come: by position and lane, first and stop of the id's run in the sorted
    history at the last mark (equal: it isn't there), and by mark and lane, how many distinct ids that history has.

    In a lane's positions sorted by id, the history's ids before a run are those of its earlier places that lie before
    the mark; a running count of them at the run's bounds is its first and stop."""
    lanes, n = ids.shape
    bits = max(1, (n - 1).bit_length())
    first, stop = np.zeros((n, lanes), np.uint16), np.zeros((n, lanes), np.uint16)
    new = np.zeros((len(ends), lanes), np.int64)
    at = np.arange(n, dtype=np.int32)
    for a in range(0, lanes, 128):
        part = ids[a : a + 128]
        m = len(part)
        order = np.sort(part.astype(np.int64) << bits | at if bits + int(part.max(initial=0)).bit_length() > 31 else part.astype(np.int32) << bits | at, axis=1)
        value = order >> bits
        order &= (1 << bits) - 1
        begins = np.ones((m, n), bool)
        np.not_equal(value[:, 1:], value[:, :-1], out=begins[:, 1:])
        run = np.cumsum(begins.ravel(), dtype=np.int32)
        begin = np.append(np.flatnonzero(begins), m * n).astype(np.int32)
        lane = np.arange(m, dtype=np.int32)[:, None]
        # bounds by position, in a count that has one more place for each lane
        back = (order + lane * n).ravel()
        low, high = np.empty(m * n, np.int32), np.empty(m * n, np.int32)
        low[back], high[back] = begin[run - 1], begin[run]
        low, high = (low.reshape(m, n) + lane).T, (high.reshape(m, n) + lane).T
        count = np.zeros((m, n + 1), np.uint16)
        for k, (t, until) in enumerate(zip([0, *ends], ends)):
            if t:
                known = order < t
                np.cumsum(known, axis=1, dtype=np.uint16, out=count[:, 1:])
                new[k, a : a + m] = np.count_nonzero(known & begins, axis=1)
                flat = count.ravel()
                first[t:until, a : a + m] = flat[low[t:until]]
                stop[t:until, a : a + m] = flat[high[t:until]]
    return first, stop, new


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Position and number of open lanes, for falling sizes."""
    m = len(sizes)
    for t in range(int(sizes[0]) if m else 0):
        while sizes[m - 1] <= t:
            m -= 1
        yield t, m


def encode_blocks(blocks: list[np.ndarray], vocab: int) -> list[bytes]:
    """Each block of ids coded from a fresh model."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    lanes, longest = len(blocks), int(sizes[0])
    ids = np.zeros((lanes, longest), np.int32)
    for i, o in enumerate(order):
        ids[i, : sizes[i]] = blocks[o]
    model = _Model(lanes, vocab)
    out = np.zeros((lanes, 2 * longest + 8), np.uint32)
    pos = np.zeros(lanes, np.int64)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def put(at: np.ndarray | slice, cum: np.ndarray, freq: np.ndarray) -> None:
        r = rng[at] >> np.uint64(_BITS)
        old = low[at]
        new = old + r * cum.view(np.uint64)
        width = r * freq.view(np.uint64)
        carry = np.flatnonzero(new < old)
        if len(carry):
            lane = carry if isinstance(at, slice) else at[carry]
            k = pos[lane] - 1
            while len(lane):
                out[lane, k] += np.uint32(1)
                over = out[lane, k] == 0
                lane, k = lane[over], k[over] - 1
        small = np.flatnonzero(width < _LOW32)
        if len(small):
            lane = small if isinstance(at, slice) else at[small]
            out[lane, pos[lane]] = (new[small] >> _U32).astype(np.uint32)
            pos[lane] += 1
            new[small] <<= _U32
            width[small] <<= _U32
        low[at], rng[at] = new, width

    ends = sorted({x for x in _MARKS if x < longest} | {longest})
    first, stop, new = _runs(ids, ends)
    marks = {x: k for k, x in enumerate(ends[:-1], 1)}
    ids = np.ascontiguousarray(ids.T)
    for t, m in _steps(sizes):
        if t in marks:
            model.count(t, new[marks[t], :m])
        model.predict(m)
        s = ids[t, :m]
        in2 = s == model.c2
        in1 = (s == model.c1) & (model.a1 > 0)
        if model.n:
            lo, hi = first[t, :m].astype(np.int64), stop[t, :m].astype(np.int64)
            fresh = lo == hi
            lo[fresh] = model.n
            hi[fresh] = model.n + model.new[:m][fresh]
            x, y = model.share(lo, hi, m)
        else:
            fresh, x, y = np.ones(m, bool), 0, model.a0
        cum, freq = model.rest + x, y - x
        h1, h2 = np.flatnonzero(in1), np.flatnonzero(in2)
        cum[h1], freq[h1] = model.a2[h1], model.a1[h1]
        cum[h2], freq[h2] = 0, model.a2[h2]
        fresh[h1] = fresh[h2] = False
        put(slice(0, m), cum, freq)
        esc = np.flatnonzero(fresh)
        if len(esc):
            e = s[esc]
            put(esc, model.prior[e], model.prior[e + 1] - model.prior[e])
        model.update(s, m)
    for shift in (32, 0):
        out[np.arange(lanes), pos] = ((low >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        pos += 1
    result: list[bytes] = [b""] * lanes
    for i, o in enumerate(order):
        result[o] = out[i, : pos[i]].astype("<u4").tobytes()
    return result


def decode_blocks(coded: list[bytes], sizes_in: list[int], vocab: int) -> list[np.ndarray]:
    """The inverse of encode_blocks."""
    if not coded:
        return []
    sizes = np.array(sizes_in)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    lanes, longest = len(coded), int(sizes[0])
    width = max(len(c) for c in coded) // 4 + 2
    words = np.zeros((lanes, width), np.uint32)
    for i, o in enumerate(order):
        w = np.frombuffer(coded[o], "<u4")
        words[i, : len(w)] = w
    flat, at_word = words.ravel(), np.arange(lanes, dtype=np.int64) * width + 2
    off = (words[:, 0].astype(np.uint64) << _U32) | words[:, 1]
    rng = np.full(lanes, 2**64 - 1, np.uint64)
    model = _Model(lanes, vocab)
    ids = np.zeros((lanes, longest), np.uint16 if model.half == 16 else np.uint32)
    # an id near a place in the prior's cumulative weights, from which few steps lead to the right one
    near = np.searchsorted(model.prior, np.arange(0, _T, 16), side="right") - 1

    def take(at: np.ndarray | slice, r: np.ndarray, cum: np.ndarray, freq: np.ndarray) -> None:
        left = off[at] - r * cum.view(np.uint64)
        new = r * freq.view(np.uint64)
        small = np.flatnonzero(new < _LOW32)
        if len(small):
            lane = small if isinstance(at, slice) else at[small]
            left[small] = (left[small] << _U32) | flat.take(at_word[lane], mode="clip")  # damaged words may ask for more
            at_word[lane] += 1
            new[small] <<= _U32
        off[at], rng[at] = left, new

    def value(at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """off // r by way of doubles, put right by one where they rounded across."""
        r, o = rng[at] >> np.uint64(_BITS), off[at]
        v = (o / r).astype(np.uint64)
        v -= r * v > o
        v += r * (v + _ONE) <= o
        return r, np.minimum(v, _LAST).astype(np.int64)

    marks = set(_MARKS)
    for t, m in _steps(sizes):
        if t in marks and t:
            model.mark(ids[:m, :t])
        model.predict(m)
        r, v = value(slice(0, m))
        in2 = v < model.a2
        in1 = (v < model.rest) & ~in2
        if model.n:
            u = np.maximum(v - model.rest, 0)
            j = (((u + 1) * model.total[:m] - 1) / model.a0).astype(np.int64)
            fresh = j >= model.n
            base = model.base0[:m]
            at = base + np.minimum(j, model.n - 1)
            seen = model.seen.take(at)
            s0 = (seen & model.wide((1 << model.half) - 1)).astype(np.int32)
            run = (seen >> model.wide(model.half)).astype(np.int64) + model.before[:m]
            lo, hi = model.begin.take(run) - base, model.begin.take(run + 1) - base
            lo[fresh] = model.n
            hi[fresh] = (model.n + model.new[:m])[fresh]
            x, y = model.share(lo, hi, m)
        else:
            fresh, s0, x, y = np.ones(m, bool), np.zeros(m, np.int32), 0, model.a0
        cum, freq = model.rest + x, y - x
        h1, h2 = np.flatnonzero(in1), np.flatnonzero(in2)
        cum[h1], freq[h1] = model.a2[h1], model.a1[h1]
        cum[h2], freq[h2] = 0, model.a2[h2]
        fresh[h1] = fresh[h2] = False
        take(slice(0, m), r, cum, freq)
        s = s0
        s[h1], s[h2] = model.c1[h1], model.c2[h2]
        esc = np.flatnonzero(fresh)
        if len(esc):
            r, v = value(esc)
            e = near.take(v >> 4)
            while (more := model.prior.take(e + 1) <= v).any():
                e += more
            take(esc, r, model.prior[e], model.prior[e + 1] - model.prior[e])
            s[esc] = e
        ids[:m, t] = s
        model.update(s, m)
    result: list[np.ndarray] = [ids[0, :0]] * lanes
    for i, o in enumerate(order):
        result[o] = ids[i, : sizes[i]]
    return result


def write_segments(parts: list[np.ndarray], vocab: int, block: int = BLOCK) -> list[bytes]:
    """Each part of ids as a payload of blocks; all are coded together."""
    cut = [[p[a : a + block] for a in range(0, len(p), block)] for p in parts]
    coded = iter(encode_blocks([b for c in cut for b in c], vocab))
    out = []
    for c in cut:
        body = [next(coded) for _ in c]
        head = np.array([[len(b), len(x), zlib.crc32(b.astype("<u4").tobytes())] for b, x in zip(c, body)], "<u4").reshape(-1, 3)
        out.append(_MAGIC + struct.pack("<II", len(c), vocab) + head.tobytes() + b"".join(body))
    return out


def read_segments(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each payload, all decoded together and verified."""
    coded, sizes, sums, counts, vocab = [], [], [], [], 1
    for p in payloads:
        if p[:4] != _MAGIC:
            raise ValueError("not a segment of this format")
        n, vocab = struct.unpack_from("<II", p, 4)
        head = np.frombuffer(p, "<u4", 3 * n, 12).reshape(-1, 3)
        at = 12 + 12 * n
        for length, size, crc in head.tolist():
            coded.append(p[at : at + size])
            sizes.append(length)
            sums.append(crc)
            at += size
        counts.append(n)
    blocks = decode_blocks(coded, sizes, vocab)
    for i, (b, crc) in enumerate(zip(blocks, sums)):
        if zlib.crc32(b.astype("<u4").tobytes()) != crc:
            raise ChecksumError(f"block {i}")
    out, at = [], 0
    for n in counts:
        out.append(np.concatenate(blocks[at : at + n]) if n else np.zeros(0, np.int32))
        at += n
    return out


_SEGMENTS = "part int, segment int, start long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, payload binary"


def encode(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Segments of the ids of docs, in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tokens.encoder(path), TaskContext.get().partitionId()
        segments: list[tuple[list, list, list]] = []
        ready, start, number = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal segments, ready, start, number
            payloads = write_segments([np.concatenate(parts) for _, _, parts in segments], enc.size)
            sums = [sum(n) for _, n, _ in segments]
            starts = (start + np.cumsum([0, *sums])).tolist()
            k = len(segments)
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * k, pa.int32()),
                    pa.array(range(number, number + k), pa.int32()),
                    pa.array(starts[:-1], pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array([d for d, _, _ in segments], pa.list_(pa.int64())),
                    pa.array([n for _, n, _ in segments], pa.list_(pa.int64())),
                    pa.array(payloads, pa.binary()),
                ],
                names=[x.split(" ")[0] for x in _SEGMENTS.split(", ")],
            )
            segments, ready, start, number = [], 0, starts[-1], number + k
            return batch

        end = np.array([end_id], enc.dtype)
        for b in tokens.grouped(batches):
            doc_ids = b.column(0).to_pylist()
            for first, found, cuts in enc.encode_array(b.column(1)):
                for d, x, y in zip(doc_ids[first:], cuts[:-1].tolist(), cuts[1:].tolist()):
                    n = y - x + 1
                    if not segments or sum_open + n > SEGMENT_TOKENS:
                        if ready >= FLUSH_TOKENS:
                            yield flush()
                        segments.append(([], [], []))
                        sum_open = 0
                    ids, counts, parts = segments[-1]
                    ids.append(d)
                    counts.append(n)
                    parts += (found[x:y], end)
                    sum_open += n
                    ready += n
        if segments:
            yield flush()

    spark = docs.sparkSession
    common.ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _SEGMENTS)


def decode(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """part, start within it, doc_id, n_tokens, ids_crc32 of every document of the files, and its ids if asked for."""
    schema = "part int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = 0
            sizes = b.column(3).to_pylist()
            while k < b.num_rows:
                stop, total = k, 0
                while stop < b.num_rows and (stop == k or total + sizes[stop] <= FLUSH_TOKENS):
                    total += sizes[stop]
                    stop += 1
                rows: list[list] = [[] for _ in range(5 + with_ids)]
                part = b.slice(k, stop - k)
                found = read_segments(part.column(6).to_pylist())
                for p, start, d, n, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist(), found):
                    cuts = np.cumsum([0, *n]).tolist()
                    raw = memoryview(ids.astype("<u4").tobytes())
                    rows[0] += [p] * len(d)
                    rows[1] += [start + c for c in cuts[:-1]]
                    rows[2] += d
                    rows[3] += n
                    rows[4] += [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cuts, cuts[1:])]
                    if with_ids:
                        rows[5] += [ids[x:y] for x, y in zip(cuts, cuts[1:])]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["part", "at", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=names)
                k = stop

    common.ship(segments.sparkSession)
    return segments.mapInArrow(run, schema)


def located(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """decode() with start: the tokens of all documents before. One row for each partition of files is summed up."""
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = decode(segments, with_ids)
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = common.write_table(encode(common.read_table(spark, sf_dir, "documents", "doc_id", "text")), "token_files", codec="uncompressed")
    return located(files)
