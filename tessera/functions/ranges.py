"""Index arithmetic of range reads, as plain functions of sizes and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LIST_RANGE_CAP, SEGMENT_BITS, TTL_BUCKET_SEC

MAX_OFFSET = 2**63 - 1
Range = tuple[int, int] | None


def rank_range(size: int, start: int, stop: int, reverse: bool = False) -> Range:
    """First and last forward rank of a sorted set's rank range, or None if that is empty."""
    if reverse:
        lo, hi = (-stop - 1 if stop < 0 else size - stop - 1), (-start - 1 if start < 0 else size - start - 1)
    else:
        lo, hi = (size + start if start < 0 else start), (size + stop if stop < 0 else stop)
    lo, hi_c = max(lo, 0), min(hi, size - 1)
    return None if hi < 0 or lo >= size or lo > hi_c else (lo, hi_c)


def rank_bounds(size: Column, start: int, stop: int, reverse: bool = False) -> tuple[Column, Column]:
    """rank_range() for a column of sizes; an empty range has its first above its last."""
    if reverse:
        lo = F.lit(-stop - 1) if stop < 0 else size - (stop + 1)
        hi = F.lit(-start - 1) if start < 0 else size - (start + 1)
    else:
        lo = size + start if start < 0 else F.lit(start)
        hi = size + stop if stop < 0 else F.lit(stop)
    return F.greatest(lo, F.lit(0)), F.least(hi, size - 1)


def list_range(size: int, start: int, stop: int, cap: int = LIST_RANGE_CAP) -> Range:
    """First and last position of a list range, at most cap long, or None if that is empty."""
    if stop < 0:
        stop += size
        if stop < 0:
            return None
    if start < 0:
        start = max(0, start + size)
    if start >= size or start > stop:
        return None
    return start, min(stop, size - 1, start + cap - 1)


def list_bounds(size: Column, start: int, stop: int, cap: int | None = LIST_RANGE_CAP) -> tuple[Column, Column]:
    """list_range() for a column of sizes; an empty range has its first above its last."""
    last = size + stop if stop < 0 else F.lit(stop)
    first = F.greatest(F.lit(0), size + start) if start < 0 else F.lit(start)
    top = F.least(last, size - 1)
    return first, top if cap is None else F.least(top, first + (cap - 1))


def bit_range(start: int, end: int) -> Range:
    """Offsets of a bitmap range (negative ones count from 2^63), or None if start lies after end."""
    start, end = (x + MAX_OFFSET + 1 if x < 0 else x for x in (start, end))
    return (start, end) if start <= end else None


def seconds_up(ms: int) -> int:
    return (ms + 999) // 1000


def ttl_bucket(ms: int) -> int:
    """The sweep bucket, in seconds, of an expiry time."""
    return (seconds_up(ms) // TTL_BUCKET_SEC + 1) * TTL_BUCKET_SEC


def ttl_bucket_col(ms: Column) -> Column:
    sec = F.floor((ms + 999) / 1000)
    return ((F.floor(sec / TTL_BUCKET_SEC) + 1) * TTL_BUCKET_SEC).cast("long")


def segment(offset: Column) -> Column:
    """First offset of the bitmap segment that holds an offset."""
    return offset - offset % SEGMENT_BITS


def size_text(n: int) -> str:
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.2f}{unit}"
    return f"{n}B"
