"""Predicates and scalar functions of keyed collections, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_SUBKEY_BYTES, MAX_VALUE_BYTES, SLOTS


def alive(expire_ms: Column, now_ms: int) -> Column:
    """Not expired at now_ms: 0 never expires; the moment itself counts as expired."""
    return (expire_ms == 0) | (expire_ms > now_ms)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A partition for keys that come without one."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(slots)).cast("int")


def fnv1_32(key: Column) -> Column:
    """FNV-1 of a text's bytes; a fold inside the JVM."""
    hexed = F.hex(F.encode(key.cast("string"), "UTF-8"))
    places = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(0x811C9DC5).cast("long"), lambda h, b: F.pmod(h * 16777619, F.lit(1 << 32)).bitwiseXOR(b))


def within(x: Column, low, high, low_open: bool = False, high_open: bool = False) -> Column:
    """Inside bounds, each of which may be open (exclusive) or absent (None)."""
    parts = []
    if low is not None:
        parts.append(x > F.lit(low) if low_open else x >= F.lit(low))
    if high is not None:
        parts.append(x < F.lit(high) if high_open else x <= F.lit(high))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def lex_bound(x: str) -> str | None:
    """The sentinels - and + mean no bound."""
    return None if x in ("-", "+") else x


def as_integer(value: Column) -> Column:
    """A counter's text as a number, null where it isn't one."""
    return value.try_cast("bigint")


def valid_element(subkey: Column, value: Column | None = None) -> Column:
    """Elements a batch may hold; others are skipped."""
    size = F.octet_length(subkey)
    ok = (size > 0) & (size <= MAX_SUBKEY_BYTES)
    return ok if value is None else ok & (F.coalesce(F.octet_length(value), F.lit(0)) <= MAX_VALUE_BYTES)


def score_key(score: Column) -> Column:
    """Sixteen hexadecimal digits that sort as scores do, -0.0 before 0.0.

    The bits of a double come from its text form by JVM functions only where it is finite; the sign decides the flip.
    """
    magnitude = F.abs(score)
    exponent = F.when(magnitude == 0, F.lit(0)).otherwise(F.greatest(F.floor(F.log2(magnitude)), F.lit(-1022)))
    raised = F.when(magnitude >= F.pow(F.lit(2.0), exponent + 1), exponent + 1).when(magnitude < F.pow(F.lit(2.0), exponent), F.greatest(exponent - 1, F.lit(-1022))).otherwise(exponent)
    normal = magnitude >= 2.2250738585072014e-308
    fraction = F.when(normal, (magnitude / F.pow(F.lit(2.0), raised) - 1) * float(1 << 52)).otherwise(magnitude / 2.2250738585072014e-308 * float(1 << 52))
    bits = F.when(normal, (raised.cast("long") + 1023) * F.lit(1 << 52)).otherwise(F.lit(0).cast("long")) + fraction.cast("long")
    negative = (score < 0) | (score.cast("string") == "-0.0")
    key = F.when(negative, F.bitwise_not(bits)).otherwise(bits)
    top = F.when(negative, F.bitwise_not(bits).bitwiseAND(F.lit((1 << 63) - 1))).otherwise(bits)
    flipped = F.when(negative, top).otherwise(key.bitwiseOR(F.lit(-(1 << 63))))
    return F.lower(F.lpad(F.hex(flipped), 16, "0"))
