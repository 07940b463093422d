"""Types of collections, kinds of records and the layouts of stored tables."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class DataType(IntEnum):
    NONE = 0
    STRING = 1
    BITMAP = 2
    HASH = 3
    LIST = 4
    SET = 5
    ZSET = 6
    ZSET_INDEX = 7
    EXPIRE_KEY = 8
    DK_HASH = 9
    DK_SET = 10


class Kind(IntEnum):
    DELETE = 0
    SET = 1
    SET_SEPARATE = 2
    LOG = 3
    PREFIX_DELETE = 4
    EXPIRE_AT = 5
    INVALID = 255


SLOTS = 1024
MAX_SUBKEY_BYTES = 10 * 1024
MAX_VALUE_BYTES = 6 * 1024 * 1024
LIST_RANGE_CAP = 10_000
SEGMENT_BITS = 64 * 1024
TTL_BUCKET_SEC = 300

#: One row for each write, in the order of seq; what a kind doesn't use is null. List positions are centred on 0.
OPS = T.StructType([
    T.StructField("seq", T.LongType(), False), T.StructField("slot", T.IntegerType()), T.StructField("key", T.StringType()),
    T.StructField("kind", T.IntegerType()), T.StructField("data_type", T.IntegerType()), T.StructField("subkey", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("expire_ms", T.LongType()), T.StructField("op_ms", T.LongType()),
])

WRONG_TYPE = "WRONGTYPE Operation against a key holding the wrong kind of value"


class WrongType(TypeError):
    def __init__(self) -> None:
        super().__init__(WRONG_TYPE)


class NotFound(KeyError):
    """A key or element that an operation demands isn't there."""
