"""What the operators share: input columns, working tables, shipping the package, hold-out folds."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of a word: anything between ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_shipped: set[str] = set()
_tables: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a Spark application, and bound an Arrow batch where the session doesn't.

    Workers started elsewhere (another working folder, another machine) need no PYTHONPATH then.
    """
    sc = spark.sparkContext
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's own: with texts, batches of a fifth keep Python workers small
        spark.conf.set(key, "2000")
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, "tessera_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def give_back() -> None:
    """Freed memory goes back to the system: Arrow's pool and glibc (where it is glibc) keep it for this process otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        return


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow, whose worker is small again when a task ends: Spark keeps workers for later stages."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a session of one machine may leave that unset (then below /tmp)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: working tables need a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
    """Write a working table as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", codec).parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a working table that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        _delete(spark, f)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _tables:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path.rpartition("/")[0])
        except Exception:  # noqa: BLE001  the application may be gone already
            return


def drop_tables(*tables: DataFrame) -> None:
    """Delete working tables that nothing reads any more."""
    for t in tables:
        drop_table(t)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def named(column: str) -> Column:
    """A column by its literal name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_of(docs: DataFrame) -> Column:
    """All columns of docs as one struct: beside it an operator may name its own columns as it likes. select("row.*") brings them back."""
    return F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, mod parts (a null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: binds it as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)
