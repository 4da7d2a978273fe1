"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: space, and code points 9 to 13.
GAP = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text that isn't null, in order."""
    return F.filter(F.split(c, GAP, -1), lambda w: w != "")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="inkveil-")
        spark.conf.set("spark.checkpoint.dir", root)
        _made.append((spark, root))
    return root


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/inkveil-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._inkveil_path = path
    return out


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows for what runs inside, so that batches of whole texts stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Remove what materialize() wrote for frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_inkveil_path", None)
        if path:
            _delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def bounds(column: pa.Array, size: int):
    """(start, stop) of consecutive rows with about size bytes of text together, one row at least."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        total += n
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def slices(column: pa.Array, size: int = 2_000_000):
    """(start, stop, texts) for consecutive rows with about size bytes of text together, one row at least.

    Only a slice's texts become Python strings at a time, whatever the size of the batch.
    """
    for start, stop in bounds(column, size):
        yield start, stop, column.slice(start, stop - start).to_pylist()


def release() -> None:
    """Give back what Arrow keeps for later, when a task's last batch is done: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
