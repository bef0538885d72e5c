"""Shared helpers: words, shared storage and stable 64-bit hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code units that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the session's checkpoint directory, which driver and executors share.

    Where the session names none, a temporary folder becomes that directory in local mode; on a cluster
    that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove what `stored` wrote for tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[dict[str, list]]:
    """Columns of Arrow batches as lists, a few rows at a time: texts become Python objects only while
    they are worked on."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()
        del batch
        pa.default_memory_pool().release_unused()
    release_memory()


def release_memory() -> None:
    """Give what a Python worker no longer uses back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_udf(of: Callable[[list[str | None]], list], schema: str, kind: pa.DataType, rows: int = 256):
    """An Arrow UDF over texts: `of` gets a few at a time and gives a value of `kind` for each."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array(of(batch.slice(at, rows).to_pylist()), kind) for at in range(0, len(batch), rows)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
        release_memory()

    return F.arrow_udf(run, schema)


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit word (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Runs of Unicode white space.
SPACES = re.compile(r"\s+")
