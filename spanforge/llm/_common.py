"""Helpers shared by the corpus operators: words, ASCII lower-casing, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls TAB..CR. Everything else belongs to a word.
WORD_GAP = r"[\x20\x09-\x0D]+"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words_of(col: Column) -> Column:
    """Words of a text in order (null: none).

    Project it to a column of its own before a lambda refers to it, and put no filter and no plain ``explode`` (for which
    Catalyst infers one) on what the lambda makes: pushed below the projection, the filter would hold the words'
    expression inside the lambda and split the text again for each element. ``explode_outer`` infers no filter."""
    return F.array_remove(F.split(text_or_empty(col), WORD_GAP), "")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. ``lower`` does it in one pass where every character is ASCII."""
    text = text_or_empty(col)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def constant_array(values, kind: str) -> Column:
    """A driver-side list of bounded length as an array literal: the split is foldable, so Catalyst evaluates it once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def give_back() -> None:
    """Returns what this process has freed to the system: Arrow's buffers and, where the C library is glibc, its heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, which gives its memory back at the end of a task: a worker lives on for later tasks, idle
    beside workers that an executor has started meanwhile, and all of them count against the executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode alone, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spanforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that ``written`` makes inside the block are removed at its end, but for those that the block keeps: it gets
    the function that writes one of these. For steps whose result is written before the block ends; the result of an
    operator alone is lazy, so its tables stay until their reader is done, in the shared folder of the session."""
    made: list[DataFrame] = []
    _SCRATCH.append(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        made[:] = [x for x in made if x is not out]
        return out

    try:
        yield keep
    finally:
        _SCRATCH.pop()
        for df in made:
            forget(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it again. Survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/spanforge-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spanforge_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Removes what ``written`` wrote, once nothing will read it again."""
    path = getattr(df, "_spanforge_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
