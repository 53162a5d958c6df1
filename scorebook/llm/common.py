"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.session import fresh_path, remove_path

#: A word is a run of anything but the ASCII space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to NumPy at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def quoted(name: str) -> Column:
    """Column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names; others can't clash with what an operator adds."""
    return df.select(*[quoted(old).alias(new) for new, old in columns.items()])


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    while name.lower() in (c.lower() for c in df.columns):
        name = "_" + name
    return name


def map_rows(df: DataFrame, fn, **added: T.DataType) -> DataFrame:
    """``mapInArrow`` over whole rows, whatever their columns are called: columns come by position, ``added`` ones last."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(plain.columns, df.schema.fields)], *[T.StructField(k, v) for k, v in added.items()]])
    return plain.mapInArrow(fn, schema).toDF(*df.columns, *added)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once to the cluster's shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def unstaged(*frames: DataFrame) -> None:
    """Removes what ``staged`` wrote for these, as soon as everything made from them is written itself."""
    for df in frames:
        remove_path(df.sparkSession, _PATHS.pop(df))


@contextmanager
def small_batches(spark: SparkSession, limit: int = SLICE_BYTES) -> Iterator[None]:
    """Rows of jobs run meanwhile reach Python in Arrow batches of about ``limit`` bytes, a slice each.

    Else 10,000 rows or 64 MB go at once, which every running task holds in the JVM, in the worker and on the way.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of each (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr, "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose texts have about ``limit`` bytes at most."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, size = 0, 0
    for i, n in enumerate(lens.tolist()):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start, batch.num_rows - start)


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and how many words lie before each text's start (len(off) counts)."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=inside[1:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, off)


def token_hash(*parts: Column | str) -> Column:
    """60-bit hash of the parts' texts that other engines can compute too (first 15 hex digits of MD5)."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
