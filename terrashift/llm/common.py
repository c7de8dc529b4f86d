"""Helpers shared by the training-data operators."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import deleted, written

#: ASCII white space that separates words.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


_RECORDING = threading.local()


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    out = written(df, name)
    if getattr(_RECORDING, "tables", None) is not None:
        _RECORDING.tables.append(out)
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``stage`` wrote, once whatever is read from it has been staged in turn."""
    deleted(*frames)
    if getattr(_RECORDING, "tables", None) is not None:
        _RECORDING.tables[:] = [t for t in _RECORDING.tables if all(t is not f for f in frames)]


@contextmanager
def recording(tables: list[DataFrame]) -> Iterator[None]:
    """Within, ``stage`` adds to ``tables`` what it writes, and ``release`` takes from it what goes."""
    before = getattr(_RECORDING, "tables", None)
    _RECORDING.tables = tables
    try:
        yield
    finally:
        _RECORDING.tables = before


def sweep(tables: list[DataFrame], reader: DataFrame) -> None:
    """Delete those of ``tables`` that ``reader`` doesn't read, and take them from the list."""
    if tables:
        files = reader.inputFiles()
        read = [t for t in tables if any(t.staged_at.rsplit("/", 1)[-1] in f for f in files)]
        deleted(*(t for t in tables if all(t is not r for r in read)))
        tables[:] = read


def with_row(docs: DataFrame, **more: Column) -> DataFrame:
    """``row``, all columns of ``docs`` in one, beside ``more``: no name of theirs can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(v.alias(k) for k, v in more.items()))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at a time: documents reach 100 kB and more."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key() -> Column:
    """Equal for repeated rows of a document, else different: orders and joins rows that share a doc_id."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def crc_mod(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def bitmap(bits: DataFrame, n: int) -> np.ndarray:
    """A bitmap of ``n`` bits in which those that the one column of ``bits`` names are set. Tasks combine bits to words
    of 64 before the shuffle, so the driver gets n / 64 words at most, however many rows there are."""
    at = F.col(bits.columns[0])
    words = bits.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bits.columns[0]} & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(n // 64, np.int64)
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out.view(np.uint8)


def in_bitmap(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def flat_binary(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column without nulls in one array, and how many each row has."""
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return np.ascontiguousarray(flat).view(kind), np.diff(ends) // np.dtype(kind).itemsize


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Small batches of narrow rows as fewer of about ``rows``."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def words_of(text: str | None) -> list[str]:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text. str.split would also cut at other Unicode spaces and \x1c-\x1f."""
    if not text:
        return []
    found = text.split()
    if text.isascii() and "\x1c" not in text and "\x1d" not in text and "\x1e" not in text and "\x1f" not in text:
        return found
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
