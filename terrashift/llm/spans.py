"""Substring dedup: sliding spans of consecutive sentences.

A sentence ends after ``. ! ?`` before white space, or at a line break. The shortest run of at least ``SENTENCES``
sentences with at least ``WORDS`` words is hashed (128 bits of its words, so spacing doesn't matter) from each sentence on
and, so that a shared passage is covered to its last sentence, up to each sentence; a sentence of ``LONE`` words or more is
a run by itself. A hash found at two places or more is a repeated span; its first place, in order of (doc_id, row,
sentence), stays, and the sentences that any other place covers are removed.

Defined results: null texts stay null and empty ones empty; a text without repeats stays as it is to the byte; repeated
rows share their places, so each is first where the other is; a null doc_id sorts last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, release, row_key, small_batches, stage, with_row, words_of

SENTENCES, WORDS = 2, 12
#: A passage's length: so long a sentence is a span without others.
LONE = 50
END = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|\n+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence with a word; what lies between two belongs to the first of them."""
    if not text:
        return []
    cuts = [0, *(m.end() for m in END.finditer(text)), len(text)]
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a and text[a:b].strip("\x20\x09\x0a\x0b\x0c\x0d"):
            out.append((a, b))
        elif out:
            out[-1] = (out[-1][0], b)
    return out


def _parts(text: str | None) -> tuple[list[int], list[bytes]]:
    """Number of words and digest of each sentence."""
    parts = [words_of(text[a:b]) for a, b in sentences(text)]
    return [len(p) for p in parts], [xxhash.xxh3_128_digest(" ".join(p).encode("utf-8", "surrogatepass")) for p in parts]


def _shortest(sizes: list[int], least: int, words: int) -> list[tuple[int, int]]:
    """First sentence and number of sentences of the shortest long enough run from each sentence."""
    out, end, have, n = [], 0, 0, len(sizes)
    for i in range(n):
        while end < n and (end - i < least or have < words):
            have += sizes[end]
            end += 1
        if end - i < least or have < words:
            break
        out.append((i, end - i))
        have -= sizes[i]
    return out


def spans(text: str | None, least: int = SENTENCES, words: int = WORDS, lone: int | None = None) -> list[tuple[int, int, int]]:
    """First sentence, number of sentences and 128-bit hash of the shortest long enough run from each sentence. With
    ``lone`` also of the shortest one up to each sentence, and of each sentence of so many words; a run counts once."""
    return [(i, k, int.from_bytes(h, "big")) for i, k, h in _hashed(text, least, words, lone)]


def _hashed(text: str | None, least: int, words: int, lone: int | None) -> list[tuple[int, int, bytes]]:
    sizes, digests = _parts(text)
    runs = _shortest(sizes, least, words)
    if lone is not None:
        n = len(sizes)
        runs = sorted({*runs, *((n - i - k, k) for i, k in _shortest(sizes[::-1], least, words)), *((i, 1) for i in range(n) if sizes[i] >= lone)})
    return [(i, k, xxhash.xxh3_128_digest(b"".join(digests[i : i + k]))) for i, k in runs]


def span_rows(docs: DataFrame, lone: int | None = None) -> DataFrame:
    """doc_id, key, place, n, h1, h2: a row for each span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, flat = [], []
            for t in b.column("text").to_pylist():
                found = _hashed(t, SENTENCES, WORDS, lone)
                sizes.append(len(found))
                flat += found
            row = np.repeat(np.arange(len(sizes)), sizes)
            # The halves of a hash, less 2^63 each: they fit a signed column.
            halves = (np.frombuffer(b"".join(x[2] for x in flat), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).reshape(-1, 2)
            columns = [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            del flat
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), b.column("key").take(pa.array(row)), *columns], ["doc_id", "key", "place", "n", "h1", "h2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(run, f"doc_id {kind}, key long, place int, n int, h1 long, h2 long")


def _at() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("place").alias("p"))


def covered(docs: DataFrame, lone: int | None = None, used: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, key, sentences: positions that a repeated span's later place covers, for texts that have any. ``lone``:
    as for ``spans``; ``used`` gets the staged tables that the result reads."""
    rows = stage(span_rows(docs, lone), "spans-rows")
    # Sums by task come before the shuffle, so a passage in every document is a row a task.
    seen = rows.groupBy("h1", "h2").agg(F.min(_at()).alias("first"), F.max(_at()).alias("last"))
    repeated = stage(seen.filter(F.col("first") != F.col("last")).select("h1", "h2", "first"), "spans-repeated")
    if used is not None:
        used += [rows, repeated]
    later = rows.join(repeated, ["h1", "h2"]).filter(_at() != F.col("first"))
    later = later.select("doc_id", "key", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("s"))
    return later.groupBy("doc_id", "key").agg(F.collect_set("s").alias("sentences"))


def remove_sentences(text: str | None, gone: list[int] | None) -> str | None:
    if text is None or gone is None:
        return text
    out = set(gone)
    return "".join(text[a:b] for i, (a, b) in enumerate(sentences(text)) if i not in out).rstrip("\x20\x09\x0a\x0b\x0c\x0d")


def _without(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` without the repeated spans, ``sentences``: the positions taken out."""
    used: list[DataFrame] = []
    gone = stage(covered(docs, LONE, used), "spans-covered")
    release(*used)
    gone = gone.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "sentences")
    rows = with_row(docs, doc_id=F.col("doc_id"), key=row_key())
    # What grows with the input is merged, not broadcast, so the plan is the same at every size.
    joined = rows.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([remove_sentences(t, None if g is None else [int(x) for x in g]) for t, g in zip(text, gone, strict=True)], dtype=object)

    changed = F.when(F.col("sentences").isNull(), F.col("row.text")).otherwise(cut("row.text", "sentences"))
    return joined.select("row", changed.alias("text"), "sentences")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated spans taken out of ``text``."""
    return _without(docs).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op6_spans(spark, sf_dir) -> DataFrame:
    """Every document: how many sentences went, their positions, and the size and digest of what stays."""
    small_batches(spark)
    out = _without(documents(spark, sf_dir).select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    n = F.coalesce(F.size(F.when(F.col("sentences").isNotNull(), F.col("sentences"))), F.lit(0)).cast("long")
    return out.select("row.doc_id", n.alias("n_removed"), F.array_sort("sentences").alias("removed"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def stage_spans(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """All documents, without the later places of repeated spans; their columns."""
    small_batches(spark)
    return deduplicate(docs)
