"""Packing: concatenate the token ids of all documents and cut the stream into fixed windows.

Two passes. The first tokenizes, gives each document its start within its partition and is written to the shared
folder; its totals by partition, one number each, become global offsets by a prefix sum. The second needs no shuffle:
a document's global start says which windows it touches, and it yields one boundary record for each.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; every window but the
last is full, so padding is under one window for the whole corpus; no document gives no row.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, small_batches, stage, words_of

LENGTH = 2048
END_ID = 1

# The splitting rule of the tokenizer's file, as it stands there: fixed values.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters alone are cut here; any other word goes to the tokenizer whole.
PLAIN = regex.compile(r"[!-~\xa1-\xff]+")
#: The same rule for lower-case words of visible ASCII characters.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")




def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for their bytes, the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in visible else next(rest)) for b in range(256)}


BYTES = _byte_characters()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Words to their ids as little-endian bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn, and a
    word's are those of its parts under the splitting rule. Each distinct part is merged once a worker as long as it is
    remembered; what is remembered is bounded, and the older half goes first.
    """

    LIMIT = 200_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        """Ids of one part, which needs no more than the merges."""
        ids = self.older.get(part)
        if ids is None:
            seen = part if part.isascii() else "".join(map(BYTES.__getitem__, part.encode()))
            ids = array("I", [t.id for t in self.merge(seen)]).tobytes()
        if len(self.parts) >= 2 * self.LIMIT:
            self.older, self.parts = self.parts, {}
        self.parts[part] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            known = self.parts
            if "<|" not in word and word.isascii() and word.isprintable():
                low = word.lower()
                if low.isalpha():
                    ids = known.get(low) or self.part(low)
                else:
                    ids = b"".join([known.get(p) or self.part(p) for p in ASCII.findall(low)])
            elif "<|" in word or not PLAIN.fullmatch(word):
                ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            else:
                ids = b"".join([known.get(p) or self.part(p) for p in PRETOKEN.findall(unicodedata.normalize("NFC", word).lower())])
        if len(self) >= self.LIMIT:
            self.words = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: str | None, end: bytes) -> bytes:
        return b"".join([*map(self.__getitem__, words_of(text)), end])


_cache: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _cache:
        _cache[path] = WordIds(path)
    return _cache[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, part_start, doc_tokens and ids (little-endian, 4 bytes an id), in the order of the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            got = [ids.text(t, end) for t in b.column("text").to_pylist()]
            sizes = np.array([len(x) // 4 for x in got], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(got), part, np.int64)), pa.array(starts), pa.array(sizes), pa.array(got, pa.binary())],
                ["doc_id", "part", "part_start", "doc_tokens", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part long, part_start long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    tokens = stage(tokenize(docs, tokenizer or default_tokenizer(), end_id), "packing-tokens")
    # One row for each partition of the scan, whatever the rows: a window over them is small.
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("part_offset"))
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("first", F.col("part_offset") + F.col("part_start"))
    windows = F.sequence(F.expr(f"first div {length}"), F.expr(f"(first + doc_tokens - 1) div {length}"))
    pieces = placed.select("doc_id", "first", "doc_tokens", "ids", F.explode(windows).alias("sequence_id"))
    start = F.greatest(F.col("sequence_id") * length - F.col("first"), F.lit(0))
    stop = F.least((F.col("sequence_id") + 1) * length - F.col("first"), F.col("doc_tokens"))
    return pieces.withColumns({"start": start, "stop": stop}).select(
        "doc_id", "start", (F.col("stop") - F.col("start")).alias("length"),
        F.expr("substring(ids, cast(start * 4 + 1 as int), cast((stop - start) * 4 as int))").alias("ids"),
        "doc_tokens", "sequence_id", (F.col("first") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark, sf_dir) -> DataFrame:
    """The whole corpus packed into windows of 2048 ids."""
    small_batches(spark)
    return digest(pack(documents(spark, sf_dir)))


def stage_packing(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Pieces of the packed corpus, with their ids (little-endian, 4 bytes an id)."""
    small_batches(spark)
    return pack(docs)
