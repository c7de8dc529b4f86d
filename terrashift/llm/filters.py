"""Filter interaction audit: what each filter removes, at each place of every order of the filters.

A row's failures are bits of a mask. Which step of an order removes it is looked up in a table of masks by orders that is
made once; tasks count (order, step) by label with ``np.bincount`` and the tasks' counts are summed by Spark. A part's
report follows from 2,912 such sums, whatever the number of its rows.

Defined results: a null text is empty; a null language is the part ``''``; a row without a doc_id is compared with no
other text, so it never fails E; repeated rows count each, and a row is no copy of one with the same doc_id; of several
labels of a doc_id any 1 counts; columns beyond those named are not read; without rows there is no part and no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, release, small_batches, stage

FILTERS = "ABCDE"
#: Parts that a task counts at a time, 23 kB each; beyond that it hands its counts on and begins anew.
PARTS = 2000


@lru_cache
def orders(names: str = FILTERS) -> tuple[str, ...]:
    return tuple(map("".join, permutations(names)))


@lru_cache
def first_failures(names: str = FILTERS) -> np.ndarray:
    """By mask and order: the step that removes a row, or ``len(names)`` if none does. Bit k of a mask is filter k."""
    n = len(names)
    bit = np.array([[names.index(f) for f in order] for order in orders(names)])
    fails = (np.arange(1 << n)[:, None, None] >> bit) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), n).astype(np.int64)


def count_cells(marked: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, cell, n of rows with ``part`` string, ``mask`` int and ``label`` int (1 for good, 2 for toxic, added).

    The cells of (label, order, step) come first, then those of (label, mask). Each task sends its non-zero cells."""
    n = len(names)
    steps, n_orders = n + 1, len(orders(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, place = first_failures(names), np.arange(n_orders) * steps
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(4 * n_orders * steps + (4 << n), np.int64))

        def emit() -> Iterator[pa.RecordBatch]:
            for part, total in counts.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["part", "cell", "n"])
            counts.clear()

        for b in batches:
            parts = b.column("part").dictionary_encode()
            code, mask, label = parts.indices.to_numpy(), b.column("mask").to_numpy().astype(np.int64), b.column("label").to_numpy().astype(np.int64)
            order = np.argsort(code, kind="stable")
            for part, rows in zip(parts.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(code, minlength=len(parts.dictionary)))[:-1]), strict=True):
                m, k = mask[rows], label[rows]
                removed = (k * n_orders * steps)[:, None] + place + table[m]
                counts[part] += np.concatenate([np.bincount(removed.ravel(), minlength=4 * n_orders * steps), np.bincount((k << n) + m, minlength=4 << n)])
            if len(counts) > PARTS:
                yield from emit()
        yield from emit()

    return marked.select("part", "mask", "label").mapInArrow(run, "part string, cell int, n long").groupBy("part", "cell").agg(F.sum("n").alias("n"))


def report(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row for each part, order and step, zeros included, from what ``count_cells`` returns."""
    n = len(names)
    steps, n_orders = n + 1, len(orders(names))
    numbers = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = np.array([[names.index(f) for f in order] for order in orders(names)])
        masks = np.arange(1 << n)
        for b in batches:
            for part, found in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                total = np.zeros(4 * n_orders * steps + (4 << n), np.int64)
                total[[x["cell"] for x in found]] = [x["n"] for x in found]
                by_label = total[: 4 * n_orders * steps].reshape(4, n_orders, steps)[:, :, :n]
                by_mask = total[4 * n_orders * steps :].reshape(4, 1 << n).sum(axis=0)
                removed = by_label.sum(axis=0)
                failing = np.array([by_mask[masks >> k & 1 == 1].sum() for k in range(n)])
                unique = by_mask[1 << np.arange(n)]
                shapley = np.bincount(which.ravel(), weights=removed.ravel(), minlength=n).astype(np.int64)
                columns = [by_mask.sum() - removed.cumsum(axis=1), removed, failing[which] - removed, unique[which], by_label[1] + by_label[3], by_label[2] + by_label[3], shapley[which]]
                head = [pa.array([part] * (n_orders * n), pa.string()), pa.array([o for o in orders(names) for _ in range(n)]), pa.array(np.tile(np.arange(1, n + 1), n_orders), pa.int32())]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(c.ravel()) for c in columns)], ["part", "filter_order", "step", *numbers])

    gathered = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    return gathered.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in numbers))


def mask_of(*fails: Column) -> Column:
    """Bit k is set where condition k holds; a null condition doesn't."""
    out = F.lit(0)
    for k, c in enumerate(fails):
        out = out + F.when(c, 1 << k).otherwise(0)
    return out


def text_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of the filters A to D over whole texts, and the text's digest."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"))
    words = F.size("words")
    few, repeated = words < 200, 100 * F.size(F.array_distinct("words")) < 50 * words
    capitals, symbols = 100 * F.regexp_count("t", F.lit("[A-Z]")) > 3 * F.char_length("t"), F.col("t").rlike("[#$%&*|]")
    return split.select("doc_id", "part", mask_of(few, repeated, capitals, symbols).alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest"))


def mark_copies(found: DataFrame, bit: int) -> DataFrame:
    """Adds ``bit`` to the mask of rows whose digest a smaller doc_id has.

    The least doc_id of each digest comes back by digest and doc_id together, so a group of copies of any size is dealt
    out evenly."""
    firsts = found.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return found.join(firsts.hint("merge"), ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 1 << bit).otherwise(0))


def label_codes(labels: DataFrame) -> DataFrame:
    """doc_id and 1 for quality 1 plus 2 for toxic 1."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.groupBy("doc_id").agg((one("quality") + 2 * one("toxic")).alias("label"))


def op12_filters(spark, sf_dir) -> DataFrame:
    """Audit of five filters over all documents, by language."""
    small_batches(spark)
    found = stage(text_failures(documents(spark, sf_dir)), "filters-found")
    labels = label_codes(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))
    marked = mark_copies(found, FILTERS.index("E")).join(labels.hint("merge"), "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    cells = stage(count_cells(marked), "filters-cells")
    release(found)
    return report(cells)
