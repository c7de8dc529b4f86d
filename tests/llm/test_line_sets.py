"""Line sets: words once a line in one order everywhere, and what the join lets through."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrashift.llm import lines
from terrashift.llm.words import Words


def test_sets_are_ordered_alike_in_every_batch():
    rng = np.random.default_rng(1)
    texts = ["\n".join(" ".join(f"w{i}" for i in rng.integers(0, 400, rng.integers(0, 60))) for _ in range(rng.integers(0, 6))) for _ in range(50)]
    sketch = rng.integers(0, 4, lines.CELLS).astype(np.uint8)
    s, at = lines.Sets(pa.array(texts), sketch), 0
    for row, text in enumerate(texts):
        for line, words in enumerate(text.split("\n")):
            if words:
                h = np.unique(Words(pa.array([words])).hashes)
                want = h[np.lexsort((h, sketch[h & np.uint64(lines.CELLS - 1)]))]
                assert (s.row[at], s.line[at]) == (row, line)
                assert np.array_equal(s.tokens[s.starts[at] : s.starts[at] + s.n[at]], want)
                at += 1
    assert at == len(s.n)


def test_words_that_agree_in_their_first_bits_are_told_apart():
    h = np.array([5, 3, 5, 4, 3, 4, 9, 5], np.uint64)
    owner = np.array([0, 0, 0, 0, 1, 1, 1, 1])
    owners, at = lines._sorted(owner, None, h)
    assert list(zip(owners, h[at], strict=True)) == [(0, 3), (0, 4), (0, 5), (1, 3), (1, 4), (1, 5), (1, 9)]


@pytest.mark.parametrize("size", [60, 120, 180, 300])
def test_large_sets_that_share_few_words_are_not_compared(spark, size):
    """Bitmaps of 64 bits are about half full for any large set, so each two that shared a rare word were verified."""
    texts = [(i, " ".join(f"x{i}y{j}" for j in range(size - 1)) + " shared") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sketch = spark.sparkContext.broadcast(np.zeros(lines.CELLS, np.uint8))
    rows = lines.line_sets(docs, sketch).select("doc_id", "n", "sig", "w1", "w2", "w3")
    pairs = rows.alias("a").join(rows.alias("b"), F.expr(f"a.doc_id < b.doc_id and {lines._possible('a', 'b')}"))
    assert pairs.count() == 0


def test_links_hold_across_the_widths_of_bitmaps(spark):
    """Sizes on both sides of LONG and LONGER: no filter may part what is linked."""
    sizes = [n + d for n in (lines.LONG, lines.LONGER) for d in (-9, -1, 0, 9)]
    texts = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in lines.removed_lines(docs).collect()}
    assert got == {i: int(any(100 * min(m, n) >= 80 * max(m, n) for m in sizes[:i])) for i, n in enumerate(sizes)}
