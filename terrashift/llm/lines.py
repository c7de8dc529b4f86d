"""Line dedup: an exact set-similarity join over lines, and removal of later matches.

A line's set is its distinct words, A-Z in lower case. Lines of equal sets form a class, whose first place in order of
(doc_id, row, line) stands for it. Two classes are linked when 100 * intersection >= PERCENT * union. A line is removed
when it isn't the first of its class, or when its class is linked to one whose first place is earlier.

The join orders a line's words by rarity (a count sketch of fixed size: any total order gives the same links, a good
one is fast), indexes only the prefix that two linked sets must share a word in, the shorter set's a little shorter, and
joins on those words with the length filter, the positional filter and a parity bitmap: words that differ flip at most
one bit each, so bitmaps of linked sets differ in few bits. Bitmaps have 64 bits, of large sets 128 or 256, which fold to
those of fewer, so that sets of any two sizes compare. What passes is verified on the full sets, which are made from
the texts again for the lines that need it.

Near copies in large numbers would make pairs by the square. So each class is first compared with a few earlier ones:
in ``KEYS`` MinHash buckets with the first class and the two right before it. A class that matches one of them is settled:
it has an earlier match, and no further one can change that. Only classes not settled probe the join; all classes stay
targets. So every class still gets its exact answer, and copies cost their number.

Defined results: lines without a word are never removed; null texts stay null; a text without removed lines stays as
it is; sets of under four words link only with their equals (that is the exact rule at 80 percent); repeated rows share
their places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, documents, flat_binary, gathered, in_bitmap, release, row_key, small_batches, stage, with_row
from .words import Words, mix

PERCENT = 80
CELLS = 1 << 20
FILTER_BITS = 1 << 24
KEYS = 3
BUCKETS = [f"bucket{i}" for i in range(KEYS)]
#: Sets of so many words have bitmaps of 128 and 256 bits too: in 64, large sets that share nothing look alike.
LONG, LONGER = 80, 200
#: A bucket is settled in from so many classes on: fewer are left to the join.
CROWD = 4
#: Rows of a bucket worked on at a time.
AT_A_TIME = 1 << 16
#: Rows of a bucket that a class is looked at against.
BEFORE = 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_A = np.random.default_rng(3).integers(1, 2**63, 2 * KEYS, dtype=np.uint64) | np.uint64(1)


def rarity(docs: DataFrame) -> Broadcast:
    """How often the words of each cell of a sketch occur, in steps of a sixth of a doubling; the sketch has CELLS cells
    whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for b in batches:
            cells += np.bincount((Words(b.column("text")).hashes & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        # Words met once in a task are as rare as unseen ones; leaving them out keeps what is sent small.
        at = np.flatnonzero(cells > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])

    counted = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(CELLS, np.uint8)
    sketch[counted["cell"].to_numpy()] = np.minimum(np.log2(counted["n"].to_numpy()) * 6, 255)
    return docs.sparkSession.sparkContext.broadcast(sketch)


def _sorted(owner: np.ndarray, rank: np.ndarray | None, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in order of (owner, rank, hash), each once: the owners, and where the words are in ``h``. Owner, rank, the
    first bits of the hash and the place are one number, as numbers are sorted faster than places; words of one line that
    agree in these bits are told apart after."""
    n = len(h)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = n.bit_length(), int(owner[-1] + 1).bit_length()
    left = 64 - low - high - (0 if rank is None else 8)
    if left <= 0:
        at = np.lexsort((h, owner) if rank is None else (h, rank, owner))
        at = at[np.concatenate(([True], (owner[at[1:]] != owner[at[:-1]]) | (h[at[1:]] != h[at[:-1]])))]
        return owner[at], at
    key = owner.astype(np.uint64) << np.uint64(64 - high) | np.arange(n, dtype=np.uint64)
    key |= h >> np.uint64(64 - left) << np.uint64(low)
    if rank is not None:
        key |= rank.astype(np.uint64) << np.uint64(low + left)
    key.sort()
    at = (key & np.uint64((1 << low) - 1)).astype(np.int64)
    key >>= np.uint64(low)
    same, sorted_h = key[1:] == key[:-1], h[at]
    apart = same & (sorted_h[1:] != sorted_h[:-1])
    if apart.any():
        run = np.concatenate(([0], np.cumsum(~same)))
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[1:][apart]] = True
        some = np.flatnonzero(mixed[run])
        at[some] = at[some][np.lexsort((sorted_h[some], run[some]))]
        sorted_h = h[at]
    first = np.concatenate(([True], ~same | (sorted_h[1:] != sorted_h[:-1])))
    return owner[at[first]], at[first]


class Sets:
    """The word sets of a batch's lines, flat: ``tokens`` by rarity within each line (by hash without a sketch), lines
    from ``starts``; ``row`` and ``line`` say which lines they are."""

    def __init__(self, texts: pa.Array, sketch: np.ndarray | None = None, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        w = Words(texts)
        first = np.ones(len(w.hashes), bool)
        first[1:] = (w.text[1:] != w.text[:-1]) | (w.line[1:] != w.line[:-1])
        at = np.flatnonzero(first)
        self.row, self.line = w.text[at], w.line[at]
        hashes, owner = w.hashes, np.cumsum(first) - 1
        if wanted is not None:
            keep = wanted(self.row, self.line)
            self.row, self.line = self.row[keep], self.line[keep]
            hashes, owner = hashes[keep[owner]], (np.cumsum(keep) - 1)[owner[keep[owner]]]
        self.owner, at = _sorted(owner, None if sketch is None else sketch[hashes & np.uint64(CELLS - 1)], hashes)
        self.tokens = hashes[at]
        self.n = np.bincount(self.owner, minlength=len(self.row))
        self.starts = np.cumsum(self.n) - self.n

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set: sums, so that the order of the words doesn't matter."""
        if not len(self.n):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h1, h2 = (np.add.reduceat(mix(self.tokens, m), self.starts) for m in (_M1, _M2))
        return mix(h1 + self.n.astype(np.uint64), _M2).view(np.int64), mix(h2, _M1).view(np.int64)


def line_sets(docs: DataFrame, sketch: Broadcast) -> DataFrame:
    """For each line with a word: doc_id, key, line, h1, h2 and, at the first of each class in a batch, the number of
    ``copies`` there and n, sig, w1, w2, w3, the buckets and prefix. A text without such lines gives a row with line -1 and nulls.
    ``sig`` is the bitmap folded to 64 bits; ``w1``, and ``w2`` and ``w3``, are what those of 128 and of 256 have besides."""
    share = PERCENT / 100
    names = ["doc_id", "key", "line", "h1", "h2", "copies", "n", "sig", "w1", "w2", "w3", *BUCKETS, "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sets(b.column("text"), sketch.value)
            none = pa.array(np.setdiff1d(np.arange(b.num_rows), s.row))
            if len(none):
                kinds = (*[pa.int64()] * 3, pa.int32(), *[pa.int64()] * (4 + KEYS), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(none), b.column("key").take(none), pa.array(np.full(len(none), -1, np.int32)), *(pa.nulls(len(none), k) for k in kinds)], names)
            if not len(s.n):
                continue
            h1, h2 = s.hashes()
            # The first of each class in order of (doc_id, key, line); rows are in this order by ``rank``.
            rank = np.empty(b.num_rows, np.int64)
            rank[pc.sort_indices(b.select(["doc_id", "key"]), sort_keys=[("doc_id", "ascending"), ("key", "ascending")], null_placement="at_end").to_numpy()] = np.arange(b.num_rows)
            order = np.lexsort((s.line, rank[s.row], h2, h1))
            new = np.concatenate(([True], (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])))
            head, copies = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
            head[order[new]] = True
            copies[order[new]] = np.diff(np.append(np.flatnonzero(new), len(order)))
            place = mix(s.tokens, _M2) >> np.uint64(56)
            bit, part = np.uint64(1) << (place & np.uint64(63)), place >> np.uint64(6)
            # The four parts of the bitmap of 256 bits: parts 0 and 2, and 1 and 3, fold to that of 128, and these to that of 64.
            parts = [np.bitwise_xor.reduceat(np.where(part == i, bit, np.uint64(0)), s.starts) for i in range(4)]
            wide = (parts[1] ^ parts[3], s.n >= LONG), (parts[2], s.n >= LONGER), (parts[3], s.n >= LONGER)
            sig = parts[0] ^ parts[1] ^ parts[2] ^ parts[3]
            least = [np.minimum.reduceat(mix(s.tokens * a, _M1), s.starts) for a in _A]
            buckets = [mix(least[2 * i] * _M2 ^ least[2 * i + 1] + np.uint64(i), _M1).view(np.int64) for i in range(KEYS)]
            place = np.arange(len(s.tokens)) - s.starts[s.owner]
            # In a shorter set every word counts: under four words only equal sets are linked.
            length = np.where((s.n < 4) | ~head, 0, s.n - np.ceil(share * s.n - 1e-9).astype(np.int64) + 1)
            prefix = (s.tokens[place < length[s.owner]] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            row, none = pa.array(s.row), ~head
            ends = pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32), mask=np.append(none, False))
            numbers = [pa.array(x, mask=none) for x in (copies, s.n.astype(np.int32), sig.view(np.int64), *(np.where(of, x, np.uint64(0)).view(np.int64) for x, of in wide), *buckets)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("key").take(row), pa.array(s.line), pa.array(h1), pa.array(h2), *numbers, pa.ListArray.from_arrays(ends, pa.array(prefix))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, key long, line int, h1 long, h2 long, copies long, n int, sig long, w1 long, w2 long, w3 long, {', '.join(f'{x} long' for x in BUCKETS)}, prefix array<int>"
    return docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(run, schema)


def _overlap(a: str, b: str) -> str:
    """The least number of words that linked sets share."""
    return f"ceil({PERCENT} * ({a}.n + {b}.n) / {100 + PERCENT}.0D - 1e-9)"


def _possible(a: str, b: str) -> str:
    """Length and bitmap filters between two sides."""
    x, x1, x2, x3 = (f"({a}.{w} ^ {b}.{w})" for w in ("sig", "w1", "w2", "w3"))
    wider = f"bit_count({x1}) + bit_count({x} ^ {x1})", f"bit_count({x2}) + bit_count({x3}) + bit_count({x1} ^ {x3}) + bit_count({x} ^ {x1} ^ {x2})"
    apart = f"case when least({a}.n, {b}.n) < {LONG} then bit_count({x}) when least({a}.n, {b}.n) < {LONGER} then {wider[0]} else {wider[1]} end"
    return f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n) and {apart} <= {a}.n + {b}.n - 2 * {_overlap(a, b)}"


def _by_prefix(a: str, b: str) -> str:
    """Same word of the prefixes; a is the shorter set, of which a shorter prefix is enough; positional filter."""
    indexed = f"{a}.place <= {a}.n - ceil({2 * PERCENT} * {a}.n / {100 + PERCENT}.0D - 1e-9)"
    return f"{a}.token = {b}.token and ({a}.n < {b}.n or {a}.n = {b}.n and {a}.node < {b}.node) and {indexed} and least({a}.n - {a}.place, {b}.n - {b}.place) >= {_overlap(a, b)} and {_possible(a, b)}"


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line")


def _shared_words(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """How many words the sets of each pair share: sets of all pairs in one array, with their sizes."""
    owner = np.concatenate((np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)))
    # A salt for each pair keeps its words together in one sort of all.
    h = np.concatenate((x, y)) ^ mix(owner.astype(np.uint64) + np.uint64(1), _M1)
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    return np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=len(nx))


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs a, b of classes those whose full sets are alike enough, staged. The sets come from the texts again."""
    place = classes.select("node", F.col("doc_id").alias("id"), F.col("key").alias("k"), F.col("line").alias("l"))
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(place, "node"), "lines-wanted")
    # Bitmaps of fixed size spare other texts and lines the work; the join that follows decides. Texts take the first
    # half of the bits, lines the second.
    mask = F.lit(FILTER_BITS - 1)
    text, line = F.col("k").bitwiseAND(mask), F.col("k").bitwiseXOR(F.col("l").cast("long") * 40503).bitwiseAND(mask) + FILTER_BITS
    shared = pairs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.explode(F.array(text, line)).alias("bit")), 2 * FILTER_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(half: int, value: np.ndarray) -> np.ndarray:
            return in_bitmap(shared.value, (value & (FILTER_BITS - 1)) + half * FILTER_BITS)

        for b in batches:
            b = b.take(pa.array(np.flatnonzero(marked(0, b.column("key").to_numpy()))))
            key = b.column("key").to_numpy()
            s = Sets(b.column("text"), wanted=lambda row, line, key=key: marked(1, key[row] ^ line.astype(np.int64) * 40503))
            row = pa.array(s.row)
            ends = np.concatenate(([0], np.cumsum(8 * s.n))).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(s.n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(s.tokens))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("key").take(row), pa.array(s.line), raw], ["doc_id", "key", "line", "set"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(sets, f"doc_id {kind}, key long, line int, set binary")
    same = (F.col("key") == F.col("k")) & (F.col("line") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("id"))
    found = stage(made.join(wanted, same).select("node", "set").dropDuplicates(["node"]), "lines-sets")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                (x, nx), (y, ny) = (flat_binary(b.column(c), np.uint64) for c in ("x", "y"))
                both = _shared_words(x, nx, y, ny)
                at = pa.array(np.flatnonzero(100 * both >= PERCENT * (nx + ny - both)))
                yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    left, right = (found.select(F.col("node").alias(i), F.col("set").alias(v)) for i, v in (("a", "x"), ("b", "y")))
    out = stage(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"), "lines-alike")
    release(wanted, found)
    return out


def leaders(classes: DataFrame) -> DataFrame:
    """a, b: each class b with some that come before it in a bucket, as far as the filters let it: the first, the one with
    the most places (copies differ less from what they are copied from than from each other, and that has the most), and
    of the ``BEFORE`` right before it the two whose bitmaps are nearest. The first ``CROWD`` of a bucket are left out. Buckets are sorted and streamed: a task holds
    so many rows of a bucket, however large."""
    rows = classes.filter("n >= 4").select(F.explode(F.array(*BUCKETS)).alias("bucket"), F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line", "node", "n", "sig", "places")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "none", "doc_id", "key", "line").select("bucket", "node", "n", "sig", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 5
        for b in gathered(batches, AT_A_TIME):
            done = len(held[0])
            bucket, node, n, sig, places = (np.concatenate((h, c.to_numpy().astype(np.int64))) for h, c in zip(held, b.columns, strict=True))
            at = np.arange(len(bucket))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], bucket[1:] != bucket[:-1])), at, 0))
            # The greatest of (bucket, places, earliest) so far ends in the index of the one with the most places.
            most = len(at) - 1 - (np.maximum.accumulate(start << 44 | np.minimum(places, (1 << 20) - 1) << 24 | len(at) - 1 - at) & (1 << 24) - 1)

            def possible(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                least = np.ceil(PERCENT * (n[i] + n[j]) / (100 + PERCENT) - 1e-9).astype(np.int64)
                apart = np.bitwise_count(sig[i] ^ sig[j]).astype(np.int64)
                return (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (apart <= n[i] + n[j] - 2 * least), apart

            far = 1 << 20
            best, second = np.full((2, len(at)), far), np.full((2, len(at)), far)  # distance and index
            i = at[(at - start >= CROWD) & (at >= done)]
            own = i
            for back in range(1, BEFORE + 1):
                i = i[i - back >= start[i]]
                if not len(i):
                    break
                ok, apart = possible(i, i - back)
                x, d = i[ok], apart[ok]
                nearer = d < best[0, x]
                second[:, x[nearer]] = best[:, x[nearer]]
                best[:, x[nearer]] = d[nearer], x[nearer] - back
                x, d = x[~nearer], d[~nearer]
                next_ = d < second[0, x]
                second[:, x[next_]] = d[next_], x[next_] - back
            found = []
            for before in (start[own], most[own - 1]):
                ok, _ = possible(own, before)
                found.append((node[before[ok]], node[own[ok]]))
            for near in (best, second):
                x = own[near[0, own] < far]
                found.append((node[near[1, x]], node[x]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])
            keep = sorted({int(start[-1]), int(most[-1]), *range(max(int(start[-1]), len(at) - BEFORE), len(at))})
            held = [x[keep] for x in (bucket, node, n, sig, places)]

    return rows.mapInArrow(run, "a long, b long").distinct()


def matched_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node of the classes that are linked to an earlier one, staged."""
    tried = stage(leaders(classes), "lines-leaders")
    alike = verify(tried, classes, docs)
    settled = stage(alike.select(F.col("b").alias("node")).distinct(), "lines-settled")
    release(tried, alike)
    rows = classes.filter("n >= 4").join(settled.withColumn("done", F.lit(True)), "node", "left").select(F.posexplode("prefix").alias("place", "token"), "node", "n", "sig", "w1", "w2", "w3", F.coalesce("done", F.lit(False)).alias("done"))
    # Only a class that isn't settled has to be answered. Which is earlier is seen after: rows without the place are
    # shorter, and these rows are most of what is on disk at a time.
    near = rows.alias("a").join(rows.alias("b"), F.expr(f"{_by_prefix('a', 'b')} and not (a.done and b.done)"))
    pairs = stage(near.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "lines-pairs")
    links = verify(pairs, classes, docs)
    place = classes.select("node", _first().alias("at"))
    ended = links.join(place.select(F.col("node").alias("a"), F.col("at").alias("pa")), "a").join(place.select(F.col("node").alias("b"), F.col("at").alias("pb")), "b")
    answered = ended.select(F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("node"))
    out = stage(settled.unionByName(answered).distinct(), "lines-matched")
    release(settled, pairs, links)
    return out


def class_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, line, h1, h2 of the lines, and a row for each class: node, its first line in order of (doc_id, row,
    line), the number of its ``places`` and what the join needs."""
    rest = ("n", "sig", "w1", "w2", "w3", *BUCKETS, "prefix")
    rows = stage(line_sets(docs, rarity(docs)), "lines-rows")
    # Copies within a batch are one row here already, so rows go to their class at once and are sorted there alone.
    heads = rows.filter("copies is not null").repartition("h1", "h2")
    grouped = heads.groupBy("h1", "h2").agg(F.min(_first()).alias("at"), F.sum("copies").alias("places"), F.first(F.struct(*rest)).alias("rest"))
    classes = grouped.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "at.doc_id", "at.key", "at.line", (F.col("places") > 1).alias("copied"), "places", "rest.*")
    classes = stage(classes, "lines-classes")
    places = stage(rows.select("doc_id", "key", "line", "h1", "h2"), "lines-places")
    release(rows)
    return places, classes


def class_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: every pair of different classes that are alike, once each, whether settled for removal or not. By the
    prefix join alone, so it costs what its pairs cost: a family of k like classes has k * (k - 1) / 2 of them."""
    rows = classes.filter("n >= 4").select(F.posexplode("prefix").alias("place", "token"), "node", "n", "sig", "w1", "w2", "w3")
    near = rows.alias("a").join(rows.alias("b"), F.expr(_by_prefix("a", "b")))
    return verify(stage(near.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "lines-all-pairs"), classes, docs)


def removed_lines(docs: DataFrame, used: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, key, n_lines (with a word), n_links (lines whose set is alike to some earlier, different set: not the number of links, which is ``class_links``), removed (line numbers):
    a row for each text. ``used`` gets the staged tables that the result reads."""
    docs = docs.select("doc_id", "text")
    rows, classes = class_sets(docs)
    matched = matched_classes(docs, classes)
    verdict = classes.join(matched.withColumn("linked", F.lit(True)), "node", "left").filter("copied or linked").select("h1", "h2", _first().alias("at"), F.coalesce("linked", F.lit(False)).alias("linked"))
    verdict = stage(verdict, "lines-verdict")
    release(classes, matched)
    if used is not None:
        used += [rows, verdict]
    # Lines of classes with one place and no link need no verdict. What grows with the input is merged, not broadcast,
    # so the plan is the same at every size.
    judged = rows.filter("line >= 0").join(verdict.hint("merge"), ["h1", "h2"])
    gone = F.col("linked") | (_first() != F.col("at"))
    found = judged.groupBy("doc_id", "key").agg(F.count_if("linked").alias("n_links"), F.collect_set(F.when(gone, F.col("line"))).alias("removed"))
    counted = rows.groupBy("doc_id", "key").agg(F.count_if(F.col("line") >= 0).alias("n_lines"))
    found = found.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "n_links", "removed")
    both = counted.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    none = F.array().cast("array<int>")
    return both.select("doc_id", "key", "n_lines", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.array_sort(F.coalesce("removed", none)).alias("removed"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines of ``text``."""
    used: list[DataFrame] = []
    gone = stage(removed_lines(docs, used).filter(F.size("removed") > 0).select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "removed"), "lines-removed")
    release(*used)
    joined = with_row(docs, doc_id=F.col("doc_id"), key=row_key()).join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(text, gone, strict=True):
            if t is not None and g is not None:
                drop = set(map(int, g))
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
            out.append(t)
        return pd.Series(out, dtype=object)

    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(cut("row.text", "removed"))
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op3_lines(spark, sf_dir) -> DataFrame:
    """Every document: its lines with words, those whose set is alike to an earlier one, and the numbers of those removed.
    The links themselves are in ``op3_links``."""
    small_batches(spark)
    return removed_lines(documents(spark, sf_dir)).select("doc_id", F.col("n_lines"), F.col("n_links"), F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.transform("removed", lambda x: x.cast("string"))).alias("removed"))


def op3_links(spark, sf_dir) -> DataFrame:
    """The similarity join whole: every pair of alike, different lines, each by the first place of its set, the earlier first."""
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    _, classes = class_sets(docs)
    left, right = (classes.select(F.col("node").alias(i), _first().alias(f"p{i}")) for i in ("a", "b"))
    ends = class_links(docs, classes).join(left, "a").join(right, "b").select(F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y"))
    return ends.select(F.col("x.doc_id").alias("doc_a"), F.col("x.line").alias("line_a"), F.col("y.doc_id").alias("doc_b"), F.col("y.line").alias("line_b"))


def op3_members(spark, sf_dir) -> DataFrame:
    """Every line with a word, and the first place of its set: what ``op3_links`` names."""
    small_batches(spark)
    rows, classes = class_sets(documents(spark, sf_dir).select("doc_id", "text"))
    place = classes.select("h1", "h2", F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"))
    return rows.filter("line >= 0").select("doc_id", "line", "h1", "h2").join(place, ["h1", "h2"]).select("doc_id", "line", "first_doc", "first_line")


def stage_lines(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """All documents, without later matches among their lines; their columns."""
    small_batches(spark)
    return deduplicate(docs)
