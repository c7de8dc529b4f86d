"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets form a class first, so copies cost nothing further. Classes get MinHash signatures;
classes that agree on a band of a signature are candidates. A candidate pair is compared batch by batch of the
signature: with m of n values equal, the similarity's posterior under a uniform prior is Beta(m + 1, n - m + 1), and
the pair is dropped as soon as the posterior gives at most ``MISS`` to a similarity of the threshold or more. Survivors
are verified on the full shingle sets. Links between classes become components.

Large groups. At first each class meets a few others: of the leads of its buckets those that it shares most buckets
with. The lead of a bucket is its most central class, the one with most company in all its buckets, as copies with few
edits link with more of the others than copies with many. Verified links are contracted to components. Only what shares
a bucket across components is left then: in each such bucket the largest component's members are dealt to blocks, and
so are all others; others meet the largest component and each other, block against block within tasks, where the same
batches prune and the full sets decide. A task yields no more links than join its components, so copies and near copies
cost their number in rows, not its square, and no link that matters to a component is lost.

Defined results: null, empty and white-space texts have an empty set, link with nothing and are kept; repeated rows are
a document each time and all get the component of their text; a null doc_id never becomes a component's id unless
nothing else is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, documents, in_bitmap, release, row_key, small_batches, stage, with_row
from .words import Words

BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
BATCH = 24
MISS = 1e-6
BLOCK = 512
FILTER_BITS = 1 << 24
#: Leads that a class is compared with before components are formed.
LEADS = 3
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_seeds = np.random.default_rng(9)
_A = _seeds.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _seeds.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of k words."""
    h = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for i in range(k):
        h = (h ^ words[i : len(words) - k + 1 + i]) * _MIX1
        h ^= h >> np.uint64(29)
    # The length keeps a short text apart from a shingle of the same words in a longer one.
    return (h + np.uint64(k)) * _MIX2


def shingle_sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; of one with fewer words the whole sequence as one."""
    w = Words(texts)
    sizes = np.bincount(w.text, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    all_k = shingle_hashes(w.hashes, k)
    out = []
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        out.append(np.unique(all_k[a : a + n - k + 1]) if n >= k else shingle_hashes(w.hashes[a : a + n], n) if n else np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least values of HASHES linear permutations of 32 bits of the shingles' hashes."""
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 4096):
        part = _A[:, None] * x[None, i : i + 4096]
        part += _B[:, None]
        np.minimum(out, part.min(1), out=out)
    return out


@lru_cache(16)
def fewest_equal(threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch end n: the fewest equal values with which the posterior still gives more than ``miss`` to a
    similarity of at least ``threshold``. P(J >= t | m of n) is the chance of at most m successes in n + 1 trials at t."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total <= miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def agree(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two signature matrices survive: batches of values are compared for the rows still open."""
    open_rows, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(fewest_equal(threshold, MISS)):
        s = slice(k * BATCH, (k + 1) * BATCH)
        equal[open_rows] += (a[open_rows, s] == b[open_rows, s]).sum(1, dtype=np.int32)
        open_rows = open_rows[equal[open_rows] >= least]
    return open_rows


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key, h1, h2 (hash of the set), n_shingles, sig (binary; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, sizes, sigs = [], [], [], []
            for s in shingle_sets_of(b.column("text"), k):
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                h1.append((d >> 64) - (1 << 63))
                h2.append((d & (1 << 64) - 1) - (1 << 63))
                sizes.append(len(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "key", "h1", "h2", "n_shingles", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(run, f"doc_id {kind}, key long, h1 long, h2 long, n_shingles long, sig binary")


def bands(classes: DataFrame) -> DataFrame:
    """node, bucket: a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(ROWS):
                h = (h ^ sig[:, :, r]) * _MIX1
                h ^= h >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("node").to_numpy(), BANDS)), pa.array(h.reshape(-1).view(np.int64))], ["node", "bucket"])

    return classes.select("node", "sig").mapInArrow(run, "node long, bucket long")


def prune(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose signatures and sizes allow the threshold."""
    # Sizes alone decide many pairs.
    sized = classes.select("node", "n_shingles", "sig")
    joined = pairs.join(sized.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a").join(sized.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b")
    joined = joined.filter(F.least("na", "nb") >= F.greatest("na", "nb") * (threshold - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
                keep = pa.array(agree(sa, sb, threshold))
                yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """node, set: the full shingle sets of ``nodes``, from the texts again."""
    wanted = stage(classes.join(nodes, "node").select("node", "first_id", "first_key"), "minhash-wanted")
    # A bitmap of fixed size spares the texts of other rows the shuffle; the join that follows decides.
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.pmod("first_key", F.lit(FILTER_BITS)).alias("bit")), FILTER_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pa.array(np.flatnonzero(in_bitmap(shared.value, b.column("key").to_numpy() % FILTER_BITS))))
            out = [s.tobytes() for s in shingle_sets_of(b.column("text"), k)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(out, pa.binary())], ["doc_id", "key", "set"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(sets, f"doc_id {kind}, key long, set binary")
    same = (F.col("key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    found = stage(read.join(wanted, same).dropDuplicates(["node"]).select("node", "set"), "minhash-sets")
    release(wanted)
    return found


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)
            keep = [i for i, (x, y) in enumerate(both) if alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def lead_pairs(buckets: DataFrame) -> DataFrame:
    """a < b: each class with the ``LEADS`` leads that it shares most buckets with. ``buckets``: node, bucket, size."""
    central = buckets.groupBy("node").agg(F.sum("size").alias("central"))
    member = buckets.join(central, "node")
    lead = member.groupBy("bucket").agg(F.max(F.struct("central", "node"))["node"].alias("lead"))
    met = member.join(lead, "bucket").filter("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("c"))
    # A class has at most one lead a band.
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "lead")), False), 1, LEADS).alias("best")).select("node", F.explode("best.lead").alias("lead"))
    return best.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def components(nodes: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root: the smallest node reachable over ``links``, staged. Labels spread to neighbours, then jump to their own
    label's label, so long chains take a logarithmic number of rounds; a round's labels go when the next are written."""
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-links")
    labels = stage(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "components-labels")
    last = labels
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # A label is a node as well: take over its label.
        jump = spread.join(spread.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").select("node", "old", F.least("root", "further").alias("root"))
        jump = stage(jump, "components-labels")
        release(last)
        last, labels = jump, jump.select("node", "root")
        if jump.filter(F.col("root") != F.col("old")).isEmpty():
            found = stage(nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "components")
            release(last, both)
            return found
    raise RuntimeError(f"components did not settle in {rounds} rounds")


class Joined(dict):
    """Components joined so far within a task."""

    def root(self, x: int) -> int:
        while x in self:
            x = self[x]
        return x


def across(rows: pa.Table, threshold: float, percent: int, joined: Joined) -> list[tuple[int, int]]:
    """Links that join the components of two blocks of a bucket, or of one with itself: as many as it takes beyond those
    ``joined`` already."""
    rows = rows.sort_by("node")
    p, q = rows["p"][0].as_py(), rows["q"][0].as_py()
    node, root, size, own = (rows[c].to_numpy() for c in ("node", "root", "n_shingles", "own"))
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
    sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
    out = []
    right = np.flatnonzero(own == q)
    for i in np.flatnonzero(own == p):
        others = right[right > i] if p == q else right
        others = others[(root[others] != root[i]) & (np.minimum(size[others], size[i]) >= np.maximum(size[others], size[i]) * (threshold - 1e-9))]
        if not len(others):
            continue
        for j in others[agree(np.broadcast_to(sig[i], (len(others), HASHES)), sig[others], threshold)]:
            x, y = joined.root(int(root[i])), joined.root(int(root[j]))
            if x != y and alike(sets[i], sets[j], percent):
                joined[max(x, y)] = min(x, y)
                out.append((int(node[i]), int(node[j])))
    return out


def rest_links(buckets: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links between members of a bucket that lie in different components: enough of them to join what is linked."""
    member = buckets.select("bucket", "node").join(labels, "node")
    per = member.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket")
    mixed = per.agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("size"), F.count("*").alias("roots")).filter("roots > 1")
    mixed = mixed.select("bucket", F.col("most.root").alias("major"), F.ceil(F.col("most.c") / BLOCK).cast("int").alias("nm"), (F.col("size") - F.col("most.c")).alias("few"))
    mixed = mixed.withColumn("nf", F.ceil(F.col("few") / BLOCK).cast("int"))
    rows = member.join(mixed, "bucket").withColumn("own", F.when(F.col("root") == F.col("major"), F.col("nf") + F.pmod(F.xxhash64("node"), F.col("nm"))).otherwise(F.pmod(F.xxhash64("node"), F.col("nf"))).cast("int"))
    # Blocks under nf hold the others. A row goes to each pair of blocks that its own is part of.
    to_few = "transform(sequence(0, nf - 1), i -> struct(least(i, own) as p, greatest(i, own) as q))"
    to_most = "transform(sequence(nf, nf + nm - 1), i -> struct(own as p, i as q))"
    pairs = F.expr(f"if(own >= nf, {to_few}, if(few = 1, {to_most}, concat({to_few}, {to_most})))")
    dealt = rows.select("bucket", "node", "root", "own", F.explode(pairs).alias("pq")).select("bucket", "pq.p", "pq.q", "node", "root", "own")
    dealt = dealt.join(classes.select("node", "n_shingles", "sig"), "node").join(sets, "node")
    dealt = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = None, Joined()

        def settle(table: pa.Table, last: bool) -> tuple[list[tuple[int, int]], pa.Table | None]:
            """Links of the groups that are complete, and the rows of the one that may go on."""
            key = [table[c].to_numpy() for c in ("bucket", "p", "q")]
            at = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])))).tolist() + [table.num_rows]
            out: list[tuple[int, int]] = []
            for a, z in zip(at if last else at[:-1], at[1:] if last else at[1:-1], strict=False):
                if z - a > 1:
                    out += across(table.slice(a, z - a), threshold, percent, joined)
            return out, None if last else table.slice(at[-2])

        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            if b.num_rows:
                table = pa.Table.from_batches([b])
                found, held = settle(table if held is None else pa.concat_tables([held, table]).combine_chunks(), False)
                yield batch(found)
        if held is not None:
            yield batch(settle(held, True)[0])

    return dealt.mapInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, used: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept for every row of ``docs``. ``used`` gets the staged tables that the result
    reads."""
    threshold = percent / 100
    rows = docs.select("doc_id", "text")
    signed = stage(shingle_sets(rows, k), "minhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    grouped = signed.filter("n_shingles > 0").groupBy("h1", "h2").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = stage(grouped.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"), "n_shingles", "sig"), "minhash-classes")
    sets = stage(signed.drop("sig"), "minhash-sizes")
    release(signed)
    banded = bands(classes)
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stage(banded.join(shared, "bucket"), "minhash-buckets")
    sets_of = full_sets(buckets.select("node").distinct(), classes, rows, k)
    tried = stage(prune(lead_pairs(buckets), classes, threshold), "minhash-tried")
    links = stage(verify(tried, sets_of, percent), "minhash-links")
    labels = components(classes, links)
    # Then whatever shares a bucket across components.
    more = stage(rest_links(buckets, labels, classes, sets_of, threshold, percent), "minhash-links")
    if not more.isEmpty():
        release(labels)
        labels = components(classes, links.unionByName(more))
    member = classes.select("node", "h1", "h2", "first_id").join(labels, "node")
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component"))
    member = stage(member.join(smallest, "root").select("h1", "h2", "component"), "minhash-member")
    release(classes, buckets, sets_of, tried, links, more, labels)
    if used is not None:
        used += [sets, member]
    own = F.coalesce("component", "doc_id")
    joined = sets.join(member, ["h1", "h2"], "left")
    return joined.select("doc_id", "key", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def op9_minhash(spark, sf_dir) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are alike to 80 percent."""
    small_batches(spark)
    return near_duplicates(documents(spark, sf_dir), k=4).drop("key")


def stage_minhash(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles), of a row and its repeats one; rows without
    words all stay. Their columns."""
    small_batches(spark)
    used: list[DataFrame] = []
    kept = stage(near_duplicates(docs, used=used).filter("kept").groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(F.max("n_shingles").alias("n")), "minhash-kept")
    release(*used)
    # By id and text together: two texts that share a hash stay two.
    rows = with_row(docs, doc_id=F.col("doc_id"), key=row_key()).join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
    one = rows.withColumn("copy", F.when(F.col("n") == 0, F.monotonically_increasing_id())).dropDuplicates(["doc_id", "key", "copy"])
    return one.select("row.*")
