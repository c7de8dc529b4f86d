"""LM scoring: context-tree weighting over the byte stream of a text.

A text is coded as its tokens, one blank between two and a stop at the end, in UTF-8 bytes. The context of a byte is the
``DEPTH`` bytes before it, across the ends of words; before the text stand start marks. Each byte is decomposed into
eight binary choices; every choice has a binary context tree of its own, whose nodes hold Krichevsky-Trofimov estimates,
and the tree mixes all depths from 0 to ``DEPTH`` with the weights

    Pw(node) = 1/2 Pe(node) + 1/2 product of Pw(children).

Everything learnt is counts over the training rows, so a node's share of the mixture is fixed once the corpus is read:
the code length of a byte depends on its context alone, and that of a text is a sum over its (context, byte) events.

As Spark jobs: tasks count their own events by sorting them as numbers, and one shuffle by the last ``SUFFIX`` bytes of
the context sums them. Everything deeper in the tree lies within a task then: sorted by context, whole subtrees are
worked off a piece at a time, once upwards (what they give the nodes above) and once downwards (the events' code
lengths). The few levels above are one small table. Of the events and words with their scores the ``HEAD`` most frequent
go to the tasks by broadcast (a bound whatever the corpus); the others meet the texts in a join.

Defined results: a null or empty text is the end token alone; an empty training set scores by the estimates' prior;
repeated rows get equal scores; a text's own zero bytes and controls are bytes like others. Texts of any length are
scored whole: arrays are as long as a batch, and a batch is bounded in bytes by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, release, small_batches, stage

DEPTH = 6
#: Levels up to here are worked out in one place: at most 2^(8 * (SUFFIX - 1)) contexts with 255 nodes each.
SUFFIX = 3
#: So many events and words, the most frequent, are broadcast with their scores.
HEAD = 1 << 21
HEAD_WORDS = 300_000
#: Events that a task holds before it sends them on, and that it works off at a time.
HELD, PIECE = 4_000_000, 400_000
#: Bytes of a batch that are turned into events at a time: memory doesn't follow the length of a text.
BLOCK = 1 << 18
#: Bytes that no UTF-8 text has.
START, STOP = 0xFE, 0xFF
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LN2 = 0.6931471805599453


# --- a batch's bytes and words ---------------------------------------------------------------------------------------


def stream(texts: pa.Array, depth: int = DEPTH) -> np.ndarray:
    """The batch as one array of bytes: for each text start marks, its words with a blank between two, a stop."""
    low = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.binary())
    joined = pc.binary_join_element_wise(pa.scalar(bytes([START]) * depth), low, pa.scalar(bytes([STOP])), pa.scalar(b""))
    if not len(joined):
        return np.empty(0, np.uint8)
    ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
    flat = np.frombuffer(joined.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    blank = _SPACE[flat]
    if not blank.any():
        return flat
    # Of a run of blanks the last stays, unless it is at either end of the text.
    flat = np.where(blank, np.uint8(0x20), flat)[~blank | ~np.append(blank[1:], False)]
    blank = flat == 0x20
    edge = np.append(flat[1:] == STOP, False) | np.insert(flat[:-1] == START, 0, False)
    return flat[~(blank & edge)]


def events(flat: np.ndarray, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each coded byte, ``BLOCK`` of them at a time: context and byte as a number, the latest byte of the context
    highest and the byte itself lowest; and the index of its text."""
    done = 0
    for at in range(depth, len(flat), BLOCK):
        part = flat[at : at + BLOCK]
        key = part.astype(np.int64)
        for d in range(1, depth + 1):
            key |= flat[at - d : at - d + len(part)].astype(np.int64) << np.int64(8 * (depth - d + 1))
        coded, stops = part != START, part == STOP
        owner = done + np.cumsum(stops) - stops
        done += int(stops.sum())
        yield key[coded], owner[coded]


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each distinct value starts."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.empty(0, np.int64)


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` (1 each) of each."""
    if n is None:
        keys = np.sort(keys)
        at = _runs(keys)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys)
    keys = keys[order]
    at = _runs(keys)
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n


class Tokens:
    """The words of a batch: ``index`` into its distinct ``words``, and the ``owner`` (index of the text) of each."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        each, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
        real = pc.greater(pc.binary_length(each), 0)
        coded = each.filter(real).dictionary_encode()
        self.words, self.index, self.owner = coded.dictionary.to_pylist(), coded.indices.to_numpy(), owner[real.to_numpy(zero_copy_only=False)]


def count_events(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, n: how often each event occurs in the training rows; n is 0 for those of the other rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _counted(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000]), pa.array(n[i : i + 200_000])], ["key", "n"])

        for b in batches:
            train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for key, owner in events(stream(b.column("text"), depth), depth):
                learnt = train[owner]
                held += [_counted(key[learnt]), (other := np.unique(key[~learnt]), np.zeros(len(other), np.int64))]
                size += sum(len(k) for k, _ in held[-2:])
                if size > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield from out(*held[0])
                        held = []
                    size = sum(len(k) for k, _ in held)
        if held:
            yield from out(*merged())

    counted = docs.select("text", "train").mapInArrow(run, "key long, n long").withColumn("suffix", F.shiftright("key", 8 * (depth - SUFFIX + 1)))
    # Tasks send an event once or a few times: sums before the shuffle would find nothing to add.
    return counted.repartition("suffix").groupBy("suffix", "key").agg(F.sum("n").alias("n")).select("key", "n")


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: the words of the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            words, counts = list(seen), list(seen.values())
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.string()), pa.array(counts[i : i + 50_000], pa.int64())], ["word", "c"])
            seen.clear()

        for b in batches:
            t = Tokens(b.column("text"))
            for w, c in zip(t.words, np.bincount(t.index, minlength=len(t.words)).tolist(), strict=True):
                seen[w] = seen.get(w, 0) + c
            if len(seen) > 400_000:
                yield from out()
        yield from out()

    return docs.filter("train").select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


# --- the tree --------------------------------------------------------------------------------------------------------

_KNOWN = 1 << 16
_HALF = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_KNOWN) + 0.5))))
_WHOLE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, _KNOWN + 1)))))


def _stirling(y: np.ndarray) -> np.ndarray:
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    if not len(a) or int((a + b).max()) < _KNOWN:
        return _HALF[a] + _HALF[b] - _WHOLE[a + b]
    half = lambda x: np.where(x < _KNOWN, _HALF[np.minimum(x, _KNOWN)], _stirling(np.maximum(x, 1) + 0.5) - 0.5723649429247001)
    whole = np.where(a + b < _KNOWN, _WHOLE[np.minimum(a + b, _KNOWN)], _stirling(np.maximum(a + b, 1) + 1.0))
    return half(a) + half(b) - whole


class Level:
    """Nodes of one depth and one of the eight choices: ``key`` (context, then the bits so far with a leading one), counts
    ``n0`` and ``n1``, and the log weights of their own estimate and of the mixture."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.n0, self.n1 = key, n0, n1
        pe = log_kt(n0, n1)
        if below is None:
            self.pw, self.stop = pe, np.ones(len(pe))
        else:
            gap = below - pe
            self.stop = 1 / (1 + np.exp(np.minimum(gap, 700.0)))
            self.pw = np.maximum(pe, below) + np.log1p(np.exp(-np.abs(gap))) - _LN2
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)

    def above(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the nodes one level up, their counts and what lies below them; and each node's place among them."""
        key = self.key >> 16 << 8 | self.key & 255
        order = np.argsort(key)
        at = _runs(key[order])
        place = np.empty(len(key), np.int64)
        place[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
        n0, n1, below = (np.add.reduceat(x[order], at) if len(at) else x for x in (self.n0, self.n1, self.pw))
        return key[order][at], n0, n1, below, place

    def mix(self, mix: np.ndarray, left: np.ndarray) -> None:
        """``p`` settled down to this depth and the weight ``left`` for deeper ones, from those of the nodes above."""
        self.p = mix + left * self.stop * self.one
        self.left = left * (1 - self.stop)


def leaves(key: np.ndarray, n: np.ndarray, choice: int) -> tuple[Level, np.ndarray]:
    """The deepest level of one choice from sorted events, and each event's node in it."""
    byte = key & 255
    node = key >> 8 << 8 | (byte | 256) >> (8 - choice)
    at = _runs(node)
    place = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(node))))
    bit = byte >> (7 - choice) & 1
    n1 = np.bincount(place, weights=n * bit, minlength=len(at)).astype(np.int64)
    return Level(node[at], np.bincount(place, weights=n, minlength=len(at)).astype(np.int64) - n1, n1, None), place


def branches(key: np.ndarray, n: np.ndarray, choice: int, depth: int, top: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels ``depth`` to ``top`` of one choice, and for each the places of its nodes (at first: events) in the one after."""
    level, place = leaves(key, n, choice)
    levels, places = [level], [place]
    for _ in range(depth - top):
        up = levels[-1].above()
        levels.append(Level(*up[:4]))
        places.append(up[4])
    return levels, places


def _pieces(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted events, some at a time, cut between suffixes."""
    keys, counts = [], []
    for b in batches:
        keys.append(b.column("key").to_numpy())
        counts.append(b.column("n").to_numpy())
        if sum(map(len, keys)) >= PIECE:
            key, n = np.concatenate(keys), np.concatenate(counts)
            suffix = key >> 8 * (depth - SUFFIX + 1)
            cut = int(np.searchsorted(suffix, suffix[-1]))
            if cut:
                yield key[:cut], n[:cut]
            keys, counts = [key[cut:]], [n[cut:]]
    if sum(map(len, keys)):
        yield np.concatenate(keys), np.concatenate(counts)


def _by_suffix(counts: DataFrame, depth: int) -> DataFrame:
    return counts.repartition(F.shiftright("key", 8 * (depth - SUFFIX + 1))).sortWithinPartitions("key")


class Top:
    """The levels above the suffixes, whole: nodes in order of key for each depth, with ``p`` and ``left``."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    def find(self, key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which nodes there are at a depth; their p and left."""
        keys, p, left = self.levels[level]
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key)), np.zeros(len(key))
        return keys[at] == key, p[at], left[at]


def top_levels(counts: DataFrame, depth: int = DEPTH) -> Top:
    """One pass upwards over all events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _pieces(batches, depth):
            key, n = key[n > 0], n[n > 0]
            for choice in range(8):
                levels, _ = branches(key, n, choice, depth, SUFFIX)
                up = levels[-1].above()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in up[:4]], ["key", "n0", "n1", "below"])

    parts = _by_suffix(counts, depth).mapInArrow(run, "key long, n0 long, n1 long, below double").groupBy("key")
    got = parts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toArrow().sort_by("key")
    level = Level(*(got[c].to_numpy() for c in ("key", "n0", "n1", "below")))
    levels, places = [level], []
    for _ in range(SUFFIX - 1):
        up = levels[-1].above()
        levels.append(Level(*up[:4]))
        places.append(up[4])
    mix, left = np.zeros(len(levels[-1].key)), np.ones(len(levels[-1].key))
    for k in range(len(levels) - 1, -1, -1):
        levels[k].mix(mix, left)
        if k:
            mix, left = levels[k].p[places[k - 1]], levels[k].left[places[k - 1]]
    return Top([(x.key, x.p, x.left) for x in levels[::-1]])


def score_events(key: np.ndarray, n: np.ndarray, top: Top, depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each of the sorted events, whole suffixes of them."""
    lp, seen = np.zeros(len(key)), n > 0
    for choice in range(8):
        bit = (key >> (7 - choice) & 1).astype(bool)
        p1 = np.full(len(key), 0.5)
        levels, places = branches(key[seen], n[seen], choice, depth, SUFFIX)
        up = levels[-1].key >> 16 << 8 | levels[-1].key & 255
        _, mix, left = top.find(up, SUFFIX - 1)
        for level, place in zip(levels[::-1], places[::-1], strict=True):
            level.mix(mix, left)
            mix, left = level.p[place], level.left[place]
        p1[seen] = mix
        # An event never seen in training goes by its deepest node that was; below that all counts are none.
        todo = np.flatnonzero(~seen)
        node = (key[todo] & 255 | 256) >> (8 - choice)
        for d in range(depth, -1, -1):
            if not len(todo):
                break
            want = key[todo] >> 8 * (depth - d + 1) << 8 | node
            if d >= SUFFIX:
                level = levels[depth - d]
                at = np.minimum(np.searchsorted(level.key, want), max(len(level.key) - 1, 0))
                found = level.key[at] == want if len(level.key) else np.zeros(len(want), bool)
                p1[todo[found]] = level.p[at[found]] + level.left[at[found]] * 0.5
            else:
                found, p, left = top.find(want, d)
                p1[todo[found]] = p[found] + left[found] * 0.5
            todo, node = todo[~found], node[~found]
        lp += np.log10(np.where(bit, p1, 1 - p1))
    return lp


def event_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, n, lp of every event of ``counts``."""
    shared = counts.sparkSession.sparkContext.broadcast(top_levels(counts, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _pieces(batches, depth):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(score_events(key, n, shared.value, depth))], ["key", "n", "lp"])

    return _by_suffix(counts, depth).mapInArrow(run, "key long, n long, lp double")


# --- texts -----------------------------------------------------------------------------------------------------------


def most_frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of the highest counts, at most ``most``: those from the least size of counts on that leaves no more than that."""
    table = table.filter(F.col(count) > 0).withColumn("size", F.floor(16 * F.log2(count)))
    total, least = 0, 1 << 30
    for r in sorted(table.groupBy("size").agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["size"]):
        total += r.rows
        if total > most:
            break
        least = r["size"]
    return table.filter(F.col("size") >= least).drop("size")


class HashTable:
    """Numbers to values, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[todo[free]]
            # Of several that took the same place the last is there.
            mine = self.keys[slot] == keys[todo]
            self.values[slot[mine]] = values[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and which are missing."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], 0.0)
        todo, missing = np.flatnonzero(there != keys), np.zeros(len(keys), bool)
        while len(todo):
            none = self.keys[slot[todo]] < 0
            missing[todo[none]] = True
            todo = todo[~none]
            slot[todo] = slot[todo] + 1 & self.mask
            hit = self.keys[slot[todo]] == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit]
        return out, missing


class Head:
    """The frequent words' counts and the frequent events' code lengths, made ready once a worker."""

    def __init__(self, *columns):
        self.columns, self.ready = columns, None

    def tables(self) -> tuple[dict[str, int], HashTable]:
        if self.ready is None:
            words, c, key, lp = self.columns
            self.ready, self.columns = (dict(zip(words, c.tolist(), strict=True)), HashTable(key, lp)), None
        return self.ready


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """A list for each row from values in order of their owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), values)


def score_texts(docs: DataFrame, trained: Column, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of the coded bytes) of every row of
    ``docs``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(trained, F.lit(False)).alias("train"))
    words = stage(count_words(rows), "ctw-words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The end is a token too, once a text.
    ends = rows.filter("train").count()
    total, distinct = total + ends, distinct + (ends > 0)
    floor = np.log10(total + 0.1 * (distinct + 1))
    end_lp = float(np.log10(ends + 0.1) - floor)
    known = most_frequent(words, "c", HEAD_WORDS).toArrow()
    counts = stage(count_events(rows, depth), "ctw-events")
    scores = stage(event_scores(counts, depth), "ctw-scores")
    release(counts)
    frequent = most_frequent(scores, "n", HEAD).select("key", "lp").toArrow()
    shared = spark.sparkContext.broadcast(Head(known["word"].to_pylist(), known["c"].to_numpy(), frequent["key"].to_numpy(), frequent["lp"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, table = shared.value.tables()
        names = ["doc_id", "n_tokens", "n_bytes", "n_known", "base", "model", "words", "events"]
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            t = Tokens(b.column("text"))
            c = np.array([head.get(w, -1) for w in t.words], np.int64)
            base = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.1) - floor, 0.0)
            of = c[t.index]
            rest = of < 0
            unknown = pa.array(t.words, pa.string()).take(pa.array(t.index[rest]))
            model, n_bytes, missed = np.zeros(m), np.zeros(m, np.int64), []
            for key, owner in events(stream(b.column("text"), depth), depth):
                lp, missing = table.get(key)
                model += np.bincount(owner, weights=lp, minlength=m)
                n_bytes += np.bincount(owner, minlength=m)
                missed.append((key[missing], owner[missing]))
            key, owner = (np.concatenate(x) for x in zip(*missed, strict=True))
            columns = [
                np.bincount(t.owner, minlength=m) + 1, n_bytes, np.bincount(t.owner, weights=of > 0, minlength=m).astype(np.int64) + (ends > 0),
                np.bincount(t.owner, weights=base[t.index], minlength=m) + end_lp, model,
            ]
            lists = [_lists(t.owner[rest], m, unknown), _lists(owner, m, pa.array(key))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns), *lists], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_bytes long, n_known long, base double, model double, words array<string>, events array<long>")
    parts = stage(parts.withColumn("row", F.monotonically_increasing_id()), "ctw-documents")
    rare_words = parts.select("row", F.explode("words").alias("word")).join(words, "word", "left").groupBy("row").agg(F.count("c").alias("k"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1) - float(floor)).alias("b"))
    rare_events = parts.select("row", F.explode("events").alias("key")).groupBy("row", "key").count().join(scores.select("key", "lp"), "key").groupBy("row").agg(F.sum(F.col("lp") * F.col("count")).alias("s"))
    score = F.col("model") + F.coalesce("s", F.lit(0.0))
    return parts.drop("words", "events").join(rare_words, "row", "left").join(rare_events, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_ctw(spark, sf_dir) -> DataFrame:
    """Score of every document by the model of the nine tenths that train it."""
    small_batches(spark)
    held_out = crc_mod("doc_id", 10) == 0
    scored = score_texts(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
