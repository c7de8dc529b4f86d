"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Obfuscated pieces of a text (letters replaced by look-alikes, letters spaced or dotted apart, letters repeated) become
lattices: each seen character may stand for itself, for a letter that it looks like, for nothing (a separator, or a
repeat of the letter before), at a cost each. Viterbi decoding finds the cheapest letters under the channel's costs and
a character trigram model counted over all documents. Plain words have one path and are not decoded.

The restored text is scored by logistic regression over the presence of its words and of their beginnings (toxic words
share stems). It is fit on at most ``SAMPLE`` labelled training rows, those with the least hash of their id; every text
is scored whole.

Defined results: null and empty texts get the score of a text without features; with no labelled training row, or one
label only, all scores are the training rows' share of label 1 (0 with none); repeated rows get equal scores; a doc_id
with several labels counts as toxic when one of them is, and of its texts the least is learnt from; doc_id may be of any
type. A text of any length is scored whole, in time proportional to it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, small_batches

SAMPLE = 12_000
DIMS = 1 << 20
PREFIXES = (4, 5, 6, 7)
LEAST_DF = 3
CHI2 = 20.0

# Letters that a character may be read as.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "\xa3": "l", "€": "e",
}
SEPARATORS = ".-_*~'`^=:,\xb7 "
COST_LOOK, COST_DROP, COST_SEPARATOR, COST_REPEAT = 1.2, 2.5, 0.4, 0.8

_LOOK = re.escape("".join(LOOKS))
#: Where something may be obfuscated: a look-alike beside a letter, one letter three times, single characters set apart,
#: separators within a word. The search is for these spots alone; each is widened to the run of non-blanks around it.
APART = re.compile(rf"(?<!\S)(?:[^\W\d_]|[{_LOOK}])(?:[ .\-_*~]{{1,2}}(?:[^\W\d_]|[{_LOOK}])){{2,}}(?!\S)")
SPOT = re.compile(rf"[^\W\d_][{_LOOK}]|[{_LOOK}][^\W\d_]|([^\W\d_])\1\1|[^\W\d_][.\-_*~][^\W\d_]+[.\-_*~][^\W\d_]")
BLANK = re.compile(r"\s")


def _run_start(text: str, at: int, low: int) -> int:
    """Where the run of non-blanks before ``at`` starts, no sooner than ``low``. Looks back twice as far each time, so it
    takes time in proportion to the run."""
    size = 64
    while True:
        piece = text[max(low, at - size) : at]
        tail = 0 if not piece or piece[-1].isspace() else len(piece.rsplit(None, 1)[-1])
        if tail < len(piece) or at - size <= low:
            return at - tail
        size *= 2


def suspects(text: str) -> list[str]:
    found, done = [], 0
    for m in SPOT.finditer(text):
        if m.start() < done:
            continue
        a = _run_start(text, m.start(), done)
        after = BLANK.search(text, m.end())
        done = after.start() if after else len(text)
        found.append(text[a:done])
    return found


WORD = re.compile(r"[^\W\d_]+")


def _symbol(c: str) -> int:
    """0 at a word's ends, 1 to 26 for a to z, 27 for any other letter."""
    return ord(c) - 96 if "a" <= c <= "z" else 27


class CharacterModel:
    """Trigram costs (negative natural logs) over 28 symbols."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(28, 28, 28).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        one = (uni + 0.5) / (uni.sum() + 14)
        two = (bi + 8 * one) / (bi.sum(1, keepdims=True) + 8)
        three = (tri + 8 * two) / (tri.sum(2, keepdims=True) + 8)
        self.cost = (-np.log(three)).tolist()


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts over the words of all texts; the table's size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(28**3, np.int64), Counter()

        def settle() -> None:
            if seen:
                words = list(seen)
                codes = np.fromiter((0 if c == " " else _symbol(c) for c in "  " + "  ".join(words) + " "), np.int64)
                keys = (codes[:-2] * 28 + codes[1:-1]) * 28 + codes[2:]
                # Trigram i ends at position i + 2; a word owns those that end in it or at the blank behind it.
                sizes = np.array([len(w) + 2 for w in words])
                weight = np.repeat(np.fromiter(seen.values(), np.int64, len(words)), sizes)
                keep = codes[2:] + codes[1:-1] > 0
                n = min(len(keys), len(weight))
                np.add.at(total, keys[:n][keep[:n]], weight[:n][keep[:n]])
                seen.clear()

        for b in batches:
            for text in b.column("text").to_pylist():
                if text:
                    seen.update([w for w in text.lower().split() if w.isalpha()])
            if len(seen) > 300_000:
                settle()
        settle()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    table = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(28**3, np.int64)
    out[table["cell"].to_numpy()] = table["n"].to_numpy()
    return out


class Decoder:
    """Viterbi decoding of lattices; remembers what it has decoded, up to a bound."""

    def __init__(self, counts: np.ndarray):
        self.cost = CharacterModel(counts).cost
        self.restore = lru_cache(100_000)(self._restore)

    def _restore(self, seen: str, apart: bool = False) -> str:
        """The likeliest letters behind ``seen``; of characters set apart (``apart``) in words, as a separator may also end
        one. Takes time in proportion to the length: letters are kept as chains."""
        cost = self.cost
        # A state is the last two symbols, the last letter seen and whether it was emitted: cost and letters so far.
        beam: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for c in seen.lower():
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c, 0.0))
            options += [(x, COST_LOOK) for x in LOOKS.get(c, "")]
            drop = COST_SEPARATOR if c in SEPARATORS else COST_DROP if not c.isalnum() else None
            new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

            def put(state: tuple[int, int, str], total: float, chain: tuple | None, new: dict = new) -> None:
                old = new.get(state)
                if old is None or total < old[0]:
                    new[state] = (total, chain)

            for (a, b, last), (total, chain) in beam.items():
                if drop is not None:
                    put((a, b, last), total + drop, chain)
                    if apart and b and c in SEPARATORS:
                        put((0, 0, ""), total + drop + cost[a][b][0], (chain, " "))
                for letter, extra in options:
                    s = _symbol(letter)
                    put((b, s, letter), total + extra + cost[a][b][s], (chain, letter))
                    if letter == last:
                        put((a, b, last), total + extra + COST_REPEAT, chain)
                if drop is None and not options:
                    put((a, b, last), total + 2 * COST_DROP, chain)
            beam = new
        chain, letters = min(((total + cost[a][b][0], chain) for (a, b, _), (total, chain) in beam.items()), key=lambda x: x[0])[1], []
        while chain:
            chain, letter = chain
            letters.append(letter)
        return "".join(reversed(letters))

    def read(self, seen: str, apart: bool = False) -> str:
        """``_restore``, remembered for what is short enough to come again."""
        return (self.restore if len(seen) <= 64 else self._restore)(seen, apart)

    def words(self, text: str) -> set[str]:
        """Distinct lower-case words of a text as it stands and as restored."""
        low = text.lower()
        found = set(WORD.findall(low))
        for seen in suspects(low):
            found.add(self.read(seen))
            found.update(WORD.findall(seen))
        for m in APART.finditer(low):
            # A word set apart, or a sentence.
            found.add(self.read(m[0]))
            found.update(self.read(m[0], True).split())
            found.update(WORD.findall(m[0]))
        found.discard("")
        return found


class Buckets(dict):
    """Words to the buckets of their features: the word and its beginnings. Of a model only those with a weight."""

    LIMIT = 400_000

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        names = [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
        found = (zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMS for x in names)
        out = self[word] = tuple(i for i in found if self.weights is None or self.weights[i])
        return out

    def of(self, words: set[str]) -> list[int]:
        """Distinct buckets, in order: sums over them don't depend on the order of the words."""
        return sorted(set().union(*map(self.__getitem__, words)))


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 300, rate: float = 0.3, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic regression over the features whose chi-square says that they matter. Returns weights and intercept."""
    weights, n, positive = np.zeros(DIMS, np.float32), len(rows), int(labels.sum())
    share = (positive + 0.5) / (n + 1) if n else 0.0
    base = math.log(share / (1 - share)) if 0 < positive < n else (30.0 if n and positive else -30.0)
    if not 0 < positive < n:
        return weights, base
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    flat = np.concatenate(rows)
    df, hit = np.bincount(flat, minlength=DIMS), np.bincount(flat, weights=labels[owner], minlength=DIMS)
    expected = df * positive / n
    chi2 = (hit - expected) ** 2 / np.maximum(expected * (1 - positive / n), 1e-9)
    chosen = np.flatnonzero((df >= LEAST_DF) & (chi2 >= CHI2))
    if not len(chosen):
        return weights, base
    index = np.full(DIMS, -1)
    index[chosen] = np.arange(len(chosen))
    keep = index[flat] >= 0
    owner, flat = owner[keep], index[flat[keep]]
    w, b = np.zeros(len(chosen)), base
    gw, gb = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(owner, weights=w[flat], minlength=n), -50, 50)))
        off = labels - p
        dw = np.bincount(flat, weights=off[owner], minlength=len(chosen)) / positive - l2 * w / 10
        db = off.sum() / positive
        gw, gb = gw + dw * dw, gb + db * db
        w, b = w + rate * dw / np.sqrt(gw), b + rate * db / math.sqrt(gb)
    weights[chosen] = w
    return weights, float(b)


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """``labels``: doc_id and toxic of the rows to learn from."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most ``sample`` rows, so they may be broadcast.
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, buckets = Decoder(shared.value), Buckets()
        for b in batches:
            rows = [np.array(buckets.of(decoder.words(t or "")), np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("order"), pa.array(rows, pa.binary())], ["toxic", "order", "features"])

    # Of several texts of an id the least, and an order that every run shares: the model depends on nothing else.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic", F.xxhash64("doc_id").alias("order"))
    got = texts.mapInArrow(run, "toxic int, order long, features binary").toArrow()
    order = np.argsort(got["order"].to_numpy(), kind="stable")
    rows = got["features"].to_pylist()
    return fit([np.frombuffer(rows[i], np.int32).astype(np.int64) for i in order], got["toxic"].to_numpy()[order].astype(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of ``docs``, by what ``labels`` teaches."""
    counts = trigram_counts(docs)
    shared = docs.sparkSession.sparkContext.broadcast((counts, *train(docs, labels, counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, base = shared.value
        decoder, buckets = Decoder(counts), Buckets(weights)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                z = base + float(weights[buckets.of(decoder.words(text))].sum(dtype=np.float64)) if text else base
                out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op4_toxicity(spark, sf_dir) -> DataFrame:
    """Score of every document by the labels of four fifths of the ids."""
    small_batches(spark)
    held_out = crc_mod("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out)
    scored = score(documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
