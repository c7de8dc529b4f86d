"""Language identification: spans of a text by language.

A word is a run of letters and marks. The script of its letters, by ranges of code points, narrows the languages it can
be in; each of these scores it by the frequencies of its letters, pairs and triples of letters, ends of the word
included. A Viterbi path over a text's words, with a penalty for each switch, labels its spans.

The counts are of all training texts: each task sums its own by ``np.bincount``, and what comes to the driver and is
broadcast is bounded by 168 thousand hashed cells a language, whatever the corpus.

Defined results: a null text, or one without letters, has no spans and the language ``und`` with score 0; so has every
text if nothing was learned; words in a script that no language has take the language of their neighbours, or the most
frequent one; equally good paths stay in a language, then take the name that comes first; repeated rows get equal results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, small_batches

# Scripts and their ranges of code points, both ends included.
SCRIPTS = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)),
    "Devanagari": ((0x900, 0x97F),),
    "Bengali": ((0x980, 0x9FF),),
    "Gurmukhi": ((0xA00, 0xA7F),),
    "Gujarati": ((0xA80, 0xAFF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Kannada": ((0xC80, 0xCFF),),
    "Malayalam": ((0xD00, 0xD7F),),
    "Sinhala": ((0xD80, 0xDFF),),
    "Thai": ((0xE00, 0xE7F),),
    "Lao": ((0xE80, 0xEFF),),
    "Tibetan": ((0xF00, 0xFFF),),
    "Myanmar": ((0x1000, 0x109F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "Ethiopic": ((0x1200, 0x139F),),
    "Khmer": ((0x1780, 0x17FF),),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "Han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)),
}
#: Letters of other scripts share one class, after the named ones; 0 is no word character.
OTHER = len(SCRIPTS) + 1
#: Code points beyond have no letters.
POINTS = 0x32000
#: Hashed cells for letters, pairs and triples.
CELLS = (1 << 12, 1 << 15, 1 << 17)
OFFSETS = (0, CELLS[0], CELLS[0] + CELLS[1])
SCRIPT_CELLS = sum(CELLS)
ALL_CELLS = SCRIPT_CELLS + OTHER + 1
#: Added to every count.
SMOOTHING = 0.1
#: A language is written in a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
#: What a switch of language costs, in nats.
SWITCH = 10.0
#: Added to a word's score for a language that isn't written in its script.
EXCLUDED = -1e4
#: Texts of more words get their path one by one, the others side by side.
LONG = 2000
#: Characters of one pass over a batch; longer texts are a pass by themselves.
PASS = 1 << 22
#: Cells looked up at a time.
LOOKUP = 1 << 18

SPAN = "array<struct<start:int,end:int,lang:string,words:int,letters:int,score:double>>"


@lru_cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: script (0: not in a word), whether it is a letter, and its lower case."""
    kind = [unicodedata.category(chr(c))[0] for c in range(POINTS)]
    word, letter = np.array([k in "LM" for k in kind]), np.array([k == "L" for k in kind])
    script = np.where(word, OTHER, 0).astype(np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            script[low : high + 1][word[low : high + 1]] = i
    lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(POINTS)], np.uint32)
    return script, letter, lower


def _cell(order: int, *letters: np.ndarray) -> np.ndarray:
    key = np.full(len(letters[0]), order, np.uint32)
    for x in letters:
        key = (key ^ x) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
    return (key & np.uint32(CELLS[order] - 1)).astype(np.int32) + np.int32(OFFSETS[order])


class Words:
    """The words of some texts: ``text`` (index), ``start`` and ``end`` (code points within it), ``letters``, ``script``,
    and ``cells``, three for each letter and one more triple for the word's end; word i has those from ``first[i]`` on."""

    def __init__(self, texts: list[str]):
        script, letter, lower = tables()
        points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.minimum(points, np.uint32(POINTS - 1))
        kind = script[points]
        inside = kind > 0
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
        low = np.where(inside, lower[points], np.uint32(0))
        at = np.flatnonzero(inside | before)
        a0, a1 = low[at], low[at - 1]
        a2 = np.where(a1 > 0, low[at - 2], np.uint32(0))
        self.cells = np.stack([_cell(0, a0), _cell(1, a1, a0), _cell(2, a2, a1, a0)])
        self.first = np.concatenate([[0], np.cumsum(end - begin + 1)])
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.text = np.searchsorted(offsets, begin, "right") - 1
        self.start, self.end = begin - offsets[self.text], end - offsets[self.text]
        count = np.concatenate([[0], np.cumsum(letter[points])])
        self.letters = count[end] - count[begin]
        self.script = kind[begin]

    def __len__(self) -> int:
        return len(self.text)


class Model:
    """``langs``: names in order; ``scores``: log-frequencies by cell and language; ``written``: by script and language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        table = np.stack([counts[x] for x in self.langs], axis=1).astype(np.float64) if counts else np.zeros((ALL_CELLS, 0))
        self.scores = np.empty((SCRIPT_CELLS, len(self.langs)), np.float32)
        for size, low in zip(CELLS, OFFSETS, strict=True):
            part = table[low : low + size]
            self.scores[low : low + size] = np.log((part + SMOOTHING) / (part.sum(axis=0) + SMOOTHING * size)) / len(CELLS)
        scripts = table[SCRIPT_CELLS:]
        total = scripts.sum(axis=0)
        self.written = scripts >= np.maximum(SCRIPT_SHARE * total, 1)
        self.prior = np.log((total + 1) / (total.sum() + len(total)))

    def word_scores(self, words: Words) -> np.ndarray:
        """Log-probability of each word in each language, up to a constant."""
        out = np.zeros((len(words), len(self.langs)))
        low = 0
        while low < len(words):
            high = max(low + 1, int(np.searchsorted(words.first, words.first[low] + LOOKUP, "right")) - 1)
            cells = words.cells[:, words.first[low] : words.first[high]]
            each = self.scores[cells[0]] + self.scores[cells[1]] + self.scores[cells[2]]
            out[low:high] = np.add.reduceat(each, words.first[low:high] - words.first[low], axis=0, dtype=np.float64)
            low = high
        can = self.written[words.script]
        none = ~can.any(axis=1)
        out[~can] += EXCLUDED
        out[none] = 0
        return out


def path_of_one(scores: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of the words of one text."""
    rows, n = scores.tolist(), scores.shape[1]
    value, back = [a + b for a, b in zip(rows[0], prior.tolist(), strict=True)], []
    for row in rows[1:]:
        best = max(value)
        at, least = value.index(best), best - switch
        back.append((at, [v >= least for v in value]))
        value = [(v if v >= least else least) + s for v, s in zip(value, row, strict=True)]
    label = max(range(n), key=value.__getitem__)
    out = np.empty(len(rows), np.int64)
    out[-1] = label
    for t in range(len(rows) - 2, -1, -1):
        at, stays = back[t]
        label = label if stays[label] else at
        out[t] = label
    return out


def paths(scores: np.ndarray, first: np.ndarray, size: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of all words; text i has ``size[i]`` words from ``first[i]`` on. Texts go side by side, a word a step."""
    out = np.zeros(len(scores), np.int64)
    for i in np.flatnonzero(size > LONG):
        out[first[i] : first[i] + size[i]] = path_of_one(scores[first[i] : first[i] + size[i]], prior, switch)
    order = np.argsort(-size, kind="stable")
    order = order[(size[order] > 0) & (size[order] <= LONG)]
    if not len(order):
        return out
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts with more than t words
    value, back = scores[first] + prior, []
    for t in range(1, size[0]):
        m = live[t]
        now = value[:m]
        at = now.argmax(axis=1)
        least = now[np.arange(m), at][:, None] - switch
        stays = now >= least
        back.append((at, stays))
        value[:m] = np.maximum(now, least) + scores[first[:m] + t]
    label = value.argmax(axis=1)
    out[first + size - 1] = label
    for t in range(size[0] - 1, 0, -1):
        m, (at, stays) = live[t], back[t - 1]
        label[:m] = np.where(stays[np.arange(m), label[:m]], label[:m], at)
        out[first[:m] + t - 1] = label[:m]
    return out


def learn(texts: DataFrame) -> Model:
    """Counts of all rows of ``texts`` (text, lang); rows without one of these teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        letter = tables()[1]  # noqa: F841  made before the first batch
        for b in batches:
            pairs = sorted(zip(b.column("lang").to_pylist(), _texts(b), strict=True), key=lambda x: x[0])
            for part in _passes(pairs):
                words = Words([t for _, t in part])
                names = [x for x, _ in part]
                edges = np.searchsorted(words.text, np.arange(len(part) + 1))
                for lang in dict.fromkeys(names):
                    low, high = edges[names.index(lang)], edges[len(names) - names[::-1].index(lang)]
                    total = counts.setdefault(lang, np.zeros(ALL_CELLS, np.int64))
                    for cells in words.cells[:, words.first[low] : words.first[high]]:
                        total[:SCRIPT_CELLS] += np.bincount(cells, minlength=SCRIPT_CELLS)
                    total[SCRIPT_CELLS:] += np.bincount(words.script[low:high], weights=words.letters[low:high], minlength=OTHER + 1).astype(np.int64)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "cell", "n"])

    rows = texts.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    got = rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    codes = got["lang"].combine_chunks().dictionary_encode()
    code, cell, n = codes.indices.to_numpy(), got["cell"].to_numpy(), got["n"].to_numpy()
    counts = {}
    for i, lang in enumerate(codes.dictionary.to_pylist()):
        counts[lang] = np.zeros(ALL_CELLS, np.int64)
        counts[lang][cell[code == i]] = n[code == i]
    return Model(counts)


def _texts(b: pa.RecordBatch) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in b.column("text").cast(pa.binary()).to_pylist()]


def _passes(rows: list, text=lambda x: x[1]) -> Iterator[list]:
    """Runs of rows of about ``PASS`` characters."""
    part, held = [], 0
    for row in rows:
        if part and held + len(text(row)) > PASS:
            yield part
            part, held = [], 0
        part.append(row)
        held += len(text(row))
    if part:
        yield part


def spans_of(model: Model, texts: list[str]) -> pa.Array:
    """The spans of each text, in order."""
    words = Words(texts)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("words", pa.int32()), ("letters", pa.int32()), ("score", pa.float64())]))
    if not len(words) or not model.langs:
        return pa.array([[]] * len(texts), kind)
    scores = model.word_scores(words)
    edges = np.searchsorted(words.text, np.arange(len(texts) + 1))
    label = paths(scores, edges[:-1], np.diff(edges), model.prior)
    begin = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])]))
    last = np.append(begin[1:], len(words)) - 1
    total = np.add.reduceat(scores, begin, axis=0)
    each = np.exp(total - total.max(axis=1, keepdims=True))
    sure = each[np.arange(len(begin)), label[begin]] / each.sum(axis=1)
    columns = [
        pa.array(words.start[begin], pa.int32()), pa.array(words.end[last], pa.int32()), pa.DictionaryArray.from_arrays(pa.array(label[begin], pa.int32()), pa.array(model.langs, pa.string())).cast(pa.string()),
        pa.array(last - begin + 1, pa.int32()), pa.array(np.add.reduceat(words.letters, begin), pa.int32()), pa.array(sure),
    ]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(words.text[begin], np.arange(len(texts) + 1)), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` of every row of ``docs`` and ``spans``: start, end (code points), lang, words, letters, and how much
    likelier the span's language is than all others together could be (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = 0
            for part in _passes(_texts(b), lambda x: x):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(low, len(part)), spans_of(shared.value, part)], ["doc_id", "spans"])
                low += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def leading(spans: Column) -> Column:
    """``lang`` with the most letters (of equal ones the first by name), its ``share`` of sure letters; null without letters."""
    letters = lambda part, weigh: F.aggregate(part, F.lit(0.0), lambda a, s: a + s["letters"] * (s["score"] if weigh else 1.0))
    of = lambda x: F.filter(spans, lambda s: s["lang"] == x)
    each = F.transform(F.array_distinct(F.transform(spans, lambda s: s["lang"])), lambda x: F.struct((-letters(of(x), False)).alias("n"), x.alias("lang"), letters(of(x), True).alias("sure")))
    total, best = letters(spans, False), F.array_min(each)
    return F.when(total > 0, F.struct(best["lang"].alias("lang"), F.least(F.lit(1.0), best["sure"] / total).alias("share")))


def op11_languages(spark, sf_dir) -> DataFrame:
    """Language of every document, learned from four fifths of the ids."""
    small_batches(spark)
    held_out = crc_mod("doc_id", 5) == 0
    docs = documents(spark, sf_dir)
    model = learn(docs.filter(~held_out))
    found = identify(docs, model).select("doc_id", leading(F.col("spans")).alias("best"))
    return found.select("doc_id", held_out.alias("held_out"), F.coalesce("best.lang", F.lit("und")).alias("lang_pred"), F.coalesce("best.share", F.lit(0.0)).alias("score"))
