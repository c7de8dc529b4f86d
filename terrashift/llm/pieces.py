"""SentencePiece encoding and decoding: Viterbi over piece scores with shared prefixes.

A text is marked as the model's file says (a mark before it and for each space) and falls into words where no piece can
reach across: before a run of marks, and around characters that are in no piece. The distinct words of a batch are
sorted, which lays them out as the depth-first order of a trie: the forward scores of a word's prefix that the word
before it shares are kept, and only the rest is computed. The best path of each distinct word is found once and stands
for all its occurrences.

The best path maximises the sum of the scores in the model's file, ties to the longer last piece; a character that is no
piece is written as its bytes. The file at hand holds merge ranks as scores, so the result is the best-scoring
segmentation under those, not the one that merging in order would give; decoding gives the marked text back either way.

Defined results: null and empty texts have no ids and decode to an empty text; ids that are no piece decode to nothing;
byte pieces that form no valid character decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

MARK = "▁"
PENALTY = 10.0
#: Paths that a worker keeps from one batch to the next, and the longest word kept.
REMEMBERED, LONGEST = 400_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.special = {i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.raw = [b"" if i in self.special else bytes((self.byte_of[i],)) if i in self.byte_of else p.encode() for i, p in enumerate(self.pieces)]
        self.paths: dict[str, bytes] = {}
        self._fill({p: (sp.get_score(i), i) for i, p in enumerate(self.pieces) if i not in self.special and i not in self.byte_of})

    def _fill(self, scored: dict[str, tuple[float, int]]) -> None:
        self.scored = scored
        if any(MARK in p[1:] and p.strip(MARK) for p in scored):
            raise ValueError("a piece has a mark behind other characters: texts can't be cut into words")
        self.unknown = min(s for s, _ in scored.values()) - PENALTY
        # A trie of the reversed pieces: from a position back, each step is one character of a possible last piece.
        self.back: dict = {}
        for p, hit in scored.items():
            node = self.back
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = hit
        chars = {c for p in scored for c in p}
        apart = "".join(c for c in "\n\t\r\x0b\x0c" if c not in chars)
        self.cut = re.compile(f"[{apart}]|{MARK}*[^{MARK}{apart}]+|{MARK}+") if apart else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def words(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def best_paths(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word, depth first through the trie of the sorted words."""
        scored, root, unknown = self.scored, self.back, self.unknown
        best, start, piece = [0.0], [0], [-1]
        last, out = "", {}
        for w in sorted(words):
            n, k = len(w), 0
            top = min(len(last), n)
            while k < top and last[k] == w[k]:
                k += 1
            del best[k + 1 :], start[k + 1 :], piece[k + 1 :]
            for j in range(k + 1, n + 1):
                # A character may stand as its bytes only if it is no piece itself.
                found, at, which = (best[j - 1] + unknown if w[j - 1] not in scored else float("-inf")), j - 1, -1
                node, i = root, j
                while i:
                    node = node.get(w[i - 1])
                    if node is None:
                        break
                    i -= 1
                    hit = node.get("")
                    # The longer last piece comes later and wins a tie.
                    if hit is not None and (score := best[i] + hit[0]) >= found:
                        found, at, which = score, i, hit[1]
                best.append(found)
                start.append(at)
                piece.append(which)
            ids, j = [], n
            while j:
                if piece[j] < 0:
                    ids += [self.bytes[b] for b in reversed(w[j - 1].encode("utf-8", "surrogatepass"))]
                else:
                    ids.append(piece[j])
                j = start[j]
            out[w] = ids[::-1]
            last = w
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, four bytes an id (little-endian)."""
        split = [self.words(t or "") for t in texts]
        known = self.paths
        if len(known) > REMEMBERED:
            known.clear()
        new = {w for words in split for w in words if w not in known}
        found = {w: np.array(ids, "<i4").tobytes() for w, ids in self.best_paths(new).items()}
        long = {w: ids for w, ids in found.items() if len(w) > LONGEST}
        for w, ids in found.items():
            if w not in long:
                known[w] = ids
        find = known.__getitem__ if not long else lambda w: long[w] if w in long else known[w]
        return [b"".join(map(find, words)) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        raw, n = self.raw, len(self.raw)
        try:
            found = b"".join([raw[i] for i in ids])
        except IndexError:
            found = b"".join([raw[i] for i in ids if 0 <= i < n])
        text = found.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_cache: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _cache:
        _cache[path] = Pieces(path)
    return _cache[path]


def encode(df: DataFrame, model: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``, the ids of ``text``; other columns stay."""
    path = model or default_model()
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for b in batches:
            rows = pieces.encode(b.column(text).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), column], [*keep, out])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` array<int>"])
    return df.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def decode(df: DataFrame, model: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text of ``ids``; other columns stay."""
    path = model or default_model()
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for b in batches:
            column = pa.array([pieces.decode(i or ()) for i in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), column], [*keep, out])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` string"])
    return df.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_chars, decoded_sha256, round_trip: every text encoded and decoded again in one pass."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows = []
            for text, ids in zip(texts, pieces.encode(texts), strict=True):
                back = pieces.decode(np.frombuffer(ids, "<i4").tolist())
                rows.append((len(ids) // 4, zlib.crc32(ids), len(text), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text.replace(MARK, " ")))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_ids", "ids_crc32", "n_chars", "decoded_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, n_chars long, decoded_sha256 string, round_trip boolean")


def op5_pieces(spark, sf_dir) -> DataFrame:
    """Every text encoded and decoded again; digests of both."""
    small_batches(spark)
    return digests(documents(spark, sf_dir))
