r"""Words ``[^\x20\x09-\x0D]+`` of a batch of texts as 64-bit hashes, A-Z in lower case, without a Python object a word.

A word's hash is a sum over its bytes, each byte's random value times a power that its place in the word gives, mixed at
the end. Equal words have equal hashes; two different ones share one with a chance of about 2^-63.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time, up to the next end of a word: memory doesn't follow the length of a text.
BLOCK = 1 << 16
_random = np.random.default_rng(20)
_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE[_SPACE] = 0
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, m: np.uint64 = _MIX) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * m
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


# A word's place in a block is taken out of its sum by the inverse power, so blocks need no place within the word.
_UP, _DOWN = _powers(_BASE, BLOCK), _powers(pow(_BASE, -1, 2**64), BLOCK)


class Words:
    """``hashes`` of the words in order, ``text``: the index of each one's text, ``line``: the number of its line there."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
        m = len(texts)
        if not m:
            self.hashes, self.text, self.line = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
            return
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + m + 1].astype(np.int64)
        data = texts.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
        ends = ends - ends[0]
        begins = np.zeros(len(flat) + 1, bool)
        begins[ends] = True
        hashes, starts, at = [], [], 0
        while at < len(flat):
            part = flat[at : at + BLOCK]
            if at + len(part) < len(flat):
                # A block ends where a word or a text does.
                cut = self._last_end(part, begins[at + 1 : at + 1 + len(part)])
                part = part[:cut] if cut else flat[at : at + self._word_end(flat, begins, at)]
            word = (part - np.uint8(9) >= 5) & (part != 32)
            first = word.copy()
            first[1:] &= ~word[:-1] | begins[at + 1 : at + len(part)]
            place = np.flatnonzero(first)
            if len(place):
                up, down = (_UP, _DOWN) if len(part) <= len(_UP) else (_powers(_BASE, len(part)), _powers(pow(_BASE, -1, 2**64), len(part)))
                sums = np.take(_VALUE, part, mode="clip")
                sums *= up[: len(part)]
                np.cumsum(sums, out=sums)
                # Bytes between words count nothing, so a word's sum is that up to the next one's start, less what came before.
                sums = sums[np.append(place[1:], len(part)) - 1]
                sums[1:] -= sums[:-1].copy()
                hashes.append(mix(sums * down[place]))
                starts.append(place + at)
            at += len(part)
        none = np.empty(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        starts = np.concatenate(starts) if starts else none
        per_text = np.diff(np.searchsorted(starts, ends))
        self.text = np.repeat(np.arange(m), per_text)
        newlines = np.flatnonzero(flat == 10)
        breaks = np.cumsum(np.bincount(np.searchsorted(starts, newlines), minlength=len(starts) + 1))[:-1]
        self.line = (breaks - np.searchsorted(newlines, ends[:-1])[self.text]).astype(np.int32)

    @staticmethod
    def _last_end(part: np.ndarray, ends: np.ndarray) -> int:
        """Length up to the last end of a word or a text; 0 without one. Most are near the end of the block."""
        for near in (len(part) - 256, 0):
            cut = np.flatnonzero(_SPACE[part[max(near, 0) :]] | ends[max(near, 0) :])
            if len(cut):
                return max(near, 0) + int(cut[-1]) + 1
        return 0

    @staticmethod
    def _word_end(flat: np.ndarray, begins: np.ndarray, at: int) -> int:
        """Length up to the end of a word longer than a block."""
        size = 2 * BLOCK
        while True:
            cut = np.flatnonzero(_SPACE[flat[at : at + size]] | begins[at + 1 : at + 1 + len(flat[at : at + size])])
            if len(cut):
                return int(cut[0]) + 1
            size *= 2
