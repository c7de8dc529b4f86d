"""Words as hashes, over blocks of every size, against a regular expression."""

import re

import numpy as np
import pyarrow as pa
import pytest

from terrashift.llm import words

TEXTS = [None, "", " a B\nc ", "x", "yZ\n\n w", "é日 \x1c q", "a" * 50 + " " + "b" * 3, "", "end\x0bv", "a\x00b A\x00B", "no blank" * 30]


def by_force(texts):
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            for w in re.findall(r"[^\x20\x09-\x0D]+", line):
                yield i, k, w.translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("block", [words.BLOCK, 64, 7, 1])
@pytest.mark.parametrize("texts", [pa.array(TEXTS), pa.array(["skipped", *TEXTS]).slice(1), pa.array([], pa.string()), pa.array([None], pa.string()), pa.array(TEXTS, pa.large_string())])
def test_words(monkeypatch, block, texts):
    monkeypatch.setattr(words, "BLOCK", block)
    got, want = words.Words(texts), list(by_force(texts.to_pylist()))
    assert list(zip(got.text.tolist(), got.line.tolist(), strict=True)) == [w[:2] for w in want]
    hashes = {}
    for (_, _, w), h in zip(want, got.hashes.tolist(), strict=True):
        assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_equal_whatever_the_block(monkeypatch):
    text = pa.array([" ".join(f"w{i * 7919 % 1000}" for i in range(3000)), "z" * 5000])
    whole = words.Words(text).hashes
    monkeypatch.setattr(words, "BLOCK", 100)
    assert np.array_equal(whole, words.Words(text).hashes)
