"""Word ids by the short ways equal the tokenizer's, also when words are forgotten in between."""

import random

import pytest

packing = pytest.importorskip("terrashift.llm.packing")


def test_odd_words_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing.WordIds, "LIMIT", 50)
    ids, r = packing.WordIds(packing.default_tokenizer()), random.Random(1)
    letters = [chr(c) for c in range(33, 127)] + ["'s", "'LL", "<|", "é", "\x01", "\x7f", "ª"]
    odd = ["".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(1500)]
    for word in [*odd, *odd[:200], "It's", "don'T", "ABC123", "a_b"]:
        assert memoryview(ids[word]).cast("I").tolist() == ids.tokenizer.encode(word, add_special_tokens=False).ids, word


def test_a_word_in_use_is_not_worked_out_again(monkeypatch):
    monkeypatch.setattr(packing.WordIds, "LIMIT", 50)
    ids = packing.WordIds(packing.default_tokenizer())
    first = ids["often"]
    monkeypatch.setattr(ids, "parts", {})
    for k in range(300):
        assert ids["often"] is first
        ids[f"w{k}"]
