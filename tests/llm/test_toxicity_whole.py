"""Obfuscation of any length, and at either end of a word."""

import random

import pytest

from terrashift.llm import toxicity


@pytest.fixture(scope="module")
def decoder(spark):
    r = random.Random(5)
    words = ["you", "are", "such", "daffodil", "a", "idiot", "ass", "did", "sassy", "the", "morning", "walks", "under", "green", "trees"]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return toxicity.Decoder(toxicity.trigram_counts(docs))


def test_long_spaced_sentence(decoder):
    sentence = " ".join(["the morning walks under green trees", "you are such an idiot", "the green trees", "under the morning"])
    spaced = " ".join("".join(c for c in sentence if c != " ")) + " " + " ".join("thegreentreesunderthemorningwalks")
    assert len(spaced) >= 200 and {"idiot", "green", "trees"} <= decoder.words(spaced)


@pytest.mark.parametrize(("seen", "word"), [("a$$", "ass"), ("a55", "ass"), ("di3", "die"), ("@s5", "ass"), ("@55y", "assy"), ("x" * 100 + ".1diot", None)])
def test_look_alikes_at_the_ends(decoder, seen, word):
    got = toxicity.suspects(f"so {seen} there")
    assert seen in got
    assert word is None or word in decoder.words(f"so {seen} there")


def test_time_is_linear(decoder):
    assert len(decoder.read("a1" * 20_000)) > 10_000


def readings(decoder, seen):
    """Every reading of a lattice with its cost: letters as they stand or as look-alikes, repeats and separators gone."""
    paths = [(0.0, (0, 0), "", "")]
    for c in seen:
        letters = ([(c, 0.0)] if c.isalpha() else []) + [(x, toxicity.COST_LOOK) for x in toxicity.LOOKS.get(c, "")]
        drop = toxicity.COST_SEPARATOR if c in toxicity.SEPARATORS else toxicity.COST_DROP if not c.isalnum() else None
        new = []
        for cost, (a, b), last, out in paths:
            if drop is not None:
                new.append((cost + drop, (a, b), last, out))
            for x, extra in letters:
                s = toxicity._symbol(x)
                new.append((cost + extra + decoder.cost[a][b][s], (b, s), x, out + x))
                if x == last:
                    new.append((cost + extra + toxicity.COST_REPEAT, (a, b), last, out))
            if drop is None and not letters:
                new.append((cost + 2 * toxicity.COST_DROP, (a, b), last, out))
        paths = new
    return sorted((cost + decoder.cost[a][b][0], out) for cost, (a, b), _, out in paths)


def test_lattices_by_enumeration(decoder):
    r = random.Random(8)
    for _ in range(300):
        seen = "".join(r.choice("aisdt1!05$@.-_8|ég") for _ in range(r.randint(1, 7)))
        best, *rest = readings(decoder, seen)
        tied = [best, *(x for x in rest if x[0] <= best[0] + 1e-9)]
        assert decoder.read(seen) in {out for _, out in tied}, seen


def test_rows_to_learn_from(spark):
    """Several texts and labels of an id, and ids that are strings, give one model whatever the order of the rows."""
    texts = [(f"d{i % 40}", f"plain words number{i}" if i % 3 else f"such an awful zidiot {i}") for i in range(120)]
    labels = [(d, int(i % 3 == 0)) for i, (d, _) in enumerate(texts)]
    scores = []
    for rows in (texts, texts[::-1]):
        docs, marks = spark.createDataFrame(rows, "doc_id string, text string").repartition(3), spark.createDataFrame(labels, "doc_id string, toxic int")
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.score(docs, marks).collect()))
    assert scores[0] == scores[1]
