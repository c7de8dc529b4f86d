"""Language spans: words and counts against plain Python, paths against enumeration, accuracy, mixed texts, odd rows."""

import itertools
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.llm import languages as L

EN = "the house and the garden with that thing which they thought about this other weather together".split()
DE = "das haus und der garten mit dem ding das sie zwischen schnee schon nicht auch über straße gedacht".split()
RU = "дом и сад с той вещью о которой они думали другая погода вместе".split()


def prose(words, seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(words, n))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(prose(w, i, 40), lang) for i in range(30) for w, lang in ((EN, "en"), (DE, "de"), (RU, "ru"))]
    return spark.createDataFrame([*rows, (None, "en"), ("text without a language", None)], "text string, lang string")


@pytest.fixture(scope="module")
def model(corpus):
    return L.learn(corpus)


def plain_words(text):
    inside, found, begin = False, [], 0
    for i, c in enumerate(text + "\n"):
        now = unicodedata.category(c)[0] in "LM"
        if now and not inside:
            begin = i
        if inside and not now:
            found.append((begin, i))
        inside = now
    return found


def test_words_and_cells():
    texts = ["", "a", "Ab, cd--É1x", "हिन्दी में 日本語", "\U0001f600 x́y", "... 12"]
    got = L.Words(texts)
    want = [(k, b, e) for k, t in enumerate(texts) for b, e in plain_words(t)]
    assert list(zip(got.text, got.start, got.end, strict=True)) == want
    assert got.letters.tolist() == [sum(unicodedata.category(c)[0] == "L" for c in texts[k][b:e]) for k, b, e in want]
    for i, (k, b, e) in enumerate(want):
        letters = [ord(c.lower()) for c in texts[k][b:e]] + [0]
        one = lambda order, *x: int(L._cell(order, *(np.array([v], np.uint32) for v in x))[0])
        padded = [0, 0, *letters]
        cells = [[one(0, c), one(1, b1, c), one(2, a1 if b1 else 0, b1, c)] for a1, b1, c in zip(padded, padded[1:], padded[2:], strict=False)]
        assert got.cells[:, got.first[i] : got.first[i + 1]].T.tolist() == cells


def test_counts_are_of_all_rows(corpus, model):
    want = Counter()
    for r in corpus.filter("text is not null and lang = 'en'").collect():
        words = L.Words([r.text])
        want.update(words.cells.ravel().tolist())
    total = np.zeros(L.SCRIPT_CELLS)
    total[list(want)] = list(want.values())
    low, size = L.OFFSETS[2], L.CELLS[2]
    part = total[low : low + size]
    scores = np.log((part + L.SMOOTHING) / (part.sum() + L.SMOOTHING * size)) / 3
    assert np.allclose(model.scores[low : low + size, model.langs.index("en")], scores, atol=1e-5)
    assert model.langs == ["de", "en", "ru"]


def test_scripts_narrow_candidates(model):
    latin, cyrillic = (list(L.SCRIPTS).index(x) + 1 for x in ("Latin", "Cyrillic"))
    assert model.written[latin].tolist() == [True, True, False] and model.written[cyrillic].tolist() == [False, False, True]
    scores = model.word_scores(L.Words(["haus дом ελλάδα"]))
    assert scores[0, 2] < -9000 and (scores[1, :2] < -9000).all() and (scores[2] == 0).all()


@pytest.mark.parametrize("seed", range(8))
def test_paths_equal_enumeration(seed):
    r = np.random.default_rng(seed)
    sizes = np.array([0, 1, 5, 3, 6])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scores, prior = r.normal(0, 3, (sizes.sum(), 3)), r.normal(0, 1, 3)
    got = L.paths(scores, first, sizes, prior, 2.0)
    for f, n in zip(first, sizes, strict=True):
        if n:
            value = lambda p: prior[p[0]] + sum(scores[f + t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
            best = max(map(value, itertools.product(range(3), repeat=int(n))))
            assert np.isclose(value(got[f : f + n].tolist()), best)
            assert np.isclose(value(L.path_of_one(scores[f : f + n], prior, 2.0).tolist()), best)


def test_mixed_text(spark, model):
    parts = [prose(EN, 91, 20), prose(DE, 92, 20), prose(RU, 93, 10)]
    text = ". ".join(parts)
    row = L.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["en", "de", "ru"]
    assert [text[s.start : s.end] for s in row.spans] == parts
    assert [s.words for s in row.spans] == [20, 20, 10] and all(s.score > 0.99 for s in row.spans)


def test_long_and_short_paths_agree(model, monkeypatch):
    text = " ".join(prose(w, i, 150) for i, w in enumerate((EN, DE, EN, RU)))
    want = L.spans_of(model, [text, "haus"]).to_pylist()
    monkeypatch.setattr(L, "LONG", 10)
    monkeypatch.setattr(L, "LOOKUP", 64)
    assert L.spans_of(model, [text, "haus"]).to_pylist() == want


def test_query(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(i, prose((EN, DE, RU)[i % 3], i, int(r.integers(3, 60))), ("en", "de", "ru")[i % 3]) for i in range(300)]
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 ... \U0001f600", "en"), (903, "ελλάδα", None), (904, "x" * 200_000, None), (905, "haus und " * 50_000, None), (905, "haus und " * 50_000, None)]
    spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({c: F.lit("taken") for c in ("spans", "best", "cell", "n", "held_out", "score")}).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    df = L.op11_languages(spark, str(tmp_path))
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    got = df.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= x.score <= 1 for x in got)
    by_id = {x.doc_id: x for x in got}
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows)
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by_id[905].lang_pred == "de" and by_id[903].lang_pred in ("en", "de", "ru")
    assert [x for x in got if x.doc_id == 905][0] == [x for x in got if x.doc_id == 905][1]


def test_empty_and_unlabelled(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert L.op11_languages(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert [(x.lang_pred, x.score) for x in L.op11_languages(spark, f"{tmp_path}/b").collect()] == [("und", 0.0)]


def test_held_out_accuracy(spark, small_dir):
    got = L.op11_languages(spark, small_dir).join(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
