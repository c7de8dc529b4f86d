"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import itertools
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.llm import common, ctw, html, lines, minhash, packing, pieces, quality, spans, tiff, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df


def prose(seed, n, words=60):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(60)]
    return [". ".join(" ".join(r.choice(pool) for _ in range(8)).capitalize() for _ in range(words // 8)) + "." for _ in range(n)]


ODD = [None, "", " ", "\n\n", "a", "one two", "x" * 3000, "wörd ñ 日本 \U0001f600", "a b c " * 400, "same text here", "same text here", "\x00\x1c ctrl", "TAB\tand\x0bVT"]
CLASHING = {"key": 1, "node": "n", "media": "m", "pages": 2, "h1": 3, "word": "w", "unit": "u", "__x": 0}


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD, **CLASHING)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, ["x"], **CLASHING).filter("doc_id < 0")


# --- TIFF -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256))])
@pytest.mark.parametrize("n", [0, 1, 127, 129, 4095, 9000])
def test_codecs(alphabet, n):
    r = random.Random(n)
    data = bytes(r.choice(alphabet) for _ in range(n))
    assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data


@pytest.mark.parametrize("rows", [1, 2, 3, 63, 64, 65, 300, 1500])
def test_tiff_round_trip(rows):
    data = np.random.default_rng(rows).integers(0, 9, rows * 64, dtype=np.uint8).tobytes()
    pages = tiff.read_pages(tiff.write_tiff(data))
    assert b"".join(p["pixels"] for p in pages) == data and {p["error"] for p in pages} == {None}


def test_predictors():
    a = np.arange(24, dtype=np.uint8).reshape(2, 12)
    back = tiff.undo_predictor(a, 2, 3, 8, "<")
    assert back[0, 3] == a[0, 0] + a[0, 3] and back[0, 6] == (int(a[0, 0]) + int(a[0, 3]) + int(a[0, 6])) % 256
    values = np.array([[1.5, -2.0, 3.25]], ">f4")
    planes = values.view(np.uint8).reshape(1, 3, 4).transpose(0, 2, 1).reshape(1, -1)
    stored = np.hstack([planes[:, :1], np.diff(planes, axis=1)])
    for order in "<>":
        assert tiff.undo_predictor(stored, 3, 1, 32, order).view(f"{order}f4").tolist() == values.tolist()


def test_broken_tiff():
    good = tiff.write_tiff(b"\1" * 64 * 600)
    assert tiff.read_pages(None) == [] and tiff.read_pages(b"") == []
    assert tiff.read_pages(b"no image at all")[0]["error"]
    assert tiff.read_pages(good[:200])[-1]["error"]
    loop = bytearray(good)
    order = "<" if good[:2] == b"II" else ">"
    import struct

    first = struct.unpack_from(order + "I", good, 4)[0]
    struct.pack_into(order + "I", loop, first + 2 + 12 * struct.unpack_from(order + "H", good, first)[0], first)
    assert "loops" in tiff.read_pages(bytes(loop))[-1]["error"]


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("reversed_bits", [False, True])
@pytest.mark.parametrize("compression", [tiff.STORED, tiff.PACKBITS, tiff.LZW])
def test_small_samples(bits, reversed_bits, compression):
    import struct

    r = random.Random(bits)
    width, height = 13, 5
    want = [[r.randrange(1 << bits) for _ in range(width)] for _ in range(height)]
    rows = []
    for row in want:
        text = "".join(f"{v:0{bits}b}" for v in row)
        text += "0" * (-len(text) % 8)
        rows.append(bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)))
    raw = b"".join(rows)
    coded = {tiff.STORED: bytes, tiff.PACKBITS: tiff.packbits_encode, tiff.LZW: tiff.lzw_encode}[compression](raw)
    if reversed_bits:
        coded = bytes(int(f"{b:08b}"[::-1], 2) for b in coded)
    fields = [(256, 4, width), (257, 4, height), (258, 3, bits), (259, 3, compression), (262, 3, 1), (266, 3, 1 + reversed_bits), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(coded))]
    coded += b"\0" * (len(coded) % 2)
    data = b"II" + struct.pack("<HI", 42, 8 + len(coded)) + coded + struct.pack("<H", len(fields))
    data += b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I" if k == 4 else "<HH", *([v] if k == 4 else [v, 0])) for t, k, v in fields) + struct.pack("<I", 0)
    (page,) = tiff.read_pages(data)
    assert page["error"] is None and list(page["pixels"]) == [v for row in want for v in row]


def test_tiff_rows(spark, odd, empty):
    stored = tiff.store_texts(odd).withColumn("page", F.lit("clash"))
    back = defaultdict(bytes)
    for r in sorted(tiff.read_tiff(stored).collect(), key=lambda r: (r.doc_id, r.page)):
        back[r.doc_id] += r.pixels
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        assert back[i] == raw + b"\0" * (-len(raw) % 64 if raw else 64)
    assert tiff.read_tiff(tiff.store_texts(empty)).count() == 0


# --- context-tree weighting -----------------------------------------------------------------------------------------


def coded(text):
    """The bytes that are coded: words with one blank between, then the stop."""
    return [*" ".join(WORD.findall(low(text or ""))).encode(), 255]


def ctw_by_recursion(texts, depth):
    """log10 probability of a text under the mixture over the training texts, by the definition."""
    from functools import cache
    from math import exp, lgamma, log, log10

    counts = defaultdict(lambda: [0, 0])
    contexts = defaultdict(set)

    def steps(text):
        seq = [254] * depth + coded(text)
        for i in range(depth, len(seq)):
            yield tuple(seq[i - depth : i][::-1]), seq[i]

    for text in texts:
        for ctx, byte in steps(text):
            for k in range(8):
                node = (256 + byte) >> (8 - k)
                for d in range(depth + 1):
                    counts[ctx[:d], node][byte >> (7 - k) & 1] += 1
                    if d:
                        contexts[ctx[: d - 1], node].add(ctx[:d])

    def kt(a, b):
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - 2 * lgamma(0.5)

    @cache
    def pw(ctx, node):
        x = kt(*counts[ctx, node])
        if len(ctx) == depth:
            return x
        y = sum(pw(child, node) for child in contexts[ctx, node])
        return log(0.5) + max(x, y) + log(exp(x - max(x, y)) + exp(y - max(x, y)))

    @cache
    def one(ctx, node, d=0):
        if (ctx[:d], node) not in counts:
            return 0.5
        a, b = counts[ctx[:d], node]
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        stop = exp(log(0.5) + kt(a, b) - pw(ctx[:d], node))
        return stop * own + (1 - stop) * one(ctx, node, d + 1)

    def score(text):
        total = 0.0
        for ctx, byte in steps(text):
            for k in range(8):
                p = one(ctx, (256 + byte) >> (8 - k))
                total += log10(p if byte >> (7 - k) & 1 else 1 - p)
        return total

    return score


@pytest.mark.parametrize(("head", "block", "piece"), [(ctw.HEAD, ctw.BLOCK, ctw.PIECE), (50, 64, 40)])
def test_ctw_equals_recursion(spark, monkeypatch, head, block, piece):
    """Whole texts; the second time with small bounds, so that most events meet the texts in the join."""
    for name, value in (("HEAD", head), ("HEAD_WORDS", 5), ("BLOCK", block), ("PIECE", piece), ("HELD", 30 * piece)):
        monkeypatch.setattr(ctw, name, value)
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abé") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 12))) for _ in range(40)]
    texts += [None, "", " A\n\n b\t", "zz zz", "A b", "\x00\x01 \x00", "日本 " * 5, texts[0], texts[3]]
    want = ctw_by_recursion([t for i, t in enumerate(texts) if i % 3], ctw.DEPTH)
    got = {x.doc_id: x for x in ctw.score_texts(docs_of(spark, texts), F.col("doc_id") % 3 != 0).collect()}
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(want(t), rel=1e-8), t
        assert got[i].bits_per_byte == pytest.approx(-want(t) / np.log10(2) / len(coded(t)), rel=1e-8)


def test_ctw_texts(spark, odd, empty):
    texts = prose(1, 40) + [None, "", "new"]
    docs = docs_of(spark, texts)
    train = F.col("doc_id") % 4 != 0
    got = {r.doc_id: r for r in ctw.score_texts(docs, train).collect()}
    tokens = {i: [*WORD.findall(low(t or "")), "\n"] for i, t in enumerate(texts)}
    c = Counter(w for i, ws in tokens.items() if i % 4 for w in ws)
    n = sum(c.values())
    for i, ws in tokens.items():
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in ws)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score < 0
    assert ctw.score_texts(odd, F.lit(True)).count() == len(ODD)
    assert ctw.score_texts(odd, F.lit(False)).filter("score < 0").count() == len(ODD)
    assert ctw.score_texts(empty, F.lit(True)).count() == 0


# --- line dedup -----------------------------------------------------------------------------------------------------


def removed_by_force(texts):
    seen, exact, out = [], set(), []
    for t in texts:
        gone = []
        for i, line in enumerate(low(t or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if not s:
                continue
            if s in exact or any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                gone.append(i)
            if s not in exact:
                seen.append(s)
                exact.add(s)
        out.append(gone)
    return out


def near_lines(seed, n):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(40)]
    bases = [[r.choice(pool) for _ in range(r.randint(1, 24))] for _ in range(12)]

    def line():
        words = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            words[r.randrange(len(words))] = r.choice(pool)
        return " ".join(words)

    return ["\n".join(line() for _ in range(r.randint(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("texts", [near_lines(1, 60), near_lines(2, 60), [*near_lines(3, 5), *ODD, None, "a b c d e\nA B C D E\na b c d f"]])
def test_lines_equal_force(spark, texts):
    docs = docs_of(spark, texts, **CLASHING)
    got = {r.doc_id: list(r.removed) for r in lines.removed_lines(docs).collect()}
    want = removed_by_force(texts)
    assert got == dict(enumerate(want))
    kept = {r.doc_id: r.text for r in lines.deduplicate(docs).collect()}
    for i, t in enumerate(texts):
        assert kept[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]))


def test_lines_empty(spark, empty):
    assert lines.deduplicate(empty).count() == 0 and lines.deduplicate(empty).columns == empty.columns


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_restores_obfuscation():
    words = Counter("the idiot moron trash clown loser worthless pathetic scum stupid and with other plain words here".split() * 20)
    counts = np.zeros(28**3, np.int64)
    for w, n in words.items():
        s = [0, 0, *(toxicity._symbol(c) for c in w), 0]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            counts[(a * 28 + b) * 28 + c] += n
    d = toxicity.Decoder(counts)
    for seen, want in {"1d10t": "idiot", "i d i o t": "idiot", "idiooot": "idiot", "m.o.r.o.n": "moron", "tr@$h": "trash", "cl-o-wn": "clown", "l0ser": "loser"}.items():
        assert want in d.words(f"the {seen} here"), seen
    assert d.words("plain words") == {"plain", "words"} and d.words("") == set()


def test_trigram_counts(spark):
    texts = ["ab ab abc", "É x", None, "a1 b"]
    want = np.zeros(28**3, np.int64)
    for t in texts:
        for w in (t or "").lower().split():
            if w.isalpha():
                s = [0, 0, *(toxicity._symbol(c) for c in w), 0]
                for a, b, c in zip(s, s[1:], s[2:], strict=False):
                    want[(a * 28 + b) * 28 + c] += 1
    got = toxicity.trigram_counts(docs_of(spark, texts))
    assert got.tolist() == want.tolist()


def test_toxicity_held_out(spark, odd, empty):
    r = random.Random(4)
    base = prose(9, 300, 40)
    toxic = [i % 3 == 0 for i in range(300)]
    texts = [t + (" You " + r.choice(["zidiot", "zmoron"]) if x else "") for t, x in zip(base, toxic, strict=True)]
    texts[3] = base[3] + " z1d10t"
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic) if i % 5], "doc_id long, toxic int")
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, labels).collect()}
    assert np.mean([got[i] == toxic[i] for i in range(0, 300, 5)]) >= 0.95
    assert toxicity.score(odd, labels.filter("doc_id < 0")).filter("score between 0 and 1").count() == len(ODD)
    assert toxicity.score(odd, labels.filter("toxic = 0")).filter("score < 0.5").count() == len(ODD)
    assert toxicity.score(empty, labels).count() == 0


# --- pieces ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.default_model())


def best_score(model, word):
    best = [0.0] + [float("-inf")] * len(word)
    for j in range(1, len(word) + 1):
        best[j] = best[j - 1] + model.unknown
        for i in range(j):
            if word[i:j] in model.scored:
                best[j] = max(best[j], best[i] + model.scored[word[i:j]][0])
    return best[-1]


def test_paths_are_best(model):
    words = {w for t in [*prose(2, 5), "naïve café 日本語 x\ty ﬁ ▁ a  b   c"] for w in model.words(t)}
    for w, ids in model.best_paths(words).items():
        known = [i for i in ids if i not in model.byte_of]
        unknown = len(w) - sum(len(model.pieces[i]) for i in known)
        assert sum(model.scored[model.pieces[i]][0] for i in known) + unknown * model.unknown == pytest.approx(best_score(model, w)), w
        assert "".join(model.pieces[i] for i in known) == "".join(c for c in w if c in model.scored) or unknown == 0


def test_paths_by_enumeration(model):
    for w in ("▁the", "▁ness", "▁tion", "▁abc"):
        cuts = (([0, *c, len(w)]) for k in range(len(w)) for c in itertools.combinations(range(1, len(w)), k))
        scores = [sum(model.scored[w[a:b]][0] for a, b in zip(c, c[1:], strict=False)) for c in cuts if all(w[a:b] in model.scored for a, b in zip(c, c[1:], strict=False))]
        assert sum(model.scored[model.pieces[i]][0] for i in model.best_paths([w])[w]) == pytest.approx(max(scores))


def test_pieces_round_trip(spark, odd, empty):
    back = {r.doc_id: r for r in pieces.decode(pieces.encode(odd)).collect()}
    for i, t in enumerate(ODD):
        assert back[i].decoded == (t or "")
    assert back[0].ids == [] and pieces.encode(empty).count() == 0


# --- spans ----------------------------------------------------------------------------------------------------------


def test_spans(spark):
    passage = "The quick brown fox jumps over the lazy dog. Then it sleeps for a very long time under a tree. At last it wakes up again."
    texts = [f"Own start one here. {passage} Own end one.", f"Another start. {passage} Another end.", "Nothing shared here at all. Really nothing in it to find again.", None, "", passage, "Short. One.", "Short. One."]
    docs = docs_of(spark, texts, **CLASHING)
    got = {r.doc_id: r for r in spans.deduplicate(docs).collect()}
    assert [got[i].text for i in (0, 2, 3, 4, 6, 7)] == [texts[i] for i in (0, 2, 3, 4, 6, 7)]
    assert got[1].text == "Another start. Another end." and got[5].text == ""


def test_spans_equal_force(spark):
    r = random.Random(7)
    pool = [" ".join(f"t{r.randrange(30)}" for _ in range(r.randint(1, 9))) + "." for _ in range(40)]
    texts = [r.choice((" ", "\n")).join(r.choice(pool) for _ in range(r.randint(1, 14))) for _ in range(50)] + list(ODD)
    keys = {}
    for i, t in enumerate(texts):
        bounds = spans.sentences(t)
        parts = [tuple(WORD.findall(t[a:b])) for a, b in bounds]
        for a in range(len(parts)):
            b = next((b for b in range(a + spans.SENTENCES, len(parts) + 1) if sum(map(len, parts[a:b])) >= spans.WORDS), None)
            if b:
                keys.setdefault(tuple(parts[a:b]), []).append((i, a, b))
    gone = defaultdict(set)
    for places in keys.values():
        for i, a, b in sorted(places)[1:]:
            gone[i] |= set(range(a, b))
    got = {r.doc_id: set(r["sentences"]) for r in spans.covered(docs_of(spark, texts)).collect()}
    assert got == {i: s for i, s in gone.items() if s}


# --- packing --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length", [7, 2048])
def test_packing(spark, odd, empty, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(odd.repartition(3), length=length).orderBy("sequence_id", "offset").collect()
    at, parts = 0, defaultdict(list)
    for r in rows:
        assert (r.sequence_id, r.offset) == divmod(at, length)
        at += r.length
        parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for i, t in enumerate(ODD):
        ids = [x for _, p, _ in sorted(parts[i]) for x in p]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] and {n for *_, n in parts[i]} == {len(ids)}
    assert packing.pack(empty).count() == 0


def test_words_tokenize_like_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = packing.word_ids(packing.default_tokenizer())
    for t in ("It's ²½ ª \xa0 a b ́x café", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ İ ǅ ﬁ 日本語 12 3", "I'LL we'Ve ##$$ a.b,c"):
        assert np.frombuffer(ids.text(t, b""), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality_counts(spark, odd):
    texts = [*ODD, *prose(3, 5), "a b c d a b c x a b c", "x y z x y z x y z", " ".join(f"w{i % 70}" for i in range(700)), "l\nl\n\n \nm\nl"]
    got = {r.doc_id: r for r in quality.statistics(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[g] > 1 for k in (j, j + 1, j + 2)}
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(s) for s in quality.SYMBOLS), len(ls) - len(set(ls)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t


def test_mcd_against_numpy(spark):
    r = np.random.default_rng(2)
    x = np.vstack([r.multivariate_normal([1, 2, 3, 4], np.diag([1, 2, 1, 3.0]) + 0.3, 900), r.normal(25, 0.5, (100, 4))])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, " + ", ".join(f"{n} double" for n in quality.FEATURES))
    far = quality.with_distance(rows, quality.robust_estimates(rows, ["g"], floor=(0.0,) * 4), ["g"])
    limit = quality._chi2_quantile(1 - quality.TAIL, 4)
    flagged = [q.d2 > limit for q in far.select("d2", quality.FEATURES[0]).collect()]
    high = [q[0] > 15 for q in far.select(quality.FEATURES[0]).collect()]
    assert sum(high) == 100 and flagged == high
    # The classical estimate is masked by the same outliers.
    mean, cov = x.mean(0), np.cov(x.T)
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    assert (d[900:] > limit).sum() == 0


def test_concentration_never_raises_the_determinant(spark):
    """Each step by plain numpy from the same start ends at the same estimate; the lesser determinant counts."""
    r = np.random.default_rng(4)
    a = np.array([[1, 0, 0, 0], [0.9, 0.3, 0, 0], [0.2, 0.5, 1, 0], [0, 0.1, 0.3, 2]])
    x = np.vstack([r.normal(0, 1, (700, 4)) @ a.T, r.normal(9, 0.3, (150, 4))])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, " + ", ".join(f"{n} double" for n in quality.FEATURES))
    got = quality.robust_estimates(rows, ["g"], floor=(0.0,) * 4, steps=30).first()
    med = np.median(x, 0)
    s = 1.4826 * np.median(np.abs(x - med), 0)
    rel = np.corrcoef(np.tanh((x - med) / s).T)
    ends = []
    for start in (0, 1):
        mean, cov = med, np.where(np.eye(4, dtype=bool), np.outer(s, s), 0.95 * start * rel * np.outer(s, s))
        dets = []
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[d <= np.quantile(d, quality.SHARE)]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) * quality.consistency(quality.SHARE, 4)
            dets.append(np.linalg.slogdet(cov)[1])
        assert all(b <= a + 1e-9 for a, b in zip(dets, dets[1:], strict=False))
        ends.append((dets[-1], mean))
    assert got.logdet == pytest.approx(min(ends)[0], abs=0.02)
    assert [got[f"m{i}"] for i in range(4)] == pytest.approx(list(min(ends, key=lambda e: e[0])[1]), abs=0.05)


def test_each_feature_rejects_alone(spark):
    """In a clean group: long words, symbols, one line after every paragraph, runs of words said twice."""
    clean = [t for t in prose(5, 400, 80) if len(WORD.findall(t)) >= 50]
    words = [f"{c}{d}{e}o" for c in "bcdfg" for d in "aeiou" for e in "klmnprst"]
    apart = {
        "f_length": " ".join(w * 4 for w in words),
        "f_symbols": " ".join(w + "#" * (i % 2) for i, w in enumerate(words)),
        "f_lines": "\n".join(" ".join(words[6 * i : 6 * i + 6]) + "\nread on" for i in range(30)),
        "f_repeats": " ".join(words[:36] + words[36:42] + words[:36] + words[42:110]),
    }
    texts = clean + list(apart.values())
    docs = docs_of(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    made = docs_of(spark, list(apart.values()))
    rows = quality.statistics(made).select("doc_id", *quality.features()).orderBy("doc_id").collect()
    for r, name in zip(rows, apart, strict=True):
        assert all(r[f] == 0 for f in quality.FEATURES[1:] if f != name), (name, r)
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs).collect()}
    assert all(got[i] == (False, True) for i in range(len(clean)))
    assert [got[len(clean) + i] for i in range(4)] == [(False, False)] * 4


def test_dependent_features_leave_scatter(spark):
    """A group of two texts' copies has features that depend wholly on each other; the verdicts are still made."""
    x = [(1.6, 0.0, 0.0, 0.0)] * 60 + [(1.9, 1.0, 0.5, 2.0)] * 60 + [(1.6, 0.0, 0.05, 0.0)]
    rows = spark.createDataFrame([("g", *v) for v in x], "g string, " + ", ".join(f"{n} double" for n in quality.FEATURES))
    d2 = [r.d2 for r in quality.with_distance(rows, quality.robust_estimates(rows, ["g"]), ["g"]).collect()]
    assert len(d2) == len(x) and all(0 <= v < 1e3 for v in d2) and sum(v > quality._chi2_quantile(1 - quality.TAIL, 4) for v in d2) <= 60


def test_small_groups_are_judged(spark):
    """Of 20 rows a source by their language's estimate, of a small language by the corpus's."""
    clean, junk = prose(5, 400, 80), ["### $$$ %%% " + re.sub(" ", "### ", t) for t in prose(6, 60, 80)]
    rows = [(i, t, "en", "big") for i, t in enumerate(clean + junk[:20])] + [(1000 + i, t, "en", "tiny") for i, t in enumerate(junk[20:40])] + [(2000 + i, t, "xx", None) for i, t in enumerate(junk[40:])]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and not any(got[r[0]] for r in rows if "###" in r[1])
    assert all(got[i] for i in range(400))


def test_quality_verdicts(spark, odd, empty):
    clean = prose(5, 300, 80)
    junk = ["### $$$ %%% " + re.sub(" ", "### ", t) for t in prose(6, 20, 80)]
    docs = docs_of(spark, clean + junk, **CLASHING).withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(got[i] for i in range(300) if len(WORD.findall(clean[i])) >= 50) and not any(got[i] for i in range(300, 320))
    assert quality.judge(odd).count() == len(ODD) and quality.judge(odd).filter("kept").count() <= 2
    kept = quality.stage_quality(spark, docs, "")
    assert kept.columns == docs.columns and quality.stage_quality(spark, empty, "").count() == 0


# --- MinHash --------------------------------------------------------------------------------------------------------


def components_by_force(texts, k):
    sets = []
    for t in texts:
        w = WORD.findall(low(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_equals_force(spark, k):
    r = random.Random(k)
    texts = []
    for t in prose(8, 12, 120):
        words = t.split()
        for _ in range(8):
            new = list(words)
            for _ in range(r.choice((0, 1, 1, 2, 3, 8))):
                new[r.randrange(len(new))] = f"n{r.randrange(999)}"
            texts.append(" ".join(new))
    texts += ODD
    r.shuffle(texts)
    sizes, roots = components_by_force(texts, k)
    got = {q.doc_id: q for q in minhash.near_duplicates(docs_of(spark, texts, **CLASHING), k).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].kept for i in range(len(texts))] == [i == x for i, x in enumerate(roots)]


def test_minhash_stage(spark, empty):
    docs = docs_of(spark, ["a b c d e f g"] * 3 + ["", None, "z"], **CLASHING)
    kept = minhash.stage_minhash(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert minhash.stage_minhash(spark, empty, "").count() == 0


def test_pruning_bounds():
    least = minhash.fewest_equal(0.8, 1e-6)
    # Fewer equal values than expected by chance at the threshold stay possible; none at all do not.
    assert all(0 < m < 0.8 * n for m, n in zip(least, range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH), strict=True))


def test_long_chains_settle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    nodes = spark.range(62).withColumnRenamed("id", "node")
    got = {r.node: r.root for r in minhash.components(nodes, links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 61: 61}


def test_inflate_stops_at_the_page(spark):
    """A stream that would unfold to 200 MB gives the page's bytes; one that ends early is an error of its page."""
    bomb = zlib.compress(bytes(200 << 20))
    tracemalloc.start()
    assert tiff.decompress(bomb, tiff.DEFLATE, 64) == bytes(64)
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    assert tiff.decompress(zlib.compress(b""), tiff.DEFLATE, 0) == b""
    with pytest.raises(ValueError):
        tiff.decompress(zlib.compress(b"abc"), tiff.DEFLATE, 4)


# --- HTML -----------------------------------------------------------------------------------------------------------


def test_crf_held_out():
    wrong = total = 0
    for seed in range(5000, 5100):
        chain, gold = html.labelled_chain(seed)
        wrong += sum(a != b for a, b in zip(html.model().label(chain), gold, strict=True))
        total += len(gold)
    assert wrong / total < 0.02


def test_viterbi_by_force():
    r = np.random.default_rng(0)
    for n in range(1, 7):
        s, m = r.normal(size=(n, 2)), r.normal(size=(2, 2))
        score = lambda y: sum(s[i, y[i]] for i in range(n)) + sum(m[y[i - 1], y[i]] for i in range(1, n))  # noqa: E731, B023
        assert html.viterbi(s, m) == list(max(itertools.product((0, 1), repeat=n), key=score))


def test_gradient_by_enumeration():
    r = np.random.default_rng(3)
    pages = [([[0, 2], [1], [2, 2, 3]], [0, 1, 1]), ([[3], [0, 1]], [1, 0])]
    w, move = r.normal(size=(4, 2)), r.normal(size=(2, 2))

    def mean(w, move):
        total = 0.0
        for feats, gold in pages:
            score = lambda y: sum(w[f, y[i]].sum() for i, f in enumerate(feats)) + sum(move[y[i - 1], y[i]] for i in range(1, len(y)))  # noqa: E731, B023
            total += score(gold) - np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=len(feats))])
        return total / len(pages)

    for got, x in zip(html.gradient(w, move, pages), (w, move), strict=True):
        for at in np.ndindex(x.shape):
            old = x[at]
            x[at] = old + 1e-6
            up = mean(w, move)
            x[at] = old - 1e-6
            down = mean(w, move)
            x[at] = old
            assert got[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_shared_chains_score_as_features():
    for seed in range(6000, 6010):
        chain, _ = html.labelled_chain(seed)
        m = html.model()
        assert m.label(chain) == html.viterbi(np.array([m.weights[f].sum(0) for f in html._features(chain)]), m.move)


PROSE = "The river rose through the night and the lower fields were under water by dawn. Farmers moved their herds to higher ground."
MORE = "Nobody was hurt, but two bridges are closed. The council meets on Monday to decide what can be repaired before winter."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div>links</div><div><h1>Title</h1><p>{PROSE}</p></div><div>Copyright</div>", ["Title", PROSE]),
        (f"<div><a href=/>Home</a> <a href=/n>News</a></div><div><h1>Flood</h1><p>{PROSE}</p><p>{MORE}</p></div><div>Copyright 2020 Valley Paper</div>", ["Flood", PROSE, MORE]),
        (f"<article><h1>Flood</h1><p>{PROSE}</p><aside>Related stuff</aside><p>{MORE}</p></article>", ["Flood", PROSE, MORE]),
        (f"<body><div class=x><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div class=y><h1>Flood</h1><div>{PROSE}</div><div>{MORE}</div></div><div>&copy; 2021 Paper</div>", ["Flood", PROSE, MORE]),
        (f"<header><a href=/>Site</a></header><main><h1>Flood</h1><p>{PROSE}</p><h2>After</h2><ul><li>one thing<li>another thing</ul></main><aside>See also</aside><footer>All rights reserved</footer>", ["Flood", PROSE, "After", "one thing", "another thing"]),
        (f"<div class=post><h1>Flood</h1><p>{PROSE}</p></div><div id=comments><div class=comment><p>{MORE}</p></div></div>", ["Flood", PROSE]),
        (f"<table><tr><td><a href=a>One</a> <a href=b>Two</a></td><td><h1>Flood</h1><p>{PROSE}<p>{MORE}</td></tr></table>", ["Flood", PROSE, MORE]),
        (f"<p>{PROSE}</p><p>{MORE}</p>", [PROSE, MORE]),
    ],
)
def test_pages_by_hand(page, want):
    assert html.main_text(html.model(), page).split("\n\n") == want


def test_hostile_pages_take_linear_time():
    n = 100_000
    hostile = [
        '<a b="x ' * n, '<i=">"' * n, "<a" * n + '">', "<a \"'" * n + ">", "<div>x" * n, "<b>" * n + "<td><li>" * n, "<div>" * n + "</span>" * n,
        "<span><body>" + "<div>" * n + "</span>x" * n, "<![CDATA[>" * n, "&#" + "9" * n + ";", "<p class='" + "a b " * n + "'>x", "<!--" * n, "<script>" * n,
    ]
    for page in hostile:
        began = time.process_time()
        html.main_text(html.model(), page)
        # By the square these would take from minutes to hours.
        assert time.process_time() - began < 30, page[:20]


def test_references_of_many_digits():
    assert [b[1] for b in html.blocks("a &#" + "0" * 6000 + "65; &#" + "9" * 6000 + "; b")] == ["a A \ufffd b"]


def test_blocks():
    page = "<body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p><b>One\n  two<br>three<p>Four</article><script>no</script><!-- no --><footer>end"
    assert [b[1] for b in html.blocks(page)] == ["Menu", "T & U", "One two three", "Four", "end"]
    assert html.blocks(None) == [] and html.blocks("") == []


def test_extract(spark):
    page = html.labelled_page(77777)[0]
    rows = spark.createDataFrame([(0, "u", page), (1, None, None), (2, "u", ""), (3, "u", "<div")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html.extract(rows).collect()}
    assert got[1] == got[2] == "" and got[0]
    assert html.extract(rows.filter("page_id < 0")).count() == 0


def test_helpers():
    assert common.words_of("a\x1cb c d") == ["a\x1cb", "c d"] and common.words_of(None) == []
    assert zlib.crc32(b"7") % 10 in range(10)
