"""Every numbered query over a table of odd rows: columns, types, one row a document, defined results; and over empty tables."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrashift.llm import catalog

QUERIES = catalog.queries()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = "The quick brown fox jumps over the lazy dog. Then it sleeps for a very long time under a tree. At last it wakes up again, hungry as ever."
TEXTS = [None, "", " \n\t ", "a", PLAIN, PLAIN, "é 日本 \U0001f600 \x1c\x00", "word " * 200_000, "x" * 1_000_000, "\n".join([PLAIN] * 5), "you id10t " + PLAIN, "m.o.r.o.n and m o r o n " + PLAIN]
COLUMNS = {
    "op1": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op2": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3": "doc_id bigint, n_lines bigint, n_links bigint, n_removed bigint, removed string",
    "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "doc_id bigint, n_ids bigint, ids_crc32 bigint, n_chars bigint, decoded_sha256 string, round_trip boolean",
    "op6": "doc_id bigint, n_removed bigint, removed array<int>, n_chars bigint, text_sha256 string",
    "op7": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10": "page_id bigint, url string, text string, n_chars bigint",
}
CLASHING = ("__key", "__row", "__doc", "__sentences", "__html", "__media", "key", "row", "node", "h1", "id", "k")


def write(spark, path, texts):
    r = random.Random(2)
    docs = [(i, t, r.choice(["en", None]), f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs += docs[3:6]  # repeated rows
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.withColumns({c: F.lit("taken") for c in CLASHING}).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 10)) for i in range(len(texts))], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    pages = [(0, "u", None), (1, None, ""), (2, "u", "<p>a &amp; b<br>c</p><nav>menu</nav>"), (3, "u", "<div title='x><p>open" + "<div>" * 500 + PLAIN), (3, "u", "<script>var x</script><article><p>" + PLAIN + "</p></article>")]
    spark.createDataFrame(pages if texts else [], "page_id long, url string, html string").withColumns({c: F.lit("taken") for c in CLASHING}).write.parquet(f"{path}/pages.parquet")
    return [(d[0], d[1]) for d in docs]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    return path, write(spark, path, TEXTS)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    write(spark, path, [])
    return path


def numbered(n):
    return next(q for q in QUERIES if q.startswith(f"op{n}_"))


@pytest.mark.parametrize("n", range(1, 11))
def test_columns_and_rows(spark, odd_dir, n):
    path, docs = odd_dir
    df = QUERIES[numbered(n)](spark, path)
    got = dict(df.dtypes)
    for column in COLUMNS[f"op{n}"].split(", "):
        name, kind = column.split(" ")
        assert got.get(name) == kind, (name, got.get(name))
    rows = df.collect()
    if n == 10:
        assert sorted(r.page_id for r in rows) == [0, 1, 2, 3, 3] and all(r.text is not None and r.n_chars == len(r.text) for r in rows)
        return
    if n == 3:  # repeated rows are one text
        assert sorted(r.doc_id for r in rows) == sorted({d for d, _ in docs})
    elif n != 7:
        assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs)
    if n in (2, 4):
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (10 if n == 2 else 5) == 0)
    by = {r.doc_id: r for r in rows}
    if n == 1:
        for d, t in docs:
            raw = (t or "").encode()
            raw_padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            assert (by[d].n_bytes, by[d].payload_bytes, by[d].tail_crc32) == (len(raw), len(raw_padded), zlib.crc32(raw_padded[-64:]))
    if n == 2:
        assert all(r.score < 0 and r.base_score < 0 and r.n_tokens == len(WORD.findall(t or "")) + 1 for (d, t) in docs for r in [by[d]])
    if n == 4:
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows) and len({by[i].score for i in (0, 1)}) == 1
    if n == 5:
        assert all(r.round_trip for r in rows) and by[0].n_ids == 0
    if n == 7:
        assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}[d] for d, _ in docs)
        spans = {}
        for r in rows:
            spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s, parts in spans.items():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at == 2048 or s == max(spans)
    if n == 8:
        assert all(not (r.base_failed and r.kept) and r.kept is not None for r in rows) and by[0].n_words == 0
    if n == 9:
        assert by[0].component_id == 0 and by[1].component_id == 1 and by[5].component_id == 4 and not by[5].kept


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_tables(spark, empty_dir, n):
    assert QUERIES[numbered(n)](spark, empty_dir).count() == 0


def test_pipeline_of_odd_rows(spark, odd_dir, empty_dir):
    path, _ = odd_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, path)
        assert out.columns == docs.columns and out.filter(F.col("`__key`") != "taken").count() == 0
    assert corpus_pipeline.run(spark, path).count() >= 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
