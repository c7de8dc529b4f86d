"""The filter audit against plain Python, over every order, and on odd rows."""

import itertools
import re
from collections import defaultdict

from pyspark.sql import functions as F

from terrashift.llm import filters

TEXTS = [None, "", "short", "short", "word " * 300, "A" * 50 + " b", "one # two", *(" ".join(f"w{i * 7 % 251}" for i in range(n)) for n in (199, 200, 260)), "Ünï " * 250, "a\x1cb \U0001f600 " * 10, "x" * 500_000, "one # two"]


def failures(text, doc_id, all_rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * any(t == text and i < doc_id for i, t in all_rows)


def expected(rows, labels):
    every = [(i, t or "") for i, t, _ in rows]
    seen = defaultdict(list)
    for i, t, lang in rows:
        seen[lang or ""].append((failures(t, i, every), *labels.get(i, (0, 0))))
    out = set()
    for part, docs in seen.items():
        shapley = defaultdict(int)
        table = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                here = [d for d in docs if f in d[0] and not set(order[: step - 1]) & set(d[0])]
                failing = [d for d in docs if f in d[0]]
                shapley[f] += len(here)
                table.append((f, part, order, step, sum(not set(order[:step]) & set(d[0]) for d in docs), len(here), len(failing) - len(here), sum(d[0] == f for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)))
        out |= {(*x[1:], shapley[x[0]]) for x in table}
    return out


def test_table():
    table = filters.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all()
    for mask, (o, order) in itertools.product(range(32), enumerate(filters.orders())):
        assert table[mask, o] == next((s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filters, "PARTS", 1)
    rows = [(i, t, ("en", None, "", "de")[i % 4]) for i, t in enumerate(TEXTS)]
    rows += [rows[2], rows[4]]  # repeated rows are no copies of themselves
    labels = {2: (1, 0), 3: (0, 1), 6: (1, 1), 9: (1, 0), 12: (0, 1)}
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("taken") for c in ("part", "mask", "label", "words", "t", "digest", "first", "cell", "n")}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] + [(2, 0, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = filters.op12_filters(spark, str(tmp_path))
    assert dict(df.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
    got = [tuple(r) for r in df.collect()]
    assert len(got) == 3 * 600 and set(got) == expected(rows, labels)


def test_rows_without_an_id_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, "same", "en"), (1, "same", "en"), (2, "same", "en")], "doc_id long, text string, lang string")
    marked = filters.mark_copies(filters.text_failures(docs), 4)
    assert sorted((r.doc_id or 0, r["mask"] >> 4) for r in marked.collect()) == [(0, 0), (1, 0), (2, 1)]
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert filters.op12_filters(spark, str(tmp_path)).count() == 0
