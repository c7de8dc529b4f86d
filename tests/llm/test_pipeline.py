"""The pipeline's stages against brute force over a small corpus."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from terrashift.llm import minhash, packing, spans
from test_llm_operators import components_by_force, docs_of, prose, removed_by_force


def corpus():
    r = random.Random(1)
    texts = prose(11, 40, 90)
    texts += [texts[0], texts[1] + " Extra.", "### " * 80, "", None]
    texts += ["\n".join(r.choice(texts[:20]) for _ in range(2)) for _ in range(5)]
    return texts


def test_stages(spark, tmp_path):
    docs = docs_of(spark, corpus(), extra=1)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "minhash_dedup", "span_dedup", "packing"]
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = step(spark, docs, "")
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.collect()}
        ids = sorted(before)
        if name == "line_dedup":
            want = removed_by_force([before[i] for i in ids])
            for i, gone in zip(ids, want, strict=True):
                assert after[i] == "\n".join(x for k, x in enumerate(before[i].split("\n")) if k not in gone)
        elif name == "minhash_dedup":
            _, roots = components_by_force([before[i] for i in ids], 5)
            assert sorted(after) == [ids[k] for k in sorted(set(roots))]
        elif name == "quality_rules":
            assert set(after) < set(before) and all(after[i] == before[i] for i in after)
        else:
            assert set(after) == set(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.doc_id] += p.length
        assert len(p.ids) == 4 * p.length
    assert set(tokens) == set(after) and all(p.length <= packing.LENGTH for p in pieces)
    assert minhash.LEADS and spans.WORDS and docs.filter(F.col("text").isNull()).count() == 0


def test_run(spark, small_dir):
    assert corpus_pipeline.run(spark, small_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
