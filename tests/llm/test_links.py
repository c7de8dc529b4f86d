"""Every link between different lines, of families in which each line is settled by the ones beside it."""

import re

from terrashift.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_links_equal_force(spark, tmp_path):
    stem = [f"w{i}" for i in range(12)]
    family = [" ".join([*stem, f"n{i}"]) for i in range(9)] + [" ".join(stem[:-1]), " ".join([*stem[::-1], "n3"]), "other words stand here alone", "a b"]
    texts = ["\n".join(family[:5]), "\n".join(family[3:]), "\n".join(family), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    places = {}
    for d, t in enumerate(texts):
        for i, x in enumerate((t or "").split("\n")):
            if words := frozenset(WORD.findall(x)):
                places.setdefault(words, (d, i))
    want = sorted((*min(p, q), *max(p, q)) for a, p in places.items() for b, q in places.items() if p < q and 100 * len(a & b) >= 80 * len(a | b))
    got = sorted(tuple(r) for r in lines.op3_links(spark, str(tmp_path)).select("doc_a", "line_a", "doc_b", "line_b").collect())
    assert got == want and len(got) > 36
    members = {(r.doc_id, r.line): (r.first_doc, r.first_line) for r in lines.op3_members(spark, str(tmp_path)).collect()}
    assert members == {(d, i): places[frozenset(WORD.findall(x))] for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)}
