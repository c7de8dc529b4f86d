"""Spans to the end of a shared passage, and of one sentence."""

import random
import re
from collections import defaultdict

from terrashift.llm import spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def after(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r.doc_id: r.text for r in spans.deduplicate(docs).collect()}


def test_short_last_sentences_go(spark):
    passage = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12 a13 a14 a15. b1 b2 b3 b4 b5 b6 b7 b8. c1 c2 c3."
    got = after(spark, [f"Own start here. {passage} Own end.", f"Another start. {passage} Another end."])
    assert got == {0: f"Own start here. {passage} Own end.", 1: "Another start. Another end."}


def test_one_long_sentence_goes(spark):
    long, short = (" ".join(f"w{i}" for i in range(n)) for n in (spans.LONE, spans.LONE - 1))
    got = after(spark, [long, long, f"One. {long}\nTwo.", short, short])
    assert got == {0: long, 1: "", 2: "One. Two.", 3: short, 4: short}


def test_equals_force(spark):
    r = random.Random(11)
    pool = [" ".join(f"t{r.randrange(30)}" for _ in range(r.choice((1, 2, 3, 8, 15, 55)))) + "." for _ in range(30)]
    shared = [[r.choice(pool) for _ in range(r.randint(1, 6))] for _ in range(8)]
    texts = [" ".join([*(r.choice(pool) for _ in range(r.randint(0, 3))), *r.choice(shared), *(r.choice(pool) for _ in range(r.randint(0, 3)))]) for _ in range(60)]
    places = defaultdict(set)
    for i, t in enumerate(texts):
        parts = [tuple(WORD.findall(t[a:b])) for a, b in spans.sentences(t)]
        n, long = len(parts), lambda a, b: b - a >= spans.SENTENCES and sum(map(len, parts[a:b])) >= spans.WORDS
        # Every run of several sentences that is long enough, not the shortest alone.
        runs = {(a, b) for a in range(n) for b in range(a + 1, n + 1) if long(a, b) or b == a + 1 and len(parts[a]) >= spans.LONE}
        for a, b in runs:
            places[tuple(parts[a:b])].add((i, a, b))
    gone = defaultdict(set)
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            gone[i] |= set(range(a, b))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert {x.doc_id: set(x["sentences"]) for x in spans.covered(docs, spans.LONE).collect()} == gone
