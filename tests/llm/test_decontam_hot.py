"""Items whose own words are frequent: a passage on a third of the documents, and items of common words alone."""

import random

import pytest

from gridols.llm import decontam as dc

RARE = "quixotic zephyrs juggle twelve amber lanterns beneath the vaulted observatory while nobody counts. The answer is heliotrope"
COMMON = "the people of that town would often go out there"


@pytest.fixture(scope="module")
def docs(spark):
    rng, common = random.Random(4), (COMMON + " and a with from some into").split()
    rows = []
    for i in range(300):
        own = " ".join(rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(3000)}" for _ in range(120))
        rows.append((i, own + (f". {RARE}. {own}" if i % 3 == 0 else f". {COMMON}." if i in (1, 4) else "")))
    rows.append((900, "a quixotic zephyr. " + " ".join(w for k, w in enumerate(RARE.split()) if k not in (3, 11))))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_hot_and_common_items_are_found(spark, docs):
    items = spark.createDataFrame([(1, RARE), (2, COMMON), (3, "w1 w2"), (4, "never seen")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, items).collect()}
    joined = {r["doc_id"]: b" " + b" ".join(dc.words(r["text"].encode())) + b" " for r in docs.collect()}
    want = {(d, i) for d, t in joined.items() for i, x in ((1, RARE), (2, COMMON)) if b" " + b" ".join(dc.words(x.encode())) + b" " in t}
    assert len(want) == 102 and want | {(900, 1)} <= found
    assert not {d for d, i in found if i == 1 and d % 3 and d < 900} and not {d for d, i in found if i == 4}


def test_places_find_every_copy():
    rng = random.Random(5)
    its = dc.Items([(k, " ".join(rng.choice("abcdefgh") for _ in range(n)).encode()) for k, n in enumerate((1, 2, 3, 4, 9, 30, 0))])
    for k, s in enumerate(its.words[:6]):
        text = b" ".join([b"zz a b"] * 5 + s + [b"c zz"])
        n = len(s)
        got = [p for _, x, p in its.places(dc.term_numbers(text, its.terms)) if x == k]
        assert any(abs(p - 15) <= n // 2 for p in got)
