import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridols.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PATH)


def all_paths(model, text):
    """Every path of a short text with its score, by plain recursion over the whole text."""
    s = (" " + text.replace("▁", pieces.LITERAL)).replace(" ", "▁") if text else ""
    out = []

    def go(i, ids, score):
        if i == len(s):
            out.append((score, tuple(ids)))
            return
        for j in range(i + 1, min(len(s), i + model.longest) + 1):
            p = model.id_of.get(s[i:j])
            if p is not None:
                go(j, [*ids, p], score + model.scores[p])
            elif j == i + 1:
                go(j, [*ids, *model.of_char(s[i])], score + model.fallback)

    go(0, [], 0.0)
    return dict((ids, score) for score, ids in out)


def applied(ids, edits):
    out = list(ids)
    for e in sorted(edits, key=lambda e: -e["piece_from"]):
        out[e["piece_from"] : e["piece_to"]] = e["ids"]
    return tuple(out)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="the inga\nß漢▁", max_size=11), st.integers(1, 6))
def test_n_best_equals_all_paths_sorted(model, text, n):
    ((ids, score, more),) = model.encode([text], n)
    paths = all_paths(model, text)
    want = sorted(paths.values(), reverse=True)[:n]
    got = [tuple(ids.tolist()), *(applied(ids.tolist(), a["edits"]) for a in more)]
    if not text:
        assert (list(ids), score, more) == ([], 0.0, [])
        return
    assert len(set(got)) == len(got) and [paths[g] for g in got] == want
    assert [score, *(a["score"] for a in more)] == want
    assert all(model.decode(g) == text for g in got)


def test_long_cells_are_segmented_as_short_ones(model):
    rng = np.random.default_rng(3)
    cells = ["".join(rng.choice(list(alphabet), size)) for alphabet in ("the inga".replace(" ", ""), "a", "xqz", "漢字of", "\U0010ffffa", "ABCDabcd0123+/=") for size in (1, 2, 7, 40, 300)]
    for c in [*cells, *(" " + c for c in cells), "   ", " \U0010ffff"]:
        short = {}
        model.segment_chunk([c], short)
        assert model.segment_long(c) == short[c], c
        if len(c) <= pieces.LONG:
            continue
        into, forward = model.edges_of(c)
        assert forward[-1] == short[c][1] and [s for s, _ in pieces.a_star(len(c), into, forward, 2)] == [short[c][1], short[c][1] - short[c][2]]


@pytest.mark.parametrize("cells", [3, 20, 63, 64, 65, 400])
def test_of_equal_losses_the_leftmost_cells_are_edited(model, cells):
    ((ids, score, more),) = model.encode([" ".join(["something"] * cells)], 4)
    per = len(ids) // cells
    assert len(ids) == per * cells and len(more) == 3
    assert [[e["piece_from"] // per for e in a["edits"]] for a in more] == [[0], [1], [2]] and len({a["score"] for a in more}) == 1


def test_a_long_text_without_spaces(model):
    rng = np.random.default_rng(5)
    for text in ("".join(rng.choice(list("ABCDEFabcdef0123456789+/"), 200_000)), "a" * 100_000, "漢字仮名交" * 20_000):
        ((ids, score, more),) = model.encode([text], 4)
        assert model.decode(ids.tolist()) == text
        assert score == sum(model.scores[i] if model.raw[i] and i not in model.byte_id.values() else 0 for i in ids) + model.fallback * fallbacks(model, ids)
        for a in more:
            assert a["score"] <= score and model.decode(applied(ids.tolist(), a["edits"])) == text


def fallbacks(model, ids):
    """Characters that went to bytes: those that do not continue a character."""
    byte = {i: b for b, i in model.byte_id.items()}
    return sum(i in byte and byte[i] & 0xC0 != 0x80 for i in ids.tolist())


def test_documents(spark, documents):
    rows = pieces.decode(pieces.encode(documents, PATH), PATH).collect()
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        assert r["text"] == text[r["doc_id"]]
        assert r["decoded_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert len(r["alternatives"]) == 3
        scores = [r["score"], *(a["score"] for a in r["alternatives"])]
        assert scores == sorted(scores, reverse=True)


def test_cache_does_not_change_results(documents, model):
    texts = [r["text"] for r in documents.limit(30).collect()]
    want = [(i.tolist(), s, a) for i, s, a in model.encode(texts, 3)]
    small, pieces.CACHE_CELLS = pieces.CACHE_CELLS, 10
    try:
        fresh = pieces.Pieces(PATH)
        assert [(i.tolist(), s, a) for t in texts for i, s, a in fresh.encode([t], 3)] == want
    finally:
        pieces.CACHE_CELLS = small


def test_odd_rows_and_none(odd, none):
    rows = pieces.decode(pieces.encode(odd, PATH), PATH).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in rows) == sorted(repr((r["doc_id"], r["text"] or "")) for r in odd.collect())
    assert pieces.decode(pieces.encode(none, PATH), PATH).count() == 0
