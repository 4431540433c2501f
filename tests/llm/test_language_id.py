"""Language identification against a naive cross-parse, on held-out rows, and in edge cases."""

import math
import random
import zlib

import numpy as np
import pytest

from docloom.llm import language_id as L


def naive_phrases(text, known):
    """Longest matches by substring search, anew every SEGMENT bytes."""
    count = 0
    for at in range(0, len(text), L.SEGMENT):
        part = text[at : at + L.SEGMENT]
        i = 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in known:
                j += 1
            i = max(i + 1, j - 1)
            count += 1
    return count


@pytest.mark.parametrize("seed", range(4))
def test_phrases_are_longest_matches(seed):
    rng = random.Random(seed)
    draw = lambda n, letters="abcdé ": "".join(rng.choice(letters) for _ in range(n))
    known = L.normalised(draw(300))
    texts = [L.normalised(draw(rng.choice([1, 5, 255, 256, 257, 900]), "abcdéxß ")) for _ in range(20)] + [L.normalised("")]
    segments, of = L.cut(texts)
    found = np.bincount(of, L.phrases(L.transitions(L.automaton("x", known.tolist())), segments), len(texts))
    assert found.tolist() == [naive_phrases(t.tobytes(), known.tobytes()) for t in texts]


def test_an_automaton_accepts_the_substrings_only():
    text = b"abcbcabcab"
    own = L.automaton("x", list(text))
    edges = {(s, b): t for s, b, t in zip(own.source.tolist(), own.byte.tolist(), own.target.tolist(), strict=True)}
    inside = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def accepted(word):
        at = 0
        for b in word:
            at = edges.get((at, b))
            if at is None:
                return False
        return True

    rng = random.Random(1)
    words = {bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 5))) for _ in range(500)} | inside
    assert {w for w in words if accepted(w)} == {w for w in words if w in inside}
    assert own.states <= 2 * len(text)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = L.op13_cross_parsing(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 100 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_blocks_of_languages_do_not_change_results(spark, monkeypatch):
    rng = random.Random(3)
    letters = ["abc", "bcd", "cde", "def", "efg"]
    rows = [(i, "".join(rng.choice(letters[i % 5]) for _ in range(60)), f"l{i % 5}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    automata = L.train(docs)
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identified(docs, automata).collect()}
    monkeypatch.setattr(L, "BLOCK_LANGUAGES", 2)
    blocks = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identified(docs, automata).collect()}
    assert {i: x[0] for i, x in one.items()} == {i: x[0] for i, x in blocks.items()} == {i: y for i, _, y in rows}
    assert all(math.isclose(one[i][1], blocks[i][1], abs_tol=1e-12) for i in one)


def test_edge_cases(spark):
    long = "the house and the garden " * 40_000
    rows = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, "das haus und der garten", "de"), (4, "das haus", None), (None, "the garden", "en"), (None, None, "en"), (5, None, "de"), (6, "", "en"), (7, "12 + 3 !", "en"), (8, "²", None), (9, long, None), (9, long, None), (11, "haus", "de"), (12, "house", "en"), (13, "漢字", None)]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(r[0] and ids[r[0]], *r[1:], "mine", "mine") for r in rows], "doc_id long, text string, lang string, bits_ string, c0 string")
    found = L.identified(docs, L.train(docs)).collect()
    assert len(found) == len(rows) and {(r["bits_"], r["c0"]) for r in found} == {("mine", "mine")}
    by_text = {r["text"]: r["lang_pred"] for r in found}
    assert by_text["the garden"] == by_text[long] == "en" and by_text["das haus"] == "de"
    assert {by_text[t] for t in (None, "", "12 + 3 !", "²")} == {"und"} and by_text["漢字"] in ("en", "de")
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in found)
    assert L.identified(docs.limit(0), L.train(docs)).count() == 0
    assert {r["lang_pred"] for r in L.identified(docs, L.train(docs.limit(0))).collect()} == {"und"}
