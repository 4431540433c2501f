"""Lexical search against scoring all documents, with ties, copies and edge cases."""

import math
import random
import re
from collections import Counter

import pytest
from oracle import compare, connect

from docloom.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    """Every document scored for every item."""
    bags = [(i, Counter(low(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            score = sum(w[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in low(text) if t in b)
            if score > 0:
                scored.append((-score, -1 if i is None else i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    rows = S.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **more).collect()
    return sorted(((r["item_id"], r["rank"], -1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in rows), key=repr)


def test_terms_are_the_maximal_matches():
    text = "".join(map(chr, range(0x180))) + " Ab_c-9é漢x\x7fÉa don't"
    assert [t.decode() for t in S.terms(text)] == low(text)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_scores(spark, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, draw(rng.choice([1, 20, 60, 400]))) for i in range(600)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1])]
    items = [(i, draw(rng.randint(1, 30))) for i in range(12)] + [(90, docs[7][1]), (91, "w1"), (91, "w1 w1 w2"), (92, "nowhere")]
    assert found(spark, docs, items, block_docs=4) == brute(docs, items)
    assert found(spark, docs, items, block_docs=4, item_terms=40) == brute(docs, items)


def test_blocks_are_skipped(spark):
    """A bound that skips blocks and lists is what makes the search cheap: on clustered topics most blocks go, and the best remain exact."""
    rng = random.Random(9)
    topics = [[f"t{k}x{j}" for j in range(30)] for k in range(40)]
    docs = [(i, " ".join(rng.choice(topics[i % 40]) for _ in range(40)) + " the of common" + f" s{rng.randint(0, 50)}") for i in range(4000)]
    items = [(k, " ".join(topics[k][:12]) + " the common s7 s8") for k in range(5)]
    assert found(spark, docs, items) == brute(docs, items)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    (block,) = S.item_blocks(spark.createDataFrame(items, "item_id long, text string"))
    v = S.vectors(frame, block)
    search, df, most = S.prepared(v, block, 16)
    least = S.thresholds(v, search, df)
    lists = S.lists_to_read(search, df, most, least)
    assert len(lists.items) < len(block.vocabulary)
    parts = S.summaries(v, search, lists)
    everything = parts.select("term", "cell").distinct().count()
    kept = S.surviving(parts, search, lists, least).count()
    assert 0 < kept < 0.7 * everything


def test_edge_cases(spark):
    long = "alpha beta gamma " * 60_000
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha"), (None, None), (2, None), (3, ""), (4, "!?"), (5, long), (6, "ÄLPHA älpha Alpha漢"), (7, "beta")]
    items = [(1, "Alpha beta"), (1, "Alpha beta"), (None, "gamma"), (2, None), (3, ""), (4, "--"), (5, "älpha")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, [(1, None)]) == [] and found(spark, [(1, "")], items) == []
    extra = spark.createDataFrame([(1, "alpha", "x", "y", "z")], "doc_id long, text string, row string, item string, terms string")
    assert S.ranked(extra, extra.withColumnRenamed("doc_id", "item_id")).count() == 1
    assert S.ranked(extra.limit(0), extra.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_query_equals_its_twin(spark):

    d = "/root/testdata/sf0.001"
    compare(S.op12_geometric_blocks(spark, d), S.OP12_SQL, connect(d))
