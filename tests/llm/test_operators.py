"""Operators of the llm subpackage against brute force, oracles and edge cases."""

import math
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import DATA, compare, connect
from pyspark.sql import functions as F

from docloom.llm import decontamination, html_text, lattice_lm, line_dedup, packing, quality_rules, registry, sharding, toxicity, url_filter

TEXTS = "doc_id long, text string"
ODD = [(None, "x y z"), (1, None), (2, ""), (3, " \n\t "), (4, "dup"), (4, "dup"), (5, "ñandú " * 3000)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    compare(registry.queries()[name](spark, DATA), registry.oracle_sql()[name], connect())


# 1 decontamination


def test_reparameterised_questions():
    index = decontamination.Index([(7, "Anna Smith has 5 apples and gives 3 apples to Bob before she walks 12 km home with Bob.")])
    canonical = decontamination.Canonical(frozenset(index.vocabulary))
    leak = lambda t: [(x[0], x[3]) for x in index.leaks(canonical.template(t))]
    assert leak("Words first. Carla Jones has 7 apples and gives 2 apples to David before she walks 9 km home with David. More.") == [(7, "reparameterised")]
    assert leak("anna smith has 5 apples and gives 3 apples to bob before she walks 12 km home with bob") == [(7, "exact")]
    assert leak("Anna Smith has 5 apples and nothing else happens on this day in the town.") == []


def test_copy_after_a_partial_variant():
    item = "Anna has 5 apples and gives 3 apples to Bob before she walks 12 km home with Bob."
    index = decontamination.Index([(7, item)])
    canonical = decontamination.Canonical(frozenset(index.vocabulary))
    leak = lambda t: [(x[0], x[2], x[3]) for x in index.leaks(canonical.template(t))]
    part = "Tom has 7 apples and gives 2 apples away to nobody at all. "
    assert leak(part + item) == [(7, 1.0, "exact")]
    assert leak(part + part.replace("7", "5") + "Anna has 4 apples and gives 9 apples to Max before she walks 8 km home with Max.") == [(7, 1.0, "reparameterised")]
    assert leak(part) == []


def test_edited_copies_and_passages():
    words = [f"word{i}" for i in range(59)]

    def leak(item, text):
        index = decontamination.Index([(7, " ".join(item))])
        return [x[0] for x in index.leaks(decontamination.Canonical(frozenset(index.vocabulary)).template(text))]

    edited = lambda n, *at: "before " + " ".join("changed" if i in at else x for i, x in enumerate(words[:n])) + " after"
    assert leak(words[:15], edited(15, 7)) == [7]
    assert leak(words[:38], edited(38, 11, 24)) == [7]
    assert leak(words, "before " + " ".join(words[20:45]) + " after") == [7]
    assert leak(words, "before " + " ".join(words[20:32]) + " after") == []
    # Short matches far apart are no copy.
    assert leak(words[:20], " ".join([*words[:6], *["other"] * 40, *words[7:13], *["other"] * 40, *words[14:20]])) == []
    assert leak(words[:5], " ".join(words[:5])) == [7]


def leaked(items, text):
    index = decontamination.Index(list(enumerate(items)))
    return [(x[0], x[3]) for x in index.leaks(decontamination.Canonical(frozenset(index.vocabulary)).template(text))]


def test_names_that_open_sentences():
    item = "Anna has 5 apples. Anna gives 3 apples to Bob."
    assert leaked([item], "Carla has 7 apples. Carla gives 2 apples to David.") == [(0, "reparameterised")]
    assert leaked([item], "We read: carla has 7 apples. Carla gives 2 apples to David. The end.") == [(0, "reparameterised")]
    assert leaked([item], item) == [(0, "exact")]


def test_numbers_alone_are_no_window_but_continue_one():
    item = "the series begins with 3 4 7 11 18 29 47 76 123"
    assert leaked([item], "So the series begins with 5 8 13 21 34 55 89 144 233 as said.") == [(0, "reparameterised")]
    assert leaked([item], " ".join(map(str, range(100, 1100)))) == []
    assert leaked(["3 4 7 11 18 29 47 76 123"], "All of 3 4 7 11 18 29 47 76 123 here.") == [(0, "exact")]


def test_matches_cost_no_more_than_they_are():
    """Long texts of numbers, many copies with other values, and many items with one opening take linear time."""
    started = time.time()
    assert leaked(["3 4 7 11 18 29 47 76 123"], " ".join(map(str, range(100_000)))) == []
    assert time.time() - started < 2
    item = "anna has 5 apples and 7 pears and gives 3 apples to the man on the way home"
    index = decontamination.Index([(1, item)])
    canonical = decontamination.Canonical(frozenset(index.vocabulary))
    started = time.time()
    text = " ".join(f"anna has {i} apples and {i + 1} pears and gives {i + 3} apples to the man on the way home." for i in range(10, 3000))
    assert [(x[0], x[2]) for x in index.leaks(canonical.template(text))] == [(1, 1.0)]
    assert time.time() - started < 10
    opening = "which of the following is the best answer to the question"
    items = [(i, f"{opening} {' '.join(f'w{i}x{k}' for k in range(18))}") for i in range(20_000)]
    started = time.time()
    index = decontamination.Index(items)
    built = time.time() - started
    canonical = decontamination.Canonical(frozenset(index.vocabulary))
    texts = [canonical.template(f"{opening} {k}") for k in range(200)]
    started = time.time()
    assert all(index.leaks(t) == [] for t in texts)
    assert time.time() - started < 2 and built < 20
    assert [x[0] for x in index.leaks(canonical.template(items[77][1]))] == [77]


def test_common_windows_lose_no_leak():
    """The same leaks whether windows that many items share are put off or not, and for equal items each id."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(["one two three four five six seven", *(rng.choice(words) for _ in range(rng.randint(0, 14)))])) for i in range(150)]
    items += [(1000 + i, items[3][1]) for i in range(100)]
    indexes = [decontamination.Index(items, common=c) for c in (1, 5, 10**9)]
    canonical = decontamination.Canonical(frozenset(indexes[0].vocabulary))
    for i, text in [*items[:20], *((0, " ".join(rng.choice([*words, "one two three four five six seven"]) for _ in range(30))) for _ in range(30))]:
        found = [x.leaks(canonical.template(text)) for x in indexes]
        assert found[0] == found[1] == found[2]
    assert {x[0] for x in indexes[0].leaks(canonical.template(items[3][1]))} >= {3, *range(1000, 1100)}


def test_short_items_are_whole_sentences():
    assert leaked(["What is 17 + 4?"], "First. What is 17 + 4? Then more.") == [(0, "exact")]
    assert leaked(["What is 17 + 4?"], "what is 17 + 4") == [(0, "exact")]
    assert leaked(["What is 17 + 4?", "the", ""], "I ask what is 17 + 4 or 5. The cat.") == []


def test_slotted_windows_equal_brute_force():
    """Questions of a few templates with random names and numbers, against a search over all bindings of whole questions."""
    rng = random.Random(5)
    names, filler = ["Anna", "Bob", "Carla", "David", "Emil"], [f"word{i}" for i in range(50)]
    shapes = ["{a} has {x} apples and gives {y} apples to {b} on the way home", "{a} buys {x} pens . {b} buys {y} pens and {a} pays {z} euros for all", "the train of {a} leaves {x} minutes after that of {b} and takes {y} hours"]

    def made(shape):
        a, b = rng.sample(names, 2)
        x, y, z = rng.sample(range(2, 99), 3)
        return shape.format(a=a, b=b, x=x, y=y, z=z)

    def same(item, text):
        """Whether the words of both are equal under a one-to-one renaming of names and of numbers."""
        i, t = item.replace(" .", ".").split(), text.replace(" .", ".").split()
        slot = lambda w: w.strip(".") in names or w.strip(".").isdigit()
        to, back = {}, {}
        return len(i) == len(t) and all((slot(p) and slot(q) and to.setdefault(p.strip("."), q.strip(".")) == q.strip(".") and back.setdefault(q.strip("."), p.strip(".")) == p.strip(".")) if slot(p) or slot(q) else p == q for p, q in zip(i, t, strict=True))

    for _ in range(60):
        item, own = made(rng.choice(shapes)), made(rng.choice(shapes))
        before, after = (" ".join(rng.choice(filler) for _ in range(12)) for _ in range(2))
        found = leaked([item.replace(" .", ".")], f"{before}. {own.replace(' .', '.')}. {after}")
        assert bool(found) == same(item, own), (item, own)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([4, 6, 20, 40])))) for i in range(30)] + [(99, None)]
    rows = []
    for d in range(120):
        text = [rng.choice(words) for _ in range(60)]
        if d % 4 == 0:
            text[20:20] = items[d // 4 % 30][1].split()
        rows.append((d, " ".join(text)))
    found = decontamination.leaks(spark.createDataFrame(rows + ODD, TEXTS), spark.createDataFrame(items, "item_id long, text string")).collect()

    def brute(text, item):
        t, i = text.split(), item.split()
        if len(i) < decontamination.PIECE:
            return False
        w = min(decontamination.WINDOW, len(i))
        own = {tuple(t[k : k + w]) for k in range(len(t) - w + 1)}
        n = len(i) - w + 1
        return sum(tuple(i[k : k + w]) in own for k in range(n)) >= decontamination.SHARE * n

    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, k) for d, t in rows for k, item in items if item and brute(t, item)}
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (None, "clean")], TEXTS)
    kept = [r["doc_id"] for r in decontamination.without_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(kept, key=repr) == sorted([d for d, _ in rows if d not in {r["doc_id"] for r in found}] + ([None] if 0 in {r["doc_id"] for r in found} else [None, None]), key=repr)
    none = spark.createDataFrame([], TEXTS)
    assert decontamination.leaks(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontamination.leaks(spark.createDataFrame(rows, TEXTS), spark.createDataFrame([], "item_id long, text string")).count() == 0


# 2 URL filter


def test_url_parts_and_edges(spark):
    rows = [(1, "HTTP://Www.Example.COM/en/a?x#y"), (2, "http://example.com/en/b"), (3, "no scheme"), (4, None), (4, None), (5, "x://a.net"), (6, "")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, verdict string")
    found = {r["page_id"]: r for r in url_filter.url_verdicts(df).collect()}
    assert (found[1]["host"], found[1]["path"], found[1]["rule"], found[1]["verdict"]) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert (found[2]["rule"], found[2]["verdict"]) == ("example.com/en/", "block")
    assert all(found[k]["host"] == "" and found[k]["rule"] is None for k in (3, 4, 6)) and url_filter.url_verdicts(df).count() == len(rows)
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


# 3 lattice likelihood


def test_lattice_sums_all_cuts():
    lattice = lattice_lm.Lattice(lattice_lm.default_vocabulary())
    pieces = {p: lattice.log_p[i] for i, p in lattice.plain}
    for word in ("the", "heble", "ñado", "x漢�", "a" * 20):
        marked = lattice_lm.MARK + word
        ways = [0.0] * (len(marked) + 1)
        ways[0] = 1.0
        for j in range(1, len(marked) + 1):
            ways[j] = sum(ways[i] * math.exp(pieces[marked[i:j]]) for i in range(j) if marked[i:j] in pieces)
            if marked[j - 1] not in pieces:
                ways[j] += ways[j - 1] * math.exp(sum(lattice.log_p[lattice.bytes[b]] for b in marked[j - 1].encode()))
        assert math.isclose(lattice.marginals([word])[0, 0], math.log(ways[-1]), rel_tol=1e-9)


def cuts(lattice, log_p, word):
    """(pieces, probability) of every cut of a word, by recursion."""
    number = {p: i for i, p in lattice.plain}
    marked = lattice_lm.MARK + word

    def walk(at):
        if at == len(marked):
            yield (), 0.0
        for end in range(at + 1, len(marked) + 1):
            own = [number[marked[at:end]]] if marked[at:end] in number else [lattice.bytes[b] for b in marked[at].encode()] if end == at + 1 else None
            if own:
                for rest, lp in walk(end):
                    yield (*own, *rest), lp + sum(log_p[i] for i in own)

    return [(own, math.exp(lp)) for own, lp in walk(0)]


def test_expected_counts_equal_enumeration():
    lattice = lattice_lm.Lattice(lattice_lm.default_vocabulary())
    words, times = ["the", "heble", "ñad", "x漢", "thorin"], np.array([3.0, 1.0, 2.0, 1.0, 5.0])
    expected = np.zeros(lattice.size)
    for w, n in zip(words, times, strict=True):
        found = cuts(lattice, lattice.log_p, w)
        whole = sum(p for _, p in found)
        for own, p in found:
            np.add.at(expected, list(own), n * p / whole)
    assert np.allclose(lattice.expected(words, times), expected, atol=1e-9)


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_scores_equal_brute_force(spark, hot):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "the", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(30)))) for i in range(60)] + [(100, None), (101, ""), (101, ""), (None, "the a"), (None, "b w1")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, base string")
    found = lattice_lm.scores(df, lattice_lm.in_training(), lattice_lm.default_vocabulary(), hot=hot, rounds=0).collect()
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    counts = Counter(w for i, t in rows if learn(i) for w in [*(t or "").split(), " "])
    n, v, docs = sum(counts.values()), len(counts), sum(learn(i) for i, _ in rows)
    lattice = lattice_lm.Lattice(lattice_lm.default_vocabulary())
    words = [w for w in counts if w != " "]
    pieces = lattice.cut_counts(words, np.array([counts[w] for w in words], float))
    end = docs / (pieces.sum() + docs)
    log_p = lattice.learned(pieces) + math.log1p(-end)
    lp = {w: math.log10(sum(p for _, p in cuts(lattice, log_p, w))) for w in {w for _, t in rows for w in (t or "").split()}}
    expected = []
    for i, t in rows:
        own = (t or "").split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*own, " "])
        expected.append((i, learn(i), len(own) + 1, sum(counts[w] > 0 for w in [*own, " "]), n, base, sum(lp[w] for w in own) + math.log10(end)))
    key = lambda r: (repr(r[0]), round(r[5], 6))
    for got, want in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key), strict=True):
        assert got[:5] == want[:5] and math.isclose(got[5], want[5], rel_tol=1e-9) and math.isclose(got[6], want[6], rel_tol=1e-6)
    assert lattice_lm.scores(df.limit(0), lattice_lm.in_training(), lattice_lm.default_vocabulary(), rounds=0).count() == 0


def test_components_are_summed(spark):
    """A document's probability is that of the mixture of the components, whichever its own class; classes beyond the last component share it."""
    rows = [(i, ("the of and is " if i % 3 else "und der die das ") * 400, f"l{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, TEXTS + ", lang string")
    score = lambda k: {r["doc_id"]: r["score"] for r in lattice_lm.scores(df, F.lit(True), lattice_lm.default_vocabulary(), "lang", rounds=1, components=k).collect()}
    one, two, three = score(1), score(2), score(3)
    assert sum(three.values()) > sum(one.values()) and all(len(x) == 30 for x in (one, two, three))


def test_every_class_has_a_component(spark):
    """Nine languages are nine components: the result does not change with what is the most frequent."""
    words = ["the of", "und der", "les des", "los las", "och att", "ja ei", "het een", "nie tak", "og det"]
    df = spark.createDataFrame([(i, f"{words[i % 9]} " * (200 + i % 9), f"l{i % 9}") for i in range(45)], TEXTS + ", lang string")
    score = lambda k, hot=None: {r["doc_id"]: r["score"] for r in lattice_lm.scores(df, F.lit(True), lattice_lm.default_vocabulary(), "lang", rounds=1, components=k, hot=hot).collect()}
    whole, nine, eight = score(None, 3), score(9), score(8)
    assert all(math.isclose(whole[i], nine[i], rel_tol=1e-9) for i in whole)
    assert all(nine[i] > eight[i] + 5 for i in nine if i % 9 in (7, 8))


# 4 packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    rows = [(i, " ".join(f"word{rng.randrange(99)}²" for _ in range(rng.choice([0, 3, 50, 900])))) for i in range(1000, 1080)] + ODD
    path = packing.default_tokenizer()
    found = packing.pack(spark.createDataFrame(rows, TEXTS), path, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    pieces: dict = {}
    for r in found:
        assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], {}).setdefault(r["start"], []).append(r)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        got = b"".join(x[0]["ids"] for _, x in sorted(pieces[i].items()))
        assert np.frombuffer(got, "<u4").tolist() == ids and {x[0]["doc_tokens"] for x in pieces[i].values()} == {len(ids)}
    spans: dict = {}
    for r in found:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(spark.createDataFrame([], TEXTS), path).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, own, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(7)
    marks = ["a", "B", "é", "日", " ", " ", " ", "\n", "\n", "\t", "'s", "'", "1", "23", "!", "\u3000", "the", "\r", ".", "<|endoftext|>"]
    for i in range(20_000):
        text = "".join(rng.choice(marks if i % 2 else marks[:9]) for _ in range(rng.randrange(14)))
        assert tokenizer.encode(text, add_special_tokens=False).ids == own.encode(text).tolist(), text


def test_plan_uses_every_piece():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.minimum(rng.geometric(1 / 300, 20000), 1024), minlength=1025)
    used = np.zeros(1025, np.int64)
    planned = packing.plan(counts)
    for lengths, repeats in planned:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += repeats
    assert (used == counts).all()
    assert sum(sum(x) * r for x, r in planned) / (1024 * sum(r for _, r in planned)) > 0.98


# 5 toxicity


def test_crf_finds_planted_words(spark):
    rng = random.Random(6)
    clean = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(clean) for _ in range(80)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(80), rng.choice(["vilest", "nasty!", "Foul"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([(*r, 9.0) for r in rows + ODD[:5]], "doc_id long, text string, score double")
    model = toxicity.train(df, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    assert set(toxicity.scored(df, model).columns) == {"doc_id", "text", "score", "predicted", "spans"}
    found = toxicity.scored(df, model).collect()
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in found if r["doc_id"] is not None and len(r["text"] or "") > 50)
    spans = next(r for r in found if r["doc_id"] == 5 and len(r["text"] or "") > 50)
    assert {re.sub(r"\W", "", spans["text"][s["start"] : s["end"]]).lower() for s in spans["spans"]} <= {"vilest", "nasty", "foul"} and spans["spans"]
    flat = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(df, flat).collect()) and toxicity.scored(df.limit(0), flat).count() == 0


def test_toxic_words_in_the_middle_of_long_texts(spark):
    """Whole labelled texts are learned from: here all that is toxic stands in the middle of 20,000 tokens."""
    rng = random.Random(8)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(60):
        text = [rng.choice(clean) for _ in range(20_000 if i % 4 < 2 else 200)]
        if i % 4 == 0:
            text[10_000:10_000] = [x for _ in range(4) for x in (rng.choice(clean), rng.choice(["vilest", "nasty"]))]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, TEXTS)
    found = toxicity.scored(df, toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in found)
    assert {r["text"][s["start"] : s["end"]] for r in found for s in r["spans"]} == {"vilest", "nasty"}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    score, move = rng.normal(size=(1, 6)), rng.normal(size=(2, 2))
    one, _, whole = toxicity.marginals(score, move)
    weight = {}
    for k in range(64):
        y = [k >> i & 1 for i in range(6)]
        weight[k] = math.exp(sum(score[0, i] * y[i] for i in range(6)) + sum(move[y[i], y[i + 1]] for i in range(5)))
    total = sum(weight.values())
    assert math.isclose(whole[0], math.log(total))
    assert np.allclose(one[0], [sum(w for k, w in weight.items() if k >> i & 1) / total for i in range(6)])


def test_text_marginals_equal_one_recursion():
    rng = np.random.default_rng(5)
    sizes = np.array([3, 0, 1, 32, 33, 64, 100, 0, 257])
    score, move = rng.normal(size=sizes.sum()) * 3, rng.normal(size=(2, 2))
    found, at = toxicity.text_marginals(score, sizes, move), 0
    for n in sizes.tolist():
        if n:
            assert np.allclose(found[at : at + n], toxicity.marginals(score[None, at : at + n], move)[0][0])
        at += n


def test_scores_and_spans_equal_brute_force(spark):
    """Every token's features, summed one by one, then one recursion over each whole text."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["vile", "vilest", "nasty"]
    rows = [(i, " ".join(rng.choice(words[: 63 if i % 4 == 0 else 60]) + rng.choice(["", "!", ","]) for _ in range(rng.choice([5, 90])))) for i in range(400)]
    model = toxicity.fit([(toxicity.tokens(t.encode()), int(i % 4 == 0)) for i, t in rows])
    assert model.words
    for i, t in rows[:40]:
        own = toxicity.tokens(t.encode())
        known = [model.words.get(w, 0) for w in own]
        score = []
        for k, w in enumerate(own):
            h, e = toxicity.affixes(w)
            x = model.own[known[k]] if known[k] else model.heads.get(h, 0) + model.tails.get(e, 0) + model.shapes[toxicity.shape(w)]
            score.append(x + (model.left[known[k - 1]] if k else 0) + (model.right[known[k + 1]] if k + 1 < len(own) else 0))
        one = toxicity.marginals(np.array([score]), model.move)[0][0]
        z = model.logit @ [1, one.max(), math.log1p(one[one >= 0.5].sum()), math.log1p(one[one < 0.5].sum())]
        r = toxicity.scored(spark.createDataFrame([(i, t)], TEXTS), model).first() if i < 8 else None
        if r:
            assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-6)
            at = [m.span() for m in re.finditer(r"\S+", t)]
            assert [(s["start"], s["end"]) for s in r["spans"]] == [at[k] for k in np.flatnonzero(one >= 0.5)]


def test_held_out_accuracy(spark):
    """On labelled rows that the model may not learn from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    known = toxicity.scored(docs, model).filter(toxicity.held_out()).join(labels.select("doc_id", "toxic"), "doc_id").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in known if r["toxic"] == 1]
    clean = [r["predicted"] for r in known if r["toxic"] == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)


# 6 quality rules


def test_quality_edges(spark):
    good = "the cat and the dog of this house " * 1 + " ".join(f"word{i} is" for i in range(60))
    df = spark.createDataFrame([(*r, True) for r in ODD] + [(9, good, False), (10, "a b c " * 40, False), (11, good.replace(" is", "### is"), True)], "doc_id long, text string, kept boolean")
    found = {r["doc_id"]: r for r in quality_rules.judged(df).collect()}
    assert found[9]["kept"] and not found[11]["kept"] and found[10]["base_failed"] and found[10]["n_repeat_words"] == 120
    assert found[1]["n_words"] == 0 and found[5]["n_repeat_words"] == 3000 and quality_rules.judged(df).count() == len(ODD) + 3


# 7 sharding


def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, "same text" if i % 3 == 0 else "x" * rng.randrange(200)) for i in range(3000)] + ODD[:-1]
    found = sharding.histogram_shards(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int"), cell_bytes=1000).collect()
    assert len(found) == len(rows)
    sizes, slots = Counter(), {}
    for r in found:
        assert r["size"] == len((r["text"] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    normal = [v for k, v in sizes.items()]
    assert sorted(normal)[-2] - min(normal) < 2 * 220 * 2 and set(sizes) <= set(range(24))
    assert sharding.histogram_shards(spark.createDataFrame([], TEXTS)).count() == 0


@pytest.mark.parametrize("case", ["one text", "one row", "many", "two hot"])
def test_cells_and_splitters_equal_brute_force(spark, case):
    """No cell holds more than twice its bytes, and splitters are where the sorted rows put them, however few texts or rows there are."""
    n, cell_bytes, shards = 30_000, 20_000, 7
    text = {"one text": lambda i: "hot", "one row": lambda i: "hot", "many": lambda i: "x" * (i * 7919 % 90), "two hot": lambda i: ["hot", "other", f"text {i}"][i % 3]}[case]
    df = spark.range(n).toPandas()["id"]
    docs = spark.createDataFrame([(7 if case == "one row" else int(i), text(int(i))) for i in df], TEXTS)
    keys = sharding.keyed(docs, "doc_id", "text", {})
    found, bounds = sharding.cells(keys, shards, 0.001, cell_bytes)
    rows = sorted(((r["key_hash"], r["key_id"], r["tie"] % (1 << 64)), r["size"]) for r in keys.collect())
    order = sharding.packed(*(np.array([r[0][k] if k < 2 else r[0][2] - (1 << 64) * (r[0][2] >> 63) for r in rows], np.int64) for k in range(3)))
    place = np.argsort(order, kind="stable")
    order, size = order[place], np.array([r[1] for r in rows])[place]
    assert len(set(order.tolist())) == n
    below = np.concatenate([[0], np.cumsum(size)])
    at = below[np.searchsorted(order, sharding.as_keys(bounds), side="left")]
    assert np.diff([0, *at, below[-1]]).max() <= 2 * cell_bytes
    cut = below[np.searchsorted(order, sharding.as_keys(found), side="left")]
    wanted = below[-1] * np.arange(1, shards) / shards
    assert (np.abs(cut - wanted) <= np.maximum(0.001 * below[-1] / shards, size.max())).all()


# 9 HTML extraction


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        ("<body><nav><a href=x>Home</a></nav><article><h1>T &amp; x</h1><p><b>One\n two<br><p>Three</article><footer>&copy; f</footer>", "T & x\nOne two\nThree"),
        ('<body><div class="ad">Buy this very long advert text now, please</div><article><h1>A</h1><p>b</p><div id="comments"><p>long reader comment here</p></div></article>', "A\nb"),
        ("<body><header>Site</header><div><p>First long paragraph of text here.</p><p>Second long paragraph of text here.</p></div><aside>side</aside><script>var t='</p>';</script></body>", "First long paragraph of text here.\nSecond long paragraph of text here."),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>One text.</p><p class="related-work">Related work is this.</p></article>', "Title\nOne text.\nRelated work is this."),
        ('<article><p>stub</p></article><div class="story"><h1>Real</h1><p>A long real paragraph of the story.</p><p>And a second long one.</p></div>', "Real\nA long real paragraph of the story.\nAnd a second long one."),
        (
            '<div class="site-header"><a href=x>Home</a></div><div class="post"><div class="entry-header"><h1>T</h1></div><div class="entry-content"><p>Paragraph one.</p><p>Paragraph two.</p></div>'
            '<div class="post-comments"><p>I think that this is a long comment of a reader.</p></div></div>',
            "T\nParagraph one.\nParagraph two.",
        ),
        ('<div class="page-with-sidebar"><main><section><h2>A</h2><p>First section text.</p></section><section><h2>B</h2><p>Second text.</p><p>More text.</p></section></main><div id="sidebar">long long text</div></div>', "A\nFirst section text.\nB\nSecond text.\nMore text."),
        ("<article>Text only<br>second line</article><div class=ad>buy buy buy buy buy buy buy</div>", "Text only\nsecond line"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<article><p>" + "many words " * 100_000 + "end</p></article>", "many words " * 100_000 + "end"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html or "") == text


def test_density_sums_equal_recursion():
    rng = random.Random(4)

    def page(depth):
        tag = rng.choice(["div", "p", "section", "b", "a", "ul", "li", "article"])
        inner = "".join(rng.choice(["word ", "some more words ", page(depth - 1) if depth else ""]) for _ in range(rng.randrange(5)))
        return f"<{tag}>{inner}</{tag}>"

    def brute(node):
        """(characters, tags, link characters, link tags, own characters) of a subtree."""
        own = sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
        sums = [brute(k) for k in node.kids()]
        chars = own + sum(x[0] for x in sums)
        tags = sum(x[1] + (k.tag not in html_text.INLINE or k.tag == "a") for x, k in zip(sums, node.kids()))
        link_tags = tags if node.tag == "a" else sum(x[3] + (k.tag == "a") for x, k in zip(sums, node.kids()))
        return chars, tags, chars if node.tag == "a" else sum(x[2] for x in sums), link_tags, own

    for _ in range(200):
        nodes = html_text.measure(html_text.parse(f"<body>{page(4)}{page(3)}</body>"))
        body = brute(nodes[0])

        def density(x):
            c, t, lc, lt, _ = x
            if not lc:
                return c / max(1, t)
            ratio, base = c / lc * max(1, t) / max(1, lt), math.log(c * lc / max(1, c - lc) + body[2] * c / max(1, body[0]) + math.e)
            return c / max(1, t) * min(1, math.log(ratio, base)) if ratio > 1 and base > 1 else 0

        for n in nodes:
            assert math.isclose(n.total, brute(n)[4] + sum(density(brute(k)) for k in n.kids()), abs_tol=1e-9)
        best = html_text.main_nodes(nodes)[0]
        sums = {n: brute(n)[4] + sum(density(brute(k)) for k in n.kids()) for n in nodes if n.tag in html_text.CONTAINERS}
        top = max(sums.values())
        assert any(math.isclose(sums.get(r, -1), top, abs_tol=1e-9) for r in best)


STORY = [f"Paragraph {k} " + "of the story goes on and on " * 15 for k in range(4)]


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout has-sidebar">{}</div>',
        '<div class="no-ads">{}</div>',
        '<div class="social-science">{}</div>',
        "<form id=aspnetForm action=x><input type=hidden>{}</form>",
        "<form><article>{}</article></form>",
        '<div class="content-sidebar-wrap"><div class="content">{}</div></div>',
        '<aside class="sidebar-left"><div>{}</div></aside>',
        '<div id="page" class="layout--with-sidebar cookie-consent-shown"><main>{}</main></div>',
        '<div role="complementary">{}</div>',
    ],
)
@pytest.mark.parametrize("heading", ["<h1>Heading</h1>", ""])
def test_no_page_is_lost(page, heading):
    """Layouts round a whole page are no noise, whatever they are called; menus, adverts and comments beside it still go."""
    beside = '<nav><a href=a>Home</a></nav><div class="ad">Buy this now, please, buy this now.</div><div id="comments"><p>I find that the story is a long one.</p></div><footer>Copyright</footer>'
    blocks = ([heading[4:-5]] if heading else []) + [s.strip() for s in STORY]
    html = "<body>" + page.format(heading + "".join(f"<p>{s}</p>" for s in STORY) + beside) + "</body>"
    assert html_text.main_text(html).split("\n") == blocks


def test_long_comments_of_a_short_article_go():
    comments = "".join(f'<article class="comment"><p>{"My opinion is as follows. " * 20}</p></article>' for _ in range(30))
    for name in ("comments", "comments-area", "post-comments"):
        assert html_text.main_text(f'<div class="post"><h1>Short</h1><p>A short story of some words.</p></div><div id="{name}">{comments}</div>') == "Short\nA short story of some words."


def test_unended_tags_and_deep_pages():
    assert html_text.main_text("<article><p>Text here.</p><p") == "Text here."
    assert html_text.main_text('<article><p>Text here.</p><p title="x>more</article>') == "Text here.\nmore"
    started = time.time()
    assert html_text.main_text("<div>" * 20_000 + "deep</p></li></x>" * 20_000) == "\n".join(["deep"] * 20_000)
    assert time.time() - started < 20


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "mine"), (1, "u", None, "mine"), (None, None, "<article><p>x</p></article>", "mine")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert html_text.extract(df.limit(0)).count() == 0


# 10 line dedup


@pytest.mark.parametrize("broadcast", [1 << 18, 0])
def test_drop_repeated(spark, broadcast):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice([f" Line {rng.randrange(6)}\t", f"own {i}", "", f"line {rng.randrange(40)}"]) for _ in range(rng.randrange(6)))) for i in range(80)] + ODD
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_lines string")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    expected = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if docs[key(x)] < 10]
        expected.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    found = line_dedup.drop_repeated(df, broadcast_lines=broadcast).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found), key=repr) == sorted(expected, key=repr)
    assert line_dedup.drop_repeated(spark.createDataFrame([], TEXTS)).count() == 0


def test_first_seen_over_batches(spark):
    runs, seen, rng = line_dedup.LineRuns(spark, fan_in=2), set(), random.Random(3)
    for lot in range(3):
        rows = [(lot * 10 + i, "\n".join(f"L{rng.randrange(30)}" for _ in range(4))) for i in range(5)]
        found = runs.first_seen(spark.createDataFrame(rows, TEXTS)).collect()
        fresh = {x.lower() for _, t in rows for x in t.split("\n")} - seen
        assert sorted(r["line"].lower() for r in found) == sorted(fresh)
        seen |= fresh
    assert max(level for level, _ in runs.runs) >= 1 and runs.again


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, at, DATA)
        assert out.columns == P.COLUMNS, name
        at = spark.createDataFrame(out.toPandas(), out.schema)
    ids = {r["doc_id"] for r in at.select("doc_id").collect()}
    packed = P.run(spark, DATA).collect()
    assert {r["doc_id"] for r in packed} == ids and 0 < len(ids) < docs.count()


def test_pipeline_end_to_end(spark, tmp_path):
    """Planted toxic documents, repeated lines, copies and passages against what a plain reading of the stages keeps, down to the packed tokens."""
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so") for b in ("lan", "ver", "dor", "kin", "pos") for c in ("", "s", "er", "ing", "al", "on")] + [f"word{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line, passage = "This very line stands in a great many documents", prose(30)
    texts = {i: prose(90) + "\n" + prose(40) for i in range(420)}
    toxic = {i for i in texts if i % 6 == 5}
    for i in toxic:
        own = texts[i].split(" ")
        for _ in range(4):
            own.insert(rng.randrange(len(own)), rng.choice(["vilest", "nasty", "foul"]))
        texts[i] = " ".join(own)
    for i in range(0, 60, 4):
        texts[i] += f"\n {line.upper()}"
    leaks = {10, 38}
    for i in leaks:
        texts[i] = prose(40) + " " + passage + " " + prose(40)
    texts[1001] = texts[1002] = texts[3]
    texts[1003] = texts[4].replace(texts[4].split(" ")[60], "changed", 1)
    docs = [(i, t, "en", "s", len(t)) for i, t in sorted(texts.items())]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in range(420)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = P.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    kept = {i: "\n".join(x for x in t.split("\n") if x.strip().lower() != line.lower()) for i, t in texts.items() if i not in toxic and i not in leaks and i < 1000}
    expected = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    found = Counter()
    for r in packed:
        found[r["doc_id"]] += r["length"]
    assert dict(found) == expected


def test_line_hashes_hold_a_piece_of_a_batch(monkeypatch):
    """A batch becomes Python texts piece by piece; its lines are counted over all of them."""
    import pyarrow as pa

    sizes, real = [], line_dedup.text_bytes
    monkeypatch.setattr(line_dedup, "text_bytes", lambda column: sizes.append(len(column)) or real(column))
    n = 2000
    batch = pa.record_batch([pa.array([i % 2 for i in range(n)], pa.int32()), pa.array([f"same\n{i}\n{i}" for i in range(n)])], names=["batch", "text"])
    out = pa.Table.from_batches(line_dedup._hashed_lines(iter([batch]))).to_pylist()
    assert sum(sizes) == n and max(sizes) <= 256
    assert len(out) == n + 2 and sorted(r["docs"] for r in out)[-3:] == [1, n // 2, n // 2]
