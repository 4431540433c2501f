"""SimHash classes against brute force."""

import random

import pytest

from docloom.llm import near_dedup as N


def brute(rows, radius):
    """Components over all pairs of fingerprints."""
    prints = {d: int.from_bytes(N.simhash((t or "").encode()), "little") for d, t in rows}
    found = joined(prints, radius)
    return {d: (f"{prints[d]:016x}", c) for d, c in found.items()}


def joined(prints, radius):
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in ids}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n ", "One two", "one TWO", "a b c"]
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 300]))]
        for _ in range(rng.choice([1, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("shard", [1024, 16])
def test_components_equal_brute_force(spark, shard):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in N.simhash_classes(df, shard=shard).collect()}
    assert found == brute(rows, N.RADIUS)


def test_dense_balls_in_small_shards(spark):
    values = {i: (1 << i) - 1 for i in range(30)} | {100 + i: 1 << i % 64 | 1 << (i * 7) % 64 for i in range(60)}
    df = spark.createDataFrame([(i, v.to_bytes(8, "little")) for i, v in values.items()], "doc_id long, sketch binary")
    found = {r["doc_id"]: r["component_id"] for r in N.classes(df, shard=16).collect()}
    assert found == joined(values, 2)


def test_empty_null_and_repeated(spark):
    assert N.simhash_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "x y z u v w"), (2, "x y z u v w"), (3, "q")]
    df = spark.createDataFrame([(*r, "no") for r in rows], "doc_id long, text string, fingerprint string")
    found = N.simhash_classes(df).collect()
    assert len(found) == 5
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(None, None), (1, 1), (2, 1), (3, 3)}


def test_bk_tree_equals_scan():
    rng = random.Random(5)
    values = [rng.getrandbits(16) for _ in range(500)]
    tree = N.BKTree()
    for v in values:
        tree.add(v)
    for v in values[::9]:
        assert sorted(tree.within(v, 3)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 3]


def test_near_classes_keep_unlike_texts_apart(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(2000)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        copy = t.split()
        copy[50] = "changed"
        rows.append((100 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in N.near_classes(df).collect()}
    assert all(found[i] == i and found[100 + i] == i for i in range(40))


def shingle_set(text):
    words = text.lower().split()
    return frozenset(zip(*(words[i:] for i in range(5)), strict=False))


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_permutations_of_one_set_of_words_end_apart(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(1000):
        rng.shuffle(words)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, words[-1]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # A word order and the same with its last word said twice are near copies; other orders share the set of words alone.
    found = {r["doc_id"]: r["component_id"] for r in N.near_classes(df, {**N.NEAR, "shard": 64}).collect()}
    assert found == {d: d // 2 * 2 for d, _ in rows}


def test_more_near_copies_than_a_shard_holds(spark):
    rng = random.Random(12)
    base = [f"word{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        copy = list(base)
        copy[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    found = N.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), {**N.NEAR, "shard": 32}).collect()
    assert {r["component_id"] for r in found} == {0}


def test_recall_and_precision_by_similarity(spark):
    """Pairs of scattered and of block edits at similarities from 0.7 to 0.95, each of its own base, so that a pair is linked directly or not at all."""
    rng = random.Random(21)
    words = [f"word{i}" for i in range(3000)]
    pairs, rows = [], []
    for i in range(700):
        n = rng.choice([60, 200, 500])
        base = [rng.choice(words) for _ in range(n)]
        copy = list(base)
        share = rng.uniform(0.02, 0.3)
        if i % 2:
            copy[n // 2 : n // 2] = [rng.choice(words) for _ in range(int(n * share))]
        else:
            for at in rng.sample(range(n), max(1, int(n * share / 9))):
                copy[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        pairs.append((2 * i, jaccard(rows[-2][1], rows[-1][1])))
    found = {r["doc_id"]: r["component_id"] for r in N.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bands = {}
    for d, s in pairs:
        assert s >= 0.8 or found[d + 1] == d + 1, s
        if s >= 0.8:
            bands.setdefault(min(int(s * 20), 18), []).append(found[d + 1] == d)
    assert set(bands) == {16, 17, 18} and all(len(x) >= 40 and sum(x) >= 0.9 * len(x) for x in bands.values()), {k: (len(x), sum(x)) for k, x in bands.items()}


def spans(links):
    """Components of links."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    out = {}
    for x in list(parent):
        out.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("judged", [False, True])
def test_blocks_equal_trees(judged):
    rng = random.Random(11)
    values = [rng.getrandbits(8) for _ in range(300)]
    kinds = [rng.getrandbits(2) for _ in values]
    ids = rng.sample(range(10_000), len(values))
    linked = (lambda i, j: kinds[i] == kinds[j]) if judged else None
    for earlier in ([], [3, 12]):
        found = N.block_links(ids, N.np.array(values, N.np.uint64), 2, earlier, linked)
        trees = N.tree_links(ids, values, 2, earlier, linked)
        assert spans(found) == spans(trees) and len(found) == len(trees)


def test_stage_takes_copies_with_words_changed_throughout(spark):
    """Copies with every fourteenth to tenth word changed go, at 0.9 or more of each band of similarity of word pairs; texts below 0.6 stay."""
    import corpus_pipeline as P

    rng = random.Random(31)
    words = [f"word{i}" for i in range(3000)]
    pairs_of = lambda t: frozenset(zip(t, t[1:]))
    rows, pairs = [], []
    for i in range(600):
        base = [rng.choice(words) for _ in range(rng.choice([60, 200, 500]))]
        copy = [rng.choice(words) if rng.random() < share else w for share in [rng.uniform(0.01, 0.2)] for w in base]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        a, b = pairs_of(base), pairs_of(copy)
        pairs.append((2 * i, len(a & b) / len(a | b)))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"] for r in P.near_stage(spark, docs, "").select("doc_id").collect()}
    bands = {}
    for d, s in pairs:
        assert d in found and (s >= 0.6 or d + 1 in found), s
        bands.setdefault(min(int(s * 10), 9), []).append(d + 1 not in found)
    assert all(len(bands[k]) >= 40 and sum(bands[k]) >= 0.9 * len(bands[k]) for k in (7, 8, 9)) and sum(bands[6]) >= 0.8 * len(bands[6]), {k: (len(x), sum(x)) for k, x in bands.items()}


def test_stage_tells_rows_of_one_id_apart_by_their_texts(spark):
    """A row goes for a near copy of its own text, not for what another row of its doc_id holds."""
    import corpus_pipeline as P

    one, two, three = ("some words of the first text here", "quite another text about other things altogether", "a third one that nobody else has ever written down")
    rows = [(1, one), (5, one), (5, two), (5, two + "\n"), (6, three), (6, three), (7, one), (7, two), (None, one), (None, one)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r["doc_id"], r["text"]) for r in P.near_stage(spark, docs, "").collect()]
    assert sorted(found, key=str) == sorted([(1, one), (5, two), (6, three), (None, one), (None, one)], key=str)
