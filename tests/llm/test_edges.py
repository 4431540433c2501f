"""Every operator and pipeline stage on nulls, empty and very long texts, ties and repeated rows, empty tables and clashing column names."""

from collections import Counter

import corpus_pipeline as P
import pytest

from docloom.llm import decontamination, html_text, lattice_lm, line_dedup, near_dedup, packing, quality_rules, sharding, toxicity, url_filter

LONG = "one line of words and more words\n" * 3_000
ROWS = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "ñ漢 \U0001f600 ﻿")]
#: Names that the operators use inside or return.
NAMES = ["size", "slot", "key_hash", "c0", "row_no", "gone", "n_words", "words", "text_", "shard", "lines", "spans", "score", "component_id", "sketch", "host", "batch"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, None, "s", 1, *("mine" for _ in NAMES)) for i, t in ROWS], schema)


@pytest.fixture(scope="module")
def side(spark):
    """Labels and a benchmark, with nulls."""
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0), (3, 1)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "what is seventeen plus four then"), (None, None), (3, "")], "item_id long, text string")
    return labels, items


def each(side):
    """(name, operator on documents, rows of its result for the documents or None where it is not a row for each row)."""
    labels, items = side
    tokenizer = packing.default_tokenizer()
    model = toxicity.fit([(t.split(), y) for t, y in [(b"good words here", 0), (b"bad words there", 1)] * 20])
    return {
        "op1": (lambda d: decontamination.leaks(d, items), 0),
        "op2": (lambda d: url_filter.url_verdicts(d.withColumnRenamed("text", "url")), len(ROWS)),
        "op3": (lambda d: lattice_lm.scores(d, lattice_lm.in_training(), lattice_lm.default_vocabulary(), "lang", rounds=1), len(ROWS)),
        "op4": (lambda d: packing.pack(d, tokenizer).filter("start = 0"), len(ROWS)),
        "op5": (lambda d: toxicity.scored(d, model), len(ROWS)),
        "op5 train": (lambda d: toxicity.scored(d, toxicity.train(d, labels)), len(ROWS)),
        "op6": (lambda d: quality_rules.judged(d), len(ROWS)),
        "op7": (lambda d: sharding.histogram_shards(d), len(ROWS)),
        "op8": (lambda d: near_dedup.simhash_classes(d), len(ROWS)),
        "near": (lambda d: near_dedup.near_classes(d), len(ROWS)),
        "op9": (lambda d: html_text.extract(d.withColumnRenamed("text", "html")), len(ROWS)),
        "op10": (lambda d: line_dedup.drop_repeated(d), len(ROWS)),
        "op10 shuffle": (lambda d: line_dedup.drop_repeated(d, min_docs=1, broadcast_lines=0), len(ROWS)),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op5 train", "op6", "op7", "op8", "near", "op9", "op10", "op10 shuffle"])
def test_operator(docs, side, name):
    run, n = each(side)[name]
    found = run(docs).drop("text", "spans").collect()
    assert len(found) == n
    if n and "doc_id" in found[0]:
        assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in ROWS)
    # Names that are not a result's pass through.
    for c in {"key_hash", "c0", "row_no", "gone", "words", "lines"} & set(found[0].asDict() if found else ()):
        assert {r[c] for r in found} == {"mine"}, c
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_stage(spark, docs, tmp_path, k, side):
    labels, items = side
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = P.STAGES[k]
    found = stage(spark, docs, str(tmp_path))
    rows = found.drop("text").collect()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    ids = Counter(r["doc_id"] for r in rows)
    if k < len(P.STAGES) - 1:
        assert found.columns == P.COLUMNS
    # Null, empty and blank texts are copies of each other; rows of one id are one document; rows without an id stay.
    expected = {"near_dedup": {1: 1, None: 2, 2: 1, 5: 1, 6: 1}, "packing": None}.get(name, dict(Counter(i for i, _ in ROWS)))
    assert expected is None or dict(ids) == expected
    assert set(ids) == ({i for i, _ in ROWS} if name != "near_dedup" else set(expected))


def test_equal_rows_split_between_shards(spark):
    """One row that is most of a table is dealt to all shards."""
    df = spark.createDataFrame([(7, "the same text")] * 960 + [(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    found = sharding.histogram_shards(df, shards=8).collect()
    sizes, slots = Counter(), {}
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(found) == 1000 and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) < 100
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
