"""Ranked lexical search over whole texts by per-term geometric blocking.

Documents become vectors of integer term impacts. The posting list of a term is clustered by the similarity of its documents: by the size of
their vectors, and by as many random hyperplanes as leave about BLOCK_DOCS documents in a block. A block's summary is the coordinatewise
maximum of its documents' impacts, for the terms of the items that ask for the list; an item's weights on it bound the score of every document inside. An item's threshold is
the score of the last of its best documents among those of its rarest terms. Lists whose largest impacts together stay below the threshold are not read for that item, and
of the others only blocks whose bound reaches it; the documents of those blocks are scored exactly. All bounds are exact, so no document is lost.

Items are read in blocks of bounded size, each broadcast; a block's vocabulary is all that vectors hold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

TOP = 20
#: Documents that a block of a posting list has on average, before the sizes of the vectors part it further.
BLOCK_DOCS = 128
#: An item's first threshold comes from its rarest lists, until they have so many postings.
SEED_POSTINGS = 400
#: Terms of items, each counted once an item, that are answered together.
ITEM_TERMS = 1 << 17
#: Hyperplanes of a document's code.
PLANES = 48
#: Values of summaries that a task holds before it hands them on.
HELD_VALUES = 4 << 20
# Bytes that end a term become blanks, A-Z become lower case.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """A text's terms in order, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(TERM_BYTES).split()


class Items(NamedTuple):
    """A block of items: ids, the vocabulary, and each item's terms (ids) with their repeats, from starts[i] to starts[i + 1]."""

    ids: list
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray


class Search(NamedTuple):
    """What tasks need to score a block of items: corpus totals, weights by term, each item's weighted terms, and the cells of lists."""

    items: Items
    n_docs: int
    n_terms: int
    weights: np.ndarray
    costs: np.ndarray
    depths: np.ndarray
    planes: np.ndarray


class Lists(NamedTuple):
    """The lists to read: by term, the items that ask for it, and the terms of those items."""

    items: dict[int, np.ndarray]
    coordinates: dict[int, np.ndarray]


def item_blocks(items: DataFrame, item_terms: int = ITEM_TERMS) -> Iterator[Items]:
    """Items with a term, in blocks of about item_terms different terms each."""
    held: list[tuple[object, Counter]] = []
    size = 0
    for r in items.toLocalIterator():
        counted = Counter(terms(r["text"]))
        if counted:
            held.append((r["item_id"], counted))
            size += len(counted)
        if size >= item_terms:
            yield _items(held)
            held, size = [], 0
    if held:
        yield _items(held)


def _items(held: list[tuple[object, Counter]]) -> Items:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in held for t in c}))}
    flat = [(vocabulary[t], k) for _, c in held for t, k in sorted(c.items())]
    starts = np.cumsum([0, *(len(c) for _, c in held)])
    return Items([i for i, _ in held], vocabulary, starts, np.array([t for t, _ in flat]), np.array([k for _, k in flat]))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def vectors(documents: DataFrame, items: Items) -> DataFrame:
    """A written row for each document with a term: a row number, its id, its number of terms, and the vocabulary's terms in it with their occurrences."""
    shared = documents.sparkSession.sparkContext.broadcast(items.vocabulary)
    kept = documents.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            at, n, ids, counts = [], [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                words = terms(text)
                if words:
                    found = Counter(map(known.get, words))
                    found.pop(None, None)
                    own = np.fromiter(sorted(found), np.int32, len(found))
                    at.append(i)
                    n.append(len(words))
                    ids.append(own)
                    counts.append(np.fromiter((found[t] for t in own.tolist()), np.int32, len(own)))
            yield pa.record_batch([b["doc_id"].take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), _lists(ids, pa.int32()), _lists(counts, pa.int32())], names=["doc_id", "n", "terms", "counts"])

    found = kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, n long, terms array<int>, counts array<int>")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "vectors")


def length_factor(n: Column, n_docs: int, n_terms: int) -> Column:
    """m of a document of n terms."""
    return F.lit(75) + F.expr(f"(25L * n * {n_docs}L) div {n_terms}L")


def prepared(found: DataFrame, items: Items, block_docs: int = BLOCK_DOCS) -> tuple[Search, np.ndarray, np.ndarray]:
    """(what scoring needs, documents by term, largest impact by term); one pass over the vectors after their totals."""
    n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = len(items.vocabulary)
    df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
    if n_docs:
        each = found.select(length_factor(F.col("n"), n_docs, n_terms).alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("m", F.col("p.terms").alias("term"), F.col("p.counts").cast("long").alias("tf"))
        # At most a row for each term of the block of items.
        for r in each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")).alias("most")).collect():
            df[r["term"]], most[r["term"]] = r["df"], r["most"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(k) + 1))) for k in df], np.int64)
    depths = np.array([max(0, math.ceil(math.log2(max(1, int(k)) / block_docs))) for k in df], np.int64)
    planes = np.random.default_rng(12).choice(np.array([-1, 1], np.int8), (size, PLANES))
    return Search(items, n_docs, n_terms, weights, weights[items.terms] * items.repeats, depths, planes), df, most


def _impacts(own: Search, n: int, counts: np.ndarray) -> np.ndarray:
    """A document's impacts."""
    counts = counts.astype(np.int64)
    m = 75 + (25 * n * own.n_docs) // own.n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def _cells(own: Search, ids: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """For each term of a document the cell of its list: the size of the vector, and the sides of as many hyperplanes as the list is deep."""
    sides = (own.weights[ids] * impacts).astype(np.float64) @ own.planes[ids] > 0
    code = int(sides @ (1 << np.arange(PLANES - 1, -1, -1)))
    return (len(ids).bit_length() << PLANES) + (code >> (PLANES - own.depths[ids]))


class Scorer:
    """Scores documents for items of a block, one document at a time."""

    def __init__(self, own: Search):
        self.own, self.full = own, np.zeros(len(own.weights), np.int64)

    def scores(self, ids: np.ndarray, impacts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Scores for the wanted items (ascending numbers)."""
        own, items = self.own, self.own.items
        self.full[ids] = impacts
        sizes = items.starts[wanted + 1] - items.starts[wanted]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(items.starts[wanted] - (ends - sizes), sizes)
        out = np.add.reduceat(own.costs[at] * self.full[items.terms[at]], ends - sizes)
        self.full[ids] = 0
        return out


def _documents(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(place, n, terms, counts) of each document of a batch."""
    starts, ids, counts, n = (np.asarray(x) for x in (b["terms"].offsets, b["terms"].values, b["counts"].values, b["n"]))
    for i in range(b.num_rows):
        yield i, int(n[i]), ids[starts[i] : starts[i + 1]], counts[starts[i] : starts[i + 1]]


def _best(scored: DataFrame, top: int) -> DataFrame:
    """Each item's best rows with their rank; Spark keeps the best of each task before it shuffles."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id", "row")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _score_schema(found: DataFrame) -> str:
    return f"item int, row long, doc_id {dict(found.dtypes)['doc_id']}, score long"


def _score_batch(b: pa.RecordBatch, places: list[int], items: list[np.ndarray], scores: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each document and item with a score above 0."""
    at = np.repeat(np.array(places, np.int64), [len(x) for x in items])
    item, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (items, scores))
    good = score > 0
    at = pa.array(at[good])
    return pa.record_batch([pa.array(item[good], pa.int32()), b["row"].take(at), b["doc_id"].take(at), pa.array(score[good], pa.int64())], names=["item", "row", "doc_id", "score"])


def thresholds(found: DataFrame, search: Search, df: np.ndarray, top: int = TOP, seed_postings: int = SEED_POSTINGS) -> np.ndarray:
    """A score for each item that `top` documents reach, from the exact scores of its rarest lists; 1 where fewer documents are in them."""
    items, asking = search.items, {}
    for i in range(len(items.ids)):
        have = 0
        for t in sorted(items.terms[items.starts[i] : items.starts[i + 1]].tolist(), key=lambda t: (df[t], t)):
            if have >= seed_postings:
                break
            if df[t]:
                asking.setdefault(t, []).append(i)
                have += int(df[t])
    lists = {t: np.array(x) for t, x in asking.items()}
    shared = found.sparkSession.sparkContext.broadcast((search, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lists = shared.value
        scorer = Scorer(own)
        for b in batches:
            places, wanted, scores = [], [], []
            for i, n, ids, counts in _documents(b):
                asked = [lists[t] for t in ids.tolist() if t in lists]
                if asked:
                    places.append(i)
                    wanted.append(np.unique(np.concatenate(asked)))
                    scores.append(scorer.scores(ids, _impacts(own, n, counts), wanted[-1]))
            yield _score_batch(b, places, wanted, scores)

    out = np.ones(len(items.ids), np.int64)
    for r in _best(found.mapInArrow(run, _score_schema(found)), top).filter(F.col("rank") == top).select("item", "score").collect():
        out[r["item"]] = r["score"]
    return out


def lists_to_read(search: Search, df: np.ndarray, most: np.ndarray, least: np.ndarray) -> Lists:
    """The lists that each item needs: the longest ones are left out while their largest impacts together stay below its threshold."""
    items, asking = search.items, {}
    for i in range(len(items.ids)):
        own = slice(items.starts[i], items.starts[i + 1])
        room = int(least[i]) - 1
        for t, cost in sorted(zip(items.terms[own].tolist(), search.costs[own].tolist(), strict=True), key=lambda x: (-df[x[0]], x[0])):
            bound = cost * int(most[t])
            if bound <= room:
                room -= bound
            else:
                asking.setdefault(t, []).append(i)
    terms_of = [items.terms[items.starts[i] : items.starts[i + 1]] for i in range(len(items.ids))]
    return Lists({t: np.array(x) for t, x in asking.items()}, {t: np.unique(np.concatenate([terms_of[i] for i in x])) for t, x in asking.items()})


def summaries(found: DataFrame, search: Search, lists: Lists) -> DataFrame:
    """(term, cell, maxima of the list's coordinates) of each task's documents; a block may have several rows, of different tasks."""
    shared = found.sparkSession.sparkContext.broadcast((search, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lists = shared.value
        full = np.zeros(len(own.weights), np.int32)
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def handed() -> pa.RecordBatch:
            keys = list(held)
            return pa.record_batch([pa.array([t for t, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int64()), _lists([held[k] for k in keys], pa.int32())], names=["term", "cell", "maxima"])

        for b in batches:
            for _, n, ids, counts in _documents(b):
                impacts = _impacts(own, n, counts)
                full[ids] = impacts
                for t, cell in zip(ids.tolist(), _cells(own, ids, impacts).tolist(), strict=True):
                    if t in lists.items:
                        values = full[lists.coordinates[t]]
                        if (t, cell) in held:
                            np.maximum(held[t, cell], values, out=held[t, cell])
                        else:
                            held[t, cell] = values
                            size += len(values)
                full[ids] = 0
                if size >= HELD_VALUES:
                    yield handed()
                    held, size = {}, 0
        if held:
            yield handed()

    return found.mapInArrow(run, "term int, cell long, maxima array<int>")


def surviving(parts: DataFrame, search: Search, lists: Lists, least: np.ndarray) -> DataFrame:
    """(term, cell, items): the blocks whose summary bound reaches the threshold of an item that asks for the list, and those items."""
    items = search.items
    bounds = {}
    for t, asked in lists.items.items():
        at = np.concatenate([np.arange(items.starts[i], items.starts[i + 1]) for i in asked])
        sizes = items.starts[asked + 1] - items.starts[asked]
        bounds[t] = (np.searchsorted(lists.coordinates[t], items.terms[at]), search.costs[at], np.cumsum(sizes) - sizes, asked, least[asked])
    shared = parts.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        key, maxima = None, None

        def judged() -> list[tuple[int, int, np.ndarray]]:
            places, costs, starts, asked, wanted = own[key[0]]
            good = np.add.reduceat(costs * maxima[places], starts) >= wanted
            return [(*key, asked[good])] if good.any() else []

        for b in batches:
            kept: list[tuple[int, int, np.ndarray]] = []
            offsets, values = np.asarray(b["maxima"].offsets), np.asarray(b["maxima"].values)
            for i, at in enumerate(zip(b["term"].to_pylist(), b["cell"].to_pylist(), strict=True)):
                mine = values[offsets[i] : offsets[i + 1]]
                if at == key:
                    maxima = np.maximum(maxima, mine)
                else:
                    kept += judged() if key else []
                    key, maxima = at, mine.astype(np.int64)
            yield _survivors(kept)
        yield _survivors(judged() if key else [])

    # Equal keys meet in one partition, in order; a block has a row for each task at most, or as often as the task hands on what it holds.
    return parts.repartition("term", "cell").sortWithinPartitions("term", "cell").mapInArrow(run, "term int, cell long, items array<int>")


def _survivors(kept: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k[0] for k in kept], pa.int32()), pa.array([k[1] for k in kept], pa.int64()), _lists([k[2] for k in kept], pa.int32())], names=["term", "cell", "items"])


def postings(found: DataFrame, search: Search, lists: Lists) -> DataFrame:
    """(term, cell, row) of the lists to read."""
    shared = found.sparkSession.sparkContext.broadcast((search, set(lists.items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted = shared.value
        for b in batches:
            at, term, cell = [], [], []
            for i, n, ids, counts in _documents(b):
                for t, c in zip(ids.tolist(), _cells(own, ids, _impacts(own, n, counts)).tolist(), strict=True):
                    if t in wanted:
                        at.append(i)
                        term.append(t)
                        cell.append(c)
            yield pa.record_batch([pa.array(term, pa.int32()), pa.array(cell, pa.int64()), b["row"].take(pa.array(at, pa.int64()))], names=["term", "cell", "row"])

    return found.mapInArrow(run, "term int, cell long, row long")


def exact_scores(candidates: DataFrame, search: Search) -> DataFrame:
    """(item, row, doc_id, score) of vectors with the items that each is a candidate for."""
    shared = candidates.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = Scorer(own)
        for b in batches:
            offsets, asked = np.asarray(b["items"].offsets), np.asarray(b["items"].values)
            places, wanted, scores = [], [], []
            for i, n, ids, counts in _documents(b):
                places.append(i)
                wanted.append(np.unique(asked[offsets[i] : offsets[i + 1]]).astype(np.int64))
                scores.append(scorer.scores(ids, _impacts(own, n, counts), wanted[-1]))
            yield _score_batch(b, places, wanted, scores)

    return candidates.mapInArrow(run, _score_schema(candidates))


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP, block_docs: int = BLOCK_DOCS, item_terms: int = ITEM_TERMS) -> DataFrame:
    """Each item's `top` documents of highest score above 0: item_id, rank (from 1), doc_id, score.

    documents has doc_id and text, items item_id and text; other columns take no part. Null and empty texts have no term: such an item has no row, such a
    document is none. Each row is an item or a document of its own, so repeated rows are ranked each, and equal scores go by doc_id, null ids first. Texts of any
    length are read whole. An empty table on either side gives an empty result.
    """
    spark = documents.sparkSession
    schema = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(documents.dtypes)['doc_id']}, score long"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items.select("item_id", "text"), item_terms):
        found = vectors(documents, block)
        search, df, most = prepared(found, block, block_docs)
        if not search.n_docs:
            continue
        least = thresholds(found, search, df, top)
        lists = lists_to_read(search, df, most, least)
        blocks = written(surviving(summaries(found, search, lists), search, lists, least), "blocks")
        asked = postings(found, search, lists).join(blocks, ["term", "cell"]).groupBy("row").agg(F.flatten(F.collect_set("items")).alias("items"))
        best = _best(exact_scores(found.join(asked, "row"), search), top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {dict(items.dtypes)['item_id']}")
        out = out.union(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def op12_geometric_blocks(spark, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest({_SPLIT}) AS term FROM d) WHERE term <> '' GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
t AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
m AS (SELECT r, 75 + (25 * n * n_docs) // n_terms AS m FROM n, t),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, t GROUP BY term, n_docs),
i AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
asked AS (SELECT q, item_id, term, count(*) AS k FROM (SELECT q, item_id, unnest({_SPLIT}) AS term FROM i) WHERE term <> '' GROUP BY ALL),
s AS (SELECT q, item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
