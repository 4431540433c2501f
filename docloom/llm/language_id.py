"""Language identification by cross-parsing entropy.

The labelled text of each language becomes a suffix automaton, which accepts exactly that text's substrings. A document is parsed against each
automaton: a phrase is the longest match of what is left of the document, and a byte that the labelled text does not have is a phrase of its own. A
phrase costs the logarithm of the labelled text's length, as that many places may be pointed at; the language whose normalised phrases cost
least wins. Letters are lower-cased and whatever else is ASCII counts as a gap; the parse starts anew every SEGMENT bytes of a text, so that the segments of all
texts of a batch advance together, one table look-up a byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

#: The fit's sample: of each language so many rows at most, in the order of a hash of their ids, while they have under so many bytes (the first in any case).
SAMPLE_ROWS = 256
FIT_BYTES = 1 << 16
SEGMENT = 256
#: Bytes of text that are parsed together, and automata of one broadcast, of which so many tables are held at once.
BATCH_BYTES = 4 << 20
BLOCK_LANGUAGES = 32
HELD_TABLES = 6
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
# Letters and the bytes of other scripts stand for themselves, the rest of ASCII is a gap (0); 1 fills up a segment.
CLASSES = np.array([b if b >= 128 or chr(b).isalpha() else 0 for b in range(256)], np.uint8)
FILL = 1


class Automaton(NamedTuple):
    """A language's suffix automaton: its labelled text's length, its states, and its edges by source, byte and target."""

    lang: str
    length: int
    states: int
    source: np.ndarray
    byte: np.ndarray
    target: np.ndarray


def normalised(text: str) -> np.ndarray:
    """Classes of a text's bytes, each run of gaps as one."""
    classes = CLASSES[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    keep = np.ones(len(classes), bool)
    keep[1:] = (classes[1:] != 0) | (classes[:-1] != 0)
    return classes[keep]


def automaton(lang: str, classes: list[int]) -> Automaton:
    """The suffix automaton of a sequence, built online: one state for each set of substrings with the same end places."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in classes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in edges[at]:
            edges[at][c] = new
            at = link[at]
        if at >= 0:
            old = edges[at][c]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(edges)
                edges.append(dict(edges[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                while at >= 0 and edges[at].get(c) == old:
                    edges[at][c] = copy
                    at = link[at]
                link[old] = link[new] = copy
        last = new
    counts = [len(x) for x in edges]
    flat = np.fromiter((v for x in edges for pair in x.items() for v in pair), np.int32, 2 * sum(counts)).reshape(-1, 2)
    return Automaton(lang, len(classes), len(edges), np.repeat(np.arange(len(edges), dtype=np.int32), counts), flat[:, 0].astype(np.uint8), flat[:, 1].copy())


def transitions(own: Automaton) -> tuple[np.ndarray, np.ndarray, int]:
    """(table, column of each byte class, start): an entry is twice the place of the next state's row, plus one where a phrase begins.

    The last row is that of a parse that has no match: every byte begins a phrase there. A byte that no edge has goes on as from that row.
    """
    seen = np.unique(own.byte)
    column = np.full(256, len(seen), np.int64)
    column[seen] = np.arange(len(seen))
    column[FILL] = width = len(seen) + 1
    width += 1
    start = own.states * width
    kind = np.int32 if 2 * (start + width) < 1 << 31 else np.int64
    none = np.full(width, 2 * start + 1, kind)
    root = own.source == 0
    none[column[own.byte[root]]] = 2 * own.target[root].astype(np.int64) * width + 1
    none[width - 1] = 2 * start
    table = np.tile(none, own.states + 1)
    table[own.source.astype(np.int64) * width + column[own.byte]] = 2 * own.target.astype(np.int64) * width
    return table, column, start


def phrases(table: tuple[np.ndarray, np.ndarray, int], segments: np.ndarray) -> np.ndarray:
    """Phrases of each column of segments, one byte of all of them at a time."""
    moves, column, start = table
    columns = column.astype(np.uint8)[segments]
    state = np.full(segments.shape[1], start, moves.dtype)
    found = np.zeros(segments.shape[1], np.int64)
    for row in columns:
        entry = moves.take(state + row)
        found += entry & 1
        state = entry >> 1
    return found


def cut(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(segments as columns, the text of each); a text without a byte has none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    parts = -(-sizes // SEGMENT)
    out = np.full(int(parts.sum()) * SEGMENT, FILL, np.uint8)
    if len(out):
        first = (np.cumsum(parts) - parts) * SEGMENT - (np.cumsum(sizes) - sizes)
        out[np.repeat(first, sizes) + np.arange(int(sizes.sum()))] = np.concatenate(texts)
    return np.ascontiguousarray(out.reshape(-1, SEGMENT).T), np.repeat(np.arange(len(texts)), parts)


def held_out() -> Column:
    """Whether a row is kept from the fit; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """A table of automata (lang, length, states, source, byte, target), one row for each language.

    It learns from rows with an id, a text and a lang outside the held-out fifth: of each language those of the smallest hashes of the id, at most
    sample_rows, while they have under fit_bytes bytes. Rows of one id are ordered by their text. An empty table or one without lang has no automaton.
    """
    usable = documents.select("doc_id", "text", "lang").filter(~held_out() & (F.length("text") > 0) & F.col("lang").isNotNull())
    keyed = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("order"), F.xxhash64("text").alias("text_hash"), F.octet_length("text").cast("long").alias("bytes"))
    order = Window.partitionBy("lang").orderBy("order", "doc_id", "text_hash")
    first = keyed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample_rows)
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = first.withColumn("before", before).filter(F.col("before") < fit_bytes).select("lang", "doc_id", "text_hash", "rank")
    # At most sample_rows rows of each language.
    rows = usable.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(few), ["lang", "doc_id", "text_hash"]).select("lang", "rank", "text").dropDuplicates(["lang", "rank"])

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        own = automaton(group["lang"].iloc[0], normalised(" ".join(group["text"])).tolist())
        return pd.DataFrame([{"lang": own.lang, "length": own.length, "states": own.states, "source": own.source.tobytes(), "byte": own.byte.tobytes(), "target": own.target.tobytes()}])

    return written(rows.groupBy("lang").applyInPandas(build, "lang string, length long, states long, source binary, byte binary, target binary"), "automata")


def _loaded(rows: list) -> list[Automaton]:
    kinds = {"source": np.int32, "byte": np.uint8, "target": np.int32}
    return [Automaton(r["lang"], r["length"], r["states"], *(np.frombuffer(r[c], k) for c, k in kinds.items())) for r in rows]


def _parsed(df: DataFrame, automata: list[Automaton]) -> DataFrame:
    """df (text last but for bits, best and mass) with the three brought up to date by some languages: the least cost, its language, and log2 of the sum of 2^-cost."""
    shared = df.sparkSession.sparkContext.broadcast(automata)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held = {x.lang: transitions(x) for x in own} if len(own) <= HELD_TABLES else {}
        for b in batches:
            bits, best, mass = (b[c].to_pylist() for c in ("bits_", "best_", "mass_"))
            for rows, segments, of in _batches(b["text_"]):
                for x in own:
                    found = np.bincount(of, phrases(held.get(x.lang) or transitions(x), segments), len(rows))
                    for i, cost in zip(rows, (found * math.log2(x.length + 1)).tolist(), strict=True):
                        if best[i] is None or (cost, x.lang) < (bits[i], best[i]):
                            bits[i], best[i] = cost, x.lang
                        mass[i] = -cost if mass[i] is None else float(np.logaddexp2(mass[i], -cost))
            rest = [b[c] for c in b.schema.names[:-3]]
            yield pa.record_batch([*rest, pa.array(bits, pa.float64()), pa.array(best, pa.string()), pa.array(mass, pa.float64())], names=b.schema.names)

    return df.mapInArrow(run, schema)


def _batches(column: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows with a letter, their segments, and the place in these rows of each segment's text; about BATCH_BYTES at a time."""
    rows: list[int] = []
    texts: list[np.ndarray] = []
    size = 0
    for i, value in enumerate(column):
        text = value.as_py()
        if text is None or not LETTER.search(text):
            continue
        rows.append(i)
        texts.append(normalised(text))
        size += len(texts[-1])
        if size >= BATCH_BYTES:
            yield rows, *cut(texts)
            rows, texts, size = [], [], 0
    if rows:
        yield rows, *cut(texts)


def identified(df: DataFrame, automata: DataFrame, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score: the language of least cost, and its share of the languages' 2^-cost.

    A null text, one without a letter, and every text where no language is learned are `und` with score 0; equal costs go to the language that sorts first.
    Texts of any length are parsed whole. Each row is judged alone, so repeated rows and null ids are returned as they are; an empty table gives an empty
    result; columns named lang_pred or score are replaced, others pass through. Automata are broadcast BLOCK_LANGUAGES at a time, each of at most some 30
    bytes a byte of its text, and a block's passes follow each other in one scan.
    """
    rest = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    keep = [f"c{i}" for i in range(len(rest))]
    state = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(rest, keep, strict=True)), F.col(f"`{text_col}`").cast("string").alias("text_"), F.lit(None).cast("double").alias("bits_"), F.lit(None).cast("string").alias("best_"), F.lit(None).cast("double").alias("mass_"))
    names = sorted(r["lang"] for r in automata.select("lang").collect())
    for at in range(0, len(names), BLOCK_LANGUAGES):
        state = _parsed(state, sorted(_loaded(automata.filter(F.col("lang").isin(names[at : at + BLOCK_LANGUAGES])).collect())))
    share = F.when(F.col("bits_").isNotNull(), F.least(F.lit(1.0), F.pow(F.lit(2.0), -F.col("bits_") - F.col("mass_"))))
    return state.select(*(F.col(k).alias(c) for c, k in zip(rest, keep, strict=True)), F.coalesce("best_", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce(share, F.lit(0.0)).alias("score"))


def op13_cross_parsing(spark, sf_dir: str) -> DataFrame:
    """Every document's language."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(documents.select("doc_id", "text"), train(documents)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
