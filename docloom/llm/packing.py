"""Packing of token sequences by non-negative least squares over length patterns.

Documents are tokenised once, cut at the window and reduced to pieces with a length. Everything after that works on the
histogram of piece lengths, which has at most `window` entries: shallow combinations of lengths that fill a window
are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded down, and
what is left is packed greedily, largest first, again on the histogram. A pattern with r repeats is r sequences, so a
piece's place follows from its rank among the pieces of its length, by arithmetic inside the task that holds it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

WINDOW = 1024
END_ID = 0
#: Coordinate-descent sweeps of the least-squares fit.
SWEEPS = 60
#: Pieces of one length ranked in one task.
RANKED = 20_000
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
# The vocabulary's pre-token pattern, given with the tokenizer files, and the same pattern where white space does not stand in runs.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: White space whose runs PATTERN may cut elsewhere than at each character, and white space other than blanks and newlines.
RUNS = ("  ", " \n", "\n ", "\n\n\n")
OTHER_SPACE = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[str, int]:
    """The byte of each letter in which byte-level vocabularies are written: printable bytes stand for themselves, the others follow 255 in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to token ids (uint32) by a byte-level BPE file of the `tokenizers` library.

    The file's vocabulary is in the order of its merges, so its ids are ranks, and tiktoken's faster merging gives the ids that `tokenizers`
    gives (a test holds them equal). Texts in which white space stands alone are cut by the plain pattern, which needs no look-ahead.
    Texts that hold an added token's string go through `tokenizers` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if piece not in self.special}
        by_pattern = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.any, self.plain = by_pattern("any", PATTERN), by_pattern("plain", PLAIN_PATTERN)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        runs = any(s in text for s in RUNS) or text.endswith("\n\n") or any(s in text for s in (OTHER_SPACE[:8] if text.isascii() else OTHER_SPACE))
        return (self.any if runs else self.plain).encode_to_numpy(text, disallowed_special=())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(df: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """PIECE_SCHEMA (and ids, the little-endian uint32 bytes, if asked for) of df (doc_id, text): documents cut every `window` ids."""
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for b in batches:
            cut: list[bytes] = []
            tokens = np.empty(b.num_rows, np.int64)
            for i, text in enumerate(b["text"].to_pylist()):
                ids = np.append(encode(text or ""), end_id).astype("<u4").tobytes()
                tokens[i] = len(ids) // 4
                cut += [ids[at : at + 4 * window] for at in range(0, len(ids), 4 * window)]
            pieces = -(-tokens // window)
            row = np.repeat(np.arange(b.num_rows), pieces)
            start = window * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            arrays = [
                b["doc_id"].take(pa.array(row)),
                pa.array(start),
                pa.array(np.minimum(tokens[row] - start, window)),
                pa.array(map(zlib.crc32, cut), pa.int64()),
                pa.array(tokens[row]),
                *([pa.array(cut, pa.binary())] if with_ids else []),
            ]
            yield pa.record_batch(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Up to four lengths that fill the window exactly: a large one, and its rest whole, halved, or cut in three ways."""
    have, out = set(lengths), set()
    for a in lengths:
        rest = window - a
        out.update((a, rest) for _ in [0] if rest in have)
        for part in {rest // 2, rest // 3, rest // 4, rest // 5} - {0}:
            out.update([(a, rest - part, part)] if part in have and rest - part in have else [])
            if rest - 2 * part in have and part in have:
                out.add((a, rest - 2 * part, part, part))
    return sorted({tuple(sorted(c, reverse=True)) for c in out})


def nnls(patterns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that makes the patterns' lengths come near the counts in least squares, by coordinate descent on sparse columns."""
    columns = [dict(zip(*np.unique(p, return_counts=True), strict=True)) for p in patterns]
    columns = [([int(k) for k in c], [int(v) for v in c.values()], float(sum(int(v) ** 2 for v in c.values()))) for c in columns]
    x, left = [0.0] * len(patterns), counts.astype(float).tolist()
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, times, square) in enumerate(columns):
            step = max(-x[j], sum(t * left[a] for a, t in zip(at, times, strict=True)) / square)
            if step:
                x[j] += step
                moved += abs(step)
                for a, t in zip(at, times, strict=True):
                    left[a] -= t * step
        if moved < 0.5:
            break
    return np.array(x)


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, repeats)] that use counts[length] pieces of each length exactly."""
    left = counts.astype(np.int64).copy()
    out = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    patterns = combinations([int(x) for x in np.flatnonzero(left)], window)
    fitted = nnls(patterns, left) if patterns else np.empty(0)
    for j in np.argsort(-fitted, kind="stable"):
        at, times = np.unique(patterns[j], return_counts=True)
        repeats = int(min(np.floor(fitted[j] + 1e-9), (left[at] // times).min()))
        if repeats <= 0:
            continue
        left[at] -= repeats * times
        out.append((patterns[j], repeats))
    while left.any():
        room, chosen, spare = window, [], left.copy()
        while room and (fits := np.flatnonzero(spare[: room + 1])).size:
            chosen.append(int(fits[-1]))
            spare[fits[-1]] -= 1
            room -= int(fits[-1])
        at, times = np.unique(chosen, return_counts=True)
        repeats = int((left[at] // times).min())
        left[at] -= repeats * times
        out.append((tuple(chosen), repeats))
    return out


def slots(planned: list[tuple[tuple[int, ...], int]], window: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) in the order of ranks."""
    used, sequence, out = np.zeros(window + 1, np.int64), 0, {}
    for lengths, repeats in planned:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((int(used[n]), sequence, offset))
            used[n] += repeats
            offset += n
        sequence += repeats
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (doc_id, start, length, ...) with sequence_id and offset (long).

    Ranks are taken in salted parts of each length, so one length may hold any share of the pieces. Equal rows are ties and
    take neighbouring ranks. No pieces give an empty result.
    """
    pieces = written(pieces, "pieces")
    counts = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    places = slots(plan(counts, window), window)
    parts = max(1, -(-int(counts.sum()) // RANKED))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    sizes = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(within) - 1).join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("within")).drop("first", "within", "part")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(zero_copy_only=False), b["rank"].to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own, table = length == n, places[int(n)]
                hit = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                sequence[own], offset[own] = hit[:, 1] + rank[own] - hit[:, 0], hit[:, 2]
            yield pa.record_batch([*(b[c] for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """df (doc_id, text) as pieces in sequences of at most `window` tokens.

    A null or empty text is the end id alone. Repeated rows are packed each; a null doc_id stays null. Other columns are ignored.
    """
    return packed(token_pieces(df, tokenizer_path, window, with_ids=with_ids), window)


def default_tokenizer() -> str:
    """The public byte-level vocabulary of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_nnls_patterns(spark, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
