"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id, a tie number of the row), so equal texts are neighbours, and one text under many ids, or even one row
repeated in a third of the table, can be split anywhere: between shards and between the cells that are sorted in one task. Candidate boundaries are probed in rounds: every partition counts the exact bytes and
rows below each probe, the driver keeps for each wanted splitter the two probes around its target, and the next round probes between
them. Only the counts of the probes (a number set by the shards, not by the rows) reach the driver. When every splitter is
within tolerance, the rows are exchanged once, by cells of bounded size inside the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

SHARDS = 24
#: A splitter may miss its target by this part of a shard's bytes.
TOLERANCE = 0.001
#: Probes between two known boundaries in one round.
FAN = 32
#: A shard is sorted in cells of about so many bytes, one task each.
CELL_BYTES = 128 << 20
TOP = 1 << 192


def packed(hashes: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Sort keys of 24 bytes whose byte order is the order of (hash, id, tie)."""
    out = np.empty((len(hashes), 3), dtype=">u8")
    for i, part in enumerate((hashes, ids, ties)):
        out[:, i] = part.view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S24").reshape(-1)


def as_keys(values: list[int]) -> np.ndarray:
    """Python integers of 192 bits as sort keys."""
    return np.array([v.to_bytes(24, "big") for v in values], dtype="S24")


def as_number(key_hash: int, key_id: int, tie: int = 0) -> int:
    """The 192-bit integer of a hash, an id and an unsigned tie."""
    return ((key_hash + (1 << 63)) << 128) + ((key_id + (1 << 63)) << 64) + tie


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe."""
    wanted, schema = probes, pa.schema([("cell", pa.int64()), ("bytes", pa.int64()), ("rows", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = as_keys(wanted)
        size, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            cell = np.searchsorted(bounds, packed(*(_numbers(b[c]) for c in ("key_hash", "key_id", "tie"))), side="right")
            np.add.at(size, cell, _numbers(b["size"]))
            np.add.at(rows, cell, 1)
        full = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(full), pa.array(size[full]), pa.array(rows[full])], schema=schema)

    found = keys.mapInArrow(count, "cell long, bytes long, rows long").groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(len(wanted) + 1, np.int64), np.zeros(len(wanted) + 1, np.int64)
    for r in found:
        size[r["cell"]], rows[r["cell"]] = r["bytes"], r["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, total: int, n_rows: int, shards: int, tolerance: float = TOLERANCE, fan: int = FAN, first: list[int] | None = None) -> list[int]:
    """shards - 1 boundaries; a row belongs below a boundary if its key is smaller.

    keys has key_hash, key_id, tie and size (long, no nulls); first are further probes of the first round, such as the edges of large groups. A
    boundary misses its target by more than the tolerance only where a single row is larger than that.
    """
    targets = [total * (i + 1) / shards for i in range(shards - 1)]
    miss = tolerance * total / shards
    low, high = [(0, 0, 0)] * len(targets), [(TOP, total, n_rows)] * len(targets)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * len(targets)
    open_at = list(range(len(targets))) if total else []
    more = set(first or [])
    while open_at:
        probes, more = more, set()
        for i in open_at:
            (a, below_a, _), (z, below_z, _) = low[i], high[i]
            step = max(1, (z - a) // fan)
            probes.update(range(a + step, z, step))
            guess = a + int((z - a) * ((targets[i] - below_a) / max(1, below_z - below_a)))
            probes.update(p for p in (guess - step // 8, guess, guess + step // 8) if a < p < z)
        ordered = sorted(probes)
        below, rows = _counted(keys, ordered)
        for i in open_at:
            # The counts grow with the probes, so the two around a target are neighbours.
            at = int(np.searchsorted(below, targets[i], side="right"))
            if at and ordered[at - 1] > low[i][0]:
                low[i] = (ordered[at - 1], int(below[at - 1]), int(rows[at - 1]))
            if at < len(ordered) and ordered[at] < high[i][0]:
                high[i] = (ordered[at], int(below[at]), int(rows[at]))
            best[i] = min(low[i], high[i], key=lambda x: abs(x[1] - targets[i]))
        open_at = [i for i in open_at if abs(best[i][1] - targets[i]) > miss and high[i][2] - low[i][2] > 1 and high[i][0] - low[i][0] > 1]
    return [x[0] for x in best]


def cell_bounds(bounds: list[int], total: int, texts: list[tuple[int, int]], large: list[tuple[int, int, int]], cell_bytes: int) -> list[int]:
    """The splitters and further boundaries inside the shards: equal widths of the hashed key space, of the hashed ids of large texts (hash, bytes), and of the ties of large groups of equal rows (hash, id, bytes)."""
    out, edges = set(bounds), [0, *bounds, TOP]
    parts = max(1, -(-total // ((len(bounds) + 1) * cell_bytes)))
    for a, z in zip(edges, edges[1:], strict=False):
        out.update(a + (z - a) * k // parts for k in range(1, parts))
    for key_hash, size in texts:
        cut = -(-size // cell_bytes)
        out.update(as_number(key_hash, -(1 << 63)) + (k << 128) // cut for k in range(cut + 1))
    for key_hash, key_id, size in large:
        cut = -(-size // cell_bytes)
        out.update(as_number(key_hash, key_id) + (k << 64) // cut for k in range(cut + 1))
    return sorted(out - {0, TOP})


def keyed(df: DataFrame, id_col: str, text_col: str, columns: dict[str, str]) -> DataFrame:
    """A written table of what rows are dealt by (size, text_crc32, key_hash, key_id, tie) and of some columns under new names; written once, as tie numbers must be the same in every job."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return written(
        df.select(
            *(F.col(f"`{c}`").alias(k) for c, k in columns.items()),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key_hash"),
            F.xxhash64(F.col(f"`{id_col}`")).alias("key_id"),
            F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
        ),
        "shard-keys",
    )


def cells(keys: DataFrame, shards: int, tolerance: float, cell_bytes: int) -> tuple[list[int], list[int]]:
    """(splitters of the shards, boundaries of the cells inside and between them)."""
    total, n_rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    # Groups of a twentieth of a shard or half a cell: their number is bounded by that of the shards and cells.
    least = max(1, min(total // (20 * shards), cell_bytes // 2))
    is_large, size = (F.col("bytes") >= least) & (F.col("n") > 1), (F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    texts = [(r["key_hash"], r["bytes"]) for r in keys.groupBy("key_hash").agg(*size).filter(is_large).select("key_hash", "bytes").collect()]
    large: list[tuple[int, int, int]] = []
    if texts:
        few = F.broadcast(keys.sparkSession.createDataFrame([(h,) for h, _ in texts], "key_hash long"))
        large = [(r["key_hash"], r["key_id"], r["bytes"]) for r in keys.join(few, "key_hash").groupBy("key_hash", "key_id").agg(*size).filter(is_large).collect()]
    edges = [as_number(h, -(1 << 63)) + t for h, _ in texts for t in (0, 1 << 128)] + [as_number(h, i) + t for h, i, _ in large for t in (0, 1 << 64)]
    found = splitters(keys, total, n_rows, shards, tolerance, first=[x for x in edges if 0 < x < TOP])
    return found, cell_bounds(found, total, texts, large, cell_bytes)


def histogram_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    cell_bytes: int = CELL_BYTES,
    columns: list[str] | None = None,
) -> DataFrame:
    """df (or its named columns) with size, text_crc32, shard and slot: `shards` runs of near-equal bytes in the order (text hash, id hash).

    size is the text's UTF-8 bytes plus 8, whatever the text's length; a null text counts as empty, a null id is one like others. Rows
    with the same id and text are ties: they are neighbours, in any order, and may be split between shards. An empty table gives an
    empty result. Other columns pass through under any name; columns named size, text_crc32, shard or slot are replaced.
    """
    rest = [c for c in (columns or df.columns) if c.lower() not in ("size", "text_crc32", "shard", "slot")]
    keep = [f"c{i}" for i in range(len(rest))]
    keys = keyed(df, id_col, text_col, dict(zip(rest, keep, strict=True)))
    found, bounds = cells(keys, shards, tolerance, cell_bytes)
    # Equal splitters leave the shards between them empty: a cell belongs to the last shard that begins at or before it.
    shard_of = np.searchsorted(as_keys(found), as_keys([0, *bounds]), side="right").astype(np.int32)
    shared = df.sparkSession.sparkContext.broadcast((as_keys(bounds), shard_of))

    @F.pandas_udf("cell int, shard int")
    def cell_of(key_hash: pd.Series, key_id: pd.Series, tie: pd.Series) -> pd.DataFrame:
        keys, shard_of = shared.value
        cell = np.searchsorted(keys, packed(*(x.to_numpy(np.int64) for x in (key_hash, key_id, tie))), side="right")
        return pd.DataFrame({"cell": cell.astype(np.int32), "shard": shard_of[cell]})

    dealt = keys.withColumn("placed", cell_of("key_hash", "key_id", "tie")).select(*keep, "size", "text_crc32", "key_hash", "key_id", "tie", "placed.cell", "placed.shard")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("cell").orderBy("key_hash", "key_id", "tie")
    ranked = dealt.withColumn("within", F.row_number().over(order) - 1).join(starts, "cell")
    named = [F.col(k).alias(c) for c, k in zip(rest, keep, strict=True)]
    return ranked.select(*named, "size", "text_crc32", "shard", (F.col("first") + F.col("within")).alias("slot"))


def op7_histogram_sort(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `bytes`."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    narrow = histogram_shards(documents, columns=["doc_id"]).select("doc_id", "size", "text_crc32", "shard", "slot")
    return narrow.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
