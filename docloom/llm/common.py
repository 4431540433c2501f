"""What the operators share: written tables, byte words and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from docloom.session import removed, written, written_alone  # noqa: F401


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def byte_words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased: bytes.lower() and bytes.split() touch ASCII alone."""
    return text.lower().split()


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of small batches in larger ones of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces(batch_in: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many rows."""
    for at in range(0, batch_in.num_rows, rows):
        yield batch_in.slice(at, rows)
