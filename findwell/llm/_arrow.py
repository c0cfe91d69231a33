"""Arrow helpers for operators that run in mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and row offsets; null is empty."""
    arr = column.cast(pa.binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def as_bytes(column: pa.Array) -> list[bytes]:
    """Rows of a string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `limit` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, off = flat(column)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups, from input sorted by `key`: about `rows` rows, one group at least."""
    held: list[pa.RecordBatch] = []
    count, goal = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < goal:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
        held = table.slice(cut).combine_chunks().to_batches()
        count = count - cut
        goal = rows if count < rows else 2 * count
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bounded_batches(spark, rows: int = 512) -> None:
    """Rows of an Arrow batch, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
