"""Words of many texts at once, by Arrow's own string functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 16 << 20


def slices(batch: pa.RecordBatch, column: int, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of at most that many rows, or SLICE_BYTES of the text column; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each word's place in the list of distinct words, the bounds of the texts among the words, and that list.

    Words are runs of other than ASCII white space; NULL has none. lower: A-Z become a-z first.
    """
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    values, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    there = pc.greater(pc.binary_length(values), 0)
    bounds = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))[ends]
    coded = values.filter(there).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, coded.dictionary.cast(pa.binary()).to_pylist()
