"""Words of Arrow batches as numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def encoded(texts: pa.Array, between: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, number of each word, words by number), in order. A-Z are lower-cased first; null texts have no
    words. ``between``: a pattern of what parts words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), between)
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return rows.filter(full).to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def gathered(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= least_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
            pa.default_memory_pool().release_unused()  # what one block took is not held beside the next
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
