"""Splitting Arrow batches of whole texts into words, lines and bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches, column: str = "text", max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most max_bytes of text each, or one longer text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def offsets_of(lists: pa.Array) -> np.ndarray:
    """Offsets from 0 of the lists' values after flatten()."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts and the number of words in each; only ASCII white space separates."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, at = lists.flatten(), offsets_of(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    keep = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(some), np.diff(keep[at])


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines of all texts, split at newlines, and the number of lines in each; a null text has one empty line."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    return lists.flatten(), np.diff(offsets_of(lists))


def codes(values: pa.Array) -> np.ndarray:
    """Equal values get equal small integers."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(values) else np.zeros(0, dtype=np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each consecutive group of counts[i] values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return total[upto[1:]] - total[upto[:-1]]
