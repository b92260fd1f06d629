"""Words of whole Arrow batches as integer codes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    """``codes[offsets[i]:offsets[i + 1]]`` are the words of row ``i``, as places in ``distinct``."""

    offsets: np.ndarray
    codes: np.ndarray
    distinct: pa.Array


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one array of non-null strings whose buffers begin with its first row; a null text is an empty one.

    The copy matters for a slice: Arrow's ``ascii_lower`` gives a slice's
    offsets into the whole buffer to the slice's own bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    whole = pc.fill_null(column.cast(pa.large_string()), "")
    return whole.take(pa.array(np.arange(len(whole))))


#: Bytes of text that a worker takes up together, about; one longer text is still taken whole.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], *names: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in smaller batches, so that what is worked out per word stays small."""
    for batch in batches:
        lengths = sum(pc.fill_null(pc.binary_length(batch.column(n)), 0).to_numpy(zero_copy_only=False).astype("int64") for n in names)
        part = np.cumsum(lengths) // size
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if part.size else np.zeros(0, "int64")
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=False):
            yield batch.slice(a, b - a)


def words_of(texts: pa.Array) -> Words:
    """Words are runs of anything but ASCII white space."""
    parts = pc.ascii_split_whitespace(texts)
    offsets = parts.offsets.to_numpy().astype("int64")
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return Words(offsets, codes, coded.dictionary)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    total = np.concatenate([[0], np.cumsum(values, dtype="int64")])
    return total[offsets[1:]] - total[offsets[:-1]]
