"""Arrow columns of vectors as numpy matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def floored(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their floor(scale * c) as int64).

    A row takes part if it is not null and holds neither null nor non-finite entries. A shorter vector counts as
    ending in zeros, so that rows of several lengths fit one matrix, as wide as the longest that takes part. Entries
    that don't fit the arithmetic (2**62 and beyond) are an error, as no exact result would hold them.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # leaves out what null rows cover
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    fine = pc.is_valid(column).to_numpy(zero_copy_only=False).astype(bool)
    fine[row[~np.isfinite(values)]] = False
    kept = fine[row]
    lengths, row, values = lengths[fine], row[kept], np.floor(scale * values[kept])
    if values.size and np.abs(values).max() >= 2.0**62:
        raise OverflowError("a vector's entry is too large for integer arithmetic")
    width = int(lengths.max(initial=0))
    if len(values) == len(lengths) * width:
        return fine, values.astype(np.int64).reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    start = np.cumsum(lengths) - lengths
    number = np.repeat(np.arange(len(lengths)), lengths)
    out[number, np.arange(len(values)) - start[number]] = values
    return fine, out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    """The rows with zeros up to ``width``."""
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def blobs(x: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The rows of a column of ``blobs``."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)
