"""What operators 11 and 12 share: list columns of Arrow batches as integer matrices, and packed rows of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array, scale: int, largest: int, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and floor(scale * x) as an integer matrix, for each length of the vectors in a list<double> column.

    Vectors that are null, empty, or hold a null or a non-finite component are left out, and so are those of another length
    than the one that is asked for. Integers of magnitude `largest` or more raise ValueError, as sums of them are not exact.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # null components become NaN
    for d in np.unique(lengths).tolist():
        if d == 0 or length not in (None, d):
            continue
        rows = np.flatnonzero(lengths == d)
        x = flat[starts[rows][:, None] + np.arange(d)]
        whole = np.isfinite(x).all(1)
        if whole.any():
            x = np.floor(x[whole] * scale)
            if np.abs(x).max() >= largest:
                raise ValueError(f"a component of {np.abs(x).max():g} after scaling; exact sums need less than {largest:g}")
            yield rows[whole], x.astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in 16 bits if all fit, else in 64, little-endian."""
    return x.astype("<i2" if np.abs(x).max(initial=0) < 32768 else "<i8")


def wide(data: bytes, dim: int, rows: int) -> np.ndarray:
    """The integer matrix of `rows` vectors that `narrow` has packed."""
    return np.frombuffer(data, "<i2" if len(data) == 2 * dim * rows else "<i8").reshape(rows, dim).astype(np.int64)


def packed(x: np.ndarray) -> pa.Array:
    """A binary value for each row: as `narrow` packs that row by itself, so equal rows have equal bytes."""
    n, d = x.shape
    small = np.abs(x).max(1) < 32768
    if not small.all():
        return pa.array([narrow(r).tobytes() for r in x], pa.binary())
    offsets = np.arange(n + 1, dtype=np.int32) * (2 * d)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.astype("<i2").tobytes())])


def unpacked(column: pa.Array, dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Length and integer matrix of the rows that `packed` gave, for each length."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for d, size in sorted(set(zip(dims.tolist(), sizes.tolist(), strict=True))):
        part = column.filter(pa.array((dims == d) & (sizes == size)))
        yield d, wide(b"".join(part.to_pylist()), d, len(part))
