"""Arrow batches worked off a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


def in_slices(batches: Iterable[tuple[pa.Array, ...]], size: int, of: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """`of` every row as arrays of at most `size` values: only so many rows are Python objects, however many a batch has."""
    for columns in batches:
        for at in range(0, len(columns[0]), size):
            rows = zip(*[c.slice(at, size).to_pylist() for c in columns])
            yield pa.array([of(*row) for row in rows], kind)
