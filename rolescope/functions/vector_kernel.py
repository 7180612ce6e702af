"""Best evidence by the dot product of unit vectors between a block of requirements and the blocks of evidence it meets.

Runs inside tasks on the blocks prepared by `operators.vector_blocks`. A matrix product finds the items that can be
among the best k; those are scored again one place after the other, as an expression over the rows would do it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

ROWS = 256      # requirements in one matrix product
SLACK = 1e-9    # of a product against the sum in order; the latter decides
NONE = np.iinfo(np.int64).max
MISSING, UNMET = -1, 1.0  # the length of a missing vector, and the score of what cannot be multiplied
NOBODY = (np.empty(0, np.int64), np.empty((0, 0)))
FOUND = pa.schema([("_row", pa.int64()), ("_item", pa.int64()), ("similarity", pa.float64())])


class Block:
    """Ids, numbers and vectors of a block; only vectors of one length meet, and a missing one has none."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, ords: pa.Array | None = None):
        self.ids = ids.to_numpy()
        self.ords = self.ids if ords is None else ords.to_numpy()
        starts = vectors.offsets.to_numpy()
        values = vectors.values.to_numpy(zero_copy_only=False)
        lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), MISSING)
        self.by_length = {
            int(n): (at, values[starts[at][:, None] + np.arange(max(n, 0))]) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]}


def _clamped(dots: np.ndarray) -> np.ndarray:
    """Between 0 and 1; not-a-number is above all numbers."""
    return np.clip(np.where(np.isnan(dots), 1.0, dots), 0.0, 1.0)


class Asked:
    def __init__(self, block: Block, k: int):
        self.block, self.k, n = block, k, len(block.ids)
        self.similarity, self.ord, self.item = np.full((n, k), -1.0), np.full((n, k), NONE), np.full((n, k), NONE)

    def meet(self, held: Block) -> None:
        n = len(held.ids)
        early = np.lexsort((held.ids, held.ords))  # the first items are the best of those with a score of 0
        for length, (rows, vectors) in self.block.by_length.items():
            at, others = held.by_length.get(length, NOBODY) if length != MISSING else NOBODY
            for lo in range(0, len(rows), ROWS):
                part = vectors[lo:lo + ROWS]
                with np.errstate(invalid="ignore", over="ignore"):
                    near = np.full((len(part), n), UNMET)
                    if len(at):
                        near[:, at] = _clamped(part @ others.T)
                low = np.partition(near, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.zeros(len(part))
                low = np.maximum(low, self.similarity[rows[lo:lo + ROWS], -1])
                place = np.full(n, -1)
                place[at] = np.arange(len(at))
                for j, r in enumerate(rows[lo:lo + ROWS].tolist()):
                    some = np.flatnonzero(near[j] >= low[j] - SLACK) if low[j] > SLACK else np.union1d(
                        np.flatnonzero(near[j] > 0), early[:self.k + np.count_nonzero(near[j] > 0)])
                    exact = np.full(len(some), UNMET)
                    own = place[some]
                    met = own >= 0
                    if met.any():
                        with np.errstate(invalid="ignore", over="ignore"):
                            exact[met] = _clamped(np.add.accumulate(others[own[met]] * part[j], axis=1)[:, -1]) if length else 0.0
                    self._keep(r, exact, held.ords[some], held.ids[some])

    def _keep(self, r: int, similarity: np.ndarray, ords: np.ndarray, items: np.ndarray) -> None:
        similarity = np.concatenate([self.similarity[r], similarity])
        ords, items = np.concatenate([self.ord[r], ords]), np.concatenate([self.item[r], items])
        best = np.lexsort((items, ords, -similarity))[:self.k]
        self.similarity[r], self.ord[r], self.item[r] = similarity[best], ords[best], items[best]

    def found(self) -> pa.RecordBatch:
        there = self.item != NONE
        rows = np.repeat(self.block.ids, there.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(self.item[there]), pa.array(self.similarity[there] + 0.0)], schema=FOUND)


def best_of_blocks(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (profile_id, part, rows, asked, items, ords, held), those of one (profile_id, part) one after the other."""
    now, asked = None, None
    for batch in batches:
        column = lambda name, i: batch.column(name)[i].values
        for i in range(batch.num_rows):
            at = (batch.column("profile_id")[i].as_py(), batch.column("part")[i].as_py())
            if at != now:
                if asked is not None:
                    yield asked.found()
                now, asked = at, Asked(Block(column("rows", i), column("asked", i)), k)
            asked.meet(Block(column("items", i), column("held", i), column("ords", i)))
    if asked is not None:
        yield asked.found()
