"""Best evidence by token Jaccard between a block of requirements and the blocks of evidence that it meets.

Runs inside tasks on the blocks prepared by `operators.evidence_index`. Per requirement the common tokens with all
items of a block are counted at once through the block's postings lists, and only items that can be among the
best k are scored exactly. Work is one pass over a block per requirement; nothing is kept of a pair that is not
among the best.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DENSE = 512       # postings lists of a block that are kept as one byte per item, the longest ones
SPARSE = 64       # a list of less than one item in so many is never kept so
COLUMN = 64       # items whose best one stands for them when the k-th best similarity is bounded
SLACK = 1e-6      # single precision bounds are rounded outwards; the exact similarity decides
NO_ORD = np.iinfo(np.int64).max

FOUND = pa.schema([
    ("profile_id", pa.string()), ("asked_bag", pa.binary()),
    ("_top", pa.list_(pa.struct([("neg", pa.float64()), ("evidence_ord", pa.int64())])))])


def _cut(words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokens of all bags, and where each bag's start; a bag's tokens are distinct and joined by blanks."""
    lists = pc.split_pattern(words, " ")
    return lists.flatten().dictionary_encode(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


class Held:
    """A block of evidence bags: postings lists, sizes, and the numbers of the items of each bag, lowest first."""

    def __init__(self, words: pa.Array, ords: pa.Array):
        tokens, starts = _cut(words)
        self.vocabulary = tokens.dictionary
        ids, n = tokens.indices.to_numpy(), len(words)
        self.width = -(-n // COLUMN) * COLUMN
        self.sizes = np.ones(self.width, dtype=np.float32)
        self.sizes[:n] = np.diff(starts)
        frequency = np.bincount(ids, minlength=len(self.vocabulary))
        self.ends = np.cumsum(frequency)
        self.begins = self.ends - frequency
        self.postings = np.repeat(np.arange(n), np.diff(starts))[np.argsort(ids, kind="stable")]
        longest = np.argsort(-frequency, kind="stable")[:DENSE]
        self.dense = {}
        for i in longest[frequency[longest] * SPARSE > n].tolist():
            self.dense[i] = np.zeros(self.width, dtype=np.uint8)
            self.dense[i][self.postings[self.begins[i]:self.ends[i]]] = 1
        self.copies = pc.list_value_length(ords).to_numpy()
        self.ords = ords.flatten().to_numpy()
        self.ords_at = np.cumsum(self.copies) - self.copies
        self.first = self.ords[self.ords_at]


class Asked:
    """A block of requirement bags with the best k items found so far."""

    def __init__(self, bags: pa.Array, words: pa.Array, k: int):
        self.bags, self.k, self.n = bags, k, len(bags)
        tokens, self.starts = _cut(words)
        self.vocabulary, self.ids = tokens.dictionary, tokens.indices.to_numpy()
        self.similarity, self.ord = np.zeros((self.n, k)), np.full((self.n, k), NO_ORD)

    def meet(self, held: Held) -> None:
        known = pc.fill_null(pc.index_in(self.vocabulary, value_set=held.vocabulary), -1).to_numpy()
        ids, reached = known[self.ids], self.similarity[:, -1].tolist()
        starts, begins, ends = self.starts.tolist(), held.begins.tolist(), held.ends.tolist()
        small, large = np.zeros(held.width, dtype=np.uint8), np.zeros(held.width, dtype=np.int32)
        common, score = np.empty(held.width, dtype=np.float32), np.empty(held.width, dtype=np.float32)
        at, bags, similarities = [], [], []
        for r in range(self.n):
            own = [i for i in ids[starts[r]:starts[r + 1]].tolist() if i >= 0]
            if not own:
                continue
            m = starts[r + 1] - starts[r]
            counts = small if m < 256 else large
            counts[:] = 0
            for i in own:
                row = held.dense.get(i)
                if row is not None:
                    counts += row
                else:
                    counts[held.postings[begins[i]:ends[i]]] += 1
            near = self._near(counts, held, m, reached[r], common, score)
            exact = counts[near].astype(np.float64)
            exact /= m + held.sizes[near].astype(np.float64) - exact
            best = np.lexsort((held.first[near], -exact))[:self.k]
            at.append(np.full(len(best), r))
            bags.append(near[best])
            similarities.append(exact[best])
        if at:
            self._keep(held, np.concatenate(at), np.concatenate(bags), np.concatenate(similarities))

    def _near(self, counts: np.ndarray, held: Held, m: int, reached: float, common: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Bags with a common token that may be among the best k."""
        np.copyto(common, counts)
        np.subtract(held.sizes, common, out=score)
        score += np.float32(m)
        np.divide(common, score, out=score)
        most = score.reshape(COLUMN, -1).max(axis=0)  # k columns hold k bags
        low = max(reached, float(np.partition(most, -self.k)[-self.k]) if len(most) >= self.k else 0.0)
        return np.flatnonzero(score >= low * (1 - SLACK)) if low > 0 else np.flatnonzero(counts)

    def _keep(self, held: Held, at: np.ndarray, bags: np.ndarray, similarities: np.ndarray) -> None:
        """The best k of what was kept and of the bags' items, most similar and then earliest first."""
        copies = held.copies[bags]
        nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        ords = held.ords[np.repeat(held.ords_at[bags], copies) + nth]
        kept, slot = np.nonzero(self.ord != NO_ORD)
        rows = np.concatenate([kept, np.repeat(at, copies)])
        similarity = np.concatenate([self.similarity[kept, slot], np.repeat(similarities, copies)])
        ords = np.concatenate([self.ord[kept, slot], ords])
        order = np.lexsort((ords, -similarity, rows))
        rows, similarity, ords = rows[order], similarity[order], ords[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < self.k
        self.similarity[rows[best], place[best]], self.ord[rows[best], place[best]] = similarity[best], ords[best]

    def found(self, profile_id: str) -> pa.RecordBatch:
        """Bags with an item that shares a token, and their best items."""
        there = self.ord != NO_ORD
        counts = there.sum(axis=1)
        some = np.flatnonzero(counts)
        items = pa.StructArray.from_arrays([pa.array(-self.similarity[there]), pa.array(self.ord[there])], fields=list(FOUND.field("_top").type.value_type))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts[some])]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([profile_id] * len(some), pa.string()), self.bags.take(pa.array(some)).cast(pa.binary()),
             pa.ListArray.from_arrays(offsets, items).cast(FOUND.field("_top").type)], schema=FOUND)


def best_of_blocks(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (profile_id, part, asked_bags, asked_words, words, ords), those of one (profile_id, part) one after the other."""
    now, asked = None, None
    for batch in batches:
        column = lambda name, i: batch.column(name)[i].values
        for i in range(batch.num_rows):
            at = (batch.column("profile_id")[i].as_py(), batch.column("part")[i].as_py())
            if at != now:
                if asked is not None:
                    yield asked.found(now[0])
                now, asked = at, Asked(column("asked_bags", i), column("asked_words", i), k)
            asked.meet(Held(column("words", i), column("ords", i)))
    if asked is not None:
        yield asked.found(now[0])
