"""Best-fit packing of documents into fixed-size bins under conflicts.

Two documents of one source, or of one duplicate cluster, never share a bin. Documents are taken longest
first. Open bins are ordered by what is left in them and carry a bitmap of their sources and one of their
clusters; the search starts at the least residual that holds the document and goes on to the next one until
a bin has neither bit. Bins without the task's most frequent sources are ordered apart, one order per
combination, so that a source with a third of all documents skips the bins that have it instead of trying
them. Bitmaps are hashed when a task has more sources or clusters than bits: then a bin may be passed over
needlessly, never taken wrongly.

Documents are dealt evenly by hash, so tasks hold a bounded number of pieces whatever the keys, and bins
never cross tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescope.llm import common

CAPACITY = 2048
PIECES_PER_TASK = 20_000
FREQUENT = 5
BITS = 2048


def _measure(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        sizes, clusters = [], []
        for text in batch.column("text").to_pylist():
            words = (text or "").encode().lower().split()
            sizes.append(len(words) + 1)
            clusters.append(xxhash.xxh3_64_intdigest(b" ".join(words)) >> 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "a", "b", "source")), pa.array(sizes, pa.int64()),
                                          pa.array(clusters, pa.int64())], ["doc_id", "a", "b", "source", "size", "cluster"])


class Bins:
    """The open bins of a task."""

    def __init__(self, capacity: int, frequent: list[int]):
        self.capacity, self.frequent = capacity, {s: 1 << i for i, s in enumerate(frequent)}
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.order: dict[int, list] = {}  # frequent sources in the bin -> [bit set of residuals, residual -> bins]

    def _put(self, bin_id: int, group: int) -> None:
        left = self.left[bin_id]
        if left:
            order = self.order.setdefault(group, [0, {}])
            order[0] |= 1 << left
            order[1].setdefault(left, []).append(bin_id)

    def _take(self, bin_id: int, group: int) -> None:
        order, left = self.order[group], self.left[bin_id]
        own = order[1][left]
        own.remove(bin_id)
        if not own:
            del order[1][left]
            order[0] &= ~(1 << left)

    def full(self) -> int:
        """A bin that is full from the start."""
        self.left.append(0)
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.left) - 1

    def tightest(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """(bin, group) of the least residual that holds the size and has neither bit."""
        own, best = self.frequent.get(source, 0), None
        source_bit, cluster_bit = 1 << source % BITS, 1 << cluster % BITS if cluster >= 0 else 0
        for group, (residuals, bins) in self.order.items():
            if group & own:
                continue
            most = self.capacity + 1 if best is None else best[0]
            ahead = residuals >> size
            left = size - 1
            while ahead:
                step = (ahead & -ahead).bit_length()
                left += step
                ahead >>= step
                if left >= most:
                    break
                found = next((b for b in bins[left] if not (self.sources[b] & source_bit or self.clusters[b] & cluster_bit)), None)
                if found is not None:
                    best = (left, found, group)
                    break
        return None if best is None else best[1:]

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, where the document starts in it)"""
        found = self.tightest(size, source, cluster)
        if found is None:
            bin_id, group = self.full(), 0
            self.left[bin_id] = self.capacity
        else:
            bin_id, group = found
            self._take(bin_id, group)
        start = self.capacity - self.left[bin_id]
        self.left[bin_id] -= size
        self.sources[bin_id] |= 1 << source % BITS
        if cluster >= 0:
            self.clusters[bin_id] |= 1 << cluster % BITS
        self._put(bin_id, group | self.frequent.get(source, 0))
        return bin_id, start


def pack_part(rows: list[tuple], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Of rows (size, source, cluster): (row, piece, bin, start, length), the rests longest first."""
    sources: dict = {}
    source = [sources.setdefault(r[1], len(sources)) for r in rows]
    repeated = Counter(r[2] for r in rows)
    clusters: dict = {}
    cluster = [clusters.setdefault(r[2], len(clusters)) if repeated[r[2]] > 1 else -1 for r in rows]
    bins = Bins(capacity, [s for s, _ in Counter(source).most_common(FREQUENT)])
    out = []
    for i, row in enumerate(rows):
        for piece in range(row[0] // capacity):
            out.append((i, piece, bins.full(), 0, capacity))
    for i in sorted(range(len(rows)), key=lambda i: (-(rows[i][0] % capacity), i)):
        piece, size = divmod(rows[i][0], capacity)
        if size:
            out.append((i, piece, *bins.place(size, source[i], cluster[i]), size))
    return out


def _pack(capacity: int):
    def packed(part: int, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        found = pack_part(list(zip(*(table.column(c).to_pylist() for c in ("size", "source", "cluster")))), capacity)
        at, piece, own, start, length = (pa.array(x, pa.int64()) for x in (zip(*found) if found else [[]] * 5))
        ids = pa.array(own.to_numpy() + (part << 32)) if len(own) else own
        columns = [table.column(c).combine_chunks().take(at) for c in ("doc_id", "source", "cluster")]
        yield pa.RecordBatch.from_arrays([*columns, piece, ids, start, length],
                                         ["doc_id", "source", "cluster", "piece", "bin_id", "start", "length"])

    def run(batches: Iterator[pa.RecordBatch]):
        """Rows come sorted by part."""
        held, part = [], None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1)) if len(parts) else []
            for p, q in zip(edges[:-1], edges[1:]):
                if held and parts[p] != part:
                    yield from packed(part, held)
                    held = []
                part = int(parts[p])
                held.append(batch.slice(p, q - p))
        if held:
            yield from packed(part, held)
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """(doc_id, source, cluster, piece, bin_id, start, length): where each piece of each document lies.

    A document takes one place per word and one for its end, so null and empty texts take one. A document
    longer than a bin fills whole bins from its beginning; its rest is packed. The cluster is the hash of
    the words, lower-cased (A-Z): copies are one cluster. Null sources are one source. Repeated rows are
    documents of their own and, as copies, never share a bin. Ties in length go by id, then by text hash.
    No rows in, no rows out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.id_order(doc_id).alias("a"), common.text_key(text).alias("b"),
                       F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    measured = common.written(rows.mapInArrow(_measure, "doc_id long, a long, b long, source string, size long, cluster long"), "sizes")
    parts = max(1, -(-measured.count() // pieces_per_task))
    dealt = (measured.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(parts))).repartition(parts, "part")
             .sortWithinPartitions("part", "a", "b"))
    return dealt.mapInArrow(_pack(capacity), "doc_id long, source string, cluster long, piece long, bin_id long, start long, length long")
