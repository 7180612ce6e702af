"""Suffix-array deduplication: a distributed merge sort of front-coded suffix runs.

Only suffixes at block starts of `segments` are sorted: every window of `width` bytes has its block at an
offset that its own content decides, so equal windows meet at equal suffixes, and the other suffixes need no
sorting. One pass counts the blocks' hashes; a suffix whose block occurs once cannot be in a repeated window
and is left at home. Each task sorts its remaining suffixes, stores equal ones once, front-codes the run and
sends it by block hash. A loser tree merges the runs of a bucket; its nodes carry the prefix known to be
shared with the last winner, so no known byte is compared again. Neighbours in merged order that share a
block form a group; within it the neighbours' shared prefixes decide which windows agree on the right of the
block's start, hashes of the left context decide the left.

A block may be as common as it likes: its equal suffixes travel once per task. If more than `group_limit`
different contexts surround it, its windows are hashed and counted by a shuffle instead of in that task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescope.llm import common
from rolescope.llm.segments import BASE, BYTE_HASH, POW, Shape, mix, segments

GRAM = 8
RUN_BYTES = 32 << 20  # distinct suffix bytes that a task sorts in one run
BUCKET_BYTES = 6 << 20
GROUP_LIMIT = 20_000
RESOLVE_AT = 2048
OUT_ROWS = 100_000

SPANS = "a long, b long, lo long, hi long"
FOUND = f"{SPANS}, h1 long, h2 long"


def _byte_segments(batch: pa.RecordBatch, shape: Shape):
    data, offsets = common.text_buffers(batch.column("text"))
    return data, offsets, segments(data, offsets, shape, lambda x: BYTE_HASH[x])


def _keys(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            _, _, found = _byte_segments(batch, shape)
            keys, n = np.unique(found.key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])
    return run


class Run:
    """Distinct suffixes of one task, each with its left context and where it occurs."""

    def __init__(self):
        self.entries: dict[tuple[int, int, bytes], list[int]] = {}
        self.bytes = 0

    def add(self, key: int, left: int, text: bytes, row: int, start: int) -> None:
        at = self.entries.get((key, left, text))
        if at is None:
            self.entries[key, left, text] = [row, start]
            self.bytes += len(text) + 250
        else:
            at.append(row)
            at.append(start)

    def payloads(self, buckets: int, a: np.ndarray, b: np.ndarray):
        by_bucket: dict[int, list] = {}
        for (key, left, text), at in self.entries.items():
            by_bucket.setdefault(key % buckets, []).append((text[left:], text[:left], at))
        pack = zstandard.ZstdCompressor(level=1)
        for bucket, entries in by_bucket.items():
            entries.sort(key=lambda e: e[0])
            yield bucket, pack.compress(front_code(entries, a, b))


def front_code(entries: list, a: np.ndarray, b: np.ndarray) -> bytes:
    """Sorted (suffix, left context, [row, start, ...]) as shared prefix lengths, rests and arrays of places."""
    shared, rests, last = [], [], b""
    for suffix, _, _ in entries:
        n = common_prefix(last, suffix, 0)
        shared.append(n)
        rests.append(suffix[n:])
        last = suffix
    lefts = [e[1] for e in entries]
    at = np.array([x for e in entries for x in e[2]], np.int64).reshape(-1, 2)
    head = np.array([len(entries), len(at)], "<i8")
    lengths = np.array([shared, list(map(len, rests)), list(map(len, lefts)), [len(e[2]) // 2 for e in entries]], "<i4")
    return b"".join([head.tobytes(), lengths.tobytes(), a[at[:, 0]].astype("<i8").tobytes(),
                     b[at[:, 0]].astype("<i8").tobytes(), at[:, 1].astype("<i8").tobytes(), *rests, *lefts])


class Decoded:
    """A front-coded run: entry i has the suffix and its shared prefix with entry i - 1."""

    def __init__(self, payload: bytes):
        raw = zstandard.ZstdDecompressor().decompress(payload)
        n, m = np.frombuffer(raw, "<i8", 2)
        n, m = int(n), int(m)
        shared, rest, left, self.counts = np.frombuffer(raw, "<i4", 4 * n, 16).reshape(4, n)
        at = 16 + 16 * n
        self.places = np.frombuffer(raw, "<i8", 3 * m, at).reshape(3, m)
        at += 24 * m
        self.first = np.cumsum(self.counts) - self.counts
        self.shared, self.suffixes, last = shared.tolist(), [], b""
        for n_shared, n_rest in zip(self.shared, rest.tolist()):
            last = last[:n_shared] + raw[at: at + n_rest]
            self.suffixes.append(last)
            at += n_rest
        self.lefts = []
        for n_left in left.tolist():
            self.lefts.append(raw[at: at + n_left])
            at += n_left


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which the first `known` bytes need no look."""
    most = min(len(x), len(y))
    while known < most:
        p, q = x[known: known + 32], y[known: known + 32]
        if p == q and len(p) == len(q):
            known += len(p)
            continue
        n = min(len(p), len(q))
        differ = int.from_bytes(p[:n], "big") ^ int.from_bytes(q[:n], "big")
        return known + n - (differ.bit_length() + 7) // 8
    return most


def loser_tree(runs: list[Decoded]) -> Iterator[tuple[int, int, int]]:
    """(shared prefix with the entry before it, run, entry) over all runs in suffix order.

    An inner node keeps the loser of its match and what that shares with the match's winner. When the
    winner's next entry climbs, both sides of a match know their prefix shared with the last winner: the
    longer one wins unread, and only equal ones are compared, behind that prefix.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * len(runs)
    suffix = [r.suffixes[0] if r.suffixes else None for r in runs] + [None] * (size - len(runs))
    loser, known = [0] * size, [0] * size

    def play(p: int, p_known: int, q: int, q_known: int) -> tuple[int, int, int, int]:
        """(winner, its known prefix, loser, the prefix it shares with the winner)"""
        x, y = suffix[p], suffix[q]
        if x is None:
            return q, q_known, p, 0
        if y is None:
            return p, p_known, q, 0
        if p_known != q_known:
            return (p, p_known, q, q_known) if p_known > q_known else (q, q_known, p, p_known)
        n = common_prefix(x, y, p_known)
        return (p, p_known, q, n) if x[n: n + 1] <= y[n: n + 1] else (q, q_known, p, n)

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        p, p_known = build(2 * node)
        q, q_known = build(2 * node + 1)
        winner, w_known, loser[node], known[node] = play(p, p_known, q, q_known)
        return winner, w_known

    winner, w_known = build(1)
    while suffix[winner] is not None:
        yield w_known, winner, at[winner]
        run = runs[winner]
        at[winner] += 1
        i = at[winner]
        if i < len(run.suffixes):
            suffix[winner], w_known = run.suffixes[i], run.shared[i]
        else:
            suffix[winner], w_known = None, 0
        node = (size + winner) // 2
        while node:
            winner, w_known, loser[node], known[node] = play(winner, w_known, loser[node], known[node])
            node //= 2


class Groups:
    """Takes merged suffixes; hands out the byte ranges of windows found at two places or more."""

    def __init__(self, shape: Shape, group_limit: int):
        self.shape, self.group_limit = shape, group_limit
        self.group: list = []
        self.hot = False
        self.batch: list = []
        self.out: list = []
        self.rows = 0

    def add(self, shared: int, suffix: bytes, left: bytes, places: np.ndarray) -> None:
        if shared < self.shape.block:
            self.close()
        entry = (shared if self.group or self.hot else 0, suffix, left, places)
        if self.hot:
            self.defer([entry])
            return
        self.group.append(entry)
        if len(self.group) > self.group_limit:
            self.defer(self.group)
            self.group, self.hot = [], True

    def close(self) -> None:
        group, self.group, self.hot = self.group, [], False
        if len(group) > 1 or group and group[0][3].shape[1] > 1:
            self.batch += group
            if len(self.batch) >= RESOLVE_AT:
                self.resolve()

    def give(self, *columns: np.ndarray) -> None:
        self.out.append(columns)
        self.rows += len(columns[0])

    def defer(self, group: list) -> None:
        """The windows of a group with very many contexts go to a shuffle."""
        width = self.shape.width
        for _, suffix, left, places in group:
            text, n = left + suffix, len(left) + len(suffix) - width + 1
            digests = [xxhash.xxh3_128_digest(text[i: i + width]) for i in range(n)]
            h = np.frombuffer(b"".join(digests), "<i8").reshape(n, 2)
            m = places.shape[1]
            lo = (places[2][:, None] - len(left) + np.arange(n)[None, :]).ravel()
            self.give(np.repeat(places[0], n), np.repeat(places[1], n), lo, lo + width, np.tile(h[:, 0], m), np.tile(h[:, 1], m))

    def resolve(self) -> None:
        batch, self.batch = self.batch, []
        if not batch:
            return
        width = self.shape.width
        m = len(batch)
        lefts = np.array([len(e[2]) for e in batch])
        rights = np.array([len(e[1]) for e in batch])
        n_x = int(lefts.max()) + 1  # x: how far a window starts before the suffix
        x = np.arange(n_x)
        shared = np.array([e[0] for e in batch])
        right = np.cumsum(shared[:, None] < width - x[None, :], axis=0).astype(np.uint64)
        context = np.zeros((m, n_x), np.uint64)
        for j, e in enumerate(batch):
            context[j, 1: len(e[2]) + 1] = BYTE_HASH[np.frombuffer(e[2], np.uint8)[::-1]]
        left = mix(np.cumsum(context * POW[:n_x], axis=1))
        same = mix(left + right * np.uint64(BASE)) + x.astype(np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95)
        valid = (x[None, :] <= lefts[:, None]) & (x[None, :] >= width - rights[:, None])
        n_places = np.array([e[3].shape[1] for e in batch])
        _, which = np.unique(same[valid], return_inverse=True)
        total = np.bincount(which, weights=np.broadcast_to(n_places[:, None], valid.shape)[valid])
        found = np.zeros((m, n_x + 2), np.int8)
        found[:, 1:-1][valid] = total[which] > 1
        edge = np.diff(found, axis=1)
        entry, x_first = np.nonzero(edge == 1)
        x_last = np.nonzero(edge == -1)[1] - 1
        places = np.concatenate([e[3] for e in batch], axis=1)
        n, first = n_places[entry], (np.cumsum(n_places) - n_places)[entry]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        none = np.zeros(len(at), np.int64)
        self.give(places[0, at], places[1, at], places[2, at] - np.repeat(x_last, n), places[2, at] + width - np.repeat(x_first, n),
                  none, none)

    def taken(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.out)] if self.out else [np.zeros(0, np.int64)] * 6
        self.out, self.rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "lo", "hi", "h1", "h2"])


def _runs(shape: Shape, buckets: int, filter_bytes):
    def run(batches: Iterator[pa.RecordBatch]):
        own, a, b, base = Run(), [], [], 0

        def flush():
            rows = list(own.payloads(buckets, np.concatenate(a), np.concatenate(b)))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

        for batch in batches:
            data, offsets, found = _byte_segments(batch, shape)
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            hit = common.in_filter(filter_bytes.value, found.key)
            start = offsets[found.row[hit]]
            lo, at, hi = start + found.first[hit], start + found.start[hit], start + found.last[hit] + shape.width
            raw = data.tobytes()
            for key, row, p, s, q, place in zip(found.key[hit].tolist(), found.row[hit].tolist(), lo.tolist(), at.tolist(),
                                                hi.tolist(), found.start[hit].tolist()):
                own.add(key, s - p, raw[p:q], base + row, place)
            base += batch.num_rows
            if own.bytes >= RUN_BYTES:
                yield flush()
                own, a, b, base = Run(), [], [], 0
        if own.entries:
            yield flush()
    return run


def _merge(shape: Shape, group_limit: int):
    def merged(payloads: list[bytes]):
        runs = [Decoded(p) for p in payloads]
        groups = Groups(shape, group_limit)
        for shared, r, i in loser_tree(runs):
            own = runs[r]
            first = own.first[i]
            groups.add(shared, own.suffixes[i], own.lefts[i], own.places[:, first: first + own.counts[i]])
            if groups.rows >= OUT_ROWS:
                yield groups.taken()
        groups.close()
        groups.resolve()
        yield groups.taken()

    def run(batches: Iterator[pa.RecordBatch]):
        """Rows come sorted by bucket."""
        bucket, payloads = None, []
        for batch in batches:
            for own, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                if own != bucket and payloads:
                    yield from merged(payloads)
                    payloads = []
                bucket = own
                payloads.append(payload.as_py())
        if payloads:
            yield from merged(payloads)
    return run


def repeated_ranges(docs: DataFrame, width: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b, lo, hi): byte ranges of documents `keyed` by (a, b) that repeated windows cover; they may overlap."""
    spark, shape = docs.sparkSession, Shape(width, GRAM)
    keys = (docs.select("text").mapInArrow(_keys(shape), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
            .where("n > 1"))
    repeated = common.written(keys, "suffix-keys")
    n_keys, places = repeated.agg(F.count("key"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_keys:
        return spark.createDataFrame([], SPANS)
    sent = spark.sparkContext.broadcast(common.bit_filter(repeated, common.filter_bits(n_keys)))
    buckets = max(8, -(-places * 2 * width // BUCKET_BYTES))
    runs = docs.mapInArrow(_runs(shape, buckets, sent), "bucket int, payload binary")
    by_bucket = runs.repartition("bucket").sortWithinPartitions("bucket")
    found = common.written(by_bucket.mapInArrow(_merge(shape, group_limit), FOUND), "suffix-ranges")
    deferred = found.where("h1 != 0 or h2 != 0")
    # written, so that both sides of the join are plain exchanges and a hot window can be split
    twice = common.written(deferred.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "suffix-twice")
    return (found.where("h1 = 0 and h2 = 0").select("a", "b", "lo", "hi")
            .unionByName(deferred.join(twice, ["h1", "h2"]).select("a", "b", "lo", "hi")))


def merged_spans(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of ranges (rows of lo, hi)."""
    if not len(ranges):
        return []
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.append(True, ranges[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return list(zip(ranges[first, 0].tolist(), reach[np.append(first[1:], len(ranges)) - 1].tolist()))


def _cut(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            spans, kept = [], []
            for text, los, his in zip(batch.column("_text").to_pylist(), batch.column("_lo").to_pylist(), batch.column("_hi").to_pylist()):
                own = merged_spans(np.array([los, his], np.int64).T) if los else []
                raw = (text or "").encode()
                if own:
                    edges = [0, *(x for s in own for x in s), len(raw)]
                    parts = [raw[p:q] for p, q in zip(edges[::2], edges[1::2])]
                    raw = b"".join(p.decode("utf-8", "ignore").encode() for p in parts) if as_text else b"".join(parts)
                spans.append([{"lo": p, "hi": q} for p, q in own])
                kept.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                 pa.array([k.decode() for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], ["_row", "removed_spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, width: int = 200, doc_id: str = "doc_id", text: str = "text",
                   group_limit: int = GROUP_LIMIT, as_text: bool = False) -> DataFrame:
    """All columns, with removed_spans (maximal byte ranges removed) and kept (the remaining bytes).

    With as_text, kept is a string without the characters of which only some bytes remain.

    A byte goes if a string of `width` bytes that covers it also starts anywhere else, in the same
    document or in another one. Columns called removed_spans or kept are replaced.
    Null and empty texts, and those shorter than the width, lose nothing. A null id is an id like any other;
    repeated rows count as documents of their own, so long ones lose everything. No rows in, no rows out.
    """
    docs = docs.drop("removed_spans", "kept")
    ranges = repeated_ranges(common.keyed(docs, doc_id, text), width, group_limit)
    by_doc = ranges.groupBy("a", "b").agg(F.collect_list(F.struct("lo", "hi")).alias("_r"))
    own = docs.select(common.row(docs).alias("_row"), common.id_order(doc_id).alias("a"), common.text_key(text).alias("b"))
    joined = own.join(by_doc, ["a", "b"], "left").select(
        "_row", F.col("_row")[text].alias("_text"), F.col("_r.lo").alias("_lo"), F.col("_r.hi").alias("_hi"))
    row_type = joined.schema["_row"].dataType.simpleString()
    kept = "string" if as_text else "binary"
    out = joined.mapInArrow(_cut(as_text), f"_row {row_type}, removed_spans array<struct<lo:bigint,hi:bigint>>, kept {kept}")
    return out.select("_row.*", "removed_spans", "kept")
