"""Substring deduplication with suffix automata of reference shards.

Every window of `width` words belongs to a segment whose block, a stretch of about half a window, is decided
by the window's own words (`segments`). Only segments whose block occurs in documents with different ids can
hold a repeated window; the others never leave their task. A broadcast of every shard's automaton to all
documents would cost (documents x shards); instead a segment travels by its block's hash to the one shard
that can match it. Equal segments travel once per task, with the places they come from. A shard is a bounded
number of words: its distinct segments are inserted into one suffix automaton whose states know the least
document id among their occurrences, then streamed through it. The matching statistics give for each window
the least id of any document that has it, and a document loses the windows where that id is below its own.

A block with more than `group_limit` different segments goes to a shuffle: its windows are hashed to 128 bits
and the least id per hash is joined back, so no group has to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescope.llm import common
from rolescope.llm.segments import Shape, segments
from rolescope.llm.suffix_dedup import merged_spans

GRAM = 8
RUN_BYTES = 24 << 20
SHARD_WORDS = 30_000
GROUP_LIMIT = 500
OUT_ROWS = 100_000
SENT = "key long, words binary, a array<long>, b array<long>, at array<long>"
FOUND = "a long, b long, lo long, hi long, h1 long, h2 long"


def _word_segments(column: pa.Array, shape: Shape):
    split = [t.encode().split() if t else [] for t in column.to_pylist()]
    offsets = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(w) for w in split], out=offsets[1:])
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for words in split for w in words), np.uint64, int(offsets[-1]))
    return split, segments(hashes, offsets, shape)


def _keys(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            _, found = _word_segments(batch.column("text"), shape)
            docs = batch.column("a").to_numpy()[found.row]
            order = np.argsort(found.key)
            key, docs = found.key[order], docs[order]
            first = np.flatnonzero(np.diff(key, prepend=key[:1] - np.uint64(1)) != 0) if len(key) else np.zeros(0, np.int64)
            low = np.minimum.reduceat(docs, first) if len(key) else docs
            high = np.maximum.reduceat(docs, first) if len(key) else docs
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(low), pa.array(high)], ["key", "low", "high"])
    return run


def _runs(shape: Shape, filter_bytes):
    def run(batches: Iterator[pa.RecordBatch]):
        own: dict[tuple[int, bytes], tuple[list, list, list]] = {}
        size = 0

        def flush():
            keys, words = zip(*own)
            a, b, at = zip(*own.values())
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(words, pa.binary()), pa.array(a, kind), pa.array(b, kind), pa.array(at, kind)],
                ["key", "words", "a", "b", "at"])

        for batch in batches:
            split, found = _word_segments(batch.column("text"), shape)
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            hit = common.in_filter(filter_bytes.value, found.key)
            for row, first, last, key in zip(found.row[hit].tolist(), found.first[hit].tolist(), found.last[hit].tolist(),
                                             found.key[hit].view(np.int64).tolist()):
                words = b" ".join(split[row][first: last + shape.width])
                places = own.get((key, words))
                if places is None:
                    places = own[key, words] = ([], [], [])
                    size += len(words) + 500
                places[0].append(a[row])
                places[1].append(b[row])
                places[2].append(first)
            if size >= RUN_BYTES:
                yield flush()
                own, size = {}, 0
        if own:
            yield flush()
    return run


class SuffixAutomaton:
    """All substrings of the inserted word sequences; each state knows the least document of its occurrences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.doc = [common.NO_ID]

    def insert(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            if doc < self.doc[last]:
                self.doc[last] = doc

    def _state(self, length: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.doc.append(common.NO_ID)
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._at_length(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state != -1:
            self.link[new] = self._at_length(state, word, self.next[state][word])
        return new

    def _at_length(self, state: int, word: bytes, target: int) -> int:
        """The target itself if it is exactly one word longer than state, else a clone that is."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def settle(self) -> None:
        """An occurrence of a sequence is one of each of its suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            link = self.link[state]
            if self.doc[state] < self.doc[link]:
                self.doc[link] = self.doc[state]

    def least_docs(self, words: list[bytes], width: int) -> list[int]:
        """For each window of an inserted sequence: the least document that has it."""
        out, state, matched = [], 0, 0
        following, link, length, doc = self.next, self.link, self.length, self.doc
        for word in words:
            state = following[state][word]
            matched += 1
            if matched >= width:
                while length[link[state]] >= width:
                    state = link[state]
                out.append(doc[state])
        return out


class Shard:
    """Groups of segments with one block each, until there are enough words for an automaton."""

    def __init__(self, width: int, group_limit: int):
        self.width, self.group_limit = width, group_limit
        self.segments: list = []
        self.words = 0
        self.group: list = []
        self.key = None
        self.hot = False
        self.out: list = []
        self.rows = 0

    def add(self, key: int, words: bytes, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> None:
        """Rows come sorted by key and words."""
        if key != self.key:
            self.close()
            self.key = key
        if self.group and self.group[-1][0] == words:
            self.group[-1][1].append((a, b, at))
        else:
            self.group.append((words, [(a, b, at)]))
        if len(self.group) > (0 if self.hot else self.group_limit):
            self.hot = True
            for segment in self.group:
                self.defer(segment)
            self.group = []

    def close(self) -> None:
        group, self.group, self.hot = self.group, [], False
        for words, places in group:
            a, b, at = (np.concatenate(x) for x in zip(*places))
            if len(group) == 1 and a.min() == a.max():
                continue  # a false hit of the filter, or a block that its neighbours left alone
            split = words.split()
            self.segments.append((split, int(a.min()), a, b, at))
            self.words += len(split)
        if self.words >= SHARD_WORDS:
            self.match()

    def match(self) -> None:
        automaton, width = SuffixAutomaton(), self.width
        for split, least, *_ in self.segments:
            automaton.insert(split, least)
        automaton.settle()
        for split, _, a, b, at in self.segments:
            docs = automaton.least_docs(split, width)
            first = 0
            for i in range(1, len(docs) + 1):
                if i == len(docs) or docs[i] != docs[first]:
                    later = a > docs[first]
                    if later.any():
                        self.give(a[later], b[later], at[later] + first, at[later] + i - 1 + width)
                    first = i
        self.segments, self.words = [], 0

    def defer(self, segment) -> None:
        words, places = segment
        split = words.split()
        n = len(split) - self.width + 1
        digests = [xxhash.xxh3_128_digest(b" ".join(split[i: i + self.width])) for i in range(n)]
        h = np.frombuffer(b"".join(digests), "<i8").reshape(n, 2)
        for a, b, at in places:
            lo = (at[:, None] + np.arange(n)[None, :]).ravel()
            self.give(np.repeat(a, n), np.repeat(b, n), lo, lo + self.width, np.tile(h[:, 0], len(a)), np.tile(h[:, 1], len(a)))

    def give(self, a, b, lo, hi, h1=None, h2=None) -> None:
        none = np.zeros(len(a), np.int64)
        self.out.append((a, b, lo, hi, none if h1 is None else h1, none if h2 is None else h2))
        self.rows += len(a)

    def taken(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.out)] if self.out else [np.zeros(0, np.int64)] * 6
        self.out, self.rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "lo", "hi", "h1", "h2"])


def _match(width: int, group_limit: int):
    def run(batches: Iterator[pa.RecordBatch]):
        shard = Shard(width, group_limit)
        for batch in batches:
            keys, words = batch.column("key").to_pylist(), batch.column("words").to_pylist()
            lists = []
            for name in ("a", "b", "at"):
                column = batch.column(name)
                ends = column.offsets.to_numpy()
                lists.append(np.split(column.values.to_numpy(zero_copy_only=False)[: ends[-1]], ends[1:-1]))
            for key, own, a, b, at in zip(keys, words, *lists):
                shard.add(key, own, a, b, at)
                if shard.rows >= OUT_ROWS:
                    yield shard.taken()
        shard.close()
        shard.match()
        yield shard.taken()
    return run


def repeated_ranges(docs: DataFrame, width: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b, lo, hi): word ranges of documents `keyed` by (a, b) whose windows a smaller id also has."""
    spark, shape = docs.sparkSession, Shape(width, GRAM)
    keys = (docs.select("a", "text").mapInArrow(_keys(shape), "key long, low long, high long")
            .groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high"))
    repeated = common.written(keys.select("key"), "substring-keys")
    n_keys = repeated.count()
    if not n_keys:
        return spark.createDataFrame([], "a long, b long, lo long, hi long")
    sent = spark.sparkContext.broadcast(common.bit_filter(repeated, common.filter_bits(n_keys)))
    by_key = docs.mapInArrow(_runs(shape, sent), SENT).repartition("key").sortWithinPartitions("key", "words")
    found = common.written(by_key.mapInArrow(_match(width, group_limit), FOUND), "substring-ranges")
    deferred = found.where("h1 != 0 or h2 != 0")
    # written, so that both sides of the join are plain exchanges and a hot window can be split
    least = common.written(deferred.groupBy("h1", "h2").agg(F.min("a").alias("least")), "substring-least")
    return (found.where("h1 = 0 and h2 = 0").select("a", "b", "lo", "hi")
            .unionByName(deferred.join(least, ["h1", "h2"]).where("a > least").select("a", "b", "lo", "hi")))


def _cut(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        n_words, spans, kept = [], [], []
        for text, los, his in zip(batch.column("_text").to_pylist(), batch.column("_lo").to_pylist(), batch.column("_hi").to_pylist()):
            words = (text or "").encode().split()
            own = merged_spans(np.array([los, his], np.int64).T) if los else []
            n_words.append(len(words))
            if own:
                edges = [0, *(x for s in own for x in s), len(words)]
                words = [w for p, q in zip(edges[::2], edges[1::2]) for w in words[p:q]]
            spans.append([{"lo": p, "hi": q} for p, q in own])
            kept.append(b" ".join(words).decode())
        rest = [batch.column(c) for c in batch.schema.names[:-3]]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
             pa.array(kept, pa.string())], [*batch.schema.names[:-3], "n_words", "removed_spans", "kept"])


def remove_repeats(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text",
                   group_limit: int = GROUP_LIMIT) -> DataFrame:
    """All columns, with n_words, removed_spans (maximal ranges of word numbers) and kept (the other words).

    A word goes if a window of `width` words that covers it also starts in a document with a smaller id.
    Columns called n_words, removed_spans or kept are replaced. Null texts have no words. A null id counts
    as larger than all others; rows that share an id never remove words from each other. Texts below the
    width keep everything. No rows in, no rows out.
    """
    docs = docs.drop("n_words", "removed_spans", "kept")
    ranges = repeated_ranges(common.keyed(docs, doc_id, text), width, group_limit)
    by_doc = ranges.groupBy("a", "b").agg(F.collect_list(F.struct("lo", "hi")).alias("_r"))
    own = docs.select(common.row(docs).alias("_row"), common.id_order(doc_id).alias("a"), common.text_key(text).alias("b"))
    joined = own.join(by_doc, ["a", "b"], "left").select(
        "_row", F.col("_row")[text].alias("_text"), F.col("_r.lo").alias("_lo"), F.col("_r.hi").alias("_hi"))
    row_type = joined.schema["_row"].dataType.simpleString()
    out = joined.mapInArrow(_cut, f"_row {row_type}, n_words long, removed_spans array<struct<lo:bigint,hi:bigint>>, kept string")
    return out.select("_row.*", "n_words", "removed_spans", "kept")
