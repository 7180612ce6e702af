"""Phrase collocations by direct-address tiling of ranked ids.

Words that occur often enough are ranked by frequency. Each pair of adjacent ranks is a cell of a square; the
ranks are cut into bands of equal frequency mass, so that the tiles of the square get similar shares of the
pairs. A task counts the pairs of its texts by address (the most frequent ranks, with `bincount`) or by
sorting, and sends one packed list of (cell, count) per tile. A tile's lists meet in one task, which adds them
up in a dense array where the tile has few cells, else as a sorted coordinate list, and gives the pairs that
occur often enough.

Longer phrases take the same step again: the frequent pairs are ranked anew, and two pairs that overlap in a
word are adjacent items like two words before. Any phrase that occurs `least` times has parts that do, so the
items left out at a level cannot be part of a result.

The ranks that travel to the tasks are bounded (DICTIONARY). Frequent items beyond it pass a bit filter of
bounded size and are counted by a shuffle of their 64-bit keys, so the results do not depend on the bound.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from rolescope.llm import common
from rolescope.llm.class_lm import Table
from rolescope.plans.spread import salted_join

DICTIONARY = 1 << 20
BYTES_AT_ONCE = 1 << 20
PAIRS_AT_ONCE = 1 << 22
HEAD = 1024  # ranks whose pairs a task counts by address
DENSE_CELLS = 1 << 22  # a tile with at most so many cells is added up in a dense array
EVENTS_PER_TILE = 1 << 22
BANDS_LEAST, BANDS_MOST = 16, 256
SALTS = 64
LANGUAGES_SENT = 1 << 16  # totals of so many languages travel to the tasks; of more, they are joined over SALTS parts of each
UNKNOWN = "und"
CELL_BITS = 40  # two ranks below DICTIONARY
NO_WORD = 0  # the key of a language's total
PAIR = "key long, left long, right long, n long"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread all 64 bits over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Reader:
    """Cuts texts into words and pieces and gives each word a 64-bit key of its language and its lower-cased bytes."""

    def __init__(self, seed: int):
        rnd = np.random.default_rng(seed)
        self.value = rnd.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.value[65:91] = self.value[97:123]
        self.base = int(rnd.integers(0, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.seed = seed
        self.is_break = np.zeros(256, bool)
        self.is_break[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
        self.is_word = ~self.is_break
        self.is_word[[0x20, 0x09]] = False
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.powers):
            of = lambda b: np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)))
            self.powers, self.inverses = of(self.base), of(self.inverse)

    def language(self, lang: str) -> int:
        return xxhash.xxh3_64_intdigest(lang.encode(), self.seed)

    def read(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> tuple[np.ndarray, ...]:
        """(keys, piece numbers, starts, ends) of the words of all documents; pieces never cross documents."""
        stop, at, piece = int(offsets[-1]), int(offsets[0]), 0
        parts = []
        while at < stop:
            end = min(at + BYTES_AT_ONCE, stop)
            while end < stop and self.is_word[data[end]] and self.is_word[data[end - 1]]:  # not inside a word
                ahead = np.flatnonzero(~self.is_word[data[end:min(end + BYTES_AT_ONCE, stop)]])
                end = end + int(ahead[0]) if len(ahead) else min(end + BYTES_AT_ONCE, stop)
            own = data[at:end]
            word, first = self.is_word[own], np.zeros(end - at + 1, bool)
            first[offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, end, "right")] - at] = True
            first[-1] = True
            opens = word.copy()
            opens[1:] &= ~word[:-1] | first[1:-1]
            closes = word.copy()
            closes[:-1] &= ~word[1:] | first[1:-1]
            s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            pieces = np.cumsum(self.is_break[own] | first[:-1], dtype=np.int64) + piece
            self._powers(len(own))
            sums = np.append(np.uint64(0), np.cumsum(self.value[own] * self.powers[:len(own)]))
            raw = (sums[e] - sums[s]) * self.inverses[s] + (e - s).astype(np.uint64)
            parts.append((raw, pieces[s], s + at, e + at))
            piece, at = int(pieces[-1]), end
        if not parts:
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
        raw, pieces, s, e = (np.concatenate(c) for c in zip(*parts))
        per_doc = np.diff(np.searchsorted(s, offsets))
        seeds = {lang: self.language(lang) for lang in set(langs)}
        seed = np.repeat(np.array([seeds[lang] for lang in langs], np.uint64), per_doc)
        return _mix(_mix(raw) + seed), pieces, s, e

    def combine(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return _mix(_mix(left + np.uint64(self.seed + 1)) + right)


_readers: dict[int, Reader] = {}


def reader(seed: int) -> Reader:
    if seed not in _readers:
        _readers[seed] = Reader(seed)
    return _readers[seed]


def _words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]):
        own = reader(seed)
        for batch in batches:
            data, offsets = common.text_buffers(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            keys, _, s, e = own.read(data, offsets, langs)
            if not len(keys):
                continue
            distinct, at, n = np.unique(keys, return_index=True, return_counts=True)
            doc = np.searchsorted(offsets, s[at], "right") - 1
            # words and the gaps between them share one buffer of offsets; every other entry is a word
            edges = np.stack([s, e], 1).ravel()
            spans = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data))
            words = pc.ascii_lower(spans.take(pa.array(2 * at))).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array([langs[d] for d in doc], pa.string()), words, pa.array(n, pa.int64())],
                ["key", "lang", "word", "n"])
            per_doc = np.diff(np.searchsorted(s, offsets))
            totals = {}
            for lang, count in zip(langs, per_doc.tolist()):
                totals[lang] = totals.get(lang, 0) + count
            yield pa.RecordBatch.from_arrays(
                [pa.array([NO_WORD] * len(totals), pa.int64()), pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()),
                 pa.array(list(totals.values()), pa.int64())], ["key", "lang", "word", "n"])
    return run


class Items:
    """Frequent items of one level: those with a rank, and a bit filter for the rest."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, rest: np.ndarray | None, events: int):
        self.token = uuid.uuid4().hex
        self.keys, self.rest = keys, rest
        wanted = int(np.clip(np.ceil(np.sqrt(events / EVENTS_PER_TILE)), BANDS_LEAST, BANDS_MOST))
        mass = np.cumsum(counts)
        shares = np.arange(1, wanted) / wanted * (mass[-1] if len(mass) else 0)
        self.edges = np.unique(np.concatenate([[0], np.searchsorted(mass, shares) + 1, [len(keys)]])).astype(np.int64)
        self.edges = self.edges[self.edges <= len(keys)]
        self.widths = np.diff(self.edges)

    @property
    def bands(self) -> int:
        return len(self.widths)

    def ready(self) -> "Items":
        """In a worker: the rank table and each rank's band, made once."""
        if self.token not in _ready:
            if len(_ready) >= 4:
                _ready.clear()
            self.table = Table(self.keys)
            self.band = np.repeat(np.arange(self.bands), self.widths)
            _ready[self.token] = self
        return _ready[self.token]

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, frequent or maybe frequent)."""
        rank = self.table.find(keys)
        if self.rest is None:
            return rank, rank >= 0
        ok = rank >= 0
        out = np.flatnonzero(~ok)
        ok[out] = common.in_filter(self.rest, keys[out])
        return rank, ok


_ready: dict[str, Items] = {}


def packed(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane; most planes are nearly empty."""
    step = np.diff(x, prepend=0)
    kind = "<u4" if not len(step) or step.max() < 1 << 32 else "<u8"
    planes = step.astype(kind).view(np.uint8).reshape(len(step), int(kind[2])).T.tobytes()
    return kind[2].encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(raw: bytes) -> np.ndarray:
    width = int(raw[:1])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Pairs:
    """Counts pairs of adjacent items in a task: ranked ones by cell, others by key."""

    def __init__(self, items: Items, own: Reader):
        self.items, self.reader = items, own
        self.first, self.second, self.held = [], [], 0
        self.left, self.right = [], []

    def add(self, rank1, rank2, key1, key2) -> bool:
        """Whether enough is held."""
        ranked = (rank1 >= 0) & (rank2 >= 0)
        self.first.append(rank1[ranked])
        self.second.append(rank2[ranked])
        if not ranked.all():
            self.left.append(key1[~ranked])
            self.right.append(key2[~ranked])
        self.held += len(rank1)
        return self.held >= PAIRS_AT_ONCE

    def cells(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Tile and cell of rank pairs, in one number."""
        own = self.items
        b1, b2 = own.band[first], own.band[second]
        cell = (first - own.edges[b1]) * own.widths[b2] + (second - own.edges[b2])
        return ((b1 * own.bands + b2) << CELL_BITS) | cell

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.first:
            first, second = np.concatenate(self.first).astype(np.int64), np.concatenate(self.second).astype(np.int64)
            head = (first < HEAD) & (second < HEAD)
            dense = np.bincount(first[head] * HEAD + second[head], minlength=1)
            at = np.flatnonzero(dense)
            cells, n = np.unique(self.cells(first[~head], second[~head]), return_counts=True)
            cells, n = _added(np.concatenate([self.cells(at // HEAD, at % HEAD), cells]), np.concatenate([dense[at], n]))
            tile = cells >> CELL_BITS
            cuts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])[:len(tile)])
            lists = [(c & ((1 << CELL_BITS) - 1), m) for c, m in zip(np.split(cells, cuts[1:]), np.split(n, cuts[1:]))] if len(cuts) else []
            yield self.batch(len(lists), tile=tile[cuts], cells=[packed(c) for c, _ in lists], counts=[packed(np.cumsum(m)) for _, m in lists])
        if self.left:
            pairs = np.stack([np.concatenate(self.left), np.concatenate(self.right)], 1)
            pairs = pairs[np.lexsort(pairs.T[::-1])]
            first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1)))
            n = np.diff(np.append(first, len(pairs)))
            left, right = pairs[first].T
            yield self.batch(len(first), key=self.reader.combine(left, right).view(np.int64), left=np.ascontiguousarray(left).view(np.int64),
                             right=np.ascontiguousarray(right).view(np.int64), n=n)
        self.__init__(self.items, self.reader)

    @staticmethod
    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in COUNTED], [c for c, _ in COUNTED])


COUNTED = [("tile", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary()), ("key", pa.int64()), ("left", pa.int64()),
           ("right", pa.int64()), ("n", pa.int64())]


def _adjacent(seed: int, levels):
    """Count adjacent items of the last level; the items of a level are two adjacent ones of the level before."""
    def run(batches: Iterator[pa.RecordBatch]):
        own, items = reader(seed), [level.value.ready() for level in levels]
        pairs = Pairs(items[-1], own)
        for batch in batches:
            data, offsets = common.text_buffers(batch.column("text"))
            keys, pieces, _, _ = own.read(data, offsets, batch.column("lang").to_pylist())
            rank, ok = items[0].known(keys)
            together = pieces[1:] == pieces[:-1]
            at = np.flatnonzero(ok[1:] & ok[:-1] & together)
            for level in items[1:]:
                longer = own.combine(keys[at], keys[at + 1])
                of_pair, ok_pair = level.known(longer)
                keys = np.zeros(len(keys), np.uint64)
                rank, ok = np.full(len(keys), -1, np.int32), np.zeros(len(keys), bool)
                keys[at], rank[at], ok[at] = longer, of_pair, ok_pair
                at = np.flatnonzero(ok[1:] & ok[:-1])
            # held pairs stay bounded however long a text is
            for i in range(0, len(at), PAIRS_AT_ONCE):
                j = at[i:i + PAIRS_AT_ONCE]
                if pairs.add(rank[j], rank[j + 1], keys[j], keys[j + 1]):
                    yield from pairs.taken()
        yield from pairs.taken()
    return run


class Tile:
    """Adds up the lists of one tile."""

    def __init__(self, tile: int, items: Items):
        self.items, (self.b1, self.b2) = items, divmod(tile, items.bands)
        self.tile = tile
        n_cells = int(items.widths[self.b1] * items.widths[self.b2])
        self.dense = np.zeros(n_cells, np.int64) if n_cells <= DENSE_CELLS else None
        self.cells, self.counts, self.held, self.kept = [], [], 0, 0

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.cells.append(cells)
        self.counts.append(counts)
        self.held += len(cells)
        if self.held > max(1 << 20, 2 * self.kept):
            self.settle()

    def settle(self) -> None:
        if not self.cells:
            return
        cells, counts = np.concatenate(self.cells), np.concatenate(self.counts)
        if self.dense is not None:
            self.dense += np.bincount(cells, counts, len(self.dense)).astype(np.int64)
            self.cells, self.counts, self.held = [], [], 0
        else:
            cells, counts = _added(cells, counts)
            self.cells, self.counts, self.held, self.kept = [cells], [counts], len(cells), len(cells)

    def frequent(self, least: int, own: Reader) -> pa.RecordBatch:
        self.settle()
        if self.dense is not None:
            cells = np.flatnonzero(self.dense >= least)
            n = self.dense[cells]
        else:
            cells, n = self.cells[0], self.counts[0]
            cells, n = cells[n >= least], n[n >= least]
        items = self.items
        left = items.keys[items.edges[self.b1] + cells // items.widths[self.b2]]
        right = items.keys[items.edges[self.b2] + cells % items.widths[self.b2]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (own.combine(left, right).view(np.int64), left.view(np.int64), right.view(np.int64), n)], ["key", "left", "right", "n"])


def _tiles(seed: int, sent, least: int):
    def run(batches: Iterator[pa.RecordBatch]):
        own, items, tile = reader(seed), sent.value, None
        for batch in batches:
            for number, cells, counts in zip(batch.column("tile").to_pylist(), batch.column("cells"), batch.column("counts")):
                if tile is None or tile.tile != number:
                    if tile is not None:
                        yield tile.frequent(least, own)
                    tile = Tile(number, items)
                tile.add(unpacked(cells.as_py()), np.diff(unpacked(counts.as_py()), prepend=0))
        if tile is not None:
            yield tile.frequent(least, own)
    return run


def _items(counts: DataFrame, dictionary: int) -> Items:
    """Of a table (key, n): whole count levels from the highest down get ranks while they fit, the rest a filter."""
    levels = sorted(((r.n, r.items) for r in counts.groupBy("n").agg(F.count("key").alias("items")).collect()), reverse=True)
    taken, level = 0, None
    for n, items in levels:
        if taken + items > dictionary:
            break
        taken, level = taken + items, n
    total, events = sum(i for _, i in levels), sum(n * i for n, i in levels)
    found = (counts.where(F.col("n") >= level) if level is not None else counts.limit(0)).select("key", "n").toArrow()
    keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.lexsort([keys, -n])
    rest = None
    if total > taken:
        others = counts.where(F.col("n") < level) if level is not None else counts
        rest = common.bit_filter(others.select("key"), common.filter_bits(total - taken))
    return Items(keys[order], n[order], rest, events)


def adjacent(docs: DataFrame, seed: int, levels: list, least: int) -> DataFrame:
    """(key, left, right, n): pairs of adjacent items of the last level that occur at least `least` times."""
    items = levels[-1].value
    counted = docs.mapInArrow(_adjacent(seed, levels), "tile long, cells binary, counts binary, key long, left long, right long, n long")
    if items.rest is not None:
        counted = common.written(counted, "collocation-counts")
    ranked = (counted.where("tile is not null").select("tile", "cells", "counts").repartition("tile").sortWithinPartitions("tile")
              .mapInArrow(_tiles(seed, levels[-1], least), PAIR))
    if items.rest is None:
        return ranked
    others = counted.where("tile is null").groupBy("key", "left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return ranked.unionByName(others)


def _cut(a: str, left: str, right: str) -> Column:
    """The score of one cut with its parts, in whole decimals: exact for counts of up to 15 digits."""
    top = f"cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))"
    score = F.expr(f"({top}) div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))")
    return F.struct(score.alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))


def mine(docs: DataFrame, least: int = 10, overlap: int = 50, text: str = "text", lang: str = "lang", dictionary: int = DICTIONARY) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of two and three words, per language.

    Texts are lower-cased (A-Z) and cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and
    tabs; null texts are empty, a null lang is `und`. A phrase occurs `least` times or more within pieces
    (a, overlaps included). l and r are the occurrences of the two parts of its worst cut, score is
    floor(1000000 a a / (l r)), of equal cuts the first; n: all words of the language. A phrase that lies in a
    longer candidate with at least `overlap` percent of its occurrences is dropped. Repeated rows count as
    often as they occur; other columns are ignored; no words, no rows. Words are told apart by 64-bit keys;
    if two frequent words or pairs share one, all is counted anew with other keys.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"))
    for seed in itertools.count(1):
        counts = common.written(
            rows.mapInArrow(_words(seed), "key long, lang string, word string, n long").groupBy("key", "lang", "word")
            .agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull()), "collocation-words")
        words = counts.where("word is not null")
        one = spark.sparkContext.broadcast(_items(words, dictionary))
        pairs = common.written(adjacent(rows, seed, [one], least), "collocation-pairs")
        two = spark.sparkContext.broadcast(_items(pairs, dictionary))
        if all(df.groupBy("key").count().where("count > 1").isEmpty() for df in (words, pairs)):
            break
    triples = common.written(adjacent(rows, seed, [one, two], least), "collocation-triples")

    word = lambda side: words.select(F.col("key").alias(side), F.col("word").alias(f"{side}_word"), F.col("n").alias(f"{side}_n"))
    named = common.written(pairs.join(words.select(F.col("key").alias("left"), "lang", F.col("word").alias("left_word"), F.col("n").alias("left_n")), "left")
                           .join(word("right"), "right"), "collocation-named")
    inside = (triples.select(F.col("left").alias("key"), "n").unionByName(triples.select(F.col("right").alias("key"), "n"))
              .groupBy("key").agg(F.max("n").alias("most")))
    two_words = (named.join(inside, "key", "left").where(F.col("most").isNull() | (100 * F.col("most") < overlap * F.col("n")))
                 .select("lang", F.concat_ws(" ", "left_word", "right_word").alias("phrase"), F.col("n").alias("a"), _cut("n", "left_n", "right_n").alias("cut")))
    head = named.select(F.col("key").alias("left"), "lang", F.concat_ws(" ", "left_word", "right_word").alias("head"),
                        F.col("left_n").alias("first_n"), F.col("n").alias("head_n"))
    tail = named.select(F.col("key").alias("right"), F.col("right_word").alias("last"), F.col("right_n").alias("last_n"), F.col("n").alias("tail_n"))
    cuts = F.when(_cut("n", "head_n", "last_n")["score"] < _cut("n", "first_n", "tail_n")["score"], _cut("n", "head_n", "last_n")
                  ).otherwise(_cut("n", "first_n", "tail_n"))
    three_words = (triples.select("left", "right", "n").join(head, "left").join(tail, "right")
                   .select("lang", F.concat_ws(" ", "head", "last").alias("phrase"), F.col("n").alias("a"), cuts.alias("cut")))
    totals = counts.where("word is null").select("lang", F.col("n").alias("n"))
    phrases = two_words.unionByName(three_words)
    # a language may hold most phrases, so they are not dealt by it
    few = totals.limit(LANGUAGES_SENT + 1).count() <= LANGUAGES_SENT
    with_n = phrases.join(F.broadcast(totals), "lang") if few else salted_join(phrases, totals, ["lang"], ["phrase"], SALTS)
    return (with_n
            .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")))


def best(phrases: DataFrame, most: int) -> DataFrame:
    """Each language's first `most` phrases by score, then occurrences, both descending, then phrase; rank from 1.

    A language's phrases are cut down in SALTS parts first, so that one task ranks SALTS * most rows at the end.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("_rn", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rn") <= most)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
