"""Brown class-based bigram model, learned by distributed exchange clustering.

All words of the training documents are counted by a shuffle of 64-bit word hashes. The words above a count
that at most DICTIONARY words reach travel to the tasks; the others and the unseen ones are in the last class,
so every token's class is known where it is read and the seen rare words set what the unseen ones get.
The dictionary words start in classes by rank and are exchanged, all of them: a shuffle brings together each
word's neighbours, and in a turn every other word proposes, in parallel and from its neighbours' classes, the
class that raises the class-bigram likelihood most. Of the moves of a turn that lowers the likelihood as a
whole, the better half is tried again; the search ends when neither half of the words gains GAIN any more.

P(word | previous) = P(class | previous class) P(word | class): transitions are smoothed towards the class
frequencies, words of the last class by one. A document is scored where it is read; only its words outside
the dictionary are joined with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.llm import common

DICTIONARY = 1 << 20
LEAST = 3  # occurrences of a dictionary word: rarer words stay in the last class and stand for the unseen ones
CLASSES = 64
GAIN = 2e-3  # log likelihood per token that a turn must gain
PRIOR = 10.0
HELD_AT_ONCE = 1 << 21
PARTS = 1024  # a word with more than one in so many tokens has its neighbours in several parts
PART_STEP = 7919
PAIRS_AT_ONCE = 1 << 19  # of a word and a neighbour, in one shard
TOKENS_AT_ONCE = 1 << 18
TEXT_AT_ONCE = 2 << 20  # bytes
SHARDS_SENT = 16
ROWS_AT_ONCE = 512
END = xxhash.xxh3_64_intdigest(b" ")  # no word has a space


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, each closed by END; offsets)."""
    parts, sizes = [], [0]
    for text in texts:
        words = tokens(text)
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        parts.append(np.array([END], np.uint64))
        sizes.append(len(words) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def _count(batches: Iterator[pa.RecordBatch]):
    held, size = [], 0

    def merged():
        words, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return words, np.bincount(which, weights=np.concatenate([h[1] for h in held])).astype(np.int64)

    def rows(words, n):
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        held.append(np.unique(_hashes(batch.column("text").to_pylist())[0], return_counts=True))
        size += len(held[-1][0])
        if size > HELD_AT_ONCE:
            held = [merged()]
            size = len(held[0][0])
            if size > HELD_AT_ONCE // 2:
                yield rows(*held[0])
                held, size = [], 0
    if held:
        yield rows(*merged())


class Table:
    """From word hashes to ranks, by open addressing; -1 for words that are not in it."""

    def __init__(self, words: np.ndarray):
        size = 1 << max(4, int(2 * len(words)).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.zeros(size, np.uint64)
        self.ranks = np.full(size, -1, np.int32)
        left = np.arange(len(words))
        at = (words & self.mask).astype(np.int64)
        while len(left):
            free = self.ranks[at[left]] < 0
            slot, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.slots[slot], self.ranks[slot] = words[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)

    def find(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int32)
        left, at = np.arange(len(words)), (words & self.mask).astype(np.int64)
        while len(left):
            rank = self.ranks[at]
            hit = (rank >= 0) & (self.slots[at] == words[left])
            out[left[hit]] = rank[hit]
            on = (rank >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & int(self.mask)
        return out


class Vocabulary(NamedTuple):
    table: Table
    counts: np.ndarray  # by rank
    unit_of_rank: np.ndarray
    exchange: int  # words with a unit of their own
    bands: int
    total: int  # training tokens
    distinct: int
    ends: int
    tail_total: int
    tail_distinct: int

    @property
    def tail_unit(self) -> int:
        return self.exchange + self.bands

    @property
    def end_unit(self) -> int:
        return self.tail_unit + 1

    @property
    def units(self) -> int:
        return self.tail_unit + 2

    def units_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(units, ranks) of a token sequence; a rank of -1 is an end or a word outside the dictionary."""
        rank = self.table.find(words)
        units = np.append(self.unit_of_rank, self.tail_unit)[rank].astype(np.int64)
        units[words == np.uint64(END)] = self.end_unit
        return units, rank


def vocabulary(counts: DataFrame, dictionary: int, exchange: int) -> tuple[Vocabulary, DataFrame]:
    """Of a counts table (word, n); with it the counts of the words outside the dictionary."""
    end = END - (1 << 64) if END >= 1 << 63 else END
    words = counts.where(F.col("word") != end)
    ends = counts.where(F.col("word") == end).agg(F.sum("n")).first()[0] or 0
    many = sorted(((r.n, r.words) for r in words.groupBy("n").agg(F.count("word").alias("words")).collect()), reverse=True)
    least, taken = 1 << 62, 0
    for n, of_n in many:
        if n < LEAST or taken + of_n > dictionary:
            break
        least, taken = n, taken + of_n
    top = words.where(F.col("n") >= least).toArrow()
    word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.lexsort((word, -n))
    word, n = word[order], n[order]
    exchange = min(exchange, len(word))
    rank = np.arange(len(word))
    band = np.floor(np.log2(np.maximum(rank, 1) / max(exchange, 1))).astype(np.int64)
    bands = int(band[-1]) + 1 if len(word) > exchange else 0
    total = sum(n * w for n, w in many)
    return Vocabulary(Table(word), n, np.where(rank < exchange, rank, exchange + np.maximum(band, 0)).astype(np.int32), exchange, bands,
                      int(total + ends), int(sum(w for _, w in many) + bool(ends)), int(ends), int(total - n.sum()),
                      int(sum(w for _, w in many) - len(word))), words.where(F.col("n") < least)


def _binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the stretches between the edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _sides(sent):
    """The neighbours of each unit and how often, many units to a shard; neighbours before it count from `units` on."""
    def run(batches: Iterator[pa.RecordBatch]):
        own, parts, shards = sent.value
        width = 2 * own.units

        def codes(words):
            out, last = np.empty(2 * len(words), np.int64), own.end_unit
            for lo in range(0, len(words), TOKENS_AT_ONCE):
                y, _ = own.units_of(words[lo: lo + TOKENS_AT_ONCE])
                x, last = np.append(last, y[:-1]), y[-1]
                for at, unit, side in ((lo, x, y), (len(words) + lo, y, own.units + x)):
                    shard = (unit + side % parts[unit] * PART_STEP) % shards
                    out[at: at + len(y)] = (shard * own.units + unit) * width + side
            return out

        for batch in batches:
            code = codes(_hashes(batch.column("text").to_pylist())[0])
            if not len(code):
                continue
            code.sort()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            n, code = np.diff(np.append(first, len(code))).astype(np.int32), code[first]
            unit, side = code // width, (code % width).astype(np.int32)
            first = np.flatnonzero(np.diff(unit, prepend=-1))  # of each unit in each shard
            many = np.diff(np.append(first, len(unit))).astype(np.int32)
            unit = unit[first]
            shard = unit // own.units
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            of_units, of_sides = np.append(starts, len(unit)), np.append(first[starts], len(side))
            rows = pa.RecordBatch.from_arrays(
                [pa.array(shard[starts]), _binaries((unit % own.units).astype(np.int32), of_units), _binaries(many, of_units),
                 _binaries(side, of_sides), _binaries(n, of_sides)], ["shard", "unit", "many", "side", "n"])
            for lo in range(0, len(starts), SHARDS_SENT):
                yield rows.slice(lo, SHARDS_SENT)
    return run


def _ints(column, kind) -> np.ndarray:
    """The values of all rows of a binary column, one after the other."""
    return np.concatenate([np.frombuffer(value.as_buffer(), kind) for value in column])


def _chunks(sent):
    """The units of a shard in one row, each with its neighbours merged: those of either half of the words, and the others."""
    def run(shard: pa.Table) -> pa.Table:
        units, exchange, parts = sent.value
        unit, many, side, n = (_ints(shard.column(c), np.int32).astype(np.int64) for c in ("unit", "many", "side", "n"))
        code = np.repeat(unit, many) * (2 * units) + side
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        code, n = code[first], np.add.reduceat(n, first)
        unit, side = code // (2 * units), (code % (2 * units)).astype(np.int32)
        half = np.where(unit < exchange, unit % 2, OTHERS)
        columns = {}
        for h in (*HALVES, OTHERS):
            of = unit[half == h]
            at = np.flatnonzero(np.diff(of, prepend=-1))
            for c, values in zip(Chunk._fields, (of[at].astype(np.int32), parts[of[at]].astype(np.int32), np.append(at, len(of)).astype(np.int32),
                                                 side[half == h], n[half == h])):
                columns[f"{c}_{h}"] = pa.array([values.tobytes()], pa.binary())
        return pa.table(columns)
    return run


class Chunk(NamedTuple):
    unit: np.ndarray
    parts: np.ndarray
    edges: np.ndarray  # where the neighbours of each unit begin, and where the last ones end
    side: np.ndarray
    n: np.ndarray

    def rows(self, at_once: int) -> Iterator[Chunk]:
        """A bounded number of units at a time."""
        for lo in range(0, len(self.unit), at_once):
            edges = self.edges[lo: lo + at_once + 1]
            yield Chunk(self.unit[lo: lo + at_once], self.parts[lo: lo + at_once], edges - edges[0],
                        self.side[edges[0]: edges[-1]], self.n[edges[0]: edges[-1]])


HALVES, OTHERS = (0, 1), 2  # of the exchanged words, every other one; the units that stay where they are


def _columns(*halves: int) -> list[str]:
    return [f"{c}_{h}" for h in halves for c in Chunk._fields]


def _each_chunk(batches: Iterator[pa.RecordBatch], *halves: int) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            for h in halves:
                *ints, n = (batch.column(c)[i].as_buffer() for c in _columns(h))
                yield Chunk(*(np.frombuffer(x, np.int32) for x in ints), np.frombuffer(n, np.int64))


class Sides(NamedTuple):
    """What a task needs for a turn."""
    class_of: np.ndarray
    matrix: np.ndarray


def _class_counts(chunk: Chunk, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the classes behind each unit, before it); `classes` has one for each neighbour"""
    row = np.repeat(np.arange(len(chunk.unit)) * (2 * n_classes), np.diff(chunk.edges))
    n = np.bincount(row + classes[chunk.side], weights=chunk.n, minlength=len(chunk.unit) * 2 * n_classes)
    both = n.reshape(len(chunk.unit), 2 * n_classes)
    return both[:, :n_classes], both[:, n_classes:]


def _one_matrix(out: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["matrix"])


def _matrices(sent):
    """The class-bigram matrix of a task's units."""
    def run(batches: Iterator[pa.RecordBatch]):
        class_of, n_classes = sent.value
        out = np.zeros(n_classes * n_classes)
        for chunk in _each_chunk(batches, *HALVES, OTHERS):
            behind = chunk.side < len(class_of)
            own = np.repeat(class_of[chunk.unit], np.diff(chunk.edges))[behind]
            out += np.bincount(own * n_classes + class_of[chunk.side[behind]], weights=chunk.n[behind], minlength=len(out))
        yield _one_matrix(out)
    return run


def _changes(sent, half: int):
    """What the moves of units of one half change in the class-bigram matrix."""
    def run(batches: Iterator[pa.RecordBatch]):
        class_of, tried, n_classes = sent.value
        moved, units = class_of != tried, len(class_of)
        out = np.zeros(n_classes * n_classes)
        for chunk in _each_chunk(batches, half):
            moves = np.repeat(moved[chunk.unit], np.diff(chunk.edges))
            unit, side, n = np.repeat(chunk.unit, np.diff(chunk.edges))[moves], chunk.side[moves], chunk.n[moves]
            behind = side < units
            x, y, times = unit[behind], side[behind], n[behind]
            for of, sign in ((tried, 1), (class_of, -1)):
                out += np.bincount(of[x] * n_classes + of[y], weights=sign * times, minlength=len(out))
            before = np.flatnonzero(~behind)
            before = before[~moved[side[before] - units]]  # of a pair that moves as a whole, the first has counted it
            x, y, times = side[before] - units, unit[before], n[before]
            for of, sign in ((tried, 1), (class_of, -1)):
                out += np.bincount(class_of[x] * n_classes + of[y], weights=sign * times, minlength=len(out))
        yield _one_matrix(out)
    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _each_once(of, *values: np.ndarray) -> np.ndarray:
    """A row for each value, or number of a few and value, computed once for all that are equal."""
    *few, n = values
    code = n * (few[0].max() + 1) + few[0] if few else n
    _, first, at = np.unique(code, return_index=True, return_inverse=True)
    return of(*(v[first] for v in values))[at]


def best_classes(matrix: np.ndarray, own: np.ndarray, behind: np.ndarray, before: np.ndarray, itself: np.ndarray,
                 targets: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, gain in log likelihood over staying) of moving each word, and only it, to one of the first classes."""
    at, behind, before = np.arange(len(own)), behind.copy(), before.copy()
    behind[at, own] -= itself
    before[at, own] -= itself
    gain, flat = np.zeros(behind.shape), _xlogx(matrix)
    for m, logs, far, near in ((matrix, flat, behind, before), (matrix.T, flat.T, before, behind)):
        row, j = np.nonzero(far)
        if not len(row):
            continue
        each, n = np.arange(len(row)), far[row, j]
        more = _each_once(lambda j, n: _xlogx(m.T[j] + n[:, None]) - logs.T[j], j, n)
        mine = j == own[row]
        rest = m[own[row], j] - n  # what the own class has with class j without the word
        more[each, own[row]] = _xlogx(rest + n) - _xlogx(rest)
        rest = m.T[j[mine]] - near[row[mine]]
        more[mine] = _xlogx(rest + n[mine, None]) - _xlogx(rest)
        more[each, j] = 0
        first = np.flatnonzero(np.diff(row, prepend=-1))
        gain[row[first]] += np.add.reduceat(more, first, axis=0)
    corner = np.tile(np.diag(matrix), (len(own), 1))
    corner[at, own] -= behind[at, own] + before[at, own] + itself
    gain += _xlogx(corner + behind + before + itself[:, None]) - _xlogx(corner)
    for margin, n in ((matrix.sum(1), behind.sum(1) + itself), (matrix.sum(0), before.sum(1) + itself)):
        less = _each_once(lambda n: _xlogx(margin + n[:, None]) - _xlogx(margin), n)
        rest = margin[own] - n
        less[at, own] = _xlogx(rest + n) - _xlogx(rest)
        gain -= less
    best = np.argmax(gain[:, :targets], axis=1)
    return best, gain[at, best] - gain[at, own]


def best_class(matrix: np.ndarray, own: int, behind: np.ndarray, before: np.ndarray, itself: float, targets: int) -> tuple[int, float]:
    """best_classes of one word."""
    best, gain = best_classes(matrix, np.array([own]), behind[None, :].astype(float), before[None, :].astype(float), np.array([float(itself)]), targets)
    return int(best[0]), float(gain[0])


def _proposals(sent, half: int, targets: int):
    """Moves that gain, of units of one half; of units in parts, their counts instead."""
    def run(batches: Iterator[pa.RecordBatch]):
        class_of, matrix = sent.value
        classes = np.append(class_of, class_of + len(matrix))
        for chunk in (rows for whole in _each_chunk(batches, half) for rows in whole.rows(ROWS_AT_ONCE)):
            behind, before = _class_counts(chunk, classes, len(matrix))
            row = np.repeat(np.arange(len(chunk.unit)), np.diff(chunk.edges))
            alike = chunk.side == chunk.unit[row]
            itself = np.bincount(row[alike], weights=chunk.n[alike], minlength=len(chunk.unit))
            at, part = np.flatnonzero(chunk.parts == 1), np.flatnonzero(chunk.parts > 1)
            best, gain = best_classes(matrix, class_of[chunk.unit[at]], behind[at], before[at], itself[at], targets)
            up = gain > 1e-6
            counts = [np.concatenate([behind[i], before[i], itself[i: i + 1]]).tobytes() for i in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(chunk.unit[at[up]], chunk.unit[part]).astype(np.int64)), pa.array(np.append(best[up], np.full(len(part), -1))),
                 pa.array(np.append(gain[up], np.zeros(len(part)))), pa.array([None] * int(up.sum()) + counts, pa.binary())],
                ["unit", "to", "gain", "counts"])
    return run


def likelihood(matrix: np.ndarray) -> float:
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def neighbours(rows: DataFrame, own: Vocabulary) -> DataFrame:
    """Chunks of all units with their neighbours; as many as there are different neighbours, so they grow with the texts."""
    context = rows.sparkSession.sparkContext
    seen = np.bincount(own.unit_of_rank, weights=own.counts, minlength=own.units)
    seen[own.tail_unit], seen[own.end_unit] = own.tail_total, own.ends
    parts = np.maximum(1, np.ceil(seen * PARTS / max(1, own.total))).astype(np.int64)
    shards = min(max(1, -(-2 * own.total // PAIRS_AT_ONCE)), (1 << 62) // (2 * own.units ** 2))  # a code of 63 bits holds shard and pair
    sent = context.broadcast((own, parts, shards))
    each = rows.mapInArrow(_sides(sent), "shard long, unit binary, many binary, side binary, n binary")
    sent = context.broadcast((own.units, own.exchange, parts))
    kind = ", ".join(f"{c} binary" for c in _columns(*HALVES, OTHERS))
    return common.written(each.groupBy("shard").applyInArrow(_chunks(sent), kind), "class-pairs")


def exchange_classes(chunks: DataFrame, own: Vocabulary, classes: int, rounds: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class-bigram matrix); the turns end with the gain, or after `rounds` if given."""
    context, n_classes = chunks.sparkSession.sparkContext, classes + own.bands + 2
    class_of = np.append(np.arange(own.exchange) % classes, np.arange(classes, n_classes))

    def added_up(sent, of, *halves: int) -> np.ndarray:
        found = chunks.select(*_columns(*halves)).mapInArrow(of, "matrix binary").collect()
        sent.destroy()
        return sum((np.frombuffer(r.matrix).reshape(n_classes, n_classes) for r in found), np.zeros((n_classes, n_classes)))

    def moves_of(half: int) -> tuple[np.ndarray, np.ndarray]:
        """(units, classes) of the moves that gain, the best first"""
        sent = context.broadcast(Sides(class_of, matrix))
        found = chunks.select(*_columns(half)).mapInArrow(_proposals(sent, half, classes), "unit long, to long, gain double, counts binary").toArrow()
        sent.destroy()
        unit, to, gain = (found.column(c).to_numpy().copy() for c in ("unit", "to", "gain"))
        counts: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(to < 0).tolist():
            counts[int(unit[i])] = counts.get(int(unit[i]), 0) + np.frombuffer(found.column("counts")[i].as_py())
        if counts:
            parted, n = np.array(list(counts)), np.array(list(counts.values()))
            best, gained = best_classes(matrix, class_of[parted], n[:, :n_classes], n[:, n_classes: -1], n[:, -1], classes)
            unit, to, gain = np.append(unit[to >= 0], parted), np.append(to[to >= 0], best), np.append(gain[to >= 0], gained)
        order = np.lexsort((unit, -gain))
        order = order[gain[order] > 1e-6]
        return unit[order], to[order]

    sent = context.broadcast((class_of, n_classes))
    matrix = added_up(sent, _matrices(sent), *HALVES, OTHERS)
    still, turn = 0, 0
    while own.exchange and still < 2 and (rounds is None or turn < rounds):
        half = turn % 2
        unit, to = moves_of(half)
        turn += 1
        still += 1
        while len(unit):
            tried = class_of.copy()
            tried[unit] = to
            sent = context.broadcast((class_of, tried, n_classes))
            after = matrix + added_up(sent, _changes(sent, half), half)
            gained = likelihood(after) - likelihood(matrix)
            if gained > 0:
                class_of, matrix = tried, after
                still = 0 if gained > GAIN * own.total else still
                break
            unit, to = unit[: len(unit) // 2], to[: len(unit) // 2]
    return class_of, matrix


class Model(NamedTuple):
    vocabulary: Vocabulary
    class_of: np.ndarray
    matrix: np.ndarray

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of transitions from class to class, of dictionary words in their class by rank)"""
        own, m = self.vocabulary, self.matrix
        of_class = m.sum(0)
        share = (of_class + 1) / (of_class.sum() + len(m))
        step = (m + PRIOR * share[None, :]) / (m.sum(1)[:, None] + PRIOR)
        classes = self.class_of[own.unit_of_rank]
        total = np.bincount(classes, weights=own.counts, minlength=len(m)) if len(classes) else np.zeros(len(m))
        return np.log10(step), np.log10(own.counts / total[classes]) if len(classes) else np.zeros(0)


def train(docs: DataFrame, text: str = "text", dictionary: int = DICTIONARY, exchange: int | None = None, classes: int = CLASSES,
          rounds: int | None = None) -> tuple[Model, DataFrame]:
    """The model of all texts, and the counts (word hash, n) of the words outside its dictionary.

    With `exchange`, only so many words are exchanged and the others have classes by the band of their rank.
    """
    rows = docs.select(F.col(text).alias("text"))
    counts = common.written(rows.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    own, tail = vocabulary(counts, dictionary, dictionary if exchange is None else exchange)
    return Model(own, *exchange_classes(neighbours(rows, own), own, classes, rounds)), tail


def _in_parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch of so many bytes, about TEXT_AT_ONCE at a time."""
    step = max(1, batch.num_rows * TEXT_AT_ONCE // max(1, size))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


SCORED = "_row {}, n_tokens long, in_dictionary long, base double, own double, words array<long>, times array<long>"


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]):
        model = sent.value
        own = model.vocabulary
        step, emit = model.logs()
        emit, counted = np.append(emit, 0.0), np.append(np.log10(own.counts + 1), 0.0)
        end_counted = float(np.log10(own.ends + 1))
        end_unit = np.uint64(END)
        for batch in (part for whole in batches for part in _in_parts(whole, whole.column("_text").nbytes)):
            words, offsets = _hashes(batch.column("_text").to_pylist())
            units, rank = own.units_of(words)
            classes = model.class_of[units]
            own_log = step[np.append(model.class_of[own.end_unit], classes[:-1]), classes] + emit[rank]
            is_end = words == end_unit
            base = np.where(is_end, end_counted, counted[rank])
            known = (rank >= 0) | (is_end & (own.ends > 0))
            tail = (rank < 0) & ~is_end
            lo = offsets[:-1]
            out_words, out_times = [], []
            for p, q in zip(lo.tolist(), offsets[1:].tolist()):
                w, n = np.unique(words[p:q][tail[p:q]].view(np.int64), return_counts=True)
                out_words.append(w)
                out_times.append(n)
            columns = [batch.column("_row"), pa.array(np.diff(offsets)), pa.array(np.add.reduceat(known.astype(np.int64), lo)),
                       pa.array(np.add.reduceat(base, lo)), pa.array(np.add.reduceat(own_log, lo)),
                       pa.array(out_words, pa.list_(pa.int64())), pa.array(out_times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "n_tokens", "in_dictionary", "base", "own", "words", "times"])
    return run


def score(docs: DataFrame, model: Model, tail: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Scores are log10 probabilities of the words and one end. Null and empty texts are one end. Columns
    called like the new ones are replaced. Without training tokens every token is unseen. Repeated rows are
    scored alike. No rows in, no rows out.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    docs, own = docs.drop(*new), model.vocabulary
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("_row"), F.col(text).alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    scored = common.written(rows.mapInArrow(_score(sent), SCORED.format(kind)).withColumn("_at", F.monotonically_increasing_id()), "lm-scores")
    open_words = scored.where(F.size("words") > 0).select("_at", F.explode(F.arrays_zip("words", "times")).alias("w"))
    joined = (open_words.select("_at", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
              .join(tail, "word", "left").select("_at", "times", F.coalesce("n", F.lit(0)).alias("n")))
    unseen = float(np.log10(own.tail_total + own.tail_distinct + 1))
    summed = joined.groupBy("_at").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"), F.sum("times").alias("tail"),
                                       F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_log"))
    zero = F.lit(0)
    log = F.coalesce("tail_log", F.lit(0.0))
    total = (F.col("own") + log - F.coalesce("tail", zero) * F.lit(unseen)).alias("score")
    out = scored.join(summed, "_at", "left").select(
        "_row.*", "n_tokens", (F.col("in_dictionary") + F.coalesce("tail_known", zero)).alias("n_known"),
        F.lit(own.total).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(float(np.log10(own.total + own.distinct + 1)))).alias("base_score"), total)
    return out.drop("_").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text is 2 modulo 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2
