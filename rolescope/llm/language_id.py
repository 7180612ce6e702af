"""Language identification with language-bitmask filters of character n-grams.

A gram is four characters of the lower-cased text, every non-letter made a space, whose middle two are
letters. Training counts grams by language with a shuffle; a language contains a gram that it uses at
least `CONTAINS` times as often as the language that uses it most. The filter is a bit-sliced Bloom filter:
a slot holds one bit per language, so that the AND of a gram's slots names all languages containing it. For
each language the hits of a text are counted and corrected for the false positives that the language's
filled slots explain; the highest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.llm import common
from rolescope.llm.segments import BASE, mix

GRAM = 4
HASHES = 3
CONTAINS = 0.1
LEAST = 3  # occurrences
SLOT_BITS_MAX = 22
CHARS_AT_ONCE = 1 << 19
COUNTS_AT_ONCE = 1 << 21
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]  # by name
    fallback: str  # the language with most grams; of texts that have letters but no gram that decides
    slots: np.ndarray  # (slots, mask words) uint64
    false_rate: np.ndarray  # per language


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower case as a code point or space if no letter) of every code point."""
    letter = np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.full(0x110000, 32, np.uint32)
    at = np.flatnonzero(letter)
    lower[at] = [ord(low) if len(low := chr(i).lower()) == 1 else i for i in at.tolist()]
    return letter, lower


def _pieces(texts: list[str | None]):
    """Chunks of (gram hash or 0 where none starts, row, first, last + 1 gram, has letter) lists."""
    letter, lower = _characters()
    chunk, rows, size = [], [], 0

    def given():
        code = np.frombuffer("".join(chunk).encode("utf-32-le"), "<u4")
        own = lower[code].astype(np.uint64)
        inner = letter[code]
        n = max(0, len(code) - GRAM + 1)
        h = np.zeros(n, np.uint64)
        for i in range(GRAM):
            h = h * np.uint64(BASE) + own[i: i + n]
        whole = inner[1: n + 1] & inner[2: n + 2]
        return mix(h), whole, np.append(0, np.cumsum(inner)), rows

    for row, text in enumerate(texts):
        padded = f" {text or ''} "
        for lo in range(0, max(1, len(padded) - GRAM + 1), CHARS_AT_ONCE):
            piece = padded[lo: lo + CHARS_AT_ONCE + GRAM - 1]
            rows.append((row, size, size + max(0, len(piece) - GRAM + 1), size + len(piece)))
            chunk.append(piece)
            size += len(piece)
        if size >= CHARS_AT_ONCE:
            yield given()
            chunk, rows, size = [], [], 0
    if chunk:
        yield given()


def _count(batches: Iterator[pa.RecordBatch]):
    held: dict[str, list] = {}
    size = 0

    def merged():
        out = {}
        for lang, parts in held.items():
            grams, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            out[lang] = [(grams, np.bincount(which, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))]
        return out

    def rows(lang, part):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0])), pa.array(part[0].view(np.int64)), pa.array(part[1])],
                                          ["lang", "gram", "n"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for h, whole, _, pieces in _pieces(batch.column("text").to_pylist()):
            own: dict[str, list] = {}
            for row, lo, hi, _ in pieces:
                own.setdefault(langs[row], []).append(h[lo:hi][whole[lo:hi]])
            for lang, parts in own.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                held.setdefault(lang, []).append((grams, n))
                size += len(grams)
        if size > COUNTS_AT_ONCE:
            held = merged()
            size = sum(len(p[0][0]) for p in held.values())
            if size > COUNTS_AT_ONCE // 2:
                for lang, parts in held.items():
                    yield rows(lang, parts[0])
                held, size = {}, 0
    for lang, parts in merged().items():
        yield rows(lang, parts[0])


def _slot_columns(bits: int) -> list[Column]:
    """The slots of a gram: disjoint stretches of its hash, hashed once more."""
    return [F.xxhash64(F.col("gram"), F.lit(i)).bitwiseAND((1 << bits) - 1) for i in range(HASHES)]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """From all rows with a text and a language."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = common.written(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
                            "language-grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], UNKNOWN, np.zeros((1, 1), np.uint64), np.zeros(0))
    words = -(-len(languages) // 64)
    known = docs.sparkSession.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(languages)], "lang string, at int, total double")
    shares = counts.join(F.broadcast(known), "lang").where(f"n >= {LEAST}").withColumn("share", F.col("n") / F.col("total"))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    contained = common.written(shares.join(most, "gram").where(F.col("share") >= CONTAINS * F.col("most")).select("gram", "at"), "language-sets")
    n_grams = contained.select("gram").distinct().count()
    bits = min(SLOT_BITS_MAX, max(10, (16 * n_grams).bit_length()))
    masks = (contained.select(F.explode(F.array(*_slot_columns(bits))).alias("slot"), F.expr("at div 64").alias("word"),
                              F.expr("shiftleft(1L, at % 64)").alias("mask"))
             .groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow())
    slots = np.zeros((1 << bits, words), np.uint64)
    slots[masks.column("slot").to_numpy(), masks.column("word").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    filled = np.array([np.mean(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))])
    return Model(languages, max(languages, key=lambda x: (totals[x], x)), slots, np.minimum(filled ** HASHES, 0.99))


def _masks(model: Model, h: np.ndarray) -> np.ndarray:
    out = None
    for i in range(HASHES):
        own = model.slots[spark_xxhash(h, i) & np.int64(len(model.slots) - 1)]
        out = own if out is None else out & own
    return out


P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * P2
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> np.uint64(32))


def spark_xxhash(longs: np.ndarray, number: int) -> np.ndarray:
    """xxhash64(long, int) as SQL has it, for arrays: XXH64 of 8 bytes with seed 42, which seeds XXH64 of 4 bytes."""
    with np.errstate(over="ignore"):
        x = np.uint64(42) + P5 + np.uint64(8)
        x = x ^ (_rotated(longs.view(np.uint64) * P2, 31) * P1)
        seed = _finished(_rotated(x, 27) * P1 + P4)
        x = (seed + P5 + np.uint64(4)) ^ (np.uint64(number) * P1)
        return _finished(_rotated(x, 23) * P2 + P3).view(np.int64)


def predict_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text; the score is the corrected share of its grams that the language contains."""
    n_lang = len(model.languages)
    hits, grams, letters = np.zeros((len(texts), n_lang)), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for h, whole, n_letters, pieces in _pieces(texts):
        row, lo, hi, end = np.array(pieces).T
        at = np.append(0, np.cumsum(whole))
        np.add.at(grams, row, at[hi] - at[lo])
        letters[row[n_letters[end] > n_letters[lo]]] = True
        if n_lang:
            mask = _masks(model, h[whole])
            for i in range(n_lang):
                summed = np.append(0, np.cumsum((mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)))
                np.add.at(hits[:, i], row, summed[at[hi]].astype(np.int64) - summed[at[lo]].astype(np.int64))
    out = []
    for i in range(len(texts)):
        if not letters[i] or not n_lang:
            out.append((UNKNOWN, 0.0))
        elif not grams[i]:
            out.append((model.fallback, 0.0))
        else:
            corrected = (hits[i] - grams[i] * model.false_rate) / (1 - model.false_rate)
            best = int(np.argmax(corrected))
            score = float(np.clip(corrected[best] / grams[i], 0, 1))
            out.append((model.languages[best] if score > 0 else model.fallback, score))
    return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, with lang_pred and score (0 to 1); columns of these names are replaced.

    Null texts and texts without a letter get `und` and 0; so does every text if nothing was learned. Texts
    with letters but too few for a gram, or whose grams no language contains, get the model's fallback and 0.
    Among equal counts the first language by name is taken. Repeated rows are judged alike.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = predict_texts(sent.value, batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["_row", "lang_pred", "score"])

    rows = docs.select(common.row(docs).alias("_row"), F.col(text).alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row {kind}, lang_pred string, score double").select("_row.*", "lang_pred", "score")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def train_on_folds(docs: DataFrame, spark: SparkSession, doc_id: str = "doc_id") -> Model:
    return train(docs.where(fold(doc_id, 3) != 1))
