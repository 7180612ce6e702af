"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased (A-Z) and lose the punctuation around them. The 4-grams of all test items set the bits
of a bounded filter; each task keeps the grams of its documents that hit it and the words around them, so no
text without a hit is moved. A hit whose neighbours hit too is a run of five words or more and always a
seed. A lone hit is a seed if its gram is rare: documents in which it stands alone number at most
`common_share` of all. Copies of an item cannot make its grams common, as their hits come in runs. Seeds
join documents to items; a pair with at least `least_seeds` different ones near one diagonal is aligned, item
against that stretch of the document, and the score is the alignment's share of a full match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescope.llm import common
from rolescope.llm.segments import BASE, mix

GRAM = 4
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
COMMON_SHARE = 0.001
COMMON_LEAST = 16  # documents that do not make a gram common in a small corpus
LEAST_SEEDS = 2
PUNCTUATION = b".,;:!?\"'()[]{}<>`~*_-"


def words_of(text: str | None) -> list[bytes]:
    return [w for x in (text or "").encode().lower().split() if (w := x.strip(PUNCTUATION))]


def grams_of(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM words from each position on."""
    n = max(0, len(hashes) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out * np.uint64(BASE) + hashes[i: i + n]
    return mix(out)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _item_grams(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for key, text in zip(batch.column("item").to_pylist(), batch.column("item_text").to_pylist()):
            words = words_of(text)
            grams = grams_of(_word_hashes(words)).view(np.int64)
            n = len(grams)
            yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(grams), pa.array(np.arange(n)),
                                              pa.array([n] * n, pa.int64()), pa.array([len(words)] * n, pa.int64())],
                                             ["item", "key", "pos", "n_grams", "n_words"])


HITS = "doc_id long, a long, b long, first long, words binary, hits array<struct<key:bigint,at:bigint,lone:boolean>>"


def _hits(filter_bytes, reach: int):
    """Documents with hits: the words from `reach` before the first to `reach` behind the last."""
    kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int64()), ("lone", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            split = [words_of(t) for t in batch.column("text").to_pylist()]
            offsets = np.append(0, np.cumsum([len(w) for w in split]))
            grams = grams_of(_word_hashes([w for words in split for w in words]))
            hit = np.flatnonzero(common.in_filter(filter_bytes.value, grams))
            row = np.searchsorted(offsets, hit, "right") - 1
            inside = hit + GRAM <= offsets[row + 1]
            hit, row = hit[inside], row[inside]
            near = np.diff(hit, prepend=-2, append=1 << 62)
            lone = (near[:-1] > 1) & (near[1:] > 1)
            edges = np.flatnonzero(np.diff(row, prepend=-1, append=-1)) if len(row) else []
            rows, firsts, words, hits = [], [], [], []
            for p, q in zip(edges[:-1], edges[1:]):
                i = int(row[p])
                at = hit[p:q] - offsets[i]
                lo = max(0, int(at[0]) - reach)
                rows.append(i)
                firsts.append(lo)
                words.append(b" ".join(split[i][lo: int(at[-1]) + GRAM + reach]))
                hits.append([{"key": k, "at": x, "lone": y} for k, x, y in
                             zip(grams[hit[p:q]].view(np.int64).tolist(), (at - lo).tolist(), lone[p:q].tolist())])
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(taken), batch.column("a").take(taken), batch.column("b").take(taken),
                 pa.array(firsts, pa.int64()), pa.array(words, pa.binary()), pa.array(hits, kind)], ["doc_id", "a", "b", "first", "words", "hits"])
    return run


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """(best local score, last item word, last document word); gaps cost what mismatches cost."""
    j = np.arange(len(doc) + 1)
    above, best, where = np.zeros(len(doc) + 1, np.int64), 0, (0, 0)
    for i, word in enumerate(item):
        now = np.maximum(above + GAP, 0)
        np.maximum(now[1:], above[:-1] + np.where(doc == word, MATCH, MISMATCH), out=now[1:])
        above = np.maximum.accumulate(now - GAP * j) + GAP * j
        at = int(np.argmax(above))
        if above[at] > best:
            best, where = int(above[at]), (i, at - 1)
    return best, *where


def best_alignment(item: list[bytes], doc: list[bytes], seeds: np.ndarray, least: int) -> tuple[float, int, int, int] | None:
    """(score, first and last + 1 word of the document, seeds) of the best stretch with enough seeds (rows of at, pos)."""
    m = len(item)
    diagonal = seeds[:, 0] - seeds[:, 1]
    seeds, diagonal = seeds[order := np.argsort(diagonal, kind="stable")], diagonal[order]
    edges = np.append(np.flatnonzero(np.diff(diagonal, prepend=diagonal[0] - m - 99) > m // 2 + 5), len(diagonal))
    ids: dict[bytes, int] = {}
    own = np.array([ids.setdefault(w, len(ids)) for w in item])
    found, pad = None, m // 4 + 5
    for p, q in zip(edges[:-1], edges[1:]):
        n = len(np.unique(seeds[p:q, 1]))
        if n < least:
            continue
        lo, hi = max(0, int(diagonal[p]) - pad), int(diagonal[q - 1]) + m + pad
        there = np.array([ids.get(w, -1) for w in doc[lo:hi]])
        score, last_item, last = align(own, there)
        if score and (found is None or score / (MATCH * m) > found[0]):
            _, _, back = align(own[last_item::-1], there[last::-1])
            found = (score / (MATCH * m), lo + last - back, lo + last + 1, n)
    return found


def _align(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows, out = [], []
        for i, (item, doc, seeds, least) in enumerate(zip(batch.column("item_text").to_pylist(), batch.column("words").to_pylist(),
                                                          batch.column("seeds").to_pylist(), batch.column("least").to_pylist())):
            best = best_alignment(words_of(item), doc.split(b" "), np.array([[s["at"], s["pos"]] for s in seeds]), least)
            if best is not None:
                rows.append(i)
                out.append(best)
        taken = pa.array(rows, pa.int64())
        first = batch.column("first").take(taken).to_numpy()
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(taken) for c in ("doc_id", "a", "b", "item_id")), pa.array([o[0] for o in out], pa.float64()),
             pa.array([o[1] for o in out], pa.int64()) if not rows else pa.array(first + [o[1] for o in out]),
             pa.array([o[2] for o in out], pa.int64()) if not rows else pa.array(first + [o[2] for o in out]),
             pa.array([o[3] for o in out], pa.int64())],
            ["doc_id", "a", "b", "item_id", "score", "first_word", "end_word", "n_seeds"])


PAIRS = "doc_id long, a long, b long, item_id long, score double, first_word long, end_word long, n_seeds long"


def aligned_pairs(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", common_share: float = COMMON_SHARE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """(doc_id, a, b, item_id, score, first_word, end_word, n_seeds) of all aligned pairs, whatever their score.

    Words count from 0 among the document's words that are not bare punctuation. Items of fewer than 4 words
    have no seed and match nothing; items with fewer grams than least_seeds need all of them. Null texts have
    no words. Null ids are ids like any other; rows that share id and text give equal pairs each. Empty
    tables give no rows.
    """
    spark = docs.sparkSession
    tests = common.written(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text"))
                           .withColumn("item", F.monotonically_increasing_id()), "items")
    grams = common.written(tests.select("item", "item_text").mapInArrow(
        _item_grams, "item long, key long, pos long, n_grams long, n_words long"), "item-grams")
    n_grams, reach = grams.agg(F.count("key"), F.max("n_words")).first()
    if not n_grams:
        return spark.createDataFrame([], PAIRS)
    sent = spark.sparkContext.broadcast(common.bit_filter(grams, common.filter_bits(n_grams, 8192)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.id_order(doc_id).alias("a"), common.text_key(text).alias("b"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = common.written(rows.mapInArrow(_hits(sent, 2 * reach), HITS).withColumn("at_row", F.monotonically_increasing_id()), "item-hits")
    hits = found.select("at_row", F.explode("hits").alias("h")).select("at_row", "h.key", "h.at", "h.lone")
    most = F.lit(max(COMMON_LEAST, int(docs.count() * common_share)))
    alone = hits.where("lone").groupBy("key").agg(F.count("at").alias("alone"))
    seeds = (grams.join(alone, "key", "left").select("key", "item", "pos", (F.coalesce("alone", F.lit(0)) <= most).alias("rare"),
                                                     F.least(F.lit(least_seeds), F.col("n_grams")).alias("least")))
    joined = hits.join(seeds, "key").where("rare OR NOT lone")
    pairs = (joined.groupBy("at_row", "item").agg(F.collect_list(F.struct("at", "pos")).alias("seeds"), F.first("least").alias("least"))
             .where(F.size(F.array_distinct(F.transform("seeds", lambda s: s["pos"]))) >= F.col("least")))
    whole = pairs.join(found.drop("hits"), "at_row").join(tests, "item")
    return whole.select("doc_id", "a", "b", "first", "words", "item_id", "item_text", "seeds", "least").mapInArrow(_align, PAIRS)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, **names) -> DataFrame:
    """The aligned pairs whose score is at least the threshold (`aligned_pairs` has columns and edge cases)."""
    return aligned_pairs(docs, items, **names).where(F.col("score") >= threshold)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents that are in no pair."""
    gone = contaminated(docs, items, threshold, doc_id=doc_id, text=text).select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct()
    rows = docs.select(common.row(docs).alias("_row"), common.id_order(doc_id).alias("_a"), common.text_key(text).alias("_b"))
    return rows.join(gone, ["_a", "_b"], "left_anti").select("_row.*")
