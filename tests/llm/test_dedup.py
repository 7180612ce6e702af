"""Exact and near-duplicate operators against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rolescope.llm import common, segments, simhash, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(alphabet: list[str], joint: str, seed: int, sizes=(500, 300, 40, 260, 900)) -> list:
    rnd = random.Random(seed)
    base = [[rnd.choice(alphabet) for _ in range(n)] for n in sizes]
    texts = [None, "", *(joint.join(b) for b in base)]
    for _ in range(60):
        x = rnd.choice(base)
        i = rnd.randrange(len(x))
        y = x[i:i + rnd.randrange(20, 700)]
        for _ in range(rnd.choice((0, 0, 1, 2))):
            y[rnd.randrange(len(y))] = "Z"
        noise = [[rnd.choice("xyzwuv") for _ in range(rnd.randrange(80))] for _ in range(2)]
        texts.append(joint.join([*noise[0], *y, *noise[1]]))
    return [*texts, joint.join(["a"] * 700), joint.join(["a", "b"] * 300), joint.join([*base[0], "q", *base[0]])]


def bytes_kept(texts: list, width: int) -> list[bytes]:
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        out.append(bytes(x for x, g in zip(r, gone) if not g))
    return out


def words_kept(rows: list[tuple], width: int) -> list[str]:
    split = [WORD.findall(t or "") for _, t in rows]
    least: dict = {}
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - width + 1):
            key, own = tuple(w[i:i + width]), common.NO_ID if d is None else d
            least[key] = min(own, least.get(key, own))
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i:i + width])] < (common.NO_ID if d is None else d):
                gone.update(range(i, i + width))
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("limit", [20_000, 3])
def test_suffix_dedup_like_brute_force(spark, limit):
    texts = corpus(list("ab cdé"), "", 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs, 200, group_limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == bytes_kept(texts, 200)


def test_suffix_dedup_edges(spark):
    long = "x" * 150 + "é" * 60
    rows = [(None, long, "a", 1), (1, long, None, 2), (1, long, None, 2), (2, None, "b", 3), (3, "short", "b", 4), (4, "", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, a int")
    out = suffix_dedup.remove_repeats(docs, 200).collect()
    assert len(out) == 6 and set(out[0].asDict()) == {"doc_id", "text", "a", "removed_spans", "kept"}
    assert sorted((r.a, bytes(r.kept), [tuple(s) for s in r.removed_spans]) for r in out) == [
        (1, b"", [(0, 270)]), (2, b"", [(0, 270)]), (2, b"", [(0, 270)]), (3, b"", []), (4, b"short", []), (5, b"", [])]
    assert suffix_dedup.remove_repeats(docs.limit(0), 200).count() == 0


def test_suffix_dedup_as_text_cuts_whole_characters(spark):
    a, b = "é" * 99 + "\u00e8" + "1", "é" * 99 + "\u00e9" + "2"  # the first byte of the last letters is equal
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(docs, 199, as_text=True).collect()}
    assert got == {1: "1", 2: "2"}


def test_loser_tree_orders_and_knows_prefixes():
    rnd = random.Random(3)
    runs = []
    for _ in range(5):
        texts = sorted({bytes(rnd.choices(b"ab", k=rnd.randrange(1, 30))) for _ in range(rnd.randrange(0, 40))})
        none = np.zeros(max(1, len(texts)), np.int64)
        entries = [(t, b"", [0, i]) for i, t in enumerate(texts)]
        payload = suffix_dedup.zstandard.ZstdCompressor().compress(suffix_dedup.front_code(entries, none, none))
        runs.append(suffix_dedup.Decoded(payload))
        assert runs[-1].suffixes == texts
    last, out = b"", []
    for shared, r, i in suffix_dedup.loser_tree(runs):
        own = runs[r].suffixes[i]
        assert shared == suffix_dedup.common_prefix(last, own, 0)
        out.append(last := own)
    assert out == sorted(x for r in runs for x in r.suffixes)


def test_equal_windows_have_equal_keys():
    rnd = np.random.default_rng(7)
    text = rnd.integers(0, 3, 3000).astype(np.uint8)
    text[2000:2400] = text[300:700]
    shape = segments.Shape(50, 4)
    found = segments.segments(text, np.array([0, 3000]), shape, lambda x: segments.BYTE_HASH[x])
    key = {}
    for first, last, start, k in zip(found.first, found.last, found.start, found.key):
        for p in range(first, last + 1):
            key[p] = (int(k), int(start) - p)
    assert len(key) == 2951 and all(key[300 + i] == key[2000 + i] for i in range(351))


def test_sequences_beyond_a_chunk_lose_no_window(monkeypatch):
    text = np.arange(5000) % 251
    monkeypatch.setattr(segments, "CHUNK", 600)
    shape = segments.Shape(50, 4)
    found = segments.segments(text.astype(np.uint8), np.array([0, 4400, 4420, 5000]), shape, lambda x: segments.BYTE_HASH[x])
    seen = Counter((int(r), p) for r, a, b in zip(found.row, found.first, found.last) for p in range(a, b + 1))
    assert seen == Counter([(0, p) for p in range(4351)] + [(2, p) for p in range(531)])


@pytest.mark.parametrize("limit", [500, 2])
def test_substring_dedup_like_brute_force(spark, limit):
    texts = corpus(["aa", "b", "c", "dé", "e,"], " ", 11, (300, 200, 30, 160, 400))
    rows = [(i * 3 % 71, t) for i, t in enumerate(texts)] + [(None, texts[2]), (None, texts[2])]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, at int").repartition(4)
    got = {r.at: r.kept for r in substring_dedup.remove_repeats(docs, 50, group_limit=limit).collect()}
    assert [got[i] for i in range(len(rows))] == words_kept(rows, 50)


def test_substring_dedup_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "  \n", 2), (3, "a " * 49, 3)], "doc_id long, text string, n_words int")
    out = {r.doc_id: (r.n_words, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert out == {1: (0, ""), 2: (0, ""), 3: (49, " ".join(["a"] * 49))}
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def fingerprint(text) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps: list[int], distance: int) -> list[int]:
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= distance:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_simhash_like_brute_force(spark):
    rnd = random.Random(2)
    base = [rnd.choice(["ab", "Cd", "é", "f,"]) + str(rnd.randrange(9)) for _ in range(400)]
    texts = [None, "", " \n", "one", "two words", "One"]
    for i in range(40):
        own = list(base) if i % 2 else [x + str(i % 8) for x in base]
        for _ in range(i // 8):
            own[rnd.randrange(len(own))] = "edit"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [fingerprint(t) for t in texts]
    assert got == {i: (f, c) for i, (f, c) in enumerate(zip(fps, grouped(fps, 3)))}


@pytest.mark.parametrize("limit", [20_000, 3])
def test_simhash_links_connect_all_near_fingerprints(spark, limit):
    rnd = random.Random(4)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            x ^= sum(1 << rnd.randrange(64) for _ in range(rnd.choice((1, 2, 3, 3, 9))))
            x &= (1 << 64) - 1
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, limit)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    want = grouped([x % (1 << 64) for x in signed], 3)
    assert [root.get(x, x) for x in signed] == [signed[i] for i in want]


def test_simhash_edges(spark):
    rows = [(None, "a b c d", 1), (7, "a b c d", 2), (7, "a b c d", 2), (3, None, 3), (None, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 3, 3), (False, 7, 7), (False, 7, 7), (True, 0, 3), (True, 0, 7)]
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id, r.text, r.fp) for r in kept) == [(3, None, 3), (7, "a b c d", 2)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    none = simhash.near_duplicates(docs.where(F.col("doc_id").isNull())).select("component_id").distinct().collect()
    assert [r.component_id for r in none] == [None]
