"""Collocations, token counts and the conversation trie against brute force, the library and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rolescope.llm import collocations, conversation_trie, queries, token_counts

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


# ---- collocations

def brute_phrases(rows, least, overlap):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, own in f.items():
        n = sum(a for g, a in own.items() if len(g) == 1)
        longer = defaultdict(int)
        for g, a in own.items():
            if len(g) == 3 and a >= least:
                for part in (g[:2], g[1:]):
                    longer[part] = max(longer[part], a)
        for g, a in own.items():
            if len(g) > 1 and a >= least and (longer[g] == 0 or 100 * longer[g] < overlap * a):
                score, _, left, right = min((1000000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
                out.add((lang, " ".join(g), a, left, right, n, score))
    return out


def mined(docs, **options):
    return {tuple(r) for r in collocations.mine(docs, **options).collect()}


ODD_TEXTS = [(None, "en"), ("", None), ("A b, a B. a\tb a b\x0bc c c c", None), ("a b", "und"), ("é É é É", "fr"), ("a\x1cb a\x1cb", "en"),
             (" . ;x y z x y z;", "en"), ("日本 語 日本 語", "zh"), ("w" * 5000 + " t " + "w" * 5000 + " t", "en")]


def test_phrases_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(" ".join(rnd.choice("the of a an x y Zz é ß q. r, s t! u\n v".split(" ")) for _ in range(rnd.randint(0, 90))), rnd.choice(["en", "de", None]))
            for _ in range(120)] + ODD_TEXTS * 3
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, key long, n string").repartition(5)
    want = brute_phrases(rows, 3, 50)
    assert len(want) > 100 and mined(docs, least=3) == want
    # the bounds on what travels, and on what a task holds, change nothing
    assert mined(docs, least=3, dictionary=7) == want
    assert mined(docs, least=3, dictionary=0) == want


def test_phrases_do_not_depend_on_how_texts_are_cut(monkeypatch):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab é.\n\t") for _ in range(rnd.randint(0, 400))) for _ in range(40)] + ["", "x" * 300]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    langs = [rnd.choice(["en", "fr"]) for _ in texts]
    whole = collocations.Reader(1).read(data, offsets, langs)
    monkeypatch.setattr(collocations, "BYTES_AT_ONCE", 17)
    cut = collocations.Reader(1).read(data, offsets, langs)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))
    words = [(lang, w) for t, lang in zip(texts, langs) for w in re.findall(rb"[^\x20\x09.,;:!?\x0A-\x0D]+", t.encode())]
    keys = defaultdict(set)
    for key, word in zip(whole[0].tolist(), words):
        keys[word].add(key)
    assert len(words) == len(whole[0]) and all(len(k) == 1 for k in keys.values()) and len(set.union(*keys.values())) == len(keys)


def test_tiles_dense_and_sparse_add_up_alike(monkeypatch):
    rnd = np.random.default_rng(2)
    keys, counts = np.arange(1, 401, dtype=np.uint64), np.sort(rnd.integers(10, 5000, 400))[::-1]
    lists = [np.unique(rnd.integers(0, 900, 300), return_counts=True) for _ in range(9)]
    packed = [(collocations.packed(c), collocations.packed(np.cumsum(n))) for c, n in lists]
    assert all(np.array_equal(collocations.unpacked(p), c) for (p, _), (c, _) in zip(packed, lists))
    big = np.array([5, 1 << 35, (1 << 39) + 1])
    assert np.array_equal(collocations.unpacked(collocations.packed(big)), big) and len(collocations.unpacked(collocations.packed(big[:0]))) == 0
    found = []
    for bound in (1 << 22, 0):
        monkeypatch.setattr(collocations, "DENSE_CELLS", bound)
        items = collocations.Items(keys, counts, None, int(counts.sum()))
        assert items.bands >= 8 and items.edges[0] == 0 and items.edges[-1] == 400
        tile = collocations.Tile(items.bands * items.bands - 1, items)
        assert (tile.dense is None) == (bound == 0)
        for cells, n in lists:
            tile.add(cells, n)
        found.append(sorted(map(tuple, tile.frequent(4, collocations.Reader(1)).to_pandas().values.tolist())))
    assert found[0] == found[1] and len(found[0]) > 50


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 999_999_999_999_937, 999_999_999_999_989, 999_999_999_999_947
    df = spark.createDataFrame([(a, left, right), (10, 10, 10), (10, 10**15 - 1, 10)], "a long, l long, r long")
    got = [r.cut.score for r in df.select(collocations._cut("a", "l", "r").alias("cut")).collect()]
    assert got == [1000000 * a * a // (left * right), 1000000, 0]


def test_best_phrases_and_no_phrases(spark):
    rows = [("en", p, a, 1, 1, 9, s) for p, a, s in [("b b", 10, 5), ("a b", 10, 5), ("é b", 10, 5), ("z z", 11, 5), ("y y", 10, 6)]] + [("fr", "q q", 10, 1, 1, 9, 1)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = [(r.lang, r.rank, r.phrase) for r in collocations.best(phrases, 4).orderBy("lang", "rank").collect()]
    assert got == [("en", 1, "y y"), ("en", 2, "z z"), ("en", 3, "a b"), ("en", 4, "b b"), ("fr", 1, "q q")]
    nothing = spark.createDataFrame([(None, None), ("", "en"), (" ,.", None)], "text string, lang string")
    assert collocations.best(collocations.mine(nothing), 5).count() == 0
    assert collocations.mine(nothing.limit(0)).count() == 0


# ---- token counts

@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library(spark, name, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN_MOST", 500)
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), token_counts.Counter(path)
    alphabet = ["a", "B", "é", "É", "é", "İ", "Σ", "ς", "ß", "1", "٣", "½", " ", "\n", "\x0b", "\x1c", "\x85", " ", " ", "'s", "'S", "'re",
                "’", "中", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "́", "​", "Ⅷ", "ª", "ǅ", "한", "가", "..", "--", "_", "\x00", "'"]
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(5000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in texts:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), ascii(text)


def test_token_counts_of_long_texts_and_words(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_counts.Counter(path)
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcde é.'\n ") for _ in range(30000)) + "x" * 4000 + "<|endoftext|>" + "ab" * 3000
    monkeypatch.setattr(token_counts, "BYTES_AT_ONCE", 700)
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_edges(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "Hello world", None), (3, "é " * 2048, "c"), (4, "é " * 2049, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect()))
    assert got == [(0, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (2, 11, 2, False), (3, 6144, 2048, False), (4, 6147, 2049, True)]
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        token_counts.Merger({"type": "WordPiece"})


def test_merging_is_lowest_rank_first():
    model = {"type": "BPE", "vocab": {s: i for i, s in enumerate(["a", "b", "c", "bc", "ab", "abc"])}, "merges": [["b", "c"], ["a", "b"], ["a", "bc"]]}
    merger = token_counts.Merger(model)
    assert [merger.count(w) for w in ["abc", "ab", "abab", "abcabc", "a", "az"]] == [1, 1, 2, 2, 1, 1]


# ---- conversation trie

COLUMNS = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, key, len(text)))
    own = {c: [(k, n) for _, _, k, n in sorted(turns)] for c, turns in own.items()}
    members, sizes, ends = defaultdict(list), {}, defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            node = tuple(k for k, _ in path[:d])
            members[node].append(c)
            sizes[node] = path[d - 1][1] if d else 0
        ends[node].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own_members) - 1) * sizes[node]
    return sorted([(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items()], key=str)


def trie(turns, shards):
    return sorted(map(tuple, conversation_trie.prefix_trie(conversation_trie.rebuilt(turns), shards).select(*COLUMNS.split(", ")).collect()), key=str)


def test_trie_equals_brute_force_whatever_the_shards(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for c in [*range(-130, 330), None]:
        for t in range(rnd.choice([0, 1, 2, 3, 6, 9, 40 if c and c % 17 == 0 else 4])):
            rows.append((c, rnd.choice([t, t, t, None, 1]), rnd.choice(["u", "a", None]), rnd.choice(["x", "é😀", "", None]), c))
    rows += [(c, t, "u", "copied", 0) for c in range(1000, 1300) for t in range(7)]  # most conversations share their turns
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key long").repartition(6)
    want = brute_trie([r[:4] for r in rows])
    monkeypatch.setattr(conversation_trie, "IDS_PER_CHUNK", 3)
    for shards in (1, 4, 61):
        assert trie(turns, shards) == want


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie(spark.createDataFrame([], schema), None) == []
    assert trie(spark.createDataFrame([(None, 1, "u", "x")], schema), None) == []
    # 1 has one turn and takes its first turns from conversation 0, which is absent: a member of the root alone
    one = trie(spark.createDataFrame([(1, 0, None, None)], schema), None)
    assert len(one) == (1 if zlib.crc32(b"1") % 6 else 2) and one[0][3] == 1 and one[0][2] is None
    rows = [(0, t, "u", f"turn {t}") for t in range(3000)]
    deep = trie(spark.createDataFrame(rows, schema), 2)
    assert len(deep) == 3001 and all(r[3:6] == (1, 1, 1) for r in deep if r[1] < 3000)


def test_findclose_walks_blocks(monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 4)
    rnd = random.Random(6)
    for n in [1, 2, 5, 40, 300]:
        bits, depth, left = [], 0, n
        while left or depth:
            if left and (not depth or rnd.random() < 0.6):
                bits.append(True)
                depth, left = depth + 1, left - 1
            else:
                bits.append(False)
                depth -= 1
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.array(sorted(want))
        assert conversation_trie.Parentheses(np.array(bits)).findclose(at).tolist() == [want[i] for i in at.tolist()]


@pytest.mark.parametrize("name", ["op11_collocations", "op13_conversation_trie"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(f"select {columns} from ({queries.ORACLES[name]})").fetchall(), key=str)
