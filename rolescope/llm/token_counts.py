"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted.

A pre-token starts as a linked list of its symbols. All adjacent pairs with a merge rank lie on a heap; the
lowest-rank pair, the leftmost among equals, is popped again and again, joined if both its neighbours still
stand as they were when it was pushed, and the pairs it makes with its new neighbours are pushed. The count is
the number of initial symbols minus the number of merges.

The tokenizer file's own normalizer and cutter make the pre-tokens. Where they provably never look over ASCII
white space (WORD_CUT), a text is counted as the sum of its pieces between white space, and pieces and
pre-tokens met before are looked up. The memories are bounded and only save time.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolescope.llm import common

KNOWN_MOST = 1 << 19  # pieces, and pre-tokens, remembered by a worker
KNOWN_BYTES = 64  # longer ones are not
BYTES_AT_ONCE = 1 << 20
# Fixed value: the pattern of the public tokenizer with word ends. No alternative matches white space.
WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_cuts_at = re.compile(rb"[ \t\n\v\f\r]")


class Merger:
    """Counts what the merges of a byte-pair vocabulary leave of a pre-token."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges",
                                                                "continuing_subword_prefix")):
            raise ValueError("only plain byte-pair models are counted")
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.width = max(vocabulary.values()) + 1
        self.inner = {s: i for s, i in vocabulary.items() if len(s) == 1}
        self.last = {s[:len(s) - len(suffix)]: i for s, i in vocabulary.items() if s.endswith(suffix) and len(s) == 1 + len(suffix)}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocabulary[left] * self.width + vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])

    def symbols(self, part: str) -> list[int]:
        """Ids of the characters; one that the vocabulary lacks makes no token, as in the library."""
        found = [self.inner.get(c) for c in part[:-1]] + [self.last.get(part[-1])]
        return [i for i in found if i is not None]

    def count(self, part: str) -> int:
        ids = self.symbols(part)
        return len(ids) - self.merges(ids)

    def merges(self, ids: list[int]) -> int:
        n, rank, made, width = len(ids), self.rank, self.made, self.width
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(ids[i] * width + ids[i + 1])
            if r is not None:
                heap.append(r * n + i)
        heapq.heapify(heap)
        done = 0
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or rank.get(ids[i] * width + ids[j]) != r:
                continue
            ids[i], ids[j] = made[r], -1
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = rank.get(ids[i] * width + ids[k])
                if s is not None:
                    heapq.heappush(heap, s * n + i)
            h = before[i]
            if h >= 0:
                s = rank.get(ids[h] * width + ids[i])
                if s is not None:
                    heapq.heappush(heap, s * n + h)
        return done


class _Known(dict):
    """A bounded memory of counts."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, key):
        n = self.count(key)
        if len(key) <= KNOWN_BYTES:
            if len(self) >= KNOWN_MOST:
                self.clear()
            self[key] = n
        return n


class Counter:
    """Token counts of whole texts under one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        own = Tokenizer.from_file(path)
        kind = json.loads(own.to_str())
        added = kind["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must stand for their plain strings")
        self.normalize = own.normalizer.normalize_str if own.normalizer else str
        self.cut = own.pre_tokenizer.pre_tokenize_str
        steps = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
        first = steps[0] if steps else {}
        self.by_piece = (first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_CUT} and first.get("invert")
                         and first.get("behavior") == "Removed"
                         and [(s["type"], s.get("add_prefix_space"), s.get("use_regex")) for s in steps[1:]] == [("ByteLevel", False, False)]
                         and [n["type"] for n in (kind["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"])
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.parts = _Known(Merger(kind["model"]).count)
        self.pieces = _Known(self._piece)

    def _piece(self, piece: bytes) -> int:
        """A run without ASCII white space: a word of ASCII letters, with marks behind it or not, is cut there."""
        if piece.isascii():
            text = piece.decode()
            word = text.rstrip(string.punctuation)
            if word.isalpha() and (len(word) == len(text) or self.special is None or not self.special.search(text)):
                n = self.parts[word.lower()]
                return n if len(word) == len(text) else n + self.parts[text[len(word):]]
        return self._whole(piece.decode())

    def _whole(self, text: str) -> int:
        """Special strings are a token each; what stands between them is normalized and cut on its own."""
        n, at = 0, 0
        for found in self.special.finditer(text) if self.special else ():
            n += 1 + self._plain(text[at:found.start()])
            at = found.end()
        return n + self._plain(text[at:])

    def _plain(self, text: str) -> int:
        return sum(self.parts[part] for part, _ in self.cut(self.normalize(text))) if text else 0

    def count(self, text: str) -> int:
        if not self.by_piece:
            return self._whole(text)
        raw = text.encode()
        n, at = 0, 0
        while len(raw) - at > BYTES_AT_ONCE:
            stop = _cuts_at.search(raw, at + BYTES_AT_ONCE)
            end = stop.start() if stop else len(raw)
            n += sum(map(self.pieces.__getitem__, raw[at:end].split()))
            at = end
        return n + sum(map(self.pieces.__getitem__, raw[at:].split()))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process and tokenizer file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]):
        own = counter(path)
        for batch in batches:
            n = [own.count(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(n, pa.int64())], ["_row", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """All columns, with n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens).

    Counted as the library counts without added special tokens, truncation or padding; strings of the special
    tokens inside a text count as one token each, which is its default. Null and empty texts have 0 bytes and
    0 tokens. Whole texts are counted, however long; a long one is read in stretches cut at white space.
    Repeated rows are counted alike. Columns called like the new ones are replaced. No rows in, no rows out.
    `tokenizer` is a .json file with a plain byte-pair model; other kinds raise ValueError.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    rows = docs.select(common.row(docs).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(_count(tokenizer), f"_row {kind}, n_tokens long")
    return out.select("_row.*", F.octet_length(F.coalesce(F.col("_row")[text], F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
