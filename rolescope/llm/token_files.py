"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are dealt into buckets of ascending ids by quantiles of the ids; a bucket becomes `ids-<n>.bin`
(16 bits an id if the vocabulary allows, else 32, little-endian), `docs-<n>.bin` (signed 64-bit document
ids) and `offsets-<n>.bin` (unsigned 64-bit, one more than documents: the number of ids before each document
in the whole corpus). Buckets are written side by side: each knows its own count, and its base in the corpus
is the prefix sum of the counts before it, added when the offsets are written. Files get a private name and
are renamed, so a task that runs twice leaves whole files only.
"""

from __future__ import annotations

import json
import os
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolescope.llm import common

DOCS_PER_FILE = 8192
CACHE_MOST = 400_000
READ_AT_ONCE = 1 << 20
MARKS = string.punctuation


class Irregular(Exception):
    """A piece whose tokens depend on its neighbours."""


class Words(dict):
    """Ids, as bytes, of the pieces of a text between single spaces.

    A byte-level tokenizer without a normalizer cuts a text before it merges, and no cut piece reaches over
    the edge between a mark and the space behind it. So a word with its leading space or line feed has the
    same ids in every text, if neither it nor its neighbours bring more white space; such words are encoded
    once. A word of letters, with ASCII marks behind it or not, is cut by that rule; the library cuts all
    others. At most CACHE_MOST are kept.
    """

    def __init__(self, tokenizer: Tokenizer, width: str):
        super().__init__()
        self.tokenize, self.cut = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str
        self.code = "H" if width == "<u2" else "I"
        self.parts: dict[str, bytes] = {}
        self.letter = {c: self.cut(c)[0][0] for c in map(chr, range(0x250)) if c.isalpha()}
        self.space, self.feed = self.cut(" ")[0][0], self.cut("\n")[0][0]

    def __missing__(self, piece: str) -> bytes:
        body, lead = (piece[1:], "") if piece[:1] == "\n" else (piece, self.space)
        word = body.rstrip(MARKS)
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            out = self.part(lead + (word if word.isascii() else "".join(map(self.letter.__getitem__, word))))
            if len(word) < len(body):
                out += self.part(body[len(word):])
            if not lead:
                out = self.part(self.feed) + out
        elif not body or not (body[0].isalnum() or "!" <= body[0] <= "~") or not (body[-1].isalnum() or "!" <= body[-1] <= "~"):
            raise Irregular
        else:
            out = self.ids(piece if not lead else " " + piece)
        if len(self) >= CACHE_MOST:
            self.clear()
        self[piece] = out
        return out

    def part(self, part: str) -> bytes:
        """Ids of one cut piece, in the library's alphabet of bytes."""
        own = self.parts.get(part)
        if own is None:
            own = array(self.code, [t.id for t in self.tokenize(part)]).tobytes()
            if len(self.parts) >= CACHE_MOST:
                self.parts.clear()
            self.parts[part] = own
        return own

    def ids(self, text: str) -> bytes:
        return b"".join([self.part(part) for part, _ in self.cut(text)])


class Encoder:
    """Encodes whole texts without special tokens, as little-endian bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        pre = kind["pre_tokenizer"] or {}
        plain = (kind["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                 and kind["truncation"] is None and kind["padding"] is None)
        self.words = Words(self.tokenizer, self.width) if plain else None
        self.special = [t["content"] for t in kind["added_tokens"]]

    def encode(self, text: str) -> bytes:
        if self.words is not None and text and not any(s in text for s in self.special):
            first, *rest = text.replace("\n", " \n").split(" ")
            try:
                if first and not rest and first[0] != "\n":
                    return self.words.ids(first)
                if first and first[0] != "\n" and (first[-1].isalnum() or "!" <= first[-1] <= "~"):
                    return self.words.ids(first) + b"".join(map(self.words.__getitem__, rest))
            except Irregular:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A memory map of a local or mounted file; of another store, its bytes."""
    fs, root = _folder(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        empty = os.path.getsize(f"{root}/{name}") == 0
        return np.zeros(0, kind) if empty else np.memmap(f"{root}/{name}", kind, "r")
    with fs.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), kind)


class _Writer:
    """The files of one bucket; the ids go to disk as they come."""

    def __init__(self, folder: str, bucket: int):
        self.fs, self.root = _folder(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.bucket, self.mark = bucket, uuid.uuid4().hex
        self.ids = self.fs.open_output_stream(f"{self.root}/ids-{bucket}.bin.{self.mark}")
        self.docs: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc: int, raw: bytes, n: int) -> None:
        self.ids.write(raw)
        self.docs.append(doc)
        self.sizes.append(n)

    def put(self, name: str, values: np.ndarray) -> None:
        with self.fs.open_output_stream(f"{self.root}/{name}.{self.mark}") as f:
            f.write(values.tobytes())
        self.fs.move(f"{self.root}/{name}.{self.mark}", f"{self.root}/{name}")

    def close(self) -> tuple[int, int, int]:
        self.ids.close()
        name = f"{self.root}/ids-{self.bucket}.bin"
        self.fs.move(f"{name}.{self.mark}", name)
        self.put(f"docs-{self.bucket}.bin", np.array(self.docs, "<i8"))
        self.put(f"sizes-{self.bucket}.bin", np.array(self.sizes, "<u8"))
        return self.bucket, len(self.docs), int(sum(self.sizes))


def _encode(path: str, end_id: int, bounds):
    def run(batches: Iterator[pa.RecordBatch]):
        own = encoder(path)
        end = np.array([end_id], own.width).tobytes()
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("a").to_numpy()
            raw = (pack.compress(own.encode(t) + end) for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(bounds.value, ids, "left"), pa.int32()), batch.column("a"), batch.column("b"),
                 pa.array(list(raw), pa.binary())], ["bucket", "a", "b", "ids"])
    return run


def _write(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        """Rows come sorted by bucket and document."""
        writer, done = None, []
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bucket, doc, ids in zip(batch.column("bucket").to_pylist(), batch.column("a").to_pylist(), batch.column("ids")):
                if writer is None or writer.bucket != bucket:
                    if writer is not None:
                        done.append(writer.close())
                    writer = _Writer(folder, bucket)
                raw = unpack.decompress(ids.as_py())
                writer.add(doc, raw, len(raw) // width)
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)], ["bucket", "n_docs", "n_ids"])
    return run


def _offsets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for bucket, base in zip(batch.column("bucket").to_pylist(), batch.column("base").to_pylist()):
                fs, root = _folder(folder)
                sizes = _mapped(folder, f"sizes-{bucket}.bin", "<u8")
                name, mark = f"{root}/offsets-{bucket}.bin", uuid.uuid4().hex
                with fs.open_output_stream(f"{name}.{mark}") as f:
                    f.write((np.append(0, np.cumsum(sizes)).astype("<u8") + np.uint64(base)).tobytes())
                fs.move(f"{name}.{mark}", name)
            yield batch
    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text",
                 docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Write all documents in ascending id order, null ids last, equal ids by their texts' hashes; return the manifest.

    The manifest (bucket, n_docs, n_ids, base, width) names the files in `folder`, which all executors must
    share. Null texts are empty; every document ends with `end_id`. Rows that share an id all share a bucket.
    No rows in: no files, an empty manifest.
    """
    spark = docs.sparkSession
    keyed = common.keyed(docs, doc_id, text)
    n = keyed.count()
    n_files = max(1, -(-n // docs_per_file))
    shares = [i / n_files for i in range(1, n_files)]
    found = keyed.select(F.percentile_approx("a", shares, 20 * n_files).alias("q")).first().q if shares and n else []
    bounds = np.unique(np.array(found, np.int64))
    width = np.dtype(encoder(tokenizer).width).itemsize
    rows = keyed.mapInArrow(_encode(tokenizer, end_id, spark.sparkContext.broadcast(bounds)), "bucket int, a long, b long, ids binary")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "a", "b")
    counts = common.written(dealt.mapInArrow(_write(folder, width), "bucket long, n_docs long, n_ids long"), "token-counts")
    counted = sorted(counts.collect())  # a row per file
    bases = np.cumsum([0, *(r.n_ids for r in counted)])
    manifest = spark.createDataFrame([(*r, int(b), width) for r, b in zip(counted, bases)],
                                     "bucket long, n_docs long, n_ids long, base long, width int")
    each = manifest.repartition(max(1, len(counted)), "bucket") if counted else manifest
    return common.written(each.mapInArrow(_offsets(folder), manifest.schema), "token-manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for bucket, width in zip(batch.column("bucket").to_pylist(), batch.column("width").to_pylist()):
                ids = _mapped(folder, f"ids-{bucket}.bin", f"<u{width}")
                docs = _mapped(folder, f"docs-{bucket}.bin", "<i8")
                offsets = _mapped(folder, f"offsets-{bucket}.bin", "<u8").astype(np.int64)
                lo, hi = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
                crc = []
                for p, q in zip(lo.tolist(), hi.tolist()):
                    own = 0
                    for i in range(p, q, READ_AT_ONCE):
                        own = zlib.crc32(ids[i: min(q, i + READ_AT_ONCE)].astype("<u4").tobytes(), own)
                    crc.append(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == common.NO_ID), pa.array(offsets[:-1]), pa.array(hi - lo), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; files are read side by side."""
    return (manifest.repartition(max(1, manifest.count()), "bucket")
            .mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def folder_for(spark: SparkSession) -> str:
    return common.scratch_path(spark, "tokens")
