"""SimHash near-duplicates by a segment-popcount embedding and a grid join.

A fingerprint is mapped to the bit counts of its 2-bit segments. Flipping a bit moves one count by one, so
the Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. The 32
counts fall into `distance` + 3 groups: fingerprints within the distance agree on all counts of some three
groups, so the grid has one cell per choice of three groups and their counts, and linked fingerprints meet
in a cell. There the total counts bound the distance once more before it is verified exactly.

Equal fingerprints are one node. A cell hands out a forest, never pairs: its members are walked breadth
first, each visited once. Cells over `cell_limit` members are dealt again by the value of 16-bit blocks, of
which linked fingerprints share one. Forests of all cells are joined by alternating large-star and
small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescope.llm import common
from rolescope.llm.segments import mix

SEED = 42
SHINGLE = 3
SEGMENTS = 32  # of 2 bits
AGREEING = 3
CELL_LIMIT = 20_000
BITS_AT_ONCE = 1 << 15


def shingle_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 without hashes."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[i: i + BITS_AT_ONCE]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        found = pa.array([fingerprint(shingle_hashes(t)) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("a"), batch.column("b"), found], ["doc_id", "a", "b", "fp"])


def embedding(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the segments, a row per fingerprint."""
    pairs = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return pairs[:, ::2] + pairs[:, 1::2]


def cells(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint its cell in each choice of agreeing groups."""
    counts = embedding(fps).astype(np.uint64)
    code = np.stack([g @ (np.uint64(3) ** np.arange(g.shape[1], dtype=np.uint64))
                     for g in np.array_split(counts, distance + AGREEING, axis=1)], axis=1)
    out = []
    for i, chosen in enumerate(combinations(range(distance + AGREEING), AGREEING)):
        cell = np.full(len(fps), i + 1, np.uint64)
        for g in chosen:
            cell = mix(cell * np.uint64(0x9E3779B97F4A7C15) + code[:, g])
        out.append(cell.view(np.int64))
    return np.stack(out, axis=1)


def _to_cells(distance: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            if len(fps):
                at = cells(fps, distance)
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(np.repeat(fps, at.shape[1]))], ["cell", "fp"])
    return run


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least of its tree, member) of the links among different fingerprints.

    The unvisited ones stay ordered by their total bit count, so that a visit looks only at those whose
    total differs by the distance at most.
    """
    bits = fps.view(np.uint64)
    total = np.bitwise_count(bits)
    order = np.argsort(total, kind="stable")
    bits, total, fps = bits[order], total[order].astype(np.int64), fps[order]
    left = np.ones(len(fps), bool)
    roots, members = [], []
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        left[seed] = False
        tree, todo = [seed], [seed]
        while todo:
            at = todo.pop()
            lo, hi = np.searchsorted(total, (total[at] - distance, total[at] + distance + 1))
            near = np.flatnonzero(left[lo:hi]) + lo
            near = near[np.bitwise_count(bits[near] ^ bits[at]) <= distance]
            left[near] = False
            tree += near.tolist()
            todo += near.tolist()
        if len(tree) > 1:
            own = fps[tree]
            members.append(own[own != own.min()])
            roots.append(np.full(len(own) - 1, own.min()))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *roots]), np.concatenate([none, *members])


def _links(distance: int, limit: int | None):
    """From rows sorted by cell to edges; a cell over the limit comes out as rows (x: its cell, y, true)."""
    def of(cell: int, fps: np.ndarray):
        if limit is not None and len(fps) > limit:
            return np.full(len(fps), cell), fps, np.ones(len(fps), bool)
        x, y = forest(fps, distance)
        return x, y, np.zeros(len(x), bool)

    def run(batches: Iterator[pa.RecordBatch]):
        cell, held = None, []
        for batch in batches:
            cells, fps = batch.column("cell").to_numpy(), batch.column("fp").to_numpy()
            if not len(cells):
                continue
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            out = []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(cells)]):
                if held and cells[lo] != cell:
                    own = np.concatenate(held)
                    if len(own) > 1:
                        out.append(of(cell, own))
                    held = []
                cell = int(cells[lo])
                held.append(fps[lo:hi])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["x", "y", "again"])
        if held and len(own := np.concatenate(held)) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in of(cell, own)], ["x", "y", "again"])
    return run


def links(fps: DataFrame, distance: int, cell_limit: int) -> DataFrame:
    """(x, y): enough links among different fingerprints to connect all that are within the distance."""
    edge = "x long, y long, again boolean"

    def by_cell(rows: DataFrame, limit: int | None) -> DataFrame:
        return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(distance, limit), edge)

    found = common.written(by_cell(fps.mapInArrow(_to_cells(distance), "cell long, fp long"), cell_limit), "simhash-cells")
    blocks = F.explode(F.array(*[F.xxhash64("x", F.lit(i), F.shiftright("y", 16 * i).bitwiseAND(0xFFFF)) for i in range(distance + 1)]))
    dealt = found.where("again").select(blocks.alias("cell"), F.col("y").alias("fp"))
    return found.where("not again").select("x", "y").unionByName(by_cell(dealt, None).select("x", "y")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each linked component; nodes without links are left out."""
    edges = common.written(edges.select("x", "y").where("x <> y"), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        down = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y")
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        small = (down.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
                 .unionByName(least.select("x", F.col("m").alias("y"))).distinct())
        edges = common.written(small, "edges")
        now = tuple(edges.agg(F.count("x"), F.bit_xor(F.xxhash64("x", "y"))).first())
        if now == state:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, distance: int = 3, doc_id: str = "doc_id", text: str = "text",
                    cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(doc_id, a, b, fp, component, component_id), a row per document.

    fp is the fingerprint as a signed long; a and b tell documents apart (`common.keyed`). Fingerprints link
    at `distance` or fewer differing bits; component is the component's least fingerprint, component_id its
    least doc_id (null if all are null). Texts without words (null, empty, white space) have fingerprint 0,
    which links like any other. Repeated rows stay. No rows in, no rows out. At most 3 bits of distance.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.id_order(doc_id).alias("a"), common.text_key(text).alias("b"),
                        F.col(text).alias("text"))
    prints = common.written(keyed.mapInArrow(_fingerprints, "doc_id long, a long, b long, fp long"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), distance, cell_limit))
    rooted = (nodes.join(found, nodes["fp"] == found["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("component")))
    ids = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "component").join(ids, "component")
    return prints.join(named, "fp").select("doc_id", "a", "b", "fp", "component", "component_id")


def keep_one(docs: DataFrame, distance: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of one document per component: the one with the least id, then the least text hash."""
    found = near_duplicates(docs, distance, doc_id, text)
    kept = found.groupBy("component").agg(F.min(F.struct("a", "b")).alias("k")).select(F.col("k.a").alias("_a"), F.col("k.b").alias("_b"))
    rows = docs.select(common.row(docs).alias("_row"), common.id_order(doc_id).alias("_a"), common.text_key(text).alias("_b"))
    return rows.join(kept, ["_a", "_b"]).dropDuplicates(["_a", "_b"]).select("_row.*")
